"""Near-duplicate documents by a Chosen-Path set similarity join.

Every document is its set of 5-word shingles.  Equal sets are one class.  Class
representatives walk down independent trees: a node branches by a few minwise
tokens, and a class follows those that it has, so that classes of similarity s
stay together at a level with probability 1 - (1 - s)**BRANCHES.  Small nodes
are compared exhaustively; so are large ones in which all but a few members are
already linked to one another.  What the trees propose is checked on the full shingle sets
of the texts' own words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.words import MinHasher, link_forest, linked_pairs, mix64, shingle_hashes, slices, word_hashes
from sigloom.llm.workspace import Workspace, components, hot_join, tidy

SHINGLE = 5
PERCENT = 75  # 100 * intersection >= PERCENT * union
TREES = 3
BRANCHES = 3
TOKENS = 64  # minwise tokens of a set
LEAF = 8  # members up to which a node's pairs are listed
#: Nodes up to these bounds (members, shingles in all) are compared exhaustively in one task.
NODE_MEMBERS, NODE_SHINGLES = 4096, 4_000_000
PIVOTS = 4  # larger nodes are linked to a few members first
DEPTH = 12
#: Deeper levels branch by several tokens at once: a pair at the threshold stays together in
#: one of the branches with a probability of 1 - (1 - .75**3)**12 = .9985, dissimilar ones part.
DEEP_TOKENS, DEEP_BRANCHES = 3, 12
#: Agreements of TOKENS below which a pair cannot matter: a pair at the threshold has fewer
#: with a probability of 4e-6.
AGREE = 32
PARTS = 3  # in which texts are dealt out one after the other, to bound the disk
PART_BYTES = 2 << 20  # of text that pairs are compared in at once


def signatures(docs: DataFrame, shingle: int = SHINGLE, tokens: int = TOKENS) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest (k1, k2) of the set and its minwise tokens."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHasher(tokens)
        for batch in batches:
            n, k1, k2, sig = [], [], [], []
            for _, _, data, off in slices(batch.column(1)):
                words, _, _, first = word_hashes(data, off)
                for hashes in shingle_hashes(words, first, shingle):
                    own = np.unique(hashes)
                    n.append(len(own))
                    k1.append(int(mix64(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                    k2.append(int(mix64(own + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64).astype(np.int64)))
                    sig.append(minhash(own).astype(np.int32) if len(own) else np.zeros(0, np.int32))
            flat = pa.array(np.concatenate(sig) if sig else np.zeros(0, np.int32), pa.int32())
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sig])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(k1, pa.int64()),
                    pa.array(k2, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), flat),
                ],
                ["doc_id", "n_shingles", "k1", "k2", "sig"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, k1 long, k2 long, sig array<int>")


def _dealt(table: DataFrame) -> DataFrame:
    """``table`` as a side of a join that grows with the input: both sides are dealt out at every size.

    A broadcast that fits small inputs only would make their shuffles, and what is projected
    from them, less than what large inputs need.
    """
    return table.hint("merge")


def _agreement(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a < b) whose sizes allow the threshold and whose minwise tokens make it likely."""
    side = reps.select("id", "n", "sig")
    return (
        pairs.join(_dealt(side.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))), "a")
        .join(_dealt(side.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))), "b")
        .where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
        .where(_agreement(F.col("sa"), F.col("sb")) >= AGREE)
        .select("a", "b")
    )


def _leaf_pairs(members: DataFrame) -> DataFrame:
    """All pairs within nodes of at most LEAF members (``members(node, id)``), each once, dealt out by ``a``."""
    sets = members.groupBy("node").agg(F.sort_array(F.collect_set("id")).alias("ids")).select("ids")
    rest = F.transform(
        F.col("ids"),
        lambda x, i: F.transform(F.slice(F.col("ids"), i + 2, F.size("ids")), lambda y: F.struct(x.alias("a"), y.alias("b"))),
    )
    # one shuffle serves the pairs' repeats and what is joined to ``a``, which has few partners in a node
    return sets.select(F.explode(F.flatten(rest)).alias("p")).select("p.a", "p.b").repartition("a").distinct()


def verify(pairs: DataFrame, docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of document ids that are linked by their full shingle sets."""
    texts = docs.select("doc_id", "text")
    both = pairs.join(_dealt(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))), "b").join(
        _dealt(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))), "a"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(3)])
            at = 0
            while at < batch.num_rows:
                # a part has some megabytes of text, or one pair
                end = int(np.searchsorted(size, (size[at - 1] if at else 0) + PART_BYTES, "right"))
                part = batch.slice(at, max(end - at, 1))
                at += part.num_rows
                # rows come sorted by a: its text is taken once for each run of rows
                ids = part.column(0).to_pylist()
                new = np.array([i == 0 or x != ids[i - 1] for i, x in enumerate(ids)])
                firsts = part.column(2).take(pa.array(np.flatnonzero(new)))
                yield part.select([0, 1]).filter(pa.array(linked_pairs(firsts, part.column(3), np.cumsum(new) - 1, percent, shingle)))

    kind = dict(docs.dtypes)["doc_id"]
    return both.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}")


def _sized(members: DataFrame) -> DataFrame:
    """members with their node's size; nodes of one member are gone."""
    return members.join(_dealt(members.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")), "node")


def link(reps: DataFrame, docs: DataFrame, work: Workspace) -> DataFrame:
    """Links (src, dst) that connect the classes ``reps(id, n, sig)`` as all true links do.

    Links inside what is connected already are not looked for.
    """
    branches = [
        F.xxhash64(F.lit(tree), F.lit(k), F.element_at("sig", tree * BRANCHES + k + 1)) for tree in range(TREES) for k in range(BRANCHES)
    ]
    nodes = work.save(_sized(reps.select("id", "n", F.explode(F.array(*branches)).alias("node"))), "nodes")
    candidates = work.save(_likely(_leaf_pairs(nodes.where(F.col("size") <= LEAF)), reps), "pairs")
    large = nodes.where(F.col("size") > LEAF)
    # all later comparisons are among these; their texts are dealt out once
    involved = candidates.select(F.col("a").alias("doc_id")).unionByName(candidates.select(F.col("b").alias("doc_id")))
    involved = involved.unionByName(large.select(F.col("id").alias("doc_id")))
    dealt, own = [], F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(PARTS))
    for part in range(PARTS):
        here = docs.where(own == part).select("doc_id", "text")
        dealt.append(work.save(here.join(_dealt(involved.where(own == part).distinct()), "doc_id"), "texts"))
        tidy()
    docs = reduce(DataFrame.unionByName, dealt)
    stars = candidates.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    pending, depth = [candidates], 0
    first = stars.unionByName(_likely(_pivots(large, depth), reps)).distinct()
    edges = work.save(verify(first, docs).select(F.col("a").alias("src"), F.col("b").alias("dst")), "links")
    tidy()
    labels = work.save(components(work, edges), "labels")
    while not large.isEmpty():
        depth += 1
        states, named = _states(large, labels, work)
        fits = (F.col("size") <= NODE_MEMBERS) & (F.col("shingles") <= NODE_SHINGLES)
        exact = named.join(states.where(fits).select("node"), "node")
        found = work.save(_compare_nodes(exact, reps, docs, work), "links")
        tidy()
        edges = work.save(edges.unionByName(found), "links")
        labels = work.save(components(work, edges), "labels")
        big = named.join(states.where(~fits).select("node"), "node")
        if big.isEmpty():
            break
        if depth > DEPTH:
            # tokens do not part these: their members meet block by block, in tasks of bounded size
            big = named.join(states.where(~fits).select("node", "size", "shingles"), "node")
            found = work.save(_compare_nodes(_blocks(big), reps, docs, work), "links")
            edges = work.save(edges.unionByName(found), "links")
            labels = work.save(components(work, edges), "labels")
            break
        children = big.select("node", "id").join(reps.select("id", "sig", "n"), "id").select("id", "n", F.explode(_deep_nodes()).alias("node"))
        nodes = work.save(_sized(children), "nodes")
        pending.append(work.save(_likely(_cross(_leaf_pairs(nodes.where(F.col("size") <= LEAF)), labels), reps), "pairs"))
        tidy()
        large = nodes.where(F.col("size") > LEAF)
        more = _cross(_likely(_pivots(large, depth), reps), labels)
        if not more.isEmpty():
            more = verify(more, docs).select(F.col("a").alias("src"), F.col("b").alias("dst"))
            edges = work.save(edges.unionByName(more), "links")
            tidy()
            labels = work.save(components(work, edges), "labels")
        del more
        tidy()
    rest = pending[0]
    for more in pending[1:]:
        rest = rest.unionByName(more)
    rest = work.save(_cross(rest.distinct(), labels), "rest")
    tidy()
    if rest.isEmpty():
        return edges
    last = work.save(verify(rest, docs).select(F.col("a").alias("src"), F.col("b").alias("dst")), "links")
    tidy()
    return edges.unionByName(last)


def _states(large: DataFrame, labels: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(node, size, shingles) of nodes with unconnected members, one of those that have the same, and all nodes' members."""
    named = work.save(
        large.join(_dealt(labels.select("id", "component_id")), "id", "left").select("node", "id", "n", F.coalesce("component_id", "id").alias("label")),
        "named",
    )
    states = named.groupBy("node").agg(
        F.count(F.lit(1)).alias("size"),
        F.sum("n").alias("shingles"),
        F.min("label").alias("lo"),
        F.max("label").alias("hi"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("members"),
    )
    states = states.where("lo <> hi").groupBy("members", "size").agg(F.min("node").alias("node"), F.first("shingles").alias("shingles"))
    return work.save(states.select("node", "size", "shingles"), "states"), named


def _compare_nodes(members: DataFrame, reps: DataFrame, docs: DataFrame, work: Workspace) -> DataFrame:
    """Links that connect ``members(node, id, label)`` of bounded nodes as all true links do.

    Minwise tokens first say which members have a likely partner of another
    label; the shingle sets of those are then compared exactly.
    """
    kind = dict(docs.dtypes)["doc_id"]
    sketched = members.select("node", "id", "label").join(_dealt(reps.select("id", "n", "sig")), "id")
    likely = sketched.groupBy("node").applyInArrow(_likely_members, f"node long, id {kind}, label {kind}")
    likely = work.save(likely, "likely")
    tidy()
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(_dealt(likely.select("id").distinct()), "id")
    return likely.join(_dealt(texts), "id").select("node", "id", "label", "text").groupBy("node").applyInArrow(_link_members, f"src {kind}, dst {kind}")


def _likely_members(table: pa.Table) -> pa.Table:
    label = table["label"].to_numpy()
    n = table["n"].to_numpy()
    sig = np.stack(table["sig"].to_pylist()).astype(np.int32)
    keep = np.zeros(len(n), bool)
    for i in range(len(n)):
        fits = (100 * np.minimum(n, n[i]) >= PERCENT * np.maximum(n, n[i])) & (label != label[i])
        at = np.flatnonzero(fits)
        keep[i] = bool(len(at)) and bool(((sig[at] == sig[i]).sum(axis=1) >= AGREE).any())
    return table.select(["node", "id", "label"]).filter(pa.array(keep))


def _link_members(table: pa.Table) -> pa.Table:
    """Exact comparison of all members of a node; a forest of links is returned."""
    kind = table.schema.field("id").type
    src, dst = link_forest(table["text"], table["label"].to_numpy(), PERCENT)
    ids = table["id"].combine_chunks()
    return pa.table({"src": ids.take(pa.array(src, pa.int64())).cast(kind), "dst": ids.take(pa.array(dst, pa.int64())).cast(kind)})


def _blocks(big: DataFrame) -> DataFrame:
    """``big(node, id, label, size, shingles)`` dealt to pairs of blocks of half a node's bounds each, so that all members meet."""
    weight = F.greatest(F.col("size") / NODE_MEMBERS, F.col("shingles") / NODE_SHINGLES)
    dealt = big.withColumn("blocks", F.ceil(2 * weight).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "id"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("own <> other")
    return met.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "id", "label")


def _deep_nodes() -> Column:
    """A class's nodes below ``node``: it follows every branch, named by its own tokens there."""

    def token(k: int, j: int) -> Column:
        return F.element_at("sig", F.pmod(F.xxhash64("node", F.lit(k), F.lit(j)), F.lit(TOKENS)).cast("int") + 1)

    return F.array(*[F.xxhash64("node", F.lit(k), *[token(k, j) for j in range(DEEP_TOKENS)]) for k in range(DEEP_BRANCHES)])


def _cross(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are not yet connected."""
    return (
        pairs.join(_dealt(labels.select(F.col("id").alias("a"), F.col("component_id").alias("ca"))), "a", "left")
        .join(_dealt(labels.select(F.col("id").alias("b"), F.col("component_id").alias("cb"))), "b", "left")
        .where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        .select("a", "b")
    )


def _pivots(large: DataFrame, depth: int) -> DataFrame:
    """Pairs of each member with its node's pivots, a few members chosen by hash, in nodes
    that are too large to be compared at once."""
    large = large.where((F.col("size") > NODE_MEMBERS))
    chosen = large.groupBy("node").agg(
        F.array(*[F.min(F.struct(F.xxhash64(F.lit(depth), F.lit(k), "id").alias("h"), "id"))["id"] for k in range(PIVOTS)]).alias("pivots")
    )
    return (
        large.select("node", "id")
        .join(chosen, "node")
        .select("id", F.explode("pivots").alias("pivot"))
        .where("id <> pivot")
        .select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Near-duplicate groups of ``docs(doc_id, text)``, one result row for each row.

    Returns doc_id, n_shingles (size of the row's shingle set), component_id (the
    smallest doc_id reachable over links, itself included) and kept (whether that
    is the row's own).  Documents are linked when 100 * intersection >= 75 * union
    of their distinct 5-word shingles over lower-cased (A-Z) words; a text of fewer
    words is one shingle, one without words has none and is linked with nothing, as
    is a null text.  Rows without doc_id are linked with nothing and have no
    component_id; they are kept.  Rows that share a doc_id are one document with
    several texts.  Other columns are ignored; an empty table gives an empty one.
    """
    work = Workspace(docs.sparkSession, "near-dup")
    sigs = work.save(signatures(docs), "signatures")
    reps = (
        sigs.where("doc_id is not null and n_shingles > 0")
        .groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies"))
    )
    reps = work.save(reps, "classes")
    # a doc_id with several texts joins their classes
    shared = sigs.where("n_shingles > 0").groupBy("doc_id").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo <> hi")
    twins = (
        sigs.join(shared.select("doc_id"), "doc_id")
        .join(reps.select("k1", "k2", "id"), ["k1", "k2"])
        .select(F.col("doc_id").alias("src"), F.col("id").alias("dst"))
    )
    edges = link(reps.drop("copies"), docs.where("doc_id is not null"), work).unionByName(twins)
    groups = components(work, edges)
    classes = (
        reps.select("k1", "k2", "id", "copies")
        .join(_dealt(groups), "id", "left")
        .select("k1", "k2", F.coalesce("component_id", "id").alias("component_id"), "copies")
    )
    classes = work.save(classes, "components")
    body = sigs.select("doc_id", "n_shingles", "k1", "k2")
    full = body.where("n_shingles > 0 and doc_id is not null")
    out = hot_join(full, classes, ["k1", "k2"], "copies", full.count())
    alone = body.where("n_shingles = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    return (
        out.unionByName(alone)
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )
