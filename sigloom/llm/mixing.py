"""Mixing sources to target weights by Pareto order sampling, natively.

Every document of a source first gets ``floor(target / source size)`` certain whole
copies.  What is left of the target is drawn as one more copy of some documents, with
inclusion probabilities in proportion to their sizes, ``p = min(1, c * size)``, where
``c`` makes the expected words those that are left.  Documents are ranked by the Pareto
order variable ``(u / (1 - u)) / (p / (1 - p))`` with u a fixed hash of the document,
and taken in that order while the source's remaining words hold them (the sample's
size is fixed in words, the unit of the targets); the last place goes to the document
whose size comes nearest to what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigloom.workspace import Workspace

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"  # with what parts it from the next
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
BUCKETS = 1 << 16


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null.

    Each word is replaced by one letter: ``regexp_count`` makes strings of all words of a
    text at once, whose garbage fills an executor's whole heap on large inputs.
    """
    return F.coalesce(F.length(F.ltrim(F.regexp_replace(text, WORD, "x"), F.lit(SPACE))), F.lit(0)).cast("long")


def uniform(key: Column, seed: str = "") -> Column:
    """A fixed pseudo-random number in (0, 1) for a text."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), key).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**12))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Targets in words for ``sizes(source, source_size)``, one row per source.

    Sources are ranked by code point with null last and weigh ``weights`` in turn.
    All words are shared by weight; no target exceeds ``max_repeat`` times its
    source, and what it would exceed goes to the others by weight.  The table has
    one row per source, so its windows are over source totals, not documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("weight", cycle).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    everything = W.partitionBy()
    by_fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
    )
    # Sources whose cap lies below the level at their own place are full.  From the first that
    # is not, the level only falls, so that source's level, the largest, holds for all after it.
    full = F.col("cap") <= F.col("level") * F.col("weight")
    level = F.max(F.when(~full, F.col("level"))).over(everything)
    return (
        filled.withColumn("final", level)
        .withColumn("target", F.when(full | F.col("final").isNull(), F.col("cap")).otherwise(F.col("final") * F.col("weight")))
        .select("source", "source_size", "target")
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    seed: str = "",
    text: str = "text",
) -> DataFrame:
    """How many words the mix takes of each row of ``docs(doc_id, source, text)``.

    Returns doc_id, source, size, source_size, target, copies and taken
    (``copies * size``).  Null texts and texts without words have size 0 and are
    taken 0 times; a null source is a source of its own, last in order; null and
    repeated ids are allowed.  Equal rows are separate documents that are told apart
    by their number among each other, so that each has a place of its own in the
    order.  Other columns are ignored and an empty table gives an empty one.  Reruns
    agree: the only randomness is a hash of doc_id, text and that number.

    The order within a source is a cumulative sum over 65,536 slices of it,
    aggregated before any shuffle; only the one slice in which a source's words run
    out is ranked row by row.
    """
    work = Workspace(docs.sparkSession, "mix")
    body = F.coalesce(F.col(text), F.lit(""))
    sized = work.save(docs.select("doc_id", "source", word_count(F.col(text)).alias("size"), F.md5(body.cast("binary")).alias("digest")), "sizes")
    sized = _numbered(sized, work)
    u = uniform(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "digest", "number"), seed)
    kinds = work.save(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "kinds")
    words = (F.col("n") * F.col("size")).cast("decimal(38,0)")
    totals = kinds.groupBy("source").agg(F.sum(words).cast("long").alias("source_size"))
    targets = source_targets(totals, weights, max_repeat)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("certain", F.least(whole, F.lit(max_repeat)).cast("long")).withColumn(
        "extra", F.col("target") - F.col("certain") * F.col("source_size")
    )
    targets = work.save(targets.withColumn("source_key", _key("source")), "targets")
    targets = work.save(targets.drop("source").join(_scales(kinds, targets), "source_key", "left"), "scaled")
    rows = sized.withColumn("source_key", _key("source"))
    rows = rows.join(F.broadcast(targets) if _few(targets) else targets, "source_key").withColumn("u", u)
    p = F.least(F.lit(1.0), F.col("size") * F.coalesce("scale", F.lit(0.0)))
    rows = rows.withColumn("order", pareto_order(F.col("u"), p))
    # slices of the order's logarithm hold few rows each, whatever the probabilities are
    place = F.when(F.col("order") == float("inf"), F.lit(1.0)).when(F.col("order") == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log("order") + F.lit(40.0)) / F.lit(80.0)))
    )
    base = work.save(rows.drop("scale").withColumn("slice", F.least((place * BUCKETS).cast("int"), F.lit(BUCKETS - 1))), "ordered")
    slices = base.groupBy("source_key", "slice").agg(F.sum("size").alias("slice_size"))
    upto = W.partitionBy("source_key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    plan = (
        slices.withColumn("words_before", F.coalesce(F.sum("slice_size").over(upto), F.lit(0)))
        .join(targets.select("source_key", "extra"), "source_key")
        .withColumn("left", F.col("extra") - F.col("words_before"))
        .where(F.col("slice_size") > F.col("left"))
    )
    # One row per source: the first slice that its extra words do not fill.
    edge = plan.groupBy("source_key").agg(F.min("slice").alias("edge_slice"), F.min_by("left", "slice").alias("edge_left"))
    edge = work.save(edge, "edges")
    rows = base.join(F.broadcast(edge) if _few(edge) else edge, "source_key", "left")
    # Slices before the edge are in; a source has no edge only if its extra words take all.
    rows = rows.withColumn("inside", F.coalesce(F.col("slice") < F.col("edge_slice"), F.col("edge_slice").isNull()))
    at_edge = F.coalesce(F.col("slice") == F.col("edge_slice"), F.lit(False)) & (F.col("size") > 0)
    running = W.partitionBy("source_key").orderBy(*_ORDER)
    ranked = (
        rows.where(at_edge)
        .withColumn("run", F.sum("size").over(running.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("inside", F.col("run") <= F.col("edge_left"))
    )
    placed = work.save(rows.where(~at_edge).withColumn("run", F.lit(None).cast("long")).unionByName(ranked), "placed")
    # The sample's last place goes to the document that comes nearest to the words still left.
    gap = F.max("edge_left") - F.coalesce(F.max(F.when(F.col("inside"), F.col("run"))), F.lit(0))
    gaps = placed.groupBy("source_key").agg(gap.alias("gap"))
    open_rows = placed.where("not inside and size > 0").join(F.broadcast(gaps) if _few(gaps) else gaps, "source_key")
    off = F.abs(F.col("size") - F.col("gap"))
    last = (
        open_rows.where(off < F.col("gap"))
        .groupBy("source_key")
        .agg(F.min(F.struct(off.alias("off"), *_ORDER[:4])).alias("x"))
        .select("source_key", F.struct(*[F.col(f"x.{c}") for c in _ORDER[:4]]).alias("last"))
    )
    done = placed.join(F.broadcast(last) if _few(last) else last, "source_key", "left")
    is_last = F.col("last").isNotNull()
    for c in _ORDER[:4]:
        is_last = is_last & F.col(c).eqNullSafe(F.col(f"last.{c}"))
    done = done.withColumn("inside", F.col("inside") | F.coalesce(is_last, F.lit(False)))
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(
        F.least(F.col("certain") + F.col("inside").cast("long"), F.lit(max_repeat))
    ).cast("long")
    return done.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


#: The order within a source; the first four name a row, its source given.
_ORDER = ["order", "doc_id", "digest", "number", "size"]


def _numbered(sized: DataFrame, work: Workspace) -> DataFrame:
    """``sized`` with each row's number among its equals, 0 for rows that have none.

    Equal rows are numbered within the parts of the table that they stand in and the
    parts' counts are added up, so that no group of copies meets in one task.
    """
    same = ["source", "doc_id", "digest"]
    part = sized.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33))
    counts = part.groupBy(*same, "part").agg(F.count(F.lit(1)).alias("n"))
    many = counts.groupBy(*same).agg(F.sum("n").alias("all")).where("all > 1").select(*same)
    many = work.save(many, "copies")
    if many.isEmpty():
        return sized.withColumn("number", F.lit(0).cast("long"))
    tag = F.xxhash64(*same)
    before = F.coalesce(F.sum("n").over(W.partitionBy(*same).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    equal = _null_safe(counts, many, same).withColumn("before", before)
    copied = _null_safe(part, equal.select(*same, "part", "before"), [*same, "part"])
    inner = F.row_number().over(W.partitionBy(*same, "part").orderBy("at")) - 1
    numbers = copied.select("at", (F.col("before") + inner).alias("number"), tag.alias("tag"))
    out = part.join(numbers.select("at", "number"), "at", "left")
    return work.save(out.select(*sized.columns, F.coalesce("number", F.lit(0).cast("long")).alias("number")), "numbered")


def _null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``left`` joined with ``right`` on columns in which null is a value."""
    other = right.withColumnsRenamed({c: f"other_{c}" for c in on})
    match = F.lit(True)
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"other_{c}"))
    return left.join(other, match).drop(*[f"other_{c}" for c in on])


def _scales(kinds: DataFrame, targets: DataFrame) -> DataFrame:
    """(source_key, scale): c with ``sum of min(1, c * size) * size`` over a source's rows equal to its extra words.

    Rows of the largest sizes are certain where c * size would exceed 1; the windows are
    over a source's distinct sizes, not its documents.
    """
    sizes = kinds.where("size > 0").withColumn("source_key", _key("source")).join(targets.select("source_key", "extra"), "source_key")
    words = (F.col("n") * F.col("size")).cast("decimal(38,0)")
    square = words * F.col("size").cast("decimal(19,0)")
    larger = W.partitionBy("source_key").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)
    own = W.partitionBy("source_key").orderBy("size").rowsBetween(W.unboundedPreceding, 0)
    certain = F.coalesce(F.sum(words).over(larger), F.lit(0)).cast("double")
    scale = (F.col("extra") - certain) / F.sum(square.cast("decimal(38,0)")).over(own).cast("double")
    # sizes above this one are certain; that holds for the largest size that is not certain itself
    tried = sizes.withColumn("scale", scale).where(F.col("scale") * F.col("size") < 1)
    return tried.groupBy("source_key").agg(F.greatest(F.max_by("scale", "size"), F.lit(0.0)).alias("scale"))


def pareto_order(u: Column, p: Column) -> Column:
    """Random odds divided by inclusion odds: 0 for what is certain, infinite for what is never drawn."""
    odds = u / (F.lit(1.0) - u)
    return F.when(p >= 1, F.lit(0.0)).when(p <= 0, F.lit(float("inf"))).otherwise(odds / (p / (F.lit(1.0) - p)))


def _key(source: str) -> Column:
    """A join key in which null is a value and clashes with no text."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def _few(per_source: DataFrame, most: int = 100_000) -> bool:
    """Whether the table of sources is small enough to send to every executor."""
    return per_source.limit(most + 1).count() <= most
