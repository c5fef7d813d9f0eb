"""Exact removal of repeated substrings by prefix-free parsing.

A position is a trigger when the rolling hash of the WIDTH bytes there is least
among its RADIUS neighbours on either side; triggers cut every text into phrases
that depend on nothing but the bytes near them.  Two equal strings of LENGTH
bytes therefore hold the same phrases, and the corpus order of suffixes down to
LENGTH bytes follows from the dictionary of phrases and their contexts:

1. phrases are counted over the corpus; no repeated string holds a phrase that
   occurs once;
2. contexts (the bytes of all LENGTH-strings that start between two triggers) are
   counted; where one repeats, all its strings do;
3. only the strings that are left, at the edges of repeats, are looked up one by
   one among each other and among one copy of each repeated context.

Everything is keyed by 64-bit fingerprints of the bytes and counted with map-side
combination, so no phrase, however frequent, meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.words import mix64, prefix_hash, slices, span_hash
from sigloom.llm.workspace import Workspace, fresh, keyed_rows, quoted, tidy

LENGTH = 200
WIDTH = 16
RADIUS = 16
LOOKUPS = 3  # parts in which the strings are looked up one after the other, to bound the disk


class Parse:
    """Triggers and prefix hashes of a slice of texts."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.prefix = prefix_hash(data, lower=False)
        at = np.arange(max(len(data) - WIDTH + 1, 0))
        hashes = mix64(span_hash(self.prefix, at, at + WIDTH))
        window, span = 2 * RADIUS + 1, 1
        least = hashes
        while span * 2 <= window and len(least) > span:
            least, span = np.minimum(least[:-span], least[span:]), span * 2
        rest = window - span
        least = np.minimum(least[: len(least) - rest], least[rest:]) if len(least) > rest else least[:0]
        trigger = np.flatnonzero(hashes[RADIUS : RADIUS + len(least)] == least) + RADIUS
        row = np.searchsorted(off, trigger, "right") - 1
        inside = (trigger - RADIUS >= off[row]) & (trigger + RADIUS + WIDTH <= off[row + 1])
        self.triggers = trigger[inside]
        self.first = np.searchsorted(self.triggers, off)
        self.off = off

    def row(self, k: int) -> tuple[int, int, np.ndarray]:
        """(start, end, triggers) of a row, as positions in the slice."""
        return int(self.off[k]), int(self.off[k + 1]), self.triggers[self.first[k] : self.first[k + 1]]

    def groups(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, number in the row, phrase, context) of all groups of all rows that hold a string:
        the strings that start before a row's first trigger, between two triggers, or behind the
        last.  Phrase 0: not a whole phrase."""
        size = np.diff(self.off)
        count = np.diff(self.first)
        rows = np.flatnonzero(size >= length)
        many = count[rows] + 1
        head = np.cumsum(many) - many
        row = np.repeat(rows, many)
        number = np.arange(int(many.sum())) - np.repeat(head, many)
        place = self.first[row] + number  # of the trigger that ends the group
        last = number == np.repeat(many, many) - 1
        bounded = np.append(self.triggers, 0)
        begin = np.where(number == 0, self.off[row], bounded[np.maximum(place - 1, 0)])
        stop = np.where(last, self.off[row + 1], bounded[place])
        phrase = np.zeros(len(row), np.uint64)
        whole = (number > 0) & ~last
        phrase[whole] = mix64(span_hash(self.prefix, begin[whole], stop[whole] + WIDTH)) | np.uint64(1)
        context = mix64(span_hash(self.prefix, begin, np.minimum(self.off[row + 1], stop - 1 + length)))
        return row, number, phrase, context


def _parses(column: pa.Array, length: int) -> Iterator[tuple[int, Parse, int]]:
    """(row of the batch, parse, row of the parse) of all rows that hold a string."""
    for first, end, data, off in slices(column):
        if int(np.diff(off).max()) < length:
            continue
        parse = Parse(data, off)
        for k in range(end - first):
            if off[k + 1] - off[k] >= length:
                yield first + k, parse, k


def _phrases(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for first, _, data, off in slices(batch.column(1)):
                row, number, phrase, context = Parse(data, off).groups(length)
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(phrase.view(np.int64)), pa.array(context.view(np.int64)), pa.array(keys[first + row]), pa.array(number.astype(np.int32))],
                        ["phrase", "context", "k", "i"],
                    )

    return docs.mapInArrow(run, "phrase long, context long, k long, i int")


def _strings(marked: DataFrame, length: int) -> DataFrame:
    """From (k, text, marks): single strings to look up, strings to be found, whole repeated runs.

    kind 0: string ``fp`` starts at ``a`` of row k and is looked up; kind 1: a repeated
    context has string ``fp``; kind 2: all strings that start at a .. b of row k repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            marks = batch.column(2).to_pylist()
            out: list[tuple] = []
            size = 0
            for at, parse, k in _parses(batch.column(1), length):
                start, end, triggers = parse.row(k)
                own = np.array(marks[at] or [], np.int64)
                groups = len(triggers) + 1
                repeated, full, chosen = (np.zeros(groups, bool) for _ in range(3))
                repeated[[0, groups - 1]] = True
                repeated[own >> 2] = True
                full[own[own & 2 > 0] >> 2] = True
                chosen[own[own & 1 > 0] >> 2] = True
                starts = end - length + 1 - start
                bounds = np.clip(np.concatenate([[0], triggers - start, [starts]]), 0, starts)
                group = np.repeat(np.arange(groups), np.diff(bounds))
                # strings that hold a phrase that occurs once
                once = np.zeros(starts + 1, np.int64)
                if groups > 2:
                    single = ~repeated[1:-1]
                    low = np.maximum(triggers[1:] + WIDTH + RADIUS - length - start, 0)[single]
                    high = np.minimum(triggers[:-1] - RADIUS - start, starts - 1)[single]
                    some = low <= high
                    np.add.at(once, low[some], 1)
                    np.add.at(once, high[some] + 1, -1)
                possible = np.cumsum(once[:-1]) == 0
                look = np.flatnonzero(possible & ~full[group])
                give = np.flatnonzero(chosen[group])
                edge = np.flatnonzero(np.diff(np.concatenate([[0], full[group].astype(np.int8), [0]])))
                for kind, p in ((0, look), (1, give)):
                    if len(p):
                        fp = mix64(span_hash(parse.prefix, start + p, start + p + length))
                        out.append((np.full(len(p), kind, np.int8), fp, np.full(len(p), keys[at] if kind == 0 else 0), p if kind == 0 else p * 0, p * 0))
                if len(edge):
                    a, b = edge[::2], edge[1::2] - 1
                    out.append((np.full(len(a), 2, np.int8), np.zeros(len(a), np.uint64), np.full(len(a), keys[at]), a, b))
                size += len(look) + len(give) + len(edge)
                if size > 200_000:
                    yield _string_batch(out)
                    out, size = [], 0
            if out:
                yield _string_batch(out)

    return marked.mapInArrow(run, "kind byte, fp long, k long, a int, b int")


def _string_batch(parts: list[tuple]) -> pa.RecordBatch:
    kind, fp, k, a, b = (np.concatenate(x) for x in zip(*parts))
    return pa.RecordBatch.from_arrays(
        [pa.array(kind), pa.array(fp.view(np.int64)), pa.array(k, pa.int64()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))],
        ["kind", "fp", "k", "a", "b"],
    )


def repeated_starts(keyed: DataFrame, work: Workspace, length: int = LENGTH) -> DataFrame:
    """(k, starts): for rows ``keyed(k, text)`` the runs [a, b] of starts of repeated strings,
    as a flat list of pairs; rows without any are absent."""
    groups = work.save(_phrases(keyed, length), "phrases")
    counted = groups.where("phrase <> 0").groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("phrase")
    again = groups.where("phrase <> 0").join(counted.hint("shuffle_hash"), "phrase").select("context", "k", "i")
    again = work.save(again.unionByName(groups.where("phrase = 0").select("context", "k", "i")), "repeated-phrases")
    work.drop(groups)
    tidy()
    contexts = (
        again.groupBy("context")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "i")).alias("first"))
        .where("n > 1")
        .select("context", F.lit(2).alias("full"), "first")
    )
    is_first = F.coalesce((F.col("first.k") == F.col("k")) & (F.col("first.i") == F.col("i")), F.lit(False)).cast("int")
    marks = (
        again.join(contexts.hint("shuffle_hash"), "context", "left")
        .select("k", (F.col("i") * 4 + F.coalesce("full", F.lit(0)) + is_first).alias("mark"))
        .groupBy("k")
        .agg(F.collect_list("mark").alias("marks"))
    )
    marks = work.save(marks, "marks")
    work.drop(again)
    tidy()
    marked = keyed.join(marks, "k").select("k", "text", "marks")
    strings = work.save(_strings(marked, length), "strings")
    tidy()
    found = None
    for part in range(LOOKUPS):
        here = strings.where((F.col("kind") < 2) & (F.pmod("fp", F.lit(LOOKUPS)) == part))
        twice = here.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("kind")).where("n > 1 and kind = 0").select("fp")
        hit = work.save(here.where("kind = 0").select("fp", "k", "a").join(twice.hint("shuffle_hash"), "fp", "left_semi").select("k", "a", F.col("a").alias("b")), "found")
        found = hit if found is None else found.unionByName(hit)
        tidy()
    runs = strings.where("kind = 2").select("k", "a", "b").unionByName(found)
    return runs.groupBy("k").agg(F.flatten(F.collect_list(F.array("a", "b"))).alias("starts"))


def removed_spans(starts: list[int] | None, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal byte spans covered by the strings that start in the runs of ``starts``."""
    if not starts:
        return []
    pairs = np.array(starts, np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    begin, end = pairs[:, 0], np.maximum.accumulate(pairs[:, 1] + length)
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(begin) - 1]])
    return [(int(a), int(min(b, size))) for a, b in zip(begin[first], end[last])]


def _join_starts(docs: DataFrame, work: Workspace, length: int) -> tuple[DataFrame, str]:
    """``docs`` with the starts of repeated strings in a column whose name clashes with none, and that name."""
    keyed, key = keyed_rows(docs, work)
    name = fresh(keyed.columns, "repeated_starts")
    starts = work.save(repeated_starts(keyed.select(F.col(key).alias("k"), "text"), work, length), "starts")
    tidy()
    return keyed.join(starts.select(F.col("k").alias(key), F.col("starts").alias(name)), key, "left").drop(key), name


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """What is removed of every row of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed,
    n_spans and kept_sha256.

    Texts are UTF-8 bytes; a byte goes when a string of ``length`` bytes that
    covers it starts anywhere else too, in the same text or another.  Strings are
    judged on the input and do not cross texts; overlaps count.  A null text is
    empty; a text shorter than ``length`` loses nothing.  Repeated rows are
    separate texts, each the other's copy; ids may be null or repeated.  Other
    columns are ignored; an empty table gives an empty one.
    """
    work = Workspace(docs.sparkSession, "substrings")
    joined, name = _join_starts(docs.select("doc_id", "text"), work, length)
    joined = joined.select("doc_id", "text", name)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, starts in zip(batch.column(1), batch.column(2)):
                data = (text.as_py() or "").encode()
                spans = removed_spans(starts.as_py(), len(data), length)
                rows.append((len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_without(data, spans)).hexdigest()))
            n, cut, count, digest = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text``; all columns and rows stay.

    Where a cut splits a code point, the rest of that code point goes too, so that
    the result is valid UTF-8.  Nulls stay null.  Repeated rows are texts of their own,
    each the other's copy; ids may be null or repeated; columns of any name stay; an
    empty table gives an empty one.
    """
    work = Workspace(docs.sparkSession, "substrings")
    columns = docs.columns
    joined, name = _join_starts(docs, work, length)
    cut_text = _cutter(length)
    cut = F.when(F.col(name).isNull() | F.col("text").isNull(), F.col("text")).otherwise(cut_text("text", name))
    return joined.withColumn("text", cut).select(*[quoted(c) for c in columns])


def _cutter(length: int):
    @F.pandas_udf("string")
    def cut(text, starts):
        out = []
        for t, s in zip(text, starts):
            if t is None or s is None:
                out.append(t)
                continue
            data = t.encode()
            out.append(_without(data, removed_spans(list(s), len(data), length)).decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    return cut


def _without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept)
