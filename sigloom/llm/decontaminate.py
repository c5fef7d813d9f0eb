"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are sequences of lower-cased words.  An item of n words is found where some
stretch of a text has a word edit distance of at most ``floor((1 - SIMILARITY) * n)``
from it.  Random walks embed sequences so that few edits become few differing places
(Chakraborty, Goldenberg and Koucky): in step j a walk writes its current word and
moves on if a random bit of (walk, j, word) says so, and in every third step anyway.  A repetition samples a few places
of one walk; a text's windows are embedded from every word on, an item from its own
words on, so every place in an item is one more repetition.  What agrees in all sampled
places of any repetition is a candidate, and an exact edit distance decides.

How many walks an item of n words gets is computed from the recall that is asked for,
by simulated items with the most edits that are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.words import mix64, release, slices, word_hashes
from sigloom.session import ship

SIMILARITY = 0.75
RECALL = 0.998  # of items with the most edits that are allowed
STEPS = 12  # of a walk
SPACING = 3  # one place is sampled in each run of this many steps, which reads a word or two
WALKS = 32  # at most
SAMPLED = ((8, 2), (14, 3))  # (n, places): items of fewer than n words sample so many places, longer ones FULL
FULL = 4
STARTS = 48  # places of an item that walks begin at, about, at most
TRIALS = 1000  # simulated items of a length
ITEM_BYTES = 4_000_000  # items that go to the executors at once; more are searched for in blocks
BITMAP = 22  # bits of a code that a first look checks, at most; fewer codes are told apart by fewer
CHUNK = 512
_RNG = np.random.default_rng(6)
_PLACES = {k: [np.arange(k) * SPACING + _RNG.integers(0, SPACING, k) for _ in range(WALKS)] for k in (2, 3, FULL)}
_C = np.uint64(0x9E3779B97F4A7C15)


def edits_allowed(n: int, similarity: float = SIMILARITY) -> int:
    return int((1.0 - similarity) * n + 1e-9)


def places_of(n: int) -> int:
    return next((k for limit, k in SAMPLED if n < limit), FULL)


def stride_of(n: int) -> int:
    """Words between the places of an item that walks begin at."""
    return max(1, n // STARTS)


class Walks:
    """The walks from every word of a sequence on; bits come from the words' own hashes."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.words = np.concatenate([words, np.zeros(STEPS + 1, np.uint64)])
        self._bits: dict[int, np.ndarray] = {}

    def codes(self, walk: int, wanted: tuple[int, ...] = tuple(_PLACES)) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each number of sampled places: (code, words passed when the last is sampled) from every word."""
        group, shift = divmod(walk, 4)
        if group not in self._bits:
            self._bits = {group: self.words if group == 0 else mix64(self.words + np.uint64(group * int(_C) % 2**64))}
        bits = (self._bits[group] >> np.uint64(16 * shift)).astype(np.uint16)
        at = np.arange(self.n, dtype=np.int64)
        out = {k: (np.full(self.n, walk * 8 + k, np.uint64), at) for k in wanted}
        last = max(int(_PLACES[k][walk][-1]) for k in wanted)
        for j in range(last + 1):
            for k in wanted:
                if j in _PLACES[k][walk]:
                    out[k] = ((out[k][0] ^ self.words[at]) * _C, at)
            if j < last:
                # the last step of a run always moves on, so that no word holds a walk
                at = at + (1 if j % SPACING == SPACING - 1 else (bits[at] >> np.uint16(j)) & np.uint16(1))
        return {k: (code ^ (code >> np.uint64(29)), last) for k, (code, last) in out.items()}


def simulated(n: int) -> int:
    """The length that is simulated for items of n words: at most n, since more places only help."""
    step = 1 if n <= 16 else 4 if n <= 32 else 8 if n <= 64 else 64
    return min(n // step * step, 256)


@lru_cache(maxsize=4096)
def walks_for(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Walks with which simulated items of n words and all their allowed edits are found at ``recall``."""
    e, k, rng = edits_allowed(n, similarity), places_of(n), np.random.default_rng(n)
    fresh = lambda size: rng.integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, size, dtype=np.uint64)
    items, texts, owner = [], [], []
    for t in range(TRIALS):
        item = fresh(n)
        text = item.tolist()
        for _ in range(e):
            kind, p = rng.integers(0, 3), int(rng.integers(0, max(len(text), 1)))
            word = int(fresh(1)[0])
            if kind == 0:
                text[p : p + 1] = [word]
            elif kind == 1:
                text.insert(p, word)
            else:
                del text[p : p + 1]
        items.append(item)
        texts.append(np.array(text, np.uint64))
        owner.append(np.full(len(text), t))
    first = np.arange(TRIALS + 1) * n
    item_walks, text_walks, owner = Walks(np.concatenate(items)), Walks(np.concatenate(texts)), np.concatenate(owner)
    found = np.zeros(TRIALS, bool)
    for walk in range(WALKS):
        code, last = item_walks.codes(walk)[k]
        at = np.flatnonzero(_begins(last, first, n))
        found[owner[np.isin(text_walks.codes(walk)[k][0], code[at])]] = True
        if found.mean() >= recall:
            return walk + 1
    return WALKS


def _begins(last: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Places of items of n words each that a walk begins at and whose sampled words are the item's own."""
    inside = np.arange(len(last)) - np.repeat(first[:-1], n)
    return (inside % stride_of(n) == 0) & (last < np.repeat(first[1:], n))


@dataclass
class Items:
    """Hashed items and the codes they are looked up by; bounded by ITEM_BYTES of benchmark text."""

    ids: pa.Array
    words: list[np.ndarray]
    edits: np.ndarray
    walks: int
    tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]  # (walk, places): sorted codes, item, place in it
    bitmaps: dict[tuple[int, int], np.ndarray]
    exact: dict[int, tuple[np.ndarray, np.ndarray]]  # words: sorted keys, item, of items that allow no edit


def _look(code: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """The place of each code in a bitmap: as many leading bits as tell its places apart."""
    return code >> np.uint64(65 - len(bitmap).bit_length())


def block_key(words: np.ndarray, size: int) -> np.ndarray:
    n = max(len(words) - size + 1, 0)
    key = np.zeros(n, np.uint64) + np.uint64(size)
    for j in range(size):
        key = mix64(key * _C + words[j : j + n])
    return key


def prepare(table: pa.Table, similarity: float = SIMILARITY, recall: float = RECALL) -> Items:
    """Hash a table of (item_id, text); items without words are left out."""
    ids = table.column(0).combine_chunks()
    words: list[np.ndarray] = []
    for chunk in table.column(1).chunks:
        for _, _, data, off in slices(chunk):
            hashes, _, _, first = word_hashes(data, off)
            words += [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
    kept = [i for i, w in enumerate(words) if len(w)]
    words = [words[i] for i in kept]
    edits = np.array([edits_allowed(len(w), similarity) for w in words], np.int64)
    parts: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    exact: dict[int, list[tuple[int, int]]] = {}
    most = 0
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if edits[i]:
            by_size.setdefault(len(w), []).append(i)
        else:
            exact.setdefault(len(w), []).append((int(block_key(w, len(w))[0]), i))
    for n, group in by_size.items():
        first, which = np.arange(len(group) + 1) * n, np.array(group)
        walks, k = Walks(np.concatenate([words[i] for i in group])), places_of(n)
        count = walks_for(simulated(n), similarity, recall)
        most = max(most, count)
        for walk in range(count):
            code, last = walks.codes(walk)[k]
            at = np.flatnonzero(_begins(last, first, n))
            parts.setdefault((walk, k), []).append((code[at], which[at // n], at % n))
    tables, bitmaps = {}, {}
    for key, found in parts.items():
        code, item, place = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(code, kind="stable")
        tables[key] = (code[order], item[order], place[order])
        bitmaps[key] = np.zeros(1 << min(BITMAP, len(code).bit_length() + 6), bool)
        bitmaps[key][_look(code, bitmaps[key])] = True
    keys = {n: (np.array([k for k, _ in sorted(v)], np.uint64), np.array([i for _, i in sorted(v)], np.int64)) for n, v in exact.items()}
    return Items(ids.take(pa.array(kept, pa.int64())), words, edits, most, tables, bitmaps, keys)


def least_edits(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least edit distance of the item from any stretch of the text, end of such a stretch).

    Bit-parallel approximate matching (Myers) over words.
    """
    n = len(item)
    mask = (1 << n) - 1
    top = 1 << (n - 1)
    equal: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        equal[w] = equal.get(w, 0) | 1 << i
    up, down, score = mask, 0, n
    best, end = n, 0
    for at, w in enumerate(text.tolist(), 1):
        eq = equal.get(w, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus = down | (~(diagonal | up) & mask)
        minus = up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1) & mask
        minus = (minus << 1) & mask
        up = minus | (~(diagonal | plus) & mask)
        down = plus & diagonal
        if score < best:
            best, end = score, at
    return best, end


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place) for every place in low[which]:high[which]."""
    many = high - low
    which = np.repeat(np.arange(len(low)), many)
    return which, low[which] + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)


def candidates(words: np.ndarray, first: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, start) of the item-sized windows that collide with an item in some repetition."""
    got: list[np.ndarray] = []
    walks = Walks(words)
    for walk in range(items.walks):
        codes = None
        for k in _PLACES:
            if (walk, k) not in items.tables:
                continue
            codes = walks.codes(walk, tuple(k for k in _PLACES if (walk, k) in items.tables)) if codes is None else codes
            table, item, place = items.tables[walk, k]
            code = codes[k][0]
            at = np.flatnonzero(items.bitmaps[walk, k][_look(code, items.bitmaps[walk, k])])
            which, entry = _expand(np.searchsorted(table, code[at], "left"), np.searchsorted(table, code[at], "right"))
            row = np.searchsorted(first, at[which], "right") - 1
            start = at[which] - first[row] - place[entry]
            got.append(np.stack([row, item[entry], np.maximum(start, 0)]))
    if not got:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.unique(np.concatenate(got, axis=1), axis=1))


def _possible(words: np.ndarray, first: np.ndarray, items: Items, row: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the text around each candidate holds as many of the item's words as its edits leave at least."""
    out = np.zeros(len(row), bool)
    size = np.array([len(w) for w in items.words])
    order = np.argsort(size[item], kind="stable")
    for a in range(0, len(order), CHUNK):
        at = order[a : a + CHUNK]
        n, e = size[item[at]], items.edits[item[at]]
        wide, span = int(n.max()), int((n + 2 * e).max())
        own = np.zeros((len(at), wide), np.uint64)
        for i, k in enumerate(item[at].tolist()):
            own[i, : n[i]] = items.words[k]
        begin = first[row[at]] + np.maximum(start[at] - e, 0)
        place = begin[:, None] + np.arange(span)[None, :]
        inside = place < np.minimum(first[row[at] + 1], begin + n + 2 * e)[:, None]
        text = np.where(inside, words[np.minimum(place, len(words) - 1)], np.uint64(0))
        held = np.zeros(own.shape, bool)
        for j in range(span):
            held |= own == text[:, j : j + 1]
        held &= np.arange(wide)[None, :] < n[:, None]
        out[at] = held.sum(axis=1) >= n - e
    return out


def search(words: np.ndarray, first: np.ndarray, items: Items) -> list[tuple[int, int, int, int]]:
    """(row, item, edits, end) of the items found in the rows of hashed words."""
    out = []
    if not len(words):
        return out
    for n, (keys, item) in items.exact.items():
        own = block_key(words, n)
        low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        at = np.flatnonzero(low < high)
        row = np.searchsorted(first, at, "right") - 1
        fits = at + n <= first[row + 1]
        which, entry = _expand(low[at[fits]], high[at[fits]])
        seen: set[tuple[int, int]] = set()
        for x, y, z in zip(row[fits][which].tolist(), item[entry].tolist(), at[fits][which].tolist()):
            if (x, y) not in seen:
                seen.add((x, y))
                out.append((x, y, 0, int(z - first[x]) + n))
    row, item, start = candidates(words, first, items)
    keep = _possible(words, first, items, row, item, start) if len(row) else np.zeros(0, bool)
    likely: dict[tuple[int, int], list[int]] = {}
    for x, y, z in zip(row[keep].tolist(), item[keep].tolist(), start[keep].tolist()):
        likely.setdefault((x, y), []).append(z)
    for (x, y), starts in likely.items():
        text, e, n = words[first[x] : first[x + 1]], int(items.edits[y]), len(items.words[y])
        best, stretch = (n + 1, 0), None
        for z in sorted(starts):
            if stretch is not None and z <= stretch[1] + e:
                stretch = (stretch[0], z)
                continue
            if stretch is not None:
                best = min(best, _judge(items.words[y], text, stretch, n, e))
            stretch = (z, z)
        best = min(best, _judge(items.words[y], text, stretch, n, e))
        if best[0] <= e:
            out.append((x, y, *best))
    return out


def _judge(item: np.ndarray, text: np.ndarray, stretch: tuple[int, int], n: int, e: int) -> tuple[int, int]:
    a = max(0, stretch[0] - e)
    edits, end = least_edits(item, text[a : stretch[1] + n + e])
    return edits, a + end


def _blocks(benchmark: DataFrame, similarity: float) -> Iterator:
    """The prepared items as broadcasts of at most about ITEM_BYTES of text each."""
    spark = ship(benchmark.sparkSession)
    rows = benchmark.select("item_id", "text")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(total) // ITEM_BYTES))
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else rows
        yield spark.sparkContext.broadcast(prepare(part.orderBy("item_id", "text").toArrow(), similarity))


def find(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Every benchmark item found in a row of ``docs(doc_id, text)``: doc_id, item_id, edits,
    item_words and end_word (where the best stretch ends in the text's words).

    ``benchmark(item_id, text)`` goes to the executors in blocks of at most
    ITEM_BYTES, one search of the documents for each.  Items with so few words that
    no edit is allowed match exactly; null or empty items and texts match nothing;
    equal items all match; repeated rows are found each; ids of either table may be of
    any type, null or repeated.  Texts are searched whole.  Other columns are ignored;
    empty tables give an empty one.
    """
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    found = None
    for sent in _blocks(benchmark, similarity):
        got = docs.select("doc_id", "text").mapInArrow(
            _finder(sent), f"doc_id {kind}, item_id {item_kind}, edits int, item_words int, end_word int"
        )
        found = got if found is None else found.unionByName(got)
    return found


def _hits(column: pa.Array, items: Items) -> Iterator[tuple[int, int, int, int]]:
    for base, _, data, off in slices(column):
        words, _, _, first = word_hashes(data, off)
        for x, y, edits, end in search(words, first, items) if items.words else ():
            yield base + x, y, edits, end


def _finder(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        for batch in batches:
            rows = list(_hits(batch.column(1), items))
            at, item, edits, end = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
            n = np.array([len(items.words[y]) for y in item.tolist()], np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), items.ids.take(pa.array(item)), pa.array(edits, pa.int32()), pa.array(n, pa.int32()), pa.array(end, pa.int32())],
                ["doc_id", "item_id", "edits", "item_words", "end_word"],
            )

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents in which an item is found; all columns stay, whatever their names.

    Each row is judged by its own text, in place: rows without doc_id, repeated ids and
    repeated rows too.  A null text holds nothing and stays; an empty table, and an
    empty benchmark, change nothing.
    """
    at = docs.columns.index("text")
    for sent in _blocks(benchmark, similarity):
        docs = docs.mapInArrow(_keeper(sent, at), docs.schema)
    return docs


def _keeper(sent, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[x for x, *_ in _hits(batch.column(at), sent.value)]] = False
            batch = batch.filter(pa.array(keep))
            yield batch
            del batch
        release()

    return run
