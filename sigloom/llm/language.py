"""Language identification by cross-parsing against suffix automata.

Each language's bounded sample of labelled text becomes a suffix automaton.  A
text is parsed greedily into the longest phrases that occur in a language's
sample; the language that needs fewest phrases a symbol wins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigloom.llm.quality import fold
from sigloom.session import ship

#: Bounds of the fit: whole texts of a language, the characters of each, languages.
SAMPLE_ROWS, SAMPLE_CHARS, LANGUAGES = 24, 4_000, 256
SYMBOLS = 63  # most frequent letters, whose transitions are a table; those of all others are sorted keys
SEGMENT = 512  # symbols that a lane parses before it is joined to the next
BLOCK_SYMBOLS = 1 << 20  # parsed at once; a longer text is a block of its own
ROWS = 1024
SHIFT = 21  # bits of a symbol in a key
UNDETERMINED = "und"


class SuffixAutomaton:
    """Online construction over small integers (Blumer et al.)."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        step: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols.tolist():
            now = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in step[p]:
                step[p][c] = now
                p = link[p]
            if p != -1:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[now] = q
                else:
                    copy = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and step[p].get(c) == q:
                        step[p][c] = copy
                        p = link[p]
                    link[q] = link[now] = copy
            last = now
        self.table = np.full((len(step), alphabet), -1, np.int32)
        self.rare: list[tuple[int, int, int]] = []  # (state, symbol, state) of symbols beyond the table
        for state, out in enumerate(step):
            for c, to in out.items():
                if c < alphabet:
                    self.table[state, c] = to
                else:
                    self.rare.append((state, c, to))


@dataclass
class Model:
    """Symbols of the letters learnt and all languages' automata; bounded by the fit's bounds."""

    languages: list[str]
    letters: dict[int, int]
    table: np.ndarray
    roots: np.ndarray
    rare_keys: np.ndarray
    rare_states: np.ndarray

    def lookup(self) -> np.ndarray:
        """The symbol of every code point: 0 for what is no letter, the last for letters in no sample."""
        points, lower = all_letters()
        unknown = len(self.letters) + 1
        known = np.full(0x110000, unknown, np.min_scalar_type(unknown))
        known[list(self.letters)] = list(self.letters.values())
        out = np.zeros(0x110000, known.dtype)
        out[points] = known[lower]
        return out

    def rare(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Where symbols beyond the table lead, or -1."""
        keys = (states << SHIFT) | symbols
        if not len(self.rare_keys):
            return np.full(keys.shape, -1, np.int64)
        at = np.minimum(np.searchsorted(self.rare_keys, keys), len(self.rare_keys) - 1)
        return np.where(self.rare_keys[at] == keys, self.rare_states[at], -1)

    def rare_table(self) -> dict[tuple[int, int], int]:
        return {(key >> SHIFT, key & ((1 << SHIFT) - 1)): to for key, to in zip(self.rare_keys.tolist(), self.rare_states.tolist())}



def letter_of(point: int) -> int:
    """The lower-case code point of a letter, 0 for all else."""
    own = chr(point)
    if not own.isalpha():
        return 0
    low = own.lower()
    return ord(low) if len(low) == 1 and low.isalpha() else point


@lru_cache(maxsize=1)
def all_letters() -> tuple[np.ndarray, np.ndarray]:
    """All code points that are letters and their lower case."""
    lower = np.array([letter_of(p) for p in range(0x110000)], np.int64)
    points = np.flatnonzero(lower)
    return points, lower[points]


def symbols_of(points: np.ndarray, lookup: np.ndarray) -> np.ndarray:
    """Letters with runs of anything else reduced to one 0."""
    s = lookup[points]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    return s[keep]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def build(samples: dict[str, list[str]]) -> Model:
    """One automaton for each language of ``samples``."""
    languages = sorted(samples)
    texts = {k: "\n".join(samples[k]) for k in languages}
    seen = Counter(x for t in texts.values() for x in map(letter_of, map(ord, t)) if x)
    letters = {p: i + 1 for i, (p, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0])))}
    none = np.zeros(0, np.int64)
    model = Model(languages, letters, np.zeros((0, SYMBOLS + 1), np.int32), none, none, none)
    lookup, tables, roots, rare, at = model.lookup(), [], [], [], 0
    for k in languages:
        automaton = SuffixAutomaton(symbols_of(code_points(texts[k]), lookup), SYMBOLS + 1)
        table = automaton.table
        tables.append(np.where(table >= 0, table + at, -1).astype(np.int32))
        rare += [((state + at) << SHIFT | c, to + at) for state, c, to in automaton.rare]
        roots.append(at)
        at += len(table)
    if rare:
        model.rare_keys, model.rare_states = np.array(sorted(rare), np.int64).T.copy()
    if tables:
        model.table, model.roots = np.concatenate(tables), np.array(roots, np.int64)
    return model


class Parser:
    """Greedy parses of a block of texts, in all languages side by side.

    A phrase ends where the automaton has no transition; the symbol there begins the
    next one.  A symbol unknown to a language is a phrase of its own: it leaves the
    automaton at its root, where any symbol begins a phrase.

    Long texts are parsed from many places at once and the parses joined: one that runs
    on beyond its segment is the next segment's parse from the first place where both
    begin a phrase.  Where two never agree within a segment, that text is parsed in one
    go, so the counts are those of the whole text's parse in every case.
    """

    def __init__(self, model: Model):
        self.model = model
        self.width = model.table.shape[1]
        self.flat = model.table.reshape(-1)
        roots = model.roots
        self.start = np.where(model.table[roots] >= 0, model.table[roots], roots[:, None])  # language x symbol

    def step(self, state: np.ndarray, language: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each lane begins a phrase with its symbol, its next state)."""
        roots = self.model.roots[language]
        far = np.flatnonzero(symbol >= self.width)
        near = np.where(symbol < self.width, symbol, 0)
        to = self.flat[state * self.width + near].astype(np.int64)
        begin = self.start[language, near].astype(np.int64)
        if len(far):
            to[far] = self.model.rare(state[far], symbol[far])
            first = self.model.rare(roots[far], symbol[far])
            begin[far] = np.where(first >= 0, first, roots[far])
        miss = to < 0
        return miss | (state == roots), np.where(miss, begin, to)

    def count(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Phrases (text x language) of the texts ``symbols[first[i]:first[i + 1]]``."""
        texts, languages = len(first) - 1, len(self.model.languages)
        total = np.zeros((texts, languages), np.int64)
        if not len(symbols) or not languages:
            return total
        pieces = -(-np.diff(first) // SEGMENT)
        text = np.repeat(np.arange(texts), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        a = first[text] + number * SEGMENT
        b = np.minimum(a + SEGMENT, first[text + 1])
        order = np.argsort(a - b, kind="stable")  # lanes by falling length
        a, b, text = a[order], b[order], text[order]
        marks = np.zeros((languages, len(symbols) + 1), bool)
        language = np.repeat(np.arange(languages), len(a))
        la, lb, lt = np.tile(a, languages), np.tile(b, languages), np.tile(text, languages)
        state = self.model.roots[language].astype(np.int64)
        grid, kinds = state.reshape(languages, -1), language.reshape(languages, -1)
        for t in range(int((b - a).max())):
            live = int(np.searchsorted(a - b, -t, "left"))
            begins, grid[:, :live] = (x.reshape(languages, live) for x in self.step(grid[:, :live].reshape(-1), kinds[:, :live].reshape(-1), np.tile(symbols[a[:live] + t], languages)))
            marks[:, a[:live] + t] = begins
        # phrases before each place, by language
        before = np.zeros(marks.shape, np.int32)
        np.cumsum(marks[:, :-1], axis=1, out=before[:, 1:])
        state = grid.reshape(-1)
        np.add.at(total, (lt, language), before[language, lb] - before[language, la])
        # those that end inside their text run on until they meet the next segment's parse
        lane = np.flatnonzero(lb < first[lt + 1])
        at, state, own, whole = lb[lane].copy(), state[lane], language[lane], lt[lane]
        stop = np.minimum(at + SEGMENT, first[whole + 1])
        head = at.copy()
        broken: set[tuple[int, int]] = set()
        extra = np.zeros(len(lane), np.int64)
        while len(at):
            begins, state = self.step(state, own, symbols[at])
            met = begins & marks[own, at]
            extra += begins & ~met
            done = met | (at + 1 >= stop)
            if done.any():
                # what the next segment's parse counted before this place gives way to what this one found
                end = np.where(met, at, at + 1)
                np.add.at(total, (whole[done], own[done]), (extra - (before[own, end] - before[own, head]))[done])
                lost = done & ~met & (at + 1 < first[whole + 1])
                broken.update(zip(whole[lost].tolist(), own[lost].tolist()))
                keep = ~done
                at, state, own, whole, stop, head, extra = (x[keep] for x in (at, state, own, whole, stop, head, extra))
            at = at + 1
        for i, k in broken:
            total[i, k] = self.plain(symbols[first[i] : first[i + 1]], k)
        return total

    def plain(self, symbols: np.ndarray, language: int) -> int:
        """Phrases of one text in one language, symbol by symbol."""
        table, root = self.model.table, int(self.model.roots[language])
        rare = self.model.rare_table()
        state, found = root, 0
        for c in symbols.tolist():
            to = int(table[state, c]) if c < self.width else rare.get((state, c), -1)
            if to < 0 or state == root:
                found += 1
            if to < 0:
                first = int(table[root, c]) if c < self.width else rare.get((root, c), -1)
                to = first if first >= 0 else root
            state = to
        return found


def parse_texts(texts: list[str], parser: Parser, lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrases by text and language, symbols by text) of whole texts, some megabytes at once."""
    parts, counts, start = [symbols_of(code_points(t), lookup) for t in texts], [], 0
    size = np.array([len(p) for p in parts], np.int64)
    total = np.cumsum(size)
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + BLOCK_SYMBOLS, "right")))
        first = np.concatenate([[0], np.cumsum(size[start:end])])
        counts.append(parser.count(np.concatenate(parts[start:end]), first))
        start = end
    return np.concatenate(counts) if counts else np.zeros((0, len(parser.model.languages)), np.int64), size


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, languages: int = LANGUAGES) -> Model:
    """Learn from at most ``sample_rows`` whole texts of each of the ``languages`` most frequent lang values.

    Only rows with text, a non-null lang and crc32(doc_id as text) mod 5 other than 0
    are learnt from, and of them those of at most ``sample_chars`` characters; of a
    language that has only longer ones, the shortest.  Which are sampled is decided by
    a hash of doc_id and text; equal rows count once.  Rows of each language are counted
    over all data; what comes to the driver is bounded by these three parameters.
    """
    usable = docs.select("doc_id", "text", "lang").where(
        "lang is not null and text is not null and text <> ''"
    ).where(fold(F.col("doc_id"), 5) != 0)
    fits, rank = F.length("text") <= sample_chars, F.xxhash64("doc_id", "text")
    counted = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.when(fits, rank)).alias("short"), F.min(F.length("text")).alias("least"))
    seen = counted.orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not seen:
        return build({})
    span = 1 << 30
    facts = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], r["short"], r["least"]) for r in seen], "lang string, short long, least int"))
    # of the different rows about four times those that are needed pass, then the first by rank
    share = F.least(F.lit(span), F.ceil(F.lit(float(4 * sample_rows * span)) / F.greatest("short", F.lit(1))))
    near = usable.join(facts, "lang").where(F.when(F.col("short") > 0, fits & (F.pmod(rank, F.lit(span)) < share)).otherwise(F.length("text") == F.col("least")))
    distinct = near.groupBy("lang", rank.alias("rank")).agg(F.min("text").alias("text"))
    chosen = distinct.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("rank"))).where(F.col("place") <= sample_rows)
    samples: dict[str, list[str]] = {}
    for r in sorted(chosen.select("lang", "rank", "text").collect(), key=lambda r: (r["lang"], r["rank"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return build(samples)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Language of every row of ``docs(doc_id, text)``: doc_id, lang_pred and score.

    The language that needs fewest phrases a symbol wins; ``score`` is the share by
    which the runner-up needs more, between 0 and 1.  Null texts, texts without a
    letter (digits and other numbers are none), and all texts where nothing was learnt
    get ``und`` with score 0; ties go to the first language in order.  Null ids and
    repeated rows stay; texts of any length are parsed whole; other columns are
    ignored; an empty table gives an empty one.
    """
    spark = ship(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        lookup, parser = own.lookup(), Parser(own)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                ids, texts = batch.column(0).slice(a, ROWS), [t or "" for t in batch.column(1).slice(a, ROWS).to_pylist()]
                names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                if own.languages:
                    phrases, symbols = parse_texts(texts, parser, lookup)
                    need = phrases / np.maximum(symbols, 1)[:, None]
                    best = phrases.argmin(axis=1)
                    least = need.min(axis=1)
                    if len(own.languages) > 1:
                        second = np.partition(need, 1, axis=1)[:, 1]
                        scores = np.where(second > 0, 1.0 - least / np.where(second > 0, second, 1.0), 0.0)
                    else:
                        scores = np.ones(len(texts))
                    known = np.array([any(map(str.isalpha, t)) for t in texts], bool)
                    names = [own.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), known.tolist())]
                    scores = np.where(known, np.clip(scores, 0.0, 1.0), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
