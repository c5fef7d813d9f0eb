"""Vectorised hashing of words and shingles over Arrow text buffers.

A word is a maximal run of bytes outside {0x20, 0x09-0x0D}; A-Z are lower-cased.
Those bytes never occur inside a UTF-8 sequence, so byte-wise and code-point-wise
splitting agree.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_COEF = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}
SLICE_BYTES = 1 << 20
#: Sums of powers modulo 2**64 can agree for different texts of 1,024 bytes and more that are built
#: alike (Thue-Morse words), so longer spans than this are hashed another way.
LONG = 256
DENSE = 4_000_000  # cells of a table of rows and shingles up to which it is filled
SIFTS = 3  # times that rows without others like them are looked for before rows are compared
LISTED = 4_000_000  # pairs of rows that share a rare shingle up to which they are listed


def release() -> None:
    """Give free memory back to the system: a worker stays for a minute, beside whatever the executor does next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (avalanche) on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The different numbers of ``x`` in order; sorting beats NumPy's hash table here."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    have = len(_POWERS["p"])
    if have < n:
        size = max(n, 2 * have, 4096)
        for key, base in (("p", _BASE), ("q", _BASE_INV)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POWERS[key] = np.cumprod(step, dtype=np.uint64)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def prefix_hash(data: np.ndarray, lower: bool = True) -> np.ndarray:
    """Prefix sums c with hash(a, b) = (c[b] - c[a]) * base**-a."""
    p, _ = powers(len(data) + 1)
    table = _BYTE[_LOWER] if lower else _BYTE
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(table[data] * p[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, equal for equal contents wherever they stand."""
    _, q = powers(len(prefix))
    return (prefix[end] - prefix[start]) * q[start]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``limit`` bytes.

    Yields (first row, end row, bytes, offsets); nulls count as empty.  A single
    longer text makes a run of its own.
    """
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    _, off_buf, data_buf = column.buffers()
    off = np.frombuffer(off_buf, width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(off, off[first] + limit, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word."""
    ink = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True  # rows begin and end words
    start = ink.copy()
    start[1:] &= ~ink[:-1] | edge[1:-1]
    end = ink.copy()
    end[:-1] &= ~ink[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first word of each row) of the lower-cased words."""
    s, e, first = word_spans(data, off)
    out = mix64(span_hash(prefix_hash(data), s, e))
    for i in np.flatnonzero(e - s > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(_LOWER[data[s[i] : e[i]]].tobytes(), digest_size=8).digest(), "little")
    return out, s, e, first


def exact_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, first word of each row): words have one number if and only if their lower-cased bytes agree."""
    hashes, s, e, first = word_hashes(data, off)
    low, size = _LOWER[data], e - s
    _, head, number = np.unique(hashes, return_index=True, return_inverse=True)
    other = s[head][number] if len(s) else s
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    if not len(s) or ((size == size[head][number]).all() and (low[np.repeat(s, size) + step] == low[np.repeat(other, size) + step]).all()):
        return number.astype(np.int64), first
    table: dict[bytes, int] = {}
    return np.array([table.setdefault(low[a:b].tobytes(), len(table)) for a, b in zip(s.tolist(), e.tolist())], np.int64), first


def exact_sets(data: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, first number of each row) of the rows' distinct k-word shingles, sorted within a row.

    Shingles have one number if and only if their words agree; a row of 1 to k - 1 words
    has its whole sequence as one, a row without words none.
    """
    words, first = exact_words(data, off)
    count = np.diff(first)
    many = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(many)), many)
    at = first[:-1][row] + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    span = int(words.max()) + 2 if len(words) else 2
    padded = np.concatenate([words + 1, np.zeros(k, np.int64)])
    code, room = padded[at], span
    for j in range(1, k):
        if room * span >= 1 << 62:  # renumber only where the packed words would not fit
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            room = len(code) + 1
        code = code * span + np.where(at + j < first[1:][row], padded[np.minimum(at + j, len(padded) - 1)], 0)
        room *= span
    code = np.unique(code, return_inverse=True)[1].astype(np.int64)
    wide = int(code.max()) + 1 if len(code) else 1
    each = distinct(row * wide + code)
    return each % wide, np.searchsorted(each // wide, np.arange(len(many) + 1))


def whole_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of all rows of a text column at once."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    for _, _, data, off in slices(column.cast(pa.large_string()), 1 << 62):
        return data, off
    return np.zeros(0, np.uint8), np.zeros(1, np.int64)


def linked_pairs(a: pa.Array, b: pa.Array, which: np.ndarray, percent: int, k: int = 5) -> np.ndarray:
    """Whether text ``b[i]`` and text ``a[which[i]]`` have 100 * intersection >= percent * union of their shingles."""
    numbers, first = exact_sets(*whole_column(pa.chunked_array([a.cast(pa.large_string()), b.cast(pa.large_string())])), k)
    wide, size = int(numbers.max()) + 1 if len(numbers) else 1, np.diff(first)
    keys = []
    for rows in (which, len(a) + np.arange(len(b))):
        many = size[rows]
        place = np.repeat(first[rows], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        keys.append(np.repeat(np.arange(len(rows)), many) * wide + numbers[place])  # sorted, pair by pair
    x, y = keys
    inter = np.zeros(len(b), np.int64)
    if len(x) and len(y):
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        inter = np.bincount(x[y[at] == x] // wide, minlength=len(b))
    union = size[which] + size[len(a) :] - inter
    return (union > 0) & (100 * inter >= percent * union)


def maybe_linked(a: pa.Array, b: pa.Array, which: np.ndarray, percent: int, k: int = 5) -> np.ndarray:
    """Whether text ``b[i]`` and text ``a[which[i]]`` can be linked as ``linked_pairs`` judges, by hashes of their shingles.

    Equal hashes of different shingles only let pairs through: none that is linked is left out.
    """
    words, _, _, first = word_hashes(*whole_column(pa.chunked_array([a.cast(pa.large_string()), b.cast(pa.large_string())])))
    acc = np.zeros(len(words), np.uint64)
    for j in range(min(k, len(words))):
        acc[: len(words) - j] += words[j:] * _COEF[j]
    most = np.maximum(np.diff(first) - k + 1, 0)
    row = np.repeat(np.arange(len(most), dtype=np.uint64), most)
    at = np.repeat(first[:-1] - np.cumsum(most) + most, most) + np.arange(len(row))
    keys = distinct(row << np.uint64(40) | mix64(acc[at]) >> np.uint64(24))
    begin = np.searchsorted(keys, np.arange(len(most) + 1, dtype=np.uint64) << np.uint64(40))
    size, x, y = np.diff(begin), len(a) + np.arange(len(b)), which
    pair = np.repeat(np.arange(len(b)), size[x])
    own = keys[np.repeat(begin[x] - np.cumsum(size[x]) + size[x], size[x]) + np.arange(len(pair))]
    want = y[pair].astype(np.uint64) << np.uint64(40) | own & np.uint64(2**40 - 1)
    hit = keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want if len(keys) else np.zeros(0, bool)
    inter = np.bincount(pair[hit], minlength=len(b))
    keep = (most[x] == 0) | (most[y] == 0)  # of fewer than k words
    # what either has alone is at most what the threshold leaves it, for as many shingles as it may have
    alone = [most[i] + -percent * (most[i] + size[j]) // (100 + percent) - (size[i] - inter) for i, j in ((x, y), (y, x))]
    return keep | (alone[0] >= 0) & (alone[1] >= 0)


def _rare_pairs(numbers: np.ndarray, first: np.ndarray, row: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(row, earlier row) of all rows that share one of the rarest shingles that linked rows cannot all miss; None where these are many."""
    size = np.diff(first)
    often = np.bincount(numbers)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    order = np.argsort(row * (len(often) + 1) + rank[numbers])
    place = np.arange(len(numbers)) - first[row]
    held = numbers[order]
    # a link's rows have percent of either one's shingles in common
    at = np.flatnonzero((place <= (size - (percent * size + 99) // 100)[row]) & (often[held] > 1))
    at = at[np.argsort(held[at], kind="stable")]
    held, rows = held[at], row[at]
    head = np.flatnonzero(np.append(True, held[1:] != held[:-1])) if len(held) else np.zeros(0, np.int64)
    many = np.diff(np.append(head, len(held)))
    before = np.arange(len(held)) - np.repeat(head, many)
    if before.sum() > LISTED:
        return None
    a = np.repeat(rows, before)
    b = rows[np.repeat(np.repeat(head, many), before) + np.arange(len(a)) - np.repeat(np.cumsum(before) - before, before)]
    pair = distinct(a * len(size) + b)
    a, b = pair // max(len(size), 1), pair % max(len(size), 1)
    fit = 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
    return a[fit], b[fit]


def _forest_of(a: np.ndarray, b: np.ndarray, numbers: np.ndarray, first: np.ndarray, row: np.ndarray, group: np.ndarray, percent: int) -> tuple[list[int], list[int]]:
    """The links among the pairs (a, b) that join ``group``s which are not yet one."""
    size, wide = np.diff(first), int(numbers.max()) + 1 if len(numbers) else 1
    keys = row * wide + numbers
    src, dst = [], []
    for part in range(0, len(a), 4096):
        x, y = a[part : part + 4096], b[part : part + 4096]
        apart = group[x] != group[y]
        x, y = x[apart], y[apart]
        many = size[x]
        which = np.repeat(np.arange(len(x)), many)
        want = y[which] * wide + numbers[np.repeat(first[x], many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)]
        hit = keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want
        inter = np.bincount(which[hit], minlength=len(x))
        linked = np.flatnonzero(100 * inter >= percent * (size[x] + size[y] - inter))
        for i, j in zip(x[linked].tolist(), y[linked].tolist()):
            if group[i] != group[j]:
                group[group == group[j]] = group[i]
                src.append(i)
                dst.append(j)
    return src, dst


def link_forest(column: pa.ChunkedArray, group: np.ndarray, percent: int, k: int = 5) -> tuple[list[int], list[int]]:
    """A forest of (row, row) that joins the ``group``s of texts as all links among them do.

    Linked rows share one of their rarest shingles, of as many as may differ and one more;
    where few rows do, these pairs are compared.  Else intersections come from one product
    of the table of rows and shingles where that is small, or each row meets the rows that
    share one of its shingles, through an index.
    """
    numbers, first = exact_sets(*whole_column(column), k)
    size = np.diff(first)
    row = np.repeat(np.arange(len(size)), size)
    near = _rare_pairs(numbers, first, row, percent)
    if near is not None:
        return _forest_of(*near, numbers, first, row, np.unique(group, return_inverse=True)[1], percent)
    order = np.argsort(numbers, kind="stable")
    holders = row[order]
    start = np.searchsorted(numbers[order], np.arange(int(numbers.max()) + 2 if len(numbers) else 1))
    group = np.unique(group, return_inverse=True)[1]
    src, dst = [], []
    dense = len(size) * max(len(start), 1) <= DENSE
    if dense:
        holds = np.zeros((len(size), len(start)), np.float32)
        holds[row, numbers] = 1
        every = (holds @ holds.T).astype(np.int64)
    for i in range(len(size)):
        if (group == group[i]).all():
            break
        if dense:
            inter = every[i]
            hit = np.flatnonzero((inter > 0) & (100 * inter >= percent * (size + size[i] - inter)) & (group != group[i]))
            for j in hit.tolist():
                if group[j] != group[i]:
                    group[group == group[j]] = group[i]
                    src.append(i)
                    dst.append(j)
            continue
        own = numbers[first[i] : first[i + 1]]
        many = start[own + 1] - start[own]
        met = holders[np.repeat(start[own], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)]
        inter = np.bincount(met, minlength=len(size))
        hit = np.flatnonzero((inter > 0) & (100 * inter >= percent * (size + size[i] - inter)) & (group != group[i]))
        for j in hit.tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                src.append(i)
                dst.append(j)
    return src, dst


def _sharing(column: pa.ChunkedArray, group: np.ndarray, percent: int, k: int) -> np.ndarray:
    """The rows that can be linked with another of their ``group``, by hashes of their shingles.

    A link leaves either text few shingles that the other has not; rows with more that no row of
    their group shares go, and what they alone shared counts no longer.  Equal hashes of different
    shingles only let rows through.
    """
    words, _, _, first = word_hashes(*whole_column(column))
    acc = np.zeros(len(words), np.uint64)
    for j in range(min(k, len(words))):
        acc[: len(words) - j] += words[j:] * _COEF[j]
    most = np.maximum(np.diff(first) - k + 1, 0)
    row = np.repeat(np.arange(len(most)), most)
    keys = mix64(acc[np.repeat(first[:-1] - np.cumsum(most) + most, most) + np.arange(len(row))] + mix64(group.astype(np.uint64) + np.uint64(1))[row])
    fit = np.ones(len(most), bool)
    for _ in range(SIFTS if len(row) else 0):
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        alone = np.bincount(row[order[~(np.append(False, same) | np.append(same, False))]], minlength=len(most))
        gone = fit & (100 * alone > (100 - percent) * most)
        fit &= ~gone
        row, keys = row[fit[row]], keys[fit[row]]
        if not gone.any() or not len(row):
            break
    return np.flatnonzero(fit)


def group_forest(column: pa.ChunkedArray, group: np.ndarray, percent: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A forest of (row, row) that joins texts as all links among those of one ``group`` do; groups are runs of rows."""
    rows = _sharing(column, group, percent, k)
    column, group = column.take(pa.array(rows)), group[rows]
    numbers, first = exact_sets(*whole_column(column), k)
    row = np.repeat(np.arange(len(rows)), np.diff(first))
    wide = int(numbers.max()) + 1 if len(numbers) else 1
    # a shingle of two groups is two shingles
    own = np.unique(group[row] * wide + numbers, return_inverse=True)[1]
    near = _rare_pairs(own, first, row, percent)
    if near is not None:
        src, dst = _forest_of(*near, own, first, row, np.arange(len(rows)), percent)
        return rows[np.array(src, np.int64)], rows[np.array(dst, np.int64)]
    found = [np.zeros((2, 0), np.int64)]
    edges = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        found.append(a + np.array(link_forest(column.slice(a, b - a), np.arange(b - a), percent, k), np.int64).reshape(2, -1))
    src, dst = np.concatenate(found, axis=1)
    return rows[src], rows[dst]


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """For each row the hashes of its k-word shingles, repeats included.

    Rows of 1 to k-1 words give one hash of the whole sequence, rows without words none.
    """
    total = len(words)
    acc = np.zeros(max(total - k + 1, 0), np.uint64)
    for j in range(k):
        acc += words[j : j + len(acc)] * _COEF[j]
    acc = mix64(acc)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            yield acc[a : b - k + 1]
        elif b > a:
            short = np.zeros(1, np.uint64) + np.uint64(b - a)
            for j in range(b - a):
                short += words[a + j : a + j + 1] * _COEF[j + 8]
            yield mix64(short)
        else:
            yield acc[:0]


class MinHasher:
    """t minwise values of a hash set under fixed pseudo-random functions."""

    def __init__(self, t: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.t = t
        self.a = rng.integers(1, 2**63, t, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, t, dtype=np.uint64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        best = np.full(self.t, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(hashes), 2048):
            part = hashes[i : i + 2048, None] * self.a
            part += self.b
            np.minimum(best, part.min(axis=0), out=best)
        return (best >> np.uint64(32)).astype(np.uint32)


def jaccard_counts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(intersection, union) of two sorted arrays of distinct hashes."""
    if len(a) == 0 or len(b) == 0:
        return 0, len(a) + len(b)
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    inter = int((large[at] == small).sum())
    return inter, len(a) + len(b) - inter
