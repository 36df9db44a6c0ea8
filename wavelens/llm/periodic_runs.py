"""Periodic runs of words, found by block convolution.

A run of period q and at least 4 q words holds, at the dyadic scale B with B <= q < 2 B, an aligned block of B words
that occurs again q words later. So at each scale every block is compared with the window after it at all distances from
B to 2 B - 1 at once: the sum of squared differences of word numbers is a convolution, computed exactly in the integers
modulo a prime by number-theoretic transforms. Where it is zero the block is taken to occur; neighbouring blocks that
occur at the same distance form a seed, and seeds that can be long enough are extended word by word to both sides (their
inner words are compared too, so a sum that is zero only modulo the prime makes no run). A scale takes all texts of a
slice at once, in matrices of bounded size.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import slices

#: A prime with transforms of up to 2 ** 30 numbers (longer than any string), and a generator of its units.
PRIME, GENERATOR = 3 * 2**30 + 1, 5
P = np.uint64(PRIME)

#: Numbers in a matrix of blocks, unless one block's transform alone is longer.
CELLS = 1 << 15

#: A run has at least LEAST words and REPEATS periods.
LEAST, REPEATS = 6, 4


@lru_cache(64)
def _twiddles(size: int, inverse: bool) -> np.ndarray:
    """The first half of the powers of a size-th root of unity."""
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    root = pow(root, PRIME - 2, PRIME) if inverse else root
    powers = np.ones(max(1, size // 2), np.uint64)
    have = 1
    while have < len(powers):
        powers[have : 2 * have] = powers[:have] * np.uint64(pow(root, have, PRIME)) % P
        have *= 2
    return powers


@lru_cache(64)
def _opposite(size: int) -> np.ndarray:
    """Where a transform in bit-reversed order has frequency -k, for the place of each k."""
    places = np.zeros(1, np.int64)
    while len(places) < size:
        places = np.concatenate([2 * places, 2 * places + 1])
    return places[-places % size]


def _add(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> None:
    """a + b modulo P. Unsigned numbers wrap, so the lesser of both candidates is the right one."""
    np.add(a, b, out=out)
    np.minimum(out, out - P, out=out)


def _subtract(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> None:
    np.subtract(a, b, out=out)
    np.minimum(out, out + P, out=out)


def transform(x: np.ndarray) -> np.ndarray:
    """Transforms of the columns of x, in bit-reversed order."""
    size, columns = x.shape
    half = size // 2
    while half:
        v = x.reshape(-1, 2, half, columns)
        a, b = v[:, 0], v[:, 1]
        out = np.empty_like(v)
        _add(a, b, out[:, 0])
        _subtract(a, b, out[:, 1])
        if half > 1:
            np.multiply(out[:, 1], _twiddles(2 * half, False)[:, None], out=out[:, 1])
            np.remainder(out[:, 1], P, out=out[:, 1])
        x = out.reshape(size, columns)
        half //= 2
    return x


def back(x: np.ndarray) -> np.ndarray:
    """The columns whose transforms x holds in bit-reversed order, times their length."""
    size, columns = x.shape
    half = 1
    while half < size:
        v = x.reshape(-1, 2, half, columns)
        a, b = v[:, 0], v[:, 1]
        b = b if half == 1 else b * _twiddles(2 * half, True)[:, None] % P
        out = np.empty_like(v)
        _add(a, b, out[:, 0])
        _subtract(a, b, out[:, 1])
        x = out.reshape(size, columns)
        half *= 2
    return x


def occurrences(words: np.ndarray, squares: np.ndarray, starts: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance): blocks words[start : start + scale] that occur again at a distance in [scale, 2 scale), modulo
    the prime. words has 3 scale numbers after each start, squares their sums of squares from the left."""
    size, found = 2 * scale, []
    step = max(1, CELLS // size)
    for at in range(0, len(starts), step):
        some = starts[at : at + step]
        places = np.unique(np.concatenate([some, some + scale, some + size]))  # a block's window is the next two blocks
        blocks = np.zeros((size, len(places)), np.uint64)
        blocks[:scale] = words[np.arange(scale)[:, None] + places]
        blocks = transform(blocks)
        block, first, second = (np.take(blocks, np.searchsorted(places, some + k * scale), axis=1) for k in range(3))
        # The second is scale further on: odd frequencies change their sign, and they are the second half of the order.
        _add(first[:scale], second[:scale], first[:scale])
        _subtract(first[scale:], second[scale:], first[scale:])
        np.multiply(first, block[_opposite(size)], out=first)
        np.remainder(first, P, out=first)
        product = back(first)[:scale]
        cross = product * np.uint64(2 * pow(size, PRIME - 2, PRIME) % PRIME) % P
        ends = some + np.arange(scale)[:, None] + scale
        total = (squares[some + scale] - squares[some]) % PRIME + (squares[ends + scale] - squares[ends]) % PRIME
        t, j = np.nonzero(total.astype(np.uint64) % P == cross)
        found.append((some[j], t + scale))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _stretch(equal, low: np.ndarray, high: np.ndarray, step: int) -> np.ndarray:
    """How far each row's equality holds from low (exclusive of high), taking step places at a time."""
    at, open_ = low.copy(), np.flatnonzero(low < high)
    while len(open_):
        places = at[open_][:, None] + np.arange(step)
        good = (places < high[open_][:, None]) & equal(open_, places)
        n = np.where(good.all(1), step, np.argmin(good, 1))
        at[open_] += n
        open_ = open_[(n == step) & (at[open_] < high[open_])]
        step = min(2 * step, 256)
    return at


def _covered(known: list[np.ndarray], start: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether a known run of a period that divides apart holds words[start : start + apart]: then so does all that repeats at
    this distance, and apart is no least period. known: for each scale (start, end, period) in order of start; few runs of a
    scale share a word, so the last ones that begin in time are enough to look at (one missed costs time only)."""
    out = np.zeros(len(start), bool)
    for begin, end, period in known:
        for back_ in range(min(3, len(begin))):
            at = np.searchsorted(begin, start, "right") - 1 - back_
            run = np.maximum(at, 0)
            out |= (at >= 0) & (end[run] >= start + apart) & (apart % period[run] == 0) & (apart > period[run])
    return out


def runs(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs in texts of so many words, whose word numbers stand in words one text after
    the other; by text, start, period. Starts count from the text's first word."""
    ends = np.cumsum(lengths)
    n, longest = int(ends[-1]) if len(ends) else 0, int(max(lengths, default=0))
    scale, known, found = 1, [], [np.zeros((4, 0), np.int64)]
    padded = np.concatenate([words, np.zeros(max(4, longest), np.int64)]).astype(np.int64)
    squares = np.concatenate([[0], np.cumsum(padded * padded % PRIME)])
    padded = padded.astype(np.uint64)
    while REPEATS * scale <= longest:
        # Blocks with room for themselves at the least distance, in texts that can hold a run of this scale.
        blocks = np.where(lengths >= REPEATS * scale, lengths // scale - 1, 0)
        owner = np.repeat(np.arange(len(lengths)), blocks)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts, apart = occurrences(padded, squares, (ends - lengths)[owner] + within * scale, scale)
        owner = np.searchsorted(ends, starts, "right")
        inside = starts + scale + apart <= ends[owner]
        starts, apart, owner = starts[inside], apart[inside], owner[inside]
        order = np.argsort(apart * (n + 2 * scale) + starts)  # chains of blocks at one distance, in order
        starts, apart, owner = starts[order], apart[order], owner[order]
        head = np.ones(len(starts), bool)
        head[1:] = (np.diff(starts) != scale) | (np.diff(apart) != 0)
        head = np.flatnonzero(head)
        blocks = np.diff(np.append(head, len(starts)))
        fit = (blocks + 2) * scale > (REPEATS - 1) * apart[head]
        head, blocks = head[fit], blocks[fit]
        new = ~_covered(known, starts[head], apart[head])
        head, blocks = head[new], blocks[new]
        b, d, o = starts[head], apart[head], owner[head]
        first = ends[o] - lengths[o]
        high = _stretch(lambda r, at, b=b, d=d: padded[np.minimum(b[r][:, None] + at, n - 1)] == padded[np.minimum(b[r][:, None] + d[r][:, None] + at, n - 1)], np.zeros_like(b), ends[o] - d - b, 16)
        low = _stretch(lambda r, at, b=b, d=d: padded[np.maximum(b[r][:, None] - 1 - at, 0)] == padded[np.maximum(b[r][:, None] - 1 - at, 0) + d[r][:, None]], np.zeros_like(b), b - first, 16)
        length = low + high + d
        good = (high > 0) & (length >= np.maximum(LEAST, REPEATS * d))
        found.append(np.stack([o, b - first - low, length, d])[:, good])
        known.append(np.stack([b - low, b - low + length, d])[:, good][:, np.argsort((b - low)[good])])
        scale *= 2
    text, start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start, text))
    text, start, length, period = (x[order] for x in (text, start, length, period))
    # A run's multiples of its period give the same stretch; the least is its period.
    new = np.ones(len(text), bool)
    new[1:] = (np.diff(text) != 0) | (np.diff(start) != 0) | (np.diff(length) != 0)
    text, start, length, period = (x[new] for x in (text, start, length, period))
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def repeated_from(n: int, doc_id: int | None) -> tuple[int, int] | None:
    """(a, p) for a text of n words whose words from a on repeat with period p, by the checksum of its id; None for others."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    return None if h % 10 else (g % n, 1 + (n - g % n) // (3 + g % 8))


def find_runs(docs: DataFrame, repeat=repeated_from) -> DataFrame:
    """The runs of every whole text of docs(doc_id, text): stretches of words with least period q, of at least 6 words and 4
    periods, that no neighbouring word extends.

    repeat(n, doc_id), if given, names the texts whose tail is first replaced by repetitions of its beginning. Returns a row
    per input row: doc_id, n_runs, start, length, period and exponent_milli of the run with the greatest length / period
    (four nulls where there is none), runs_sha256 of all runs as 'start,length,period' lines, collapsed_sha256 of the
    words left when each run keeps its first period only, and runs itself (structs, by start and period). Words end at
    ASCII white space. A null text counts as empty: no runs. A null doc_id stays null and is never replaced; repeated
    rows each give a row, other columns are ignored, an empty table gives no rows. Nothing is shuffled; working memory
    follows the longest text, whose runs may be of any length."""
    kind = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:bigint,length:bigint,period:bigint>>"
    triple = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def one(doc_id, words: list[bytes], found: np.ndarray) -> tuple:
        listed = list(zip(*found.tolist(), strict=True))
        best = (None,) * 4
        if listed:
            s, n, q = listed[0]
            for s2, n2, q2 in listed[1:]:  # in order, so the first of equals stays
                if n2 * q > n * q2:
                    s, n, q = s2, n2, q2
            best = (s, n, q, 1000 * n // q)
            kept = np.zeros(len(words) + 1, np.int64)
            np.add.at(kept, found[0] + found[2], 1)
            np.add.at(kept, found[0] + found[1], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(kept)[:-1] == 0).tolist()]
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in listed)
        return (doc_id, len(listed), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest(), [dict(zip(("start", "length", "period"), x, strict=True)) for x in listed])

    def search(batches):
        for batch in (part for whole in batches for part in slices(whole, rows=4096, size=1 << 22)):
            ids, numbers, texts = batch.column(0).to_pylist(), defaultdict(count(1).__next__), []
            for doc_id, text in zip(ids, batch.column(1), strict=True):
                words = (text.as_py() or "").encode("utf-8", "replace").split()
                if repeat and (cut := repeat(len(words), doc_id)):
                    a, p = cut
                    words = words[:a] + (words[a : a + p] * (1 + (len(words) - a) // p))[: len(words) - a]
                texts.append(words)
            lengths = np.array([len(w) for w in texts], np.int64)
            flat = np.fromiter((numbers[w] for words in texts for w in words), np.int64, int(lengths.sum()))
            text, *rest = runs(flat, lengths)
            rest, cuts = np.stack(rest), np.searchsorted(text, np.arange(len(texts) + 1))
            rows = [one(i, w, rest[:, a:b]) for i, w, a, b in zip(ids, texts, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            types = [*[pa.int64()] * 6, pa.string(), pa.string(), pa.list_(triple)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in kind.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(search, kind)
