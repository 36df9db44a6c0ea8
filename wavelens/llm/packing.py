"""Packing documents into sequences of a fixed length by cutting-stock column generation.

A document's ids are cut into full sequences, a core (a multiple of UNIT ids) and a tail of fewer than UNIT ids.
Cores are the items of a cutting-stock problem over the histogram of their lengths: a linear program over patterns,
with a knapsack dynamic program pricing new ones. Rounded patterns are assigned to the cores ranked within their
length. What patterns leave free is filled from the stream of all tails; the rest of that stream fills sequences of its
own, and its end sequences whose lengths are powers of two. Where the lengths are such that patterns leave more than the
tails can fill (many cores of one length over half a sequence, say), so many cores go into the stream too, and are cut
wherever a sequence ends, that padding is at most WASTE of all ids.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import Remembered
from .common import materialise
from .pretokens import Splitter, is_near, slices
from .token_counts import library

SIZE = 2048
UNIT = 32
#: Share of all ids that may be padding.
WASTE = 0.005
#: Rows to a block within which ranks and positions are running counts, at most; a few blocks for each partition at least.
BLOCK = 50_000


def knapsack(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern (a count for each size 1..len(value)) of the largest value that fits into capacity."""
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        sizes = np.arange(1, min(c, len(value)) + 1)
        total = best[c - sizes] + value[sizes - 1]
        if (k := int(np.argmax(total))) is not None and total[k] > best[c] + 1e-12:
            best[c], pick[c] = total[k], k + 1
    pattern, c = np.zeros(len(value), int), capacity
    while c > 0:
        if pick[c]:
            pattern[pick[c] - 1] += 1
            c -= pick[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def column_generation(histogram: np.ndarray, capacity: int, max_columns: int = 2000) -> list[tuple[np.ndarray, float]]:
    """Patterns and their numbers (real) that minimise the number of bins for histogram[i] items of size i + 1.

    Revised simplex over the restricted master problem with equality constraints; the first basis has one pattern for
    each size, filled with that size alone. Sizes without items take part with demand zero.
    """
    m = len(histogram)
    columns = [np.eye(m, dtype=int)[i] * (capacity // (i + 1)) for i in range(m)]
    basis = np.array(columns, float).T
    x = np.linalg.solve(basis, histogram.astype(float))
    for _ in range(max_columns):
        duals = np.linalg.solve(basis.T, np.ones(m))
        value, pattern = knapsack(duals, capacity)
        if value <= 1 + 1e-9:
            break
        direction = np.linalg.solve(basis, pattern.astype(float))
        ratio = np.where(direction > 1e-10, x / np.where(direction > 1e-10, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        step = max(0.0, ratio[out])
        x -= step * direction
        x[out] = step
        basis[:, out] = pattern
        columns[out] = pattern
    return [(p, max(0.0, float(v))) for p, v in zip(columns, x, strict=True)]


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole numbers that use up the histogram exactly: the linear program's, rounded down, and then
    patterns for what is left, which a knapsack over the left-over counts builds one by one."""
    left, out = histogram.astype(np.int64).copy(), []
    for pattern, x in column_generation(histogram, capacity):
        n = int(np.floor(x + 1e-9))
        used = pattern > 0
        if n and used.any():
            n = min(n, int((left[used] // pattern[used]).min()))
        if n and used.any():
            out.append((pattern, n))
            left -= n * pattern
    while left.any():
        pattern, room = np.zeros(len(left), int), capacity
        while room and (fits := np.flatnonzero(left[:room] > pattern[:room])).size:
            s = int(fits[-1])  # the longest that fits
            k = int(min(left[s] - pattern[s], room // (s + 1)))
            pattern[s] += k
            room -= k * (s + 1)
        n = int((left[pattern > 0] // pattern[pattern > 0]).min())
        out.append((pattern, max(1, n)))
        left -= max(1, n) * pattern
    return out


def streamed(histogram: np.ndarray, capacity: int, spare: int, allowed: int) -> tuple[np.ndarray, list[tuple[np.ndarray, int]]]:
    """How many cores of each size go into the stream, which holds spare units already, and a plan for the others, so that
    the patterns' gaps exceed the stream by allowed units at most. The least share of the sizes in wasteful patterns does
    it, found by bisection; if all were in the stream there would be no gaps."""
    sizes = np.arange(1, len(histogram) + 1)

    def tried(out: np.ndarray):
        patterns = plan(histogram - out, capacity)
        gaps = sum(n * int(capacity - p @ sizes) for p, n in patterns)
        return gaps - spare - int(out @ sizes), patterns

    none = np.zeros(len(histogram), np.int64)
    over, patterns = tried(none)
    if over <= allowed:
        return none, patterns
    wasteful = np.zeros(len(histogram), bool)
    for p, _ in patterns:
        if capacity - p @ sizes >= max(1, capacity // 32):
            wasteful |= p > 0
    low, high, best = 0.0, 1.0, None
    for _ in range(10):
        share = high if best is None else (low + high) / 2
        out = np.where(wasteful if share < 1 or best is not None else True, np.ceil(share * histogram), 0).astype(np.int64)
        over, patterns = tried(out)
        if over <= allowed:
            high, best = share, (out, patterns)
        else:
            low = share
    return best


def powers(n: int) -> list[int]:
    return [1 << i for i in reversed(range(n.bit_length())) if n >> i & 1]


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary's pieces: printable ones stand for themselves (a fixed
    rule of the format), the others take the characters from 256 on in turn."""
    plain = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


@lru_cache(2)
def ids_by_piece(path: str) -> Remembered:
    """Shared by the tasks that one Python worker runs in turn."""
    tokenize, letters = library(path)[0].model.tokenize, byte_letters()
    return Remembered(lambda piece: [t.id for t in tokenize(piece.encode().decode("latin-1").translate(letters))])


def lengths(docs: DataFrame, tokenizer_path: str, end_id: int, size: int, unit: int) -> DataFrame:
    """Cuts of each document of docs(doc_id, text): rows (uid, part, doc_id, doc_tokens, start, length, crc, tail).

    part 0 is a full sequence, 1 the core, 2 the tail; the latter two with their ids (binary, under 4 * size bytes)."""
    kind = "uid bigint, part int, doc_id bigint, doc_tokens bigint, start bigint, length bigint, crc bigint, tail binary"
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in kind.split(", ")]

    def run(batches):
        tokenizer, special = library(tokenizer_path)
        split = Splitter(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")  # what its byte-level step does
        ids_of = ids_by_piece(tokenizer_path).__getitem__
        end = struct.pack("<I", end_id)

        def packed(text: str):
            if is_near(text) and not any(s in text for s in special):
                for pieces in split(text):
                    yield b"".join(map(ids_of, pieces))
            else:
                yield np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            yield end

        for batch in (part for whole in batches for part in slices(whole)):
            out = []
            for uid, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rest, at, cuts = b"", 0, []
                for some in packed(text or ""):
                    rest += some
                    while len(rest) >= 4 * size:
                        cuts.append((0, at, size, zlib.crc32(rest[: 4 * size]), None))
                        rest, at = rest[4 * size :], at + size
                core = len(rest) // 4 // unit * unit
                if core:
                    cuts.append((1, at, core, zlib.crc32(rest[: 4 * core]), rest[: 4 * core]))
                if tail := rest[4 * core :]:
                    cuts.append((2, at + core, len(tail) // 4, None, tail))
                total = at + len(rest) // 4
                out.extend((uid, part, doc_id, total, start, n, crc, t) for part, start, n, crc, t in cuts)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint"), "text").mapInArrow(run, kind)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = SIZE, unit: int = UNIT, block: int = BLOCK) -> DataFrame:
    """Pack all ids of docs(doc_id, text), each document's followed by end_id, into sequences of at most size ids.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null text counts as
    empty (its end_id alone), repeated rows are documents of their own, a null doc_id stays null, other columns are
    ignored; an empty table gives no rows. A very long text is cut as it is encoded, a sequence at a time. What reaches the
    driver: counts by length (size / unit) and two sums; patterns (as many) go back by broadcast.
    """
    spark = docs.sparkSession
    cuts = materialise(lengths(docs, tokenizer_path, end_id, size, unit))
    capacity = size // unit
    n = cuts.where("part > 0").count()
    spread = max(-(-n // block), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered = cuts.where("part > 0").withColumn("blk", F.expr(f"pmod(xxhash64(uid), {spread})"))

    # Ranks of the cores within their length: blocks in turn, running numbers within a block.
    cores = numbered.where("part = 1").withColumn("class", (F.col("length") / unit).cast("int"))
    counts = cores.groupBy("class", "blk").agg(F.count("*").alias("n"))
    before = counts.selectExpr("class", "blk", "sum(n) OVER (PARTITION BY class ORDER BY blk) - n AS before")
    histogram = np.zeros(capacity - 1, np.int64)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():  # fewer rows than capacity
        histogram[r["class"] - 1] = r["n"]
    tail_ids = cuts.where("part = 2").agg(F.sum("length")).first()[0] or 0
    ids = tail_ids + int(histogram @ np.arange(1, capacity)) * unit
    freed, patterns = streamed(histogram, capacity, int(tail_ids) // unit, int(WASTE * ids) // unit)

    # Slots: ranks lo <= rank < hi of a class fill k places of a pattern's sequences, from offset on.
    slots, gaps, taken, sequence = [], [], np.zeros(capacity - 1, np.int64), 0
    for pattern, times in patterns:
        at = 0
        for c in np.flatnonzero(pattern)[::-1]:
            k = int(pattern[c])
            slots.append((int(c) + 1, int(taken[c]), int(taken[c]) + k * times, k, sequence, at))
            taken[c] += k * times
            at += k * (int(c) + 1) * unit
        if at < size:
            gaps.append((sequence, times, at))
        sequence += times
    slot_frame = spark.createDataFrame(slots, "class int, lo bigint, hi bigint, k bigint, first bigint, at bigint")
    ranked = cores.join(F.broadcast(before), ["class", "blk"]) if spread <= 1000 else cores.join(before, ["class", "blk"])
    ranked = ranked.withColumn("rank", F.expr("before + row_number() OVER (PARTITION BY class, blk ORDER BY uid, start) - 1"))
    placed = ranked.join(F.broadcast(slot_frame), "class").where("rank >= lo AND rank < hi")  # ranks beyond are in the stream
    core_rows = placed.selectExpr("doc_id", "start", "length", "crc AS ids_crc32", "doc_tokens", "first + (rank - lo) DIV k AS sequence_id", "at + (rank - lo) % k * length AS offset")

    # The stream of tails and freed cores: gaps first, then whole sequences, then powers of two.
    tails = numbered.where("part = 2").select("uid", "blk", "doc_id", "start", "length", "doc_tokens", "tail")
    if freed.any():
        kept = [int(histogram[c] - freed[c]) for c in range(capacity - 1)]
        free = F.expr("rank >= CASE class " + " ".join(f"WHEN {c + 1} THEN {k}" for c, k in enumerate(kept)) + " END")
        tails = tails.union(ranked.where(free).select(*tails.columns))
        tails = materialise(tails)
    sums = tails.groupBy("blk").agg(F.sum("length").alias("n"))
    at = sums.selectExpr("blk", "sum(n) OVER (ORDER BY blk) - n AS before")
    total = tail_ids + int(freed @ np.arange(1, capacity)) * unit
    # Segments, one for each pattern with a gap: stream position, first sequence, ids already there.
    begin, seq, off = [], [], []
    position = 0
    for first, times, fill in gaps:
        if position < total:
            begin.append(position), seq.append(first), off.append(fill)
            position += times * (size - fill)
    gap_end = position = min(position, total)
    whole, rest = divmod(total - position, size)
    end = position + whole * size
    ends, p = [], end
    for k in powers(rest):
        ends.append((p, sequence + whole + len(ends)))
        p += k
    sequence_end = sequence + whole + len(ends)
    begin, seq, off = (np.array(x, np.int64) for x in (begin, seq, off))
    end_at, end_seq = (np.array([e[i] for e in ends], np.int64) for i in (0, 1))

    def cut(batches):
        """Tails with their stream positions become pieces that don't cross segments."""
        for batch in batches:
            out = []
            for doc_id, start, doc_tokens, pos, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                while tail:
                    if pos < gap_end:
                        i = int(np.searchsorted(begin, pos, "right")) - 1
                        k, o = divmod(pos - int(begin[i]), size - int(off[i]))
                        s, o = int(seq[i]) + k, int(off[i]) + o
                        room = size - o
                    elif pos < end:
                        s, o = divmod(pos - gap_end, size)
                        s, room = s + sequence, size - o
                    else:
                        i = int(np.searchsorted(end_at, pos, "right")) - 1
                        s, o = int(end_seq[i]), int(pos - end_at[i])
                        room = (int(end_at[i + 1]) if i + 1 < len(end_at) else total) - pos
                    part, tail = tail[: 4 * room], tail[4 * room :]
                    k = len(part) // 4
                    out.append((doc_id, start, k, zlib.crc32(part), doc_tokens, s, o))
                    start, pos = start + k, pos + k
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    stream = tails.join(F.broadcast(at) if spread <= 1000 else at, "blk")
    stream = stream.withColumn("pos", F.expr("before + sum(length) OVER (PARTITION BY blk ORDER BY uid, start ROWS UNBOUNDED PRECEDING) - length"))
    tail_rows = stream.select("doc_id", "start", "doc_tokens", "pos", "tail").mapInArrow(cut, kind)

    full = cuts.where("part = 0").withColumn("sequence_id", F.lit(sequence_end) + F.monotonically_increasing_id())
    full_rows = full.selectExpr("doc_id", "start", "length", "crc AS ids_crc32", "doc_tokens", "sequence_id", "0L AS offset")
    return core_rows.unionByName(tail_rows).unionByName(full_rows)
