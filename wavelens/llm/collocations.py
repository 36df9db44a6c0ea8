"""Phrase collocations from depth-truncated suffix trees that are built group by group.

Vertical partitioning: the suffixes of all pieces (the words from each place on, cut at the greatest phrase length) are
divided by their first word. A prefix whose suffixes exceed the memory budget is extended by the next word, and so on;
prefixes are counted over all texts for that. Prefixes are dealt to groups of about the budget, and each group builds its
subtrees by itself: its suffixes in order, the nodes where neighbours part, and the nodes' counts as totals of their
leaves. A prefix that is extended to the whole depth is a leaf, and its total a plain sum.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .pretokens import slices

#: Suffixes of a group (a leaf takes some 100 bytes while its trees are built), and how many prefixes of a length may be long:
#: all are known to every task, in some 50 MB at most. Beyond MOST times BUDGET words, groups grow instead.
BUDGET, MOST = 600_000, 500_000

#: Texts are counted some bytes at a time.
SLICE = 1 << 23

_ENDS = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


def numbered(texts: list[str | None]) -> tuple[np.ndarray, list[bytes]]:
    """The lower-cased words of texts as numbers from 2, with a 1 where a piece ends; and the words by number."""
    numbers = defaultdict(count().__next__)
    numbers[b""], numbers[b"\n"]
    parts = []
    for text in texts:
        words = (text or "").encode("utf-8", "replace").lower().translate(_ENDS).replace(b"\n", b" \n ").split(b" ")
        words.append(b"\n")
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return flat[flat != 0], list(numbers)


def keys(rows: np.ndarray) -> np.ndarray:
    """A number for each row of small numbers, equal where rows are."""
    key = rows[:, 0]
    for d in range(1, rows.shape[1]):
        wide = int(rows[:, d].max(initial=0)) + 1
        if int(key.max(initial=0)) >= 2**62 // wide:  # numbers of prefixes, so that a key of any depth fits 64 bits
            key = np.unique(key, return_inverse=True)[1]
        key = key * wide + rows[:, d]
    return key


def suffixes(flat: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes cut at depth words, as rows of word numbers (0 after a piece's end), and how often each occurs."""
    columns = np.zeros((depth, len(flat)), np.int64)
    columns[0] = flat
    going = flat != 1
    for d in range(1, depth):
        columns[d, :-d] = flat[d:] if len(flat) > d else 0
        going = going & (columns[d] != 1)
        columns[d][~going] = 0
    rows = columns[:, flat != 1].T
    _, first, times = np.unique(keys(rows), return_index=True, return_counts=True)
    return rows[first], times


def packed(words: list[bytes], rows: np.ndarray, times: np.ndarray) -> bytes:
    """Leaves in little space: rows of places in words (from 1; 0 for none), and how often each occurs."""
    used = np.unique(rows)
    used = used[used > 0]
    small = np.where(rows > 0, np.searchsorted(used, rows) + 1, 0).astype("<u4")
    head = np.array([len(rows), rows.shape[1] if rows.ndim == 2 else 0], "<i8").tobytes()
    return zstandard.compress(head + small.T.tobytes() + times.astype("<i8").tobytes() + b"\n".join(words[i - 1] for i in used.tolist()), 1)


def unpacked(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    data = zstandard.decompress(data)
    n, depth = np.frombuffer(data, "<i8", 2).tolist()
    rows = np.frombuffer(data, "<u4", n * depth, 16).reshape(depth, n).T.astype(np.int64)
    times = np.frombuffer(data, "<i8", n, 16 + 4 * n * depth)
    return data[16 + 4 * n * depth + 8 * n :].split(b"\n"), rows, times


def leaves(docs: DataFrame, depth: int) -> DataFrame:
    """(lang, leaves): the suffixes of each slice of docs(lang, text), counted and packed."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, rows=1 << 16, size=SLICE)):
            langs = pc.fill_null(batch.column(0), "und")
            for lang in pc.unique(langs).to_pylist():
                flat, words = numbered(batch.column(1).filter(pc.equal(langs, lang)).to_pylist())
                rows, times = suffixes(flat, depth)
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([packed(words[2:], np.maximum(rows - 1, 0), times)], pa.binary())], ["lang", "leaves"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, leaves binary")


def prefix_lengths(words: list[bytes], rows: np.ndarray, long_: set[tuple[bytes, ...]]) -> np.ndarray:
    """For each leaf the words of its prefix: one, and one more for each prefix in a row that is long."""
    alone = np.array([False, *((w,) in long_ for w in words)], bool)
    out = np.where(alone[rows[:, 0]], 2, 1)
    open_ = np.flatnonzero((out == 2) & (rows[:, 1] > 0))
    for d in range(2, rows.shape[1]):
        _, first, which = np.unique(keys(rows[open_, :d]), return_index=True, return_inverse=True)
        more = np.array([tuple(words[i - 1] for i in head) in long_ for head in rows[open_[first], :d].tolist()], bool)[which]
        open_ = open_[more]
        out[open_] += 1
        open_ = open_[rows[open_, d] > 0]
    return out


def prefix_counts(table: DataFrame, d: int, depth: int, long_) -> DataFrame:
    """(lang, w1, ..., n): how often each prefix of d words occurs, of those whose prefixes are long. Under the whole depth
    only those that may be long themselves are counted: their last word must be long as well."""
    names = [f"w{i + 1}" for i in range(d)]
    kind = ", ".join(["lang string", *(f"{w} string" for w in names), "n bigint"])

    def run(batches):
        for batch in batches:
            for lang, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, rows, times = unpacked(data)
                keep = rows[:, d - 1] > 0
                if d > 1:
                    known = long_.value.get(lang, set())
                    keep &= prefix_lengths(words, rows, known) >= d
                    if d < depth:
                        keep &= np.array([False, *((w,) in known for w in words)], bool)[rows[:, d - 1]]
                _, first, which = np.unique(keys(rows[keep, :d]), return_index=True, return_inverse=True)
                heads = rows[keep, :d][first]
                total = np.bincount(which, times[keep], len(heads)).astype(np.int64)  # exact: a slice's counts are small
                text = pa.array([w.decode("utf-8", "replace") for w in words], pa.string())
                for at in range(0, len(heads), 65_536):
                    some = heads[at : at + 65_536]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), *(text.take(pa.array(some[:, i] - 1)) for i in range(d)), pa.array(total[at : at + 65_536])], ["lang", *names, "n"])

    return table.mapInArrow(run, kind).groupBy("lang", *names).agg(F.sum("n").alias("n"))


def dealt(table: DataFrame, depth: int, long_, groups: int) -> DataFrame:
    """(grp, lang, leaves): each slice's leaves by the group of their prefix; the prefix's length is a last column of the
    leaves. Leaves whose prefix is as long as can be stay behind."""

    def run(batches):
        for batch in batches:
            for lang, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, rows, times = unpacked(data)
                prefix = prefix_lengths(words, rows, long_.value.get(lang, set()))
                keep = prefix < depth
                rows, times, prefix = rows[keep], times[keep], prefix[keep]
                hashes = np.array([0, *(xxhash.xxh64_intdigest(w) for w in words)], np.uint64)
                mixed = np.full(len(rows), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
                for d in range(depth - 1):
                    mixed = np.where(prefix > d, mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[rows[:, d]], mixed)
                group = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(groups)).astype(np.int64)
                order = np.argsort(group, kind="stable")
                cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
                for part in np.split(order, cuts[1:]) if len(order) else ():
                    # The length stands behind the words as one more of them: packed() keeps words by place.
                    labels = [*words, *(b"%d" % k for k in range(1, depth))]
                    some = np.column_stack([rows[part], len(words) + prefix[part]])
                    yield pa.RecordBatch.from_arrays([pa.array([int(group[part[0]])]), pa.array([lang], pa.string()), pa.array([packed(labels, some, times[part])], pa.binary())], ["grp", "lang", "leaves"])

    return table.mapInArrow(run, "grp bigint, lang string, leaves binary")


def subtrees(parts: list[bytes], depth: int, least: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, and nodes (rows of places in words, and counts) of the trees over a group's packed leaves: those of two words or
    more that occur least times or more and are no shorter than their prefix, which groups may share."""
    numbers: dict[bytes, int] = {}
    rows, times, prefixes = [], [], []
    for data in parts:
        words, some, n = unpacked(data)
        place = np.array([0, *(numbers.setdefault(w, len(numbers) + 1) for w in words)], np.int64)
        rows.append(place[some[:, :depth]])
        label, which = np.unique(some[:, depth], return_inverse=True)
        prefixes.append(np.array([int(words[i - 1]) for i in label.tolist()], np.int64)[which])
        times.append(n)
    rows, times, prefix = np.concatenate(rows), np.concatenate(times), np.concatenate(prefixes)
    order = np.lexsort(rows.T[::-1])  # the leaves in order: a node's are neighbours
    rows, times, prefix = rows[order], times[order], prefix[order]
    new, nodes, totals = np.arange(len(rows)) == 0, [], []
    for d in range(1, depth + 1):
        new[1:] |= np.diff(rows[:, d - 1]) != 0  # a leaf that parts from its neighbour within d words opens a node there
        first = np.flatnonzero(new)
        total = np.add.reduceat(times, first)
        keep = (rows[first, d - 1] > 0) & (prefix[first] <= d) & (total >= least)
        if d >= 2:
            found = rows[first[keep]].copy()
            found[:, d:] = 0
            nodes.append(found)
            totals.append(total[keep])
    return list(numbers), np.concatenate(nodes), np.concatenate(totals)


def phrase_counts(docs: DataFrame, depth: int = 3, least: int = 10, budget: int = BUDGET, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): all words (lang, w1, n), and all phrases of 2 to depth words that occur least times or more
    (lang, w1, ..., n), each with its number of occurrences within pieces, overlaps included."""
    names = [f"w{d + 1}" for d in range(depth)]
    context = docs.sparkSession.sparkContext
    table = materialise(leaves(docs, depth))
    words = materialise(prefix_counts(table, 1, depth, None))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    limit = max(budget, -(-total // most))  # so at most `most` prefixes of a length are long
    counts, long_, apart = words, {}, []
    for d in range(1, depth):
        for row in counts.where(F.col("n") > limit).select("lang", *names[:d]).collect():
            long_.setdefault(row[0], set()).add(tuple(w.encode() for w in row[1:]))
        shared = context.broadcast(long_)
        counts = materialise(prefix_counts(table, d + 1, depth, shared))
        # Of these the trees hold what is not extended further.
        apart.append(counts.where(F.col("n") > limit) if d + 1 < depth else counts)
    kind = ", ".join(["lang string", *(f"{w} string" for w in names), "n bigint"])

    def build(group: pa.Table) -> pa.Table:
        out = []
        for lang in pc.unique(group["lang"]).to_pylist():
            found, nodes, totals = subtrees(group.filter(pc.equal(group["lang"], lang))["leaves"].to_pylist(), depth, least)
            text = pa.array([None, *(w.decode("utf-8", "replace") for w in found)], pa.string())
            out.append(pa.table([pa.array([lang] * len(nodes), pa.string()), *(text.take(pa.array(nodes[:, d])) for d in range(depth)), pa.array(totals, pa.int64())], ["lang", *names, "n"]))
        return pa.concat_tables(out)

    phrases = dealt(table, depth, shared, max(1, -(-total // budget))).groupBy("grp").applyInArrow(build, kind)
    for counted in apart:
        phrases = phrases.unionByName(counted.where(F.col("n") >= least), allowMissingColumns=True)
    return words, materialise(phrases)


def _cut(phrase: str, first: str, n: str) -> str:
    """SQL: n words of a phrase from number first (from 1) on."""
    return f"array_join(slice({phrase}, {first}, {n}), ' ')"


def collocations(docs: DataFrame, depth: int = 3, least: int = 10, top: int = 2000, inside: int = 50, budget: int = BUDGET) -> DataFrame:
    """Each language's top phrases of 2 to depth words by how much oftener they occur than chance has their parts meet.

    Texts of docs(text, lang) are lower-cased (A-Z) and split into pieces at . , ; : ! ? and line ends; words end at spaces
    and tabs. A phrase counts if it occurs least times or more in its language; its score is the least of
    floor(1000000 a^2 / (l r)) over its cuts into two parts that occur l and r times (ties: the first cut). A phrase inside
    a longer one that has inside percent of its occurrences or more is left out. Returns lang, rank (from 1), phrase, a, l,
    r, n (words of the language), score; order by score, a, then phrase. A null text counts as empty, a null lang as
    'und'; repeated rows count each, other columns are ignored, an empty table gives no rows. Numbers are exact while
    1000000 a^2 is below 10^38. Memory follows the slices of texts and the groups, not the longest phrase's occurrences;
    a text longer than a slice is counted by itself."""
    words, phrases = phrase_counts(docs, depth, least, budget)
    names = [f"w{d + 1}" for d in range(depth)]
    found = phrases.select("lang", F.expr(f"filter(array({', '.join(names)}), w -> w IS NOT NULL)").alias("ws"), F.col("n").alias("a"))
    found = found.withColumn("phrase", F.expr("array_join(ws, ' ')"))
    counts = words.where(F.col("n") >= least).selectExpr("lang", "w1 AS part", "n").union(found.select("lang", "phrase", "a"))
    cuts = found.select("lang", "phrase", "a", "ws", F.expr("explode(sequence(1, size(ws) - 1)) AS k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr(_cut("ws", "1", "k")).alias("first"), F.expr(_cut("ws", "k + 1", "size(ws)")).alias("rest"))
    cuts = cuts.join(counts.selectExpr("lang", "part AS first", "n AS l"), ["lang", "first"]).join(counts.selectExpr("lang", "part AS rest", "n AS r"), ["lang", "rest"])
    whole = lambda c: f"CAST({c} AS decimal(19, 0))"
    score = f"(1000000BD * {whole('a')} * {whole('a')}) DIV ({whole('l')} * {whole('r')})"
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.expr(f"struct({score} AS score, k, l, r)")).alias("b"))
    # A longer phrase's parts of two words and more.
    within = found.where("size(ws) > 2").select("lang", "a", "ws", F.expr("explode(sequence(2, size(ws) - 1)) AS m")).select("lang", "a", "ws", "m", F.expr("explode(sequence(1, size(ws) - m + 1)) AS s"))
    within = within.groupBy("lang", F.expr(_cut("ws", "s", "m")).alias("phrase")).agg(F.max("a").alias("longer"))
    left = scored.join(within, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {inside} * a")
    left = left.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = "ORDER BY score DESC, a DESC, phrase"
    # The best of each of many shares first, so that no task orders a language.
    some = left.withColumn("share", F.expr("pmod(xxhash64(phrase), 64)")).withColumn("at", F.expr(f"row_number() OVER (PARTITION BY lang, share {order})")).where(F.col("at") <= top)
    best = some.withColumn("rank", F.expr(f"CAST(row_number() OVER (PARTITION BY lang {order}) AS bigint)")).where(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = """
    WITH d AS MATERIALIZED (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents),
    p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
    g AS (SELECT lang, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i FROM p, (VALUES (1), (2), (3)) s(k) WHERE len(w) >= k),
    f AS MATERIALIZED (SELECT lang, k, w[i : i + k - 1] AS ws, count(*)::HUGEINT AS n FROM g GROUP BY ALL),
    c AS MATERIALIZED (SELECT * FROM f WHERE k > 1 AND n >= 10),
    cut AS (SELECT c.*, unnest(generate_series(1, k - 1)) AS at_ FROM c),
    s AS (SELECT cut.lang, cut.ws, cut.n AS a, at_, x.n AS l, y.n AS r, (1000000 * cut.n * cut.n) // (x.n * y.n) AS score
        FROM cut JOIN f x ON x.lang = cut.lang AND x.ws = cut.ws[1 : at_] JOIN f y ON y.lang = cut.lang AND y.ws = cut.ws[at_ + 1 :]),
    m AS (SELECT *, row_number() OVER (PARTITION BY lang, ws ORDER BY score, at_) AS nth FROM s),
    o AS (SELECT lang, n, unnest([ws[1 : 2], ws[2 : 3]]) AS ws FROM c WHERE k = 3),
    longer AS (SELECT lang, ws, max(n) AS n FROM o GROUP BY ALL),
    kept AS (SELECT m.lang, array_to_string(m.ws, ' ') AS phrase, a, l, r, score FROM m LEFT JOIN longer x ON x.lang = m.lang AND x.ws = m.ws WHERE nth = 1 AND (x.n IS NULL OR 100 * x.n < 50 * a)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept),
    total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang)
    SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""
