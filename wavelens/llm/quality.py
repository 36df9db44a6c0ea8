"""Document quality by co-training: a classifier of the text's content and one of the page's metadata teach each other.

Both views of every document are written down once. The classifiers start from the labelled sample; in every round
each scores all documents without a label, and its most confident ones become pseudo-labels of the other. Both are
calibrated on labelled documents that neither has been fitted to, and all documents are scored by the mean of the two
calibrated log-odds. Only features of bounded number and size reach the driver, never texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .pretokens import slices

BUCKETS = 4096
#: Labelled documents that take part in fitting, at most.
MOST_LABELLED = 2000
ROUNDS, TAKEN = 4, 60
#: Values of the metadata view.
METADATA = 9 + 24


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Buckets(dict):
    """A word's bucket: its own hash for lower-case words, coarser ones by shape for others."""

    def __missing__(self, word: str) -> int:
        shape = "U" if word.isupper() and len(word) > 1 else ""
        tail = word.lstrip("".join(c for c in word if c.isalnum()))[:3]
        value = xxhash.xxh64_intdigest(f"{shape}{tail}" if shape or len(tail) > 1 else word.lower().strip(".,")) % BUCKETS
        if len(self) > 200_000:
            self.clear()
        self[word] = value
        return value


def content(text: str, bucket) -> tuple[np.ndarray, np.ndarray]:
    """Word buckets of a text, and the square roots of their shares of its words."""
    words = text.split()
    found, times = np.unique(np.fromiter(map(bucket, words), np.int32, len(words)), return_counts=True)
    return found, np.sqrt(times / max(1, len(words))).astype(np.float32)


def metadata(text: str, lang: str | None, source: str | None) -> np.ndarray:
    """Language and source (hashed), sizes and shares of kinds of bytes, repetition of words and lines."""
    raw = text.encode("utf-8", "replace")
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, words, lines = max(1, len(raw)), text.split(), text.split("\n")
    upper, lower, digit, space = by[65:91].sum(), by[97:123].sum(), by[48:58].sum(), by[[9, 10, 13, 32]].sum()
    mark = by[33:127].sum() - upper - lower - digit
    w = max(1, len(words))
    values = [np.log1p(n) / 10, w / n * 5, len(set(words)) / w, len(set(lines)) / len(lines), upper / n * 3, digit / n * 3, mark / n * 8, space / n * 3, min(1.0, n / w / 20)]
    out = np.zeros(len(values) + 24, np.float32)
    out[: len(values)] = values
    out[len(values) + xxhash.xxh64_intdigest(lang or "") % 8] = 1
    out[len(values) + 8 + xxhash.xxh64_intdigest(source or "") % 16] = 0.3
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, rounds: int = 200, start: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last one the bias) by accelerated gradient steps."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    w = v = np.zeros(x.shape[1], np.float32) if start is None else start
    weight, y, l2 = weight.astype(np.float32), y.astype(np.float32), np.float32(l2)
    step = np.float32(4.0 / (float((x * x).sum(1).mean()) + l2))
    for i in range(rounds):
        g = (weight * (sigmoid(x @ v) - y)) @ x / weight.sum() + l2 * np.r_[v[:-1], np.float32(0)]
        new = v - step * g
        w, v = new, new + np.float32(i / (i + 3)) * (new - w)
    return w


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    w = logistic(z[:, None].astype(np.float32) / 4, y, np.ones(len(y)), 1e-3)
    return max(0.05, float(w[0]) / 4), float(w[1])


def products(w: np.ndarray, buckets: pa.ListArray, shares: pa.ListArray) -> np.ndarray:
    """Log-odds of the content view for lists of buckets and their shares."""
    owner = np.asarray(pc.list_parent_indices(buckets))
    values = w[np.asarray(pc.list_flatten(buckets))] * np.asarray(pc.list_flatten(shares))
    return np.bincount(owner, values, len(buckets)) + w[-1]


def table_of(lists: pa.ListArray) -> np.ndarray:
    return np.asarray(pc.list_flatten(lists)).reshape(len(lists), -1)


@dataclass
class Model:
    views: list[tuple[np.ndarray, float, float]]  # weights, slope and shift of each view

    def score(self, buckets: pa.ListArray, shares: pa.ListArray, meta: pa.ListArray) -> np.ndarray:
        z = raw(self.views[0][0], self.views[1][0], buckets, shares, meta)
        return sigmoid(sum(a * one + b for one, (_, a, b) in zip(z, self.views, strict=True)) / 2)


def raw(w0: np.ndarray, w1: np.ndarray, buckets: pa.ListArray, shares: pa.ListArray, meta: pa.ListArray) -> list[np.ndarray]:
    """Log-odds of both views."""
    return [products(w0, buckets, shares), table_of(meta) @ w1[:-1] + w1[-1] if len(meta) else np.zeros(0)]


def dense(rows: list) -> list[np.ndarray]:
    """Both views of collected rows (buckets, shares, meta)."""
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i, r.buckets] = r.shares
    return [x, np.array([r.meta for r in rows], np.float32).reshape(len(rows), METADATA)]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, buckets, shares, meta) of every whole text of docs(doc_id, text, lang, source)."""
    kind = "doc_id bigint, buckets array<int>, shares array<float>, meta array<float>"
    types = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.list_(pa.float32())]

    def run(batches):
        bucket = Buckets().__getitem__
        for batch in (part for whole in batches for part in slices(whole)):
            ids, *columns = batch.columns
            out = [(*content(t or "", bucket), metadata(t or "", lang, source)) for t, lang, source in zip(*(c.to_pylist() for c in columns), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types[1:], strict=True))], ["doc_id", "buckets", "shares", "meta"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang", "source").mapInArrow(run, kind)


def surest(pool: DataFrame, weights: list[np.ndarray], taken: list[set[int]], whole: bool) -> DataFrame:
    """(view, side, z, doc_id and, if whole, the features) of what each view of pool's rows says with log-odds over 1 and the
    other view has not learnt from yet."""
    held = pool.schema.fields if whole else pool.schema.fields[:1]
    kind = "view int, side int, z double, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held)

    def run(batches):
        known = [np.array(sorted(t), np.int64) for t in taken]
        for batch in batches:
            ids = batch.column(0).to_numpy()
            z = raw(*weights, *batch.columns[1:])
            for view in (0, 1):
                new = ~np.isin(ids, known[1 - view])
                for side, sure in ((0, -z[view]), (1, z[view])):
                    at = np.flatnonzero(new & (sure > 1))
                    if len(at):
                        some = batch.select(range(len(held))).take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), view, np.int32)), pa.array(np.full(len(at), side, np.int32)), pa.array(sure[at].astype(float)), *some.columns], ["view", "side", "z", *some.schema.names])

    return pool.mapInArrow(run, kind)


def first(sure: DataFrame, most: int) -> DataFrame:
    """The most confident rows of each view and side."""
    return sure.withColumn("r", F.expr("row_number() OVER (PARTITION BY view, side ORDER BY z DESC, doc_id)")).where(f"r <= {most}").drop("r")


def candidates(pool: DataFrame, weights: list[np.ndarray], taken: list[set[int]], most: int, known: DataFrame | None = None) -> DataFrame:
    """(view, side, z, doc_id) of the most confident rows of pool whose ids are not known(id): the join carries no features."""
    sure = surest(pool, weights, taken, False)
    return first(sure if known is None else sure.join(known.select("id"), F.col("doc_id") == F.col("id"), "left_anti"), most)


def confident(pool: DataFrame, weights: list[np.ndarray], taken: list[set[int]], most: int, known: DataFrame | None = None) -> list:
    """Of all documents in pool without a known label, for each view and side the most confident ones (at most most each) that
    the other view has not learnt from yet: rows (view, side, z, doc_id, buckets, shares, meta)."""
    ids = sorted({r.doc_id for r in candidates(pool, weights, taken, most, known).collect()})  # 4 * most at most
    return first(surest(pool.where(F.col("doc_id").isin(ids)), weights, taken, True), most).collect() if ids else []


def train(found: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, rounds: int = ROUNDS, taken: int = TAKEN) -> Model:
    """Fit on features(doc_id, buckets, shares, meta). Labelled rows are a bounded sample in hash order, without those
    whose crc32(doc_id) modulo 4 is 2; pseudo-labels come from all documents without a label. A quarter of the labelled
    sample is kept for calibration. Null ids and null labels take no part; of an id's labels the least counts."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("quality").cast("int").alias("q")).where("id IS NOT NULL AND q IS NOT NULL").groupBy("id").agg(F.min("q").alias("q"))
    half = lambda q: known.where(f"q = {q} AND crc32(cast(id AS string)) % 4 <> 2").orderBy(F.xxhash64("id"), "id").limit(most_labelled // 2)
    rows = found.join(F.broadcast(half(0).union(half(1))), F.col("doc_id") == F.col("id")).groupBy("doc_id").agg(F.min(F.struct("buckets", "shares", "meta")).alias("x"), F.min("q").alias("q")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    if not rows:
        return Model([(np.zeros(BUCKETS + 1, np.float32), 1.0, 0.0), (np.zeros(METADATA + 1, np.float32), 1.0, 0.0)])
    x, y = dense([r.x for r in rows]), np.array([r.q for r in rows], float)
    pool = found.where("doc_id IS NOT NULL")
    return fit(x, y, lambda weights, used: confident(pool, weights, used, taken, known), rounds)


def fit(x: list[np.ndarray], y: np.ndarray, confident_rows, rounds: int = ROUNDS) -> Model:
    """Both views of the labelled rows, their labels, and a function that gives each round's pseudo-labelled rows."""
    rest = np.arange(len(y)) % 4 == 3 if len(y) >= 8 else np.ones(len(y), bool)
    use = ~rest if len(y) >= 8 else np.ones(len(y), bool)
    used: list[set[int]] = [set(), set()]
    more, said, l2, weights = [np.zeros((0, BUCKETS), np.float32), np.zeros((0, METADATA), np.float32)], [[], []], (1e-4, 1e-3), [None, None]

    def trained(v: int) -> np.ndarray:
        t = np.r_[y[use], said[v]]
        balance = np.where(t == 1, 0.5 / max(t.mean(), 1e-3), 0.5 / max(1 - t.mean(), 1e-3))
        balance[use.sum() :] *= 0.3  # a pseudo-label counts for less
        return logistic(np.concatenate([x[v][use], more[v]]), t, balance, l2[v], 200 if weights[v] is None else 60, weights[v])

    for _ in range(rounds):
        weights = [trained(0), trained(1)]
        rows = confident_rows(weights, used)
        for v in (0, 1):
            new = {r.doc_id: r for r in rows if r.view == 1 - v}  # an id has one label; rows that repeat it count once
            used[v].update(new)
            more[v] = np.concatenate([more[v], dense(list(new.values()))[v]])
            said[v] += [r.side for r in new.values()]
        if not rows:
            break
    weights = [trained(0), trained(1)]
    return Model([(w, *calibrated(x[v][rest] @ w[:-1] + w[-1], y[rest])) for v, w in enumerate(weights)])


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, model: Model | None = None) -> DataFrame:
    """Quality of every whole text of docs(doc_id, text, lang, source), learnt from labels(doc_id, quality).

    Returns a row per input row: doc_id, held_out (crc32 of the id modulo 4 is 2), score (0 to 1, higher is better), kept
    (score >= threshold). Null texts count as empty, null languages and sources as unknown ones. Repeated rows are
    scored alike. Other columns are ignored; an empty table gives no rows. A text has at most BUCKETS features however
    long it is. The model is of fixed size and goes to the tasks by broadcast.
    """
    found = materialise(features(docs))
    shared = docs.sparkSession.sparkContext.broadcast(model or train(found, labels))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(*batch.columns[1:]).astype(float))], ["doc_id", "score"])

    scored = found.mapInArrow(run, "doc_id bigint, score double")
    held_out = F.coalesce(F.expr("crc32(cast(doc_id AS string)) % 4 = 2"), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).alias("kept"))
