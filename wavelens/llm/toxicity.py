"""Toxicity of documents: a bidirectional gated recurrent network with attention pooling, written in numpy.

A word's input is its own embedding and the mean of its character n-grams' embeddings (both by hashed buckets), so
that unseen forms of a word are recognised. A text is scored in overlapping windows that cover all of it; its score
is its highest window's, calibrated on labelled documents that the network has not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import slices

WINDOW, STRIDE = 64, 48
UNITS, DIM = 8, 8
WORD_BUCKETS, GRAM_BUCKETS = 8192, 16384
GRAMS = (3, 4, 5)
#: Labelled documents of either class that take part in fitting, at most.
MOST_TOXIC, MOST_CLEAN = 900, 1500
#: Longer texts are scored like any other but are not collected for fitting.
MOST_CHARS = 50_000
EPOCHS = 8


class Words:
    """The inputs of distinct words: a word bucket each, and n-gram buckets with their word's row."""

    def __init__(self, words: pa.Array):
        words = words.cast(pa.large_binary())
        n = len(words)
        ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
        ends = ends - ends[0]
        length = np.diff(ends)
        # Each word between two marks, in one array.
        start = ends[:-1] + 2 * np.arange(n)
        chars = np.full(len(data) + 2 * n, 1, np.uint64)
        owner = np.repeat(np.arange(n), length + 2)
        inner = np.ones(len(chars), bool)
        inner[start] = inner[start + length + 1] = False
        chars[inner] = data
        whole = np.zeros(n, np.uint64)
        if len(chars):
            power = (np.arange(len(chars)) - start[owner]).astype(np.uint64)
            mixed = (chars + np.uint64(1)) * (power * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93))
            whole = np.add.reduceat((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9), start)
        self.n, self.word = n, (whole >> np.uint64(33)) % np.uint64(WORD_BUCKETS)
        grams, owners = [], []
        for k in GRAMS:
            if len(chars) < k:
                continue
            h = np.full(len(chars) - k + 1, k, np.uint64)
            for i in range(k):
                h = (h ^ chars[i : len(chars) - k + 1 + i]) * np.uint64(0x100000001B3)
            inside = owner[: len(h)] == owner[k - 1 :]
            grams.append(((h ^ (h >> np.uint64(29))) % np.uint64(GRAM_BUCKETS))[inside])
            owners.append(owner[: len(h)][inside])
        self.gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        self.owner = np.concatenate(owners) if owners else np.zeros(0, int)
        order = np.argsort(self.owner, kind="stable")
        self.gram, self.owner = self.gram[order].astype(np.int64), self.owner[order]
        self.word = self.word.astype(np.int64)
        self.grams = np.maximum(np.bincount(self.owner, minlength=n), 1)


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts (null: empty), coded by a dictionary, and where each text's begin; one more at the end."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = pc.list_flatten(lists)
    full = np.asarray(pc.not_equal(flat, ""))
    length = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), length)[full]
    starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]) if len(texts) else np.zeros(1, int)
    return flat.filter(pa.array(full)).dictionary_encode(), starts.astype(np.int64)


def windows(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows over whole texts: text, first word, number of words. An empty text has one empty window."""
    n = np.diff(starts)
    count = np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE))
    text = np.repeat(np.arange(len(n)), count)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return text, starts[text] + first, np.minimum(WINDOW, n[text] - first)


def sigmoid(x):
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def scattered(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by their place among n."""
    return np.stack([np.bincount(at, rows[:, j], n) for j in range(rows.shape[1])], 1).astype(np.float32)


class Network:
    """Parameters by name, forward and backward passes."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        u = UNITS
        self.p = {"word": rng.normal(0, 0.1, (WORD_BUCKETS, DIM)), "gram": rng.normal(0, 0.3, (GRAM_BUCKETS, DIM)), "att": rng.normal(0, 0.3, 2 * u), "out": rng.normal(0, 0.3, 2 * u), "bias": np.zeros(1) - 1.0}
        for d in "fb":
            self.p |= {f"x{d}": rng.normal(0, 0.4, (2 * DIM, 3 * u)), f"h{d}": rng.normal(0, 0.3, (u, 3 * u)), f"c{d}": np.zeros(3 * u)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def inputs(self, w: Words) -> np.ndarray:
        """Word and character inputs of distinct words."""
        chars = np.zeros((w.n, DIM), np.float32)
        if len(w.gram):
            at = np.flatnonzero(np.r_[True, w.owner[1:] != w.owner[:-1]])
            chars[w.owner[at]] = np.add.reduceat(self.p["gram"][w.gram], at, axis=0)
        return np.concatenate([self.p["word"][w.word], chars / np.sqrt(w.grams)[:, None].astype(np.float32)], 1)

    def projected(self, w: Words) -> dict[str, np.ndarray]:
        """What each distinct word adds to the gates of either direction; the last row, for padding, is zero."""
        x = self.inputs(w)
        return {d: np.concatenate([x @ self.p[f"x{d}"] + self.p[f"c{d}"], np.zeros((1, 3 * UNITS), np.float32)]) for d in "fb"}

    def forward(self, gates: dict[str, np.ndarray], ids: np.ndarray, n: np.ndarray, keep: bool = False):
        """Logits of windows; ids (windows x steps, padding -1), n words in each."""
        b, t = ids.shape
        u = UNITS
        states = np.zeros((t, b, 2 * u), np.float32)
        live = (np.arange(t)[:, None] < n[None, :]).astype(np.float32)[:, :, None]
        kept = {}
        for d, steps in (("f", range(t)), ("b", range(t - 1, -1, -1))):
            h, hu, table = np.zeros((b, u), np.float32), self.p[f"h{d}"], gates[d]
            steps_kept = []
            for s in steps:
                g = table[ids[:, s]]
                zr = sigmoid(g[:, : 2 * u] + h @ hu[:, : 2 * u])
                z, r = zr[:, :u], zr[:, u:]
                c = np.tanh(g[:, 2 * u :] + (r * h) @ hu[:, 2 * u :])
                new = c + z * (h - c)
                new = h + live[s] * (new - h)
                if keep:
                    steps_kept.append((s, h, z, r, c))
                h = new
                states[s, :, slice(0, u) if d == "f" else slice(u, 2 * u)] = h
            kept[d] = steps_kept
        e = states @ self.p["att"]
        e = np.where(live[:, :, 0] > 0, e, -1e9)
        a = np.exp(e - e.max(0, keepdims=True)) * live[:, :, 0]
        a /= np.maximum(a.sum(0, keepdims=True), 1e-9)
        pooled = np.einsum("tb,tbu->bu", a, states)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (states, live, kept, a, pooled)) if keep else logit

    def backward(self, w: Words, gates, ids, n, cache, slope: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the parameters, where slope is the loss's derivative by each logit."""
        states, live, kept, a, pooled = cache
        u, (b, t) = UNITS, ids.shape
        grad = {"out": pooled.T @ slope, "bias": np.array([slope.sum()], np.float32)}
        d_pooled = slope[:, None] * self.p["out"]
        d_states = a[:, :, None] * d_pooled[None]
        d_a = np.einsum("bu,tbu->tb", d_pooled, states)
        d_e = a * (d_a - (a * d_a).sum(0, keepdims=True))
        grad["att"] = np.einsum("tb,tbu->u", d_e, states)
        d_states += d_e[:, :, None] * self.p["att"]
        d_x = np.zeros((w.n, 2 * DIM), np.float32)
        x = self.inputs(w)
        for d in "fb":
            hu = self.p[f"h{d}"]
            d_hu, by_step = np.zeros_like(hu), []
            d_h = np.zeros((b, u), np.float32)
            part = slice(0, u) if d == "f" else slice(u, 2 * u)
            for s, h, z, r, c in reversed(kept[d]):
                d_h = d_h + d_states[s, :, part]
                d_new = d_h * live[s]
                d_old = d_h - d_new
                d_c = d_new * (1 - z) * (1 - c * c)
                d_z = d_new * (h - c) * z * (1 - z)
                d_rh = d_c @ hu[:, 2 * u :].T
                d_r = d_rh * h * r * (1 - r)
                d_zr = np.concatenate([d_z, d_r], 1)
                d_old += d_new * z + d_rh * r + d_zr @ hu[:, : 2 * u].T
                d_hu[:, : 2 * u] += h.T @ d_zr
                d_hu[:, 2 * u :] += (r * h).T @ d_c
                by_step.append((ids[:, s], np.concatenate([d_zr, d_c], 1)))
                d_h = d_old
            at, rows = (np.concatenate(x) for x in zip(*by_step, strict=True))
            d_g = scattered(np.where(at < 0, w.n, at), rows, w.n + 1)[:-1]
            grad |= {f"h{d}": d_hu, f"x{d}": x.T @ d_g, f"c{d}": d_g.sum(0)}
            d_x += d_g @ self.p[f"x{d}"].T
        met = d_x.any(1)
        part = met[w.owner]
        grad["word"] = scattered(w.word[met], d_x[met, :DIM], WORD_BUCKETS)
        grad["gram"] = scattered(w.gram[part], (d_x[:, DIM:] / np.sqrt(w.grams)[:, None])[w.owner[part]], GRAM_BUCKETS)
        return grad


def table_of(ids: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Word codes of windows as a table, padded with -1 (the last row of the gates)."""
    steps = np.arange(max(1, int(n.max(initial=1))))
    at = np.minimum(first[:, None] + steps, max(0, len(ids) - 1))
    return np.where(steps < n[:, None], ids[at] if len(ids) else -1, -1)


def window_logits(net: Network, texts: pa.Array, batch: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words, np.ndarray, np.ndarray, np.ndarray]:
    words, starts = words_of(texts)
    w = Words(pc.utf8_trim(pc.utf8_lower(words.dictionary), ".,;:!?\"'()"))  # forms that become equal have equal inputs
    gates, ids = net.projected(w), np.asarray(words.indices).astype(np.int64)
    text, first, n = windows(starts)
    logit = np.zeros(len(text), np.float32)
    order = np.argsort(n, kind="stable")
    for at in range(0, len(order), batch):
        some = order[at : at + batch]
        logit[some] = net.forward(gates, table_of(ids, first[some], n[some]), n[some])
    return logit, text, first, w, gates, ids, n


@dataclass
class Model:
    net: Network
    slope: float
    shift: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """A score in [0, 1] for each text."""
        logit, text, *_ = window_logits(self.net, texts)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, text, logit.astype(float))
        return sigmoid(self.slope * best + self.shift)


def fit(texts: list[str], labels: np.ndarray, prior: float, epochs: int = EPOCHS, rate: float = 0.02, seed: int = 0) -> Model:
    """Train on three quarters of the documents, each by its highest window; calibrate on the last quarter for prior."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    cut = max(1, len(order) * 3 // 4)
    train, rest = order[:cut], order[cut:] if len(order) >= 8 else order
    net, first_moment, second_moment, step = Network(seed), {}, {}, 0
    for _ in range(epochs):
        rng.shuffle(train)
        for at in range(0, len(train), 48):
            some = train[at : at + 48]
            logit, text, first, w, gates, ids, n = window_logits(net, pa.array([texts[i] for i in some]))
            top = np.lexsort((-logit, text))[np.searchsorted(np.sort(text), np.arange(len(some)))]
            table = table_of(ids, first[top], n[top])
            out, cache = net.forward(gates, table, n[top], keep=True)
            y = labels[some].astype(np.float32)
            grad = net.backward(w, gates, table, n[top], cache, ((sigmoid(out) - y) / len(some)).astype(np.float32))
            step += 1
            for k, g in grad.items():  # Adam; of the embeddings only the rows that this step has met
                rows = np.flatnonzero(g.any(1)) if k in ("word", "gram") else slice(None)
                g = np.clip(g[rows], -1, 1)
                m, v = first_moment.setdefault(k, np.zeros_like(net.p[k])), second_moment.setdefault(k, np.zeros_like(net.p[k]))
                m[rows] += 0.1 * (g - m[rows])
                v[rows] += 0.001 * (g * g - v[rows])
                net.p[k][rows] -= (rate * m[rows] / (1 - 0.9**step) / (np.sqrt(v[rows] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    model = Model(net, 1.0, 0.0)
    best = np.log(np.clip(model.scores(pa.array([texts[i] for i in rest])), 1e-9, 1 - 1e-9) / np.clip(1 - model.scores(pa.array([texts[i] for i in rest])), 1e-9, 1))
    y = labels[rest].astype(float)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else prior
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    slope, shift = 1.0, 0.0
    for _ in range(300):  # weighted logistic regression on one feature, with a little shrinkage
        p = sigmoid(slope * best + shift)
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-4)
        m = np.array([[np.sum(h * best * best) + 0.5, np.sum(h * best)], [np.sum(h * best), np.sum(h) + 0.5]])
        move = np.linalg.solve(m, [np.sum(g * best) + 0.5 * (slope - 1), np.sum(g)])
        slope, shift = max(0.05, slope - 0.5 * move[0]), shift - 0.5 * move[1]
    model.slope, model.shift = float(slope), float(np.clip(shift, -20, 20))
    return model


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, most_chars: int = MOST_CHARS) -> Model:
    """Fit on a bounded sample of labelled documents whose crc32(doc_id) modulo 4 is not 2, taken in hash order.

    Texts of over most_chars characters are left out of the sample, so that its bytes are bounded too. Null ids and labels
    take no part; an id labelled both ways counts as toxic. Without any example of a class the network learns what there is."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL AND crc32(cast(doc_id AS string)) % 4 <> 2")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic_n, n = known.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    pick = lambda value, most: known.where(f"toxic = {value}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = pick(1, most_toxic).union(pick(0, most_clean)).withColumnsRenamed({"doc_id": "id"})
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.coalesce(F.length("text"), F.lit(0)) <= most_chars).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").collect()
    y = np.array([r.toxic for r in rows])
    if not len(rows):
        return Model(Network(), 1.0, -1.0)
    return fit([r.text or "" for r in rows], y, min(max(toxic_n / max(n, 1), 0.01), 0.5))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, model: Model | None = None) -> DataFrame:
    """Toxicity of every whole text of docs(doc_id, text), learnt from labels(doc_id, toxic).

    Returns a row per input row: doc_id, held_out (crc32 of the id modulo 4 is 2; false for a null id), score (0 to 1),
    predicted (score >= threshold). Null and empty texts are scored as one empty window. Other columns are neither
    read nor returned; an empty table gives no rows. The model is of fixed size and goes to the tasks by broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, labels))

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 2048)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1)).astype(float))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
    held_out = F.coalesce(F.expr("crc32(cast(doc_id AS string)) % 4 = 2"), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.expr(f"int(score >= {threshold})").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without the rows whose text scores threshold or more; all columns come back.

    Null and empty texts are scored as one empty window and stay null or empty. Rows that repeat are scored alike; an
    empty table stays empty. A long text is scored in windows over all of it; memory follows the longest text."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    columns = docs.columns
    at = columns.index("text")

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 2048)):
            yield batch.filter(pa.array(shared.value.scores(batch.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)
