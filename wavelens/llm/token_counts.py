"""Token counts of whole texts without their ids.

Every text becomes its pre-token frequencies. Pieces of the commonest pre-tokens (a bounded head, found in a bounded
sample; it only saves work) are counted once beforehand and summed where the frequencies arise. All other pre-tokens
are dealt by their text, so that each distinct one meets all its documents in one partition, is counted there once
and joined to the frequencies; sums by document follow.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .pretokens import WORD_PATTERN, Splitter, is_near, slices

HEAD = 131_072
SAMPLE_DOCS = 6_000


@lru_cache(2)
def library(path: str) -> tuple[Tokenizer, list[str]]:
    """The tokenizer, and the special strings that it takes out of a text first."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, [t.content for t in tokenizer.get_added_tokens_decoder().values()]


class Frequencies:
    """A text's pre-token frequencies; special strings are counted apart."""

    def __init__(self, path: str):
        self.tokenizer, self.special = library(path)
        self.split = Splitter(WORD_PATTERN)

    def __call__(self, text: str) -> tuple[Counter, int]:
        parts, n = [text], 0
        for s in self.special:
            if s in text:
                parts = [x for part in parts for x in part.split(s)]
        n = len(parts) - 1
        out: Counter = Counter()
        for part in parts:
            low = part.lower() if is_near(part) else self.tokenizer.normalizer.normalize_str(part)
            for pieces in self.split(low):
                out.update(pieces)
        return out, n


def pieces_of(path: str, words: list[str]) -> list[int]:
    """The number of tokens of each pre-token."""
    tokenizer, _ = library(path)
    return [len(e.ids) for e in tokenizer.encode_batch(words, add_special_tokens=False)]


def frequent(docs: DataFrame, path: str, head: int = HEAD, sample_docs: int = SAMPLE_DOCS) -> dict[str, int]:
    """The commonest pre-tokens of a bounded sample of docs(uid, doc_id, text) and their numbers of tokens; at most head of them."""
    n = docs.count()
    some = docs.where(f"pmod(xxhash64(uid), {max(1, -(-n // sample_docs))}) = 0")

    def words(batches):
        frequencies = Frequencies(path)
        for batch in (part for whole in batches for part in slices(whole)):
            total: Counter = Counter()
            for text in batch.column(0).to_pylist():
                total.update(frequencies(text or "")[0].keys())
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def count(batches):
        for batch in batches:
            w = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(pieces_of(path, w), pa.int64())], ["word", "n"])

    top = some.select("text").mapInArrow(words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = top.where(F.length("word") < 64).orderBy(F.desc("n"), "word").limit(head).select("word")
    return {r.word: r.n for r in top.mapInArrow(count, "word string, n bigint").collect()}


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text of docs(doc_id, text).

    A null text counts as empty (0 bytes, 0 tokens). Repeated rows each give a row, a null doc_id stays null, other
    columns are ignored. Special strings inside a text are one token each, as the library takes them by default.
    """
    path = tokenizer_path
    keyed = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    known = docs.sparkSession.sparkContext.broadcast(frequent(keyed, path))  # at most HEAD pre-tokens under 64 characters
    kind = T.StructType.fromDDL("uid bigint, doc_id bigint, n_bytes bigint, n bigint, word string")
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def batch_of(columns):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], kind.names)

    def frequencies_of(batches):
        frequencies, head = Frequencies(path), known.value
        for batch in (part for whole in batches for part in slices(whole)):
            out = [[], [], [], [], []]
            for uid, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, n = frequencies(text or "")
                rest = []
                for word, f in found.items():
                    if (m := head.get(word)) is None:
                        rest.append((uid, None, None, f, word))
                    else:
                        n += m * f
                rest.append((uid, doc_id, len((text or "").encode("utf-8", "replace")), n, None))
                for column, values in zip(out, zip(*rest, strict=True), strict=True):
                    column.extend(values)
            yield batch_of(out)

    def join_counts(batches):
        """Rows come in order of their pre-token, so each distinct one is counted once and only the last is remembered; rows
        of documents' own sums pass through."""
        counts: dict[str, int] = {}
        for batch in batches:
            uid, doc_id, n_bytes, n, word = (c.to_pylist() for c in batch.columns)
            new = list({w for w in word if w is not None and w not in counts})
            counts.update(zip(new, pieces_of(path, new), strict=True))
            n = [f if w is None else f * counts[w] for f, w in zip(n, word, strict=True)]
            yield batch_of([uid, doc_id, n_bytes, n, [None] * len(uid)])
            counts = {word[-1]: counts[word[-1]]} if word and word[-1] is not None else {}

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed.mapInArrow(frequencies_of, kind)
    rows = rows.repartition(parts, F.coalesce(F.col("word"), F.col("uid").cast("string"))).sortWithinPartitions("word").mapInArrow(join_counts, kind)
    # A null doc_id is the maximum of nulls alone.
    total = rows.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return total.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
