"""License scans by diagonal voting, in DataFrame functions only.

Templates are short phrases, which count where their words stand one after the other, and longer notices, which may be
edited. Hashes of all rolling word k-grams of every text are joined to the places where templates hold them; each hit votes
for a diagonal (place in the text less place in the template). A diagonal with many votes is a core; the votes of
neighbouring diagonals, which insertions and deletions leave behind, are merged into it. A span is reported if its
grams, compared word by word, cover enough of the template and of the span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Label and words of the phrases asked for.
PHRASES = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]

#: Labels and words of notices (well-known public wording), of at most 60 words each.
NOTICES = [
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit-notice", "released under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

#: Words of a k-gram (the shortest phrase has two), share of a template that makes a diagonal a core, similarity of a
#: span that is reported, and how far diagonals that are merged may lie from their core.
K, CORE, SIMILAR, SLACK = 2, 0.3, 0.8, 3
BUCKET = 64

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates(phrases=PHRASES, notices=NOTICES) -> list[tuple]:
    """(template number, label, phrase or not, words)."""
    out = []
    for base, some in ((True, phrases), (False, notices)):
        for label, text in some:
            words = text.split()
            if not K <= len(words) <= 60:
                raise ValueError("templates have 2 to 60 words")
            out.append((len(out), label, base, words))
    return out


def hits(docs: DataFrame, known: list[tuple]) -> DataFrame:
    """(uid, doc_id, n_words, t, at, pos): gram number at of template t stands at word pos; and a row with null t for each
    document. Texts are read once and don't leave their task; only these rows are written."""
    spark = docs.sparkSession
    rows = [(t, at, words[at : at + K]) for t, _, _, words in known for at in range(len(words) - K + 1)]
    table = spark.createDataFrame([*rows, (None, None, [])], "t int, at int, gram array<string>")
    table = table.withColumn("hash", F.expr("if(t IS NULL, 0L, xxhash64(xxhash64(gram[0]), xxhash64(get(gram, 1))))"))
    # Case: A-Z only matters, but for the Kelvin sign, whose lower case is a plain k.
    text = r"lower(replace(coalesce(text, ''), 'K', 'ĸ'))"
    split = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), F.expr(f"regexp_extract_all({text}, r'{WORD}', 0)").alias("words"))
    split = split.withColumn("h", F.expr("transform(words, w -> xxhash64(w))"))
    grams = split.withColumn("hashes", F.expr("transform(h, (x, i) -> xxhash64(x, get(h, i + 1)))"))
    each = grams.select("uid", "doc_id", "words", F.posexplode(F.expr("concat(array(0L), hashes)")).alias("pos", "hash"))
    found = each.join(F.broadcast(table), "hash").where(f"t IS NULL AND pos = 0 OR slice(words, pos, {K}) = gram")
    return materialise(found.select("uid", "doc_id", F.size("words").cast("bigint").alias("n_words"), "t", "at", F.expr("pos - 1 AS pos")))


def spans(found: DataFrame, known: list[tuple]) -> DataFrame:
    """(uid, t, start, end, similarity) of templates in the texts, from hits: each core diagonal that no better one within
    SLACK outdoes (ties: the least diagonal), with what its neighbours add. Words count from 0, end is exclusive; similarity
    is the template's words found over the longer of template and span."""
    facts = found.sparkSession.createDataFrame([(t, base, len(words)) for t, _, base, words in known], "t int, base boolean, words int")
    votes = found.where("t IS NOT NULL").groupBy("uid", "t", F.expr("pos - at").alias("diagonal")).agg(F.expr("bit_or(shiftleft(1L, at))").alias("grams"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    words = lambda g: f"bit_count({g} | shiftleft({g}, 1))"
    votes = votes.join(F.broadcast(facts), "t").withColumn("own", F.expr(words("grams")))
    whole = votes.where("base AND own = words").selectExpr("uid", "t", "diagonal AS start", "diagonal + words AS end", "1D AS similarity")
    loose = votes.where("NOT base")
    core = loose.where(f"own >= {CORE}D * words").selectExpr("uid", "t", "diagonal AS core", f"explode(sequence(floor((diagonal - {SLACK}) / {BUCKET}), floor((diagonal + {SLACK}) / {BUCKET}))) AS bucket")
    near = loose.withColumn("bucket", F.expr(f"floor(diagonal / {BUCKET})")).join(core, ["uid", "t", "bucket"]).where(f"abs(diagonal - core) <= {SLACK}")
    merged = near.groupBy("uid", "t", "core").agg(F.expr("bit_or(grams)").alias("grams"), F.min("first").alias("start"), F.expr(f"max(last + {K})").alias("end"), F.max("words").alias("words"), F.max(F.expr("struct(own, -diagonal)")).alias("best"))
    merged = merged.where("best.col2 = -core").withColumn("similarity", F.expr(f"{words('grams')} / greatest(words, end - start)"))
    return whole.unionByName(merged.select("uid", "t", "start", "end", "similarity"))


def _labels(known: list[tuple], which: str) -> str:
    names = "array(" + ", ".join(f"'{label}'" for _, label, *_ in known) + ")"
    return f"array_join(array_sort(array_distinct(transform(collect_set(if({which}, t, NULL)), t -> {names}[t]))), ',')"


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Licenses in every whole text of docs(doc_id, text).

    Returns a row per input row: doc_id, n_words, n_base (places of phrases), first_word and last_word (their least and
    greatest start; null without any), base_labels and labels (distinct, sorted; the latter with those of notices found with
    similarity 0.8 or more), score (the greatest similarity of a template, below 0.8 too; 0 without a core). A null text
    counts as empty: no words, no labels. Repeated rows each give a row, a null doc_id stays null, other columns are
    ignored; an empty table gives no rows. A text of any length is split in its task, and its hits are dealt on."""
    known = templates(phrases, notices)
    found = hits(docs, known)
    base = f"t < {len(phrases)}"
    places = spans(found, known).selectExpr("uid", "CAST(NULL AS bigint) AS doc_id", "CAST(NULL AS bigint) AS n_words", "t", "CAST(start AS bigint) AS start", "similarity")
    rows = found.where("t IS NULL").selectExpr("uid", "doc_id", "n_words", "t", "CAST(NULL AS bigint) AS start", "CAST(NULL AS double) AS similarity").unionByName(places)
    return (
        rows.groupBy("uid")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_words").alias("n_words"),
            F.expr(f"count_if({base})").alias("n_base"),
            F.expr(f"min(if({base}, start, NULL))").alias("first_word"),
            F.expr(f"max(if({base}, start, NULL))").alias("last_word"),
            F.expr(_labels(known, base)).alias("base_labels"),
            F.expr(_labels(known, f"similarity >= {SIMILAR}D")).alias("labels"),
            F.expr("coalesce(max(similarity), 0D)").alias("score"),
        )
        .drop("uid")
    )


def found_spans(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(doc_id, label, phrase, start, end, similarity) of each place of a phrase and each notice found, as scan reports
    them; start and end in words. Nulls and odd rows as there."""
    known = templates(phrases, notices)
    found = hits(docs, known)
    names = docs.sparkSession.createDataFrame([(t, label, base) for t, label, base, *_ in known], "t int, label string, phrase boolean")
    out = spans(found, known).where(f"similarity >= {SIMILAR}D").join(F.broadcast(names), "t")
    return found.where("t IS NULL").select("uid", "doc_id").join(out, "uid").select("doc_id", "label", "phrase", "start", "end", "similarity")


def _sql() -> str:
    known = templates()
    listed = ", ".join(f"({t}, '{label}', {base}, string_split('{' '.join(words)}', ' '), {K})" for t, label, base, words in known)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
        WITH tpl(t, label, base, words, k) AS (VALUES {listed}),
        tg AS (SELECT t, k, unnest(generate_series(0, len(words) - k)) AS off, words FROM tpl),
        tgram AS (SELECT t, k, off, array_to_string(words[off + 1 : off + k], ' ') AS gram FROM tg),
        d AS MATERIALIZED (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '{WORD}') AS w FROM documents),
        p AS (SELECT uid, w, kk.k, unnest(generate_series(0, len(w) - kk.k)) AS pos FROM d, (SELECT DISTINCT k FROM tpl) kk),
        g AS (SELECT uid, k, pos, array_to_string(w[pos + 1 : pos + k], ' ') AS gram FROM p),
        h AS (SELECT uid, t, off, pos, pos - off AS diagonal FROM g JOIN tgram USING (k, gram)),
        covered AS (SELECT DISTINCT uid, t, diagonal, unnest(generate_series(off, off + k - 1)) AS word, pos FROM h JOIN tpl USING (t)),
        v AS (SELECT uid, t, diagonal, count(DISTINCT word) AS own, min(pos) AS first, max(pos) AS last FROM covered GROUP BY ALL),
        core AS (SELECT uid, t, diagonal AS core FROM v JOIN tpl USING (t) WHERE own >= CASE WHEN base THEN 1.0 ELSE {CORE} END * len(words)),
        n AS (SELECT core.*, v.* EXCLUDE (uid, t) FROM core JOIN tpl USING (t) JOIN v ON v.uid = core.uid AND v.t = core.t AND abs(v.diagonal - core.core) <= CASE WHEN base THEN 0 ELSE {SLACK} END),
        m AS (SELECT n.uid, n.t, core, min(first) AS first, max(last) + max(k) AS stop, max(len(words)) AS size, bool_and(own < coreown OR (own = coreown AND diagonal >= core)) AS best
            FROM n JOIN tpl USING (t) JOIN (SELECT uid, t, diagonal AS core, own AS coreown FROM v) o USING (uid, t, core) GROUP BY n.uid, n.t, core),
        c AS (SELECT n.uid, n.t, core, count(DISTINCT word) AS words FROM n JOIN covered x ON x.uid = n.uid AND x.t = n.t AND x.diagonal = n.diagonal GROUP BY ALL),
        s AS (SELECT m.uid, m.t, core AS start, c.words::DOUBLE / greatest(size, stop - first) AS similarity FROM m JOIN c USING (uid, t, core) WHERE best),
        r AS (SELECT uid, start, similarity, label, base FROM s JOIN tpl USING (t))
        SELECT doc_id, len(w)::BIGINT AS n_words, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
            coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ','), '') AS base_labels,
            coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (similarity >= {SIMILAR}))), ','), '') AS labels, coalesce(max(similarity), 0.0)::DOUBLE AS score
        FROM d LEFT JOIN r USING (uid) GROUP BY uid, doc_id, w"""


ORACLE_SQL = _sql()
