"""Secret scans by multipart credential linking, in DataFrame functions only.

Strong patterns are reported as such. Weak candidates (short access identifiers, mixed tokens, endpoints) are parts of
a credential: an interval join within scopes of a text reports them only where complementary parts co-occur. Parts of a
text don't overlap: overlapping candidates are settled first, so that no part is its own complement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, row_key

#: Kind, pattern, the rest of what a match must meet, a cheap test that any match implies.
BASE = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(regexp_extract(m, {p}, 1)) >= 6", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    ("access", r"AKIA[A-Z0-9]+", "length(m) >= 20", r"AKIA"),
    ("hex", r"[0-9a-f]+", "length(m) >= 24", r"[0-9a-f]{{24}}"),
]
WEAK = [
    ("weak_access", r"(?:AKIA|ASIA)[A-Z0-9]{8,}", "true", r"A[KS]IA[A-Z0-9]{{8}}"),
    ("weak_secret", r"[A-Za-z0-9+/_-]{16,}", "m RLIKE '[0-9]' AND m RLIKE '[A-Za-z]'", r"[A-Za-z0-9+/_-]{{16}}"),
    ("endpoint", r"https?://[^\s\x22'<>]+", "true", r"https?://"),
]
KINDS = [k for k, *_ in BASE + WEAK]
PART = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "access", "weak_access": "access", "endpoint": "endpoint"}
SCOPE = 200


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _pieces(kind: str, pattern: str, also: str, quick: str) -> str:
    """SQL: the text's matches of pattern in turn, each with the length of what lies before it."""
    p = _quoted(pattern)
    also = also.format(p=p)
    matches = f"transform(regexp_extract_all(text, {p}, 0), m -> named_struct('len', length(m), 'ok', {also}))"
    gaps = f"transform(split(text, {p}, -1), g -> length(g))"
    row = f"zip_with({matches}, {gaps}, (m, g) -> named_struct('kind', {KINDS.index(kind)}, 'gap', g, 'len', m.len, 'ok', m.ok))"
    none = "cast(array() AS array<struct<kind:int,gap:int,len:int,ok:boolean>>)"
    return f"CASE WHEN text RLIKE {_quoted(quick.replace('{{', '{').replace('}}', '}'))} THEN transform(filter({row}, x -> x.len IS NOT NULL), (x, i) -> named_struct('kind', x.kind, 'gap', x.gap, 'len', x.len, 'ok', x.ok, 'i', i)) ELSE transform({none}, (x, i) -> named_struct('kind', x.kind, 'gap', x.gap, 'len', x.len, 'ok', x.ok, 'i', i)) END"


def matches(docs: DataFrame) -> DataFrame:
    """(key, doc_id, found): all matches of all patterns in each whole text, written down once without the text."""
    each = ", ".join(_pieces(*x) for x in BASE + WEAK)
    base = docs.select(row_key("doc_id", "text").alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return materialise(base.select("key", "doc_id", F.expr(f"concat({each})").alias("found")))


def _clear_of(rows: DataFrame, stronger: str) -> DataFrame:
    """rows(key, kind, start, end) without those that overlap a row of a kind for which stronger holds (rows of such a
    kind stay)."""
    over = F.expr(f"""
        coalesce(max(if({stronger}, end, NULL)) OVER (PARTITION BY key ORDER BY start RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > start, false)
        OR coalesce(min(if({stronger}, start, NULL)) OVER (PARTITION BY key ORDER BY start RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) < end, false)""")
    return rows.withColumn("over", over).where(f"({stronger}) OR NOT over").select("key", "kind", "start", "end")


def spans(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(key, kind, start, end) of what is reported: strong spans, and weak ones whose complements lie within scope.

    A weak access identifier needs a secret, a weak secret an access identifier, an endpoint both. A weak candidate that
    overlaps a strong span is dropped, then a weak access identifier or secret that overlaps an endpoint (it is part of
    an address), then a weak secret that overlaps a weak access identifier. So complements are other, disjoint spans.
    Distances are between the nearest ends, in code points."""
    one = found.where("size(found) > 0").dropDuplicates(["key"]).select("key", F.inline("found"))
    placed = one.withColumn("start", F.expr("sum(gap + len) OVER (PARTITION BY key, kind ORDER BY i ROWS UNBOUNDED PRECEDING) - len"))
    parts = placed.where("ok").selectExpr("key", "kind", "start", "start + len AS end")
    strong, access, endpoint = f"kind < {len(BASE)}", KINDS.index("weak_access"), KINDS.index("endpoint")
    for stronger in (strong, f"{strong} OR kind = {endpoint}", f"{strong} OR kind = {endpoint} OR kind = {access}"):
        parts = _clear_of(parts, stronger)
    parts = materialise(parts)
    part = "CASE " + " ".join(f"WHEN kind = {i} THEN '{PART[k]}'" for i, k in enumerate(KINDS)) + " END"
    # A summary row for each scope-wide bucket that a part touches; parts are clipped to it.
    touched = parts.withColumn("part", F.expr(part)).where("part <> 'endpoint'").withColumn("bucket", F.expr(f"explode(sequence(start DIV {scope}, end DIV {scope}))"))
    summary = touched.groupBy("key", "part", "bucket").agg(F.min(F.expr(f"greatest(start, bucket * {scope})")).alias("first"), F.max(F.expr(f"least(end, (bucket + 1) * {scope})")).alias("last"))
    asks = parts.where(f"NOT {strong}").withColumn("part", F.expr(part))
    asks = asks.withColumn("need", F.expr("explode(CASE part WHEN 'access' THEN array('secret') WHEN 'secret' THEN array('access') ELSE array('access', 'secret') END)"))
    asks = asks.withColumn("near", F.expr(f"explode(sequence(greatest(start - {scope}, 0) DIV {scope}, (end + {scope}) DIV {scope}))"))
    met = asks.alias("a").join(summary.alias("s"), F.expr("a.key = s.key AND a.need = s.part AND a.near = s.bucket")).where(f"s.last >= a.start - {scope} AND s.first <= a.end + {scope}")
    linked = met.groupBy("a.key", "a.kind", "a.start", "a.end").agg(F.countDistinct("a.need").alias("n")).where(f"n = CASE WHEN kind = {endpoint} THEN 2 ELSE 1 END")
    return parts.where(strong).select("key", "kind", "start", "end").union(linked.select("key", "kind", "start", "end"))


def _listed(spans_column: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans_column}, s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')"


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Secrets in every whole text of docs(doc_id, text).

    Returns a row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans ('kind:start:end', by start and
    then kind; code points, end exclusive). A null text counts as empty: no spans. Repeated rows each give a row, a
    null doc_id stays null, other columns are ignored; an empty table gives no rows. Texts are read once, however long;
    only matches are shuffled.
    """
    found = matches(docs)
    listed = spans(found, scope).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"))
    out = found.select("key", "doc_id").join(listed, "key", "left").withColumn("all", F.expr("coalesce(all, array())")).withColumn("base", F.expr(f"filter(all, s -> s.kind < {len(BASE)})"))
    count = lambda k: F.expr(f"cast(size(filter(base, s -> s.kind = {KINDS.index(k)})) AS bigint)").alias(f"n_{k}")
    return out.select("doc_id", *(count(k) for k, *_ in BASE), F.expr(f"sha2({_listed('base')}, 256)").alias("base_sha256"), F.expr(_listed("all")).alias("spans"))


def redacted(docs: DataFrame, scope: int = SCOPE, mark: str = "[REDACTED]") -> DataFrame:
    """docs with every reported span of text replaced by mark (overlapping ones by one mark); all columns come back and
    n_chars, where there is one, is the new length. A null text stays null, texts without spans and repeated rows stay as
    they are; an empty table stays empty."""
    listed = spans(matches(docs), scope).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__wl_spans")).withColumnRenamed("key", "__wl_key")
    joined = docs.join(listed, row_key("doc_id", "text") == F.col("__wl_key"), "left")
    text = F.expr(f"""
        CASE WHEN __wl_spans IS NULL THEN text ELSE aggregate(__wl_spans, named_struct('pos', 0L, 'out', array('')),
            (a, s) -> named_struct('pos', greatest(a.pos, s.end), 'out',
                CASE WHEN s.start < a.pos THEN a.out ELSE concat(a.out, array(substring(text, int(a.pos + 1), int(s.start - a.pos)), '{mark}')) END),
            a -> concat(array_join(a.out, ''), substring(text, int(a.pos + 1)))) END""")
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
