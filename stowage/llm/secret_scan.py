"""Secret scans with multipart credential linking, in DataFrame operations only.

One scan finds the matches of every pattern as lengths of matches and of the text between them; running sums of
these are the spans. Access identifiers, secrets and endpoints are the parts of a credential. Weak candidates (an
identifier by its name only, a short secret, an address) are reported only where parts of the other kinds stand
near in the same scope, the paragraph: an interval join over bins as wide as the distance, in which every bin keeps
its first and last part only, so that no pairs are listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import written

_NAME_END = r"""["']?\x20*[:=]\x20*["']?"""
#: Kinds in the order in which spans of one start are listed; the first three are the base.
PATTERNS = {
    "assign": rf"(?i)(password|passwd|secret|token|api_?key){_NAME_END}([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{16,}",
    "ident": rf"(?i)(user_?name|user|login|account|client_?id|access_?key_?id){_NAME_END}([A-Za-z0-9._@-]+)",
    "endpoint": r"(?:https?|postgres|mysql|mongodb|redis|amqp|ftp)://[A-Za-z0-9._~:@/?=&%+-]+",
    "break": r"\n[\x20\x09\x0D]*\n",
}
KINDS = ("assign", "access", "hex", "ident", "endpoint", "weak")
BASE = 3
#: Shortest values: of base secrets and access identifiers, of weak secrets and of named identifiers.
SECRET, ACCESS, WEAK, IDENT = 12, 18, 6, 3
#: Code points between the starts of two parts of one credential, at most.
NEAR = 200

_ROLE = {"assign": "secret", "hex": "secret", "weak": "secret", "access": "access", "ident": "access", "endpoint": "endpoint"}
#: Of each weak kind, the roles of the parts it needs; one of them is enough for a secret, an identifier or an address needs a secret.
_NEEDS = {"weak": ("access", "endpoint"), "ident": ("secret",), "endpoint": ("secret",)}


def _matches(text: Column, kind: str) -> Column:
    """Of each match: code points before it since the last match, its own, and those of its value."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = (lambda m: F.length(F.regexp_extract(m, pattern, 2))) if "([A-Za-z" in pattern else F.length
    sizes = F.transform(found, lambda m: F.struct(F.length(m).alias("n"), value(m).alias("v")))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    none = F.array().cast("array<struct<gap:int,n:int,v:int>>")
    zipped = F.zip_with(F.slice(gaps, 1, F.size(found)), sizes, lambda g, s: F.struct(g.alias("gap"), s["n"].alias("n"), s["v"].alias("v")))
    return F.when(F.size(found) > 0, zipped).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, row_id and the sizes of all matches, an array for each pattern; written, with no text in it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hits = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(_matches(text, k).alias(k) for k in PATTERNS))
    return written(hits.withColumn("row_id", F.monotonically_increasing_id()), "secret-scan")


def parts(hits: DataFrame) -> DataFrame:
    """row_id, kind, start, end, scope of all matches that are long enough; scope counts the breaks before."""
    each = [hits.select("row_id", F.lit(k).alias("kind"), F.posexplode(k).alias("at", "m")) for k in PATTERNS]
    every = each[0]
    for other in each[1:]:
        every = every.union(other)
    order = Window.partitionBy("row_id", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.n")).over(order)
    spans = every.select("row_id", "kind", (end - F.col("m.n")).alias("start"), end.alias("end"), F.col("m.v").alias("v"))
    kind = F.when((F.col("kind") == "assign") & (F.col("v") < SECRET), F.when(F.col("v") >= WEAK, "weak")).otherwise(F.col("kind"))
    long_enough = ((F.col("kind") != "access") | (F.col("v") >= ACCESS)) & ((F.col("kind") != "ident") | (F.col("v") >= IDENT))
    spans = spans.where(long_enough).withColumn("kind", kind).where("kind is not null")
    before = Window.partitionBy("row_id").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    return spans.withColumn("scope", F.count(F.when(F.col("kind") == "break", 1)).over(before)).where("kind <> 'break'").drop("v")


def linked(spans: DataFrame) -> DataFrame:
    """Weak candidates near a part that complements them: row_id, kind, start, end."""
    role = F.create_map(*(F.lit(x) for pair in _ROLE.items() for x in pair))
    placed = spans.withColumn("role", role[F.col("kind")]).withColumn("bin", F.floor(F.col("start") / NEAR).cast("long"))
    bins = placed.groupBy("row_id", "scope", "role", "bin").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    needs = F.create_map(*(x for k, roles in _NEEDS.items() for x in (F.lit(k), F.array(*map(F.lit, roles)))))
    wanted = placed.where(F.col("kind").isin(*_NEEDS)).select("row_id", "scope", "kind", "start", "end", "bin", F.explode(needs[F.col("kind")]).alias("role"))
    wanted = wanted.select("row_id", "scope", "kind", "start", "end", "role", F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1)).alias("bin"))
    # in the own bin all starts are near; of the bin before the last is nearest, of the one after the first
    near = (F.col("start") - F.col("hi") <= NEAR) & (F.col("lo") - F.col("start") <= NEAR)
    return wanted.join(bins, ["row_id", "scope", "role", "bin"]).where(near).select("row_id", "kind", "start", "end").distinct()


def find_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows (row_id, doc_id), and the spans that are reported (row_id, kind, start, end)."""
    hits = scan(docs)
    spans = written(parts(hits), "secret-parts")
    return hits.select("row_id", "doc_id"), spans.where(F.col("kind").isin(*KINDS[:BASE])).select("row_id", "kind", "start", "end").union(linked(spans))


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. The base kinds are assign, access
    and hex; ident, endpoint and weak are reported where they are linked. Null and empty texts have no spans; rows are
    independent, so repeated rows and null ids come out as they are; an empty table gives no rows. Columns other than
    doc_id and text are not looked at. What is written and shuffled are spans, never texts.
    """
    rows, spans = find_spans(docs)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    named = F.struct("start", rank.alias("rank"), F.concat_ws(":", "kind", "start", "end").alias("name"))
    base = F.col("kind").isin(*KINDS[:BASE])
    by_row = spans.groupBy("row_id").agg(
        *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS[:BASE]),
        F.count(F.when(~base, 1)).alias("n_linked"),
        F.sort_array(F.collect_list(F.when(base, named))).alias("base"),
        F.sort_array(F.collect_list(named)).alias("every"),
    )
    joined = lambda c: F.concat_ws(",", F.transform(F.coalesce(c, F.array().cast("array<struct<start:bigint,rank:bigint,name:string>>")), lambda s: s["name"]))
    counts = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS[:BASE]]
    return rows.join(by_row, "row_id", "left").select(
        "doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("every")).alias("spans"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked")
    )


def _oracle() -> str:
    """The same rows by listing all pairs of parts of a paragraph."""
    quoted = {k: p.replace("'", "''") for k, p in PATTERNS.items()}
    value = lambda k: f"len(regexp_extract(m, '{quoted[k]}', 2))" if "([A-Za-z" in PATTERNS[k] else "len(m)"
    found = " UNION ALL ".join(
        f"""SELECT doc_id, '{k}' AS kind, i, len(m) AS n, {value(k)} AS v,
                   list_sum(list_transform(gaps[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0) AS start
            FROM (SELECT doc_id, ms, gaps, unnest(ms) AS m, generate_subscripts(ms, 1) AS i
                  FROM (SELECT doc_id, regexp_extract_all(t, '{quoted[k]}') AS ms, string_split_regex(t, '{quoted[k]}') AS gaps FROM texts))"""
        for k in PATTERNS
    )
    roles = " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in _ROLE.items())
    ranks = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS))
    needs = " OR ".join(f"(c.kind = '{k}' AND p.role IN ({', '.join(repr(r) for r in rs)}))" for k, rs in _NEEDS.items())
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
spans AS (
  SELECT doc_id, CASE WHEN kind = 'assign' AND v < {SECRET} THEN CASE WHEN v >= {WEAK} THEN 'weak' END ELSE kind END AS kind,
         CAST(start AS BIGINT) AS s, CAST(start + n AS BIGINT) AS e
  FROM found WHERE NOT (kind = 'access' AND v < {ACCESS}) AND NOT (kind = 'ident' AND v < {IDENT})),
scoped AS (
  SELECT *, CASE kind {roles} END AS role,
         (SELECT count(*) FROM spans b WHERE b.doc_id = a.doc_id AND b.kind = 'break' AND b.s <= a.s) AS scope
  FROM spans a WHERE kind IS NOT NULL AND kind <> 'break'),
reported AS (
  SELECT doc_id, kind, s, e FROM scoped c
  WHERE kind IN ('assign', 'access', 'hex')
     OR EXISTS (SELECT 1 FROM scoped p WHERE p.doc_id = c.doc_id AND p.scope = c.scope AND abs(p.s - c.s) <= {NEAR} AND ({needs}))),
named AS (SELECT *, CASE kind {ranks} END AS r, kind || ':' || s || ':' || e AS name FROM reported),
rows_ AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         count(*) FILTER (r >= {BASE}) AS n_linked,
         string_agg(name, ',' ORDER BY s, r) FILTER (r < {BASE}) AS base, string_agg(name, ',' ORDER BY s, r) AS spans
  FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM documents d LEFT JOIN rows_ USING (doc_id)
"""


ORACLE_SQL = _oracle()
