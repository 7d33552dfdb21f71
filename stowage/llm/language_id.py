"""Language of pages by Bayesian evidence fusion.

The likelihood of a page's visible text comes from byte runs counted over the texts of known language. What pages
declare in their markup, the suffix of their address and their host are further evidence; how it depends on the
language is learned from the pages themselves by grouped sums of the text's posteriors. A host's prior is smoothed
by its domain's, and that by all pages'; a page doesn't count among the evidence for itself.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import keyed, written
from ._words import U, buffers, lean, mix, slices

#: Buckets of the byte runs; the model has so many numbers a language.
BUCKETS = 1 << 15
RUN = 3
#: Weight of a run's log likelihood, for neighbouring runs overlap; the most that one page's text may say, in nats.
TEMPER, MOST = 0.3, 40.0
#: Rows that a prior counts as, of the level above, and rows of smoothing for markup and suffix.
HOST_ROWS, DOMAIN_ROWS, EVIDENCE_ROWS = 10.0, 20.0, 2.0
#: A domain outweighs its hosts' suffix evidence, which it shares; so this counts less.
SUFFIX_WEIGHT = 0.5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER[[b for b in range(0x80) if not chr(b).isalpha()]] = 0x20
_HIDING = re.compile(r"<(script|style)\b", re.IGNORECASE)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style")}
DECLARED = r"(?i)<html[^<>]*\blang\s*=\s*[\"']?([a-z]+)"
#: Languages that are told apart; what else is declared, in a column that holds anything, counts as OTHER.
MOST_LANGUAGES, OTHER = 256, "und"


def visible(page: str) -> str:
    """The page without comments, scripts, styles and tags, each a blank, and with its character references resolved.

    What isn't closed counts as a tag, or as text where no tag ends after it. One pass: what was not found once is not
    looked for again, so a page takes time in proportion to its length.
    """
    found, at, open_ended = [], 0, set()
    while (start := page.find("<", at)) >= 0:
        end = 0
        if page.startswith("<!--", start) and "comment" not in open_ended:
            end = page.find("-->", start + 4) + 3
            if end < 3:
                end = 0
                open_ended.add("comment")
        elif (hiding := _HIDING.match(page, start)) and (name := hiding[1].lower()) not in open_ended:
            if closing := _ENDS[name].search(page, hiding.end()):
                end = closing.end()
            else:
                open_ended.add(name)
        if not end and not (end := page.find(">", start) + 1):
            break
        found += [page[at:start], " "]
        at = end
    return html.unescape("".join([*found, page[at:]]))


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte runs (letters folded, all else a blank) and the row of each; no run spans rows."""
    at = offsets - offsets[0]
    low = _LOWER[data[offsets[0] : offsets[-1]]].astype(U)
    n = max(0, len(low) - RUN + 1)
    key = np.zeros(n, U)
    for j in range(RUN):
        key |= low[j : j + n] << U(8 * j)
    row = np.searchsorted(at, np.arange(n), side="right") - 1
    fits = (np.arange(n) + RUN <= at[row + 1]) & (key != 0x202020)
    return (mix(key[fits]) % U(BUCKETS)).astype(np.int64), row[fits]


def count_runs(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over all texts of known language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                names, code = np.unique(np.array(part.column("lang").to_pylist(), object).astype(str), return_inverse=True)
                bucket, row = _runs(*buffers(part.column("text")))
                counts = np.bincount(code[row] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for name, own in zip(names.tolist(), counts, strict=True):
                    total[name] = total.get(name, 0) + own
        for name, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(own[at])], ["lang", "bucket", "n"])

    known = _named(docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")))
    return known.mapInArrow(lean(run), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _named(known: DataFrame) -> DataFrame:
    """``known`` with at most MOST_LANGUAGES languages: those with the most texts stay, all others are one, OTHER."""
    most = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(most) <= MOST_LANGUAGES:
        return known
    own = [r.lang for r in most[: MOST_LANGUAGES - 1]]
    return known.withColumn("lang", F.when(F.col("lang").isin(own), F.col("lang")).otherwise(OTHER))


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by code point and their log likelihoods by bucket; as large as the languages are many, MOST_LANGUAGES at most, whatever the input."""
    rows = count_runs(docs).toPandas()
    langs = sorted(rows["lang"].unique().tolist()) or ["und"]
    counts = np.full((len(langs), BUCKETS), 0.5)
    if len(rows):
        counts[[langs.index(x) for x in rows["lang"]], rows["bucket"].to_numpy(np.int64)] += rows["n"].to_numpy(float)
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True))


def text_evidence(pages: DataFrame, logs: np.ndarray) -> DataFrame:
    """page_id, host, domain, suffix, declared, and the text's log likelihood by language, its largest 0."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    source = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), DECLARED, 1)).alias("declared"), F.coalesce("html", F.lit("")).alias("html")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = pa.array([visible(x) for x in part.column("html").to_pylist()], pa.string())
                bucket, row = _runs(*buffers(texts))
                found = TEMPER * np.stack([np.bincount(row, own[bucket], part.num_rows) for own in logs], axis=1)
                found = np.maximum(found - found.max(axis=1, keepdims=True), -MOST)
                at = pa.array(np.arange(0, found.size + 1, len(logs)), pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "host", "declared")), pa.ListArray.from_arrays(at, pa.array(found.ravel()))], ["page_id", "host", "declared", "said"])

    rows = source.mapInArrow(lean(run), "page_id long, host string, declared string, said array<double>")
    return rows.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).withColumn("suffix", F.regexp_extract("host", r"([^.]+)$", 1))


def _normal(logs: Column) -> Column:
    """Probabilities from an array of logs."""
    raised = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _sums(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """Sums of the posteriors p by keys, as one array, and the rows of each."""
    return rows.groupBy(*keys).agg(F.array(*(F.sum(F.col("p")[i]) for i in range(n))).alias(name), F.count(F.lit(1)).alias(f"{name}_rows"))


def _smoothed(counts: Column, prior: Column, rows: float) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(counts, prior, lambda c, q: (F.greatest(c, F.lit(0.0)) + rows * q) / (F.greatest(total, F.lit(0.0)) + rows))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, lang, confidence, text_lang, declared, host.

    lang is the language (of those that ``docs`` declare in lang, up to MOST_LANGUAGES) with the largest posterior, confidence its
    probability; ties go to the first by code point. text_lang goes by the text alone. Null pages have no text, null
    addresses no host (''); such pages are told by the other evidence, at last by the prior. Rows are scored one by one,
    so repeated rows and null ids come out as they are, though they count as evidence each; an empty table gives no
    rows. Without documents all pages are 'und'. Columns that aren't named here are not looked at.
    """
    langs, logs = fit(docs)
    n = len(langs)
    each = lambda x: F.array(*(F.lit(x) for _ in langs))
    rows = text_evidence(pages, logs)
    rows = written(rows.withColumn("p", _normal(F.col("said"))), "lang-text")
    # one row a host, domain, suffix, declaration
    hosts = written(_sums(rows, ["host", "domain", "suffix"], n, "host_n"), "lang-hosts")
    summed = lambda keys, name: hosts.groupBy(*keys).agg(F.array(*(F.sum(F.col("host_n")[i]) for i in range(n))).alias(name), F.count(F.lit(1)).alias(f"{name}_rows"))
    suffixes, domains = summed(["suffix"], "suffix_n"), summed(["domain"], "domain_n")
    first = hosts.agg(F.array(*(F.coalesce(F.sum(F.col("host_n")[i]), F.lit(0.0)) for i in range(n))).alias("t"), F.count(F.lit(1)).alias("hosts"), F.sum("host_n_rows").alias("pages")).first()
    totals, n_hosts, n_pages = first["t"], first["hosts"], first["pages"] or 0
    overall = (np.array(totals) + 1) / (sum(totals) + n)
    base, size = F.array(*(F.lit(float(x)) for x in overall)), F.array(*(F.lit(float(x) + 1) for x in totals))
    declared = written(_sums(rows, ["declared"], n, "declared_n"), "lang-declared")
    hosts = keyed(keyed(hosts, domains, ["domain"], "domain_n_rows", n_hosts), suffixes, ["suffix"], "suffix_n_rows", n_hosts)
    hosts = written(hosts.select("host", "host_n", "host_n_rows", "domain_n", "suffix_n"), "lang-priors")

    found = keyed(keyed(rows.drop("domain", "suffix"), hosts, ["host"], "host_n_rows", n_pages), declared, ["declared"], "declared_n_rows", n_pages)
    less = lambda c: F.zip_with(F.col(c), F.col("p"), lambda a, b: a - b)
    prior = _smoothed(less("host_n"), _smoothed(less("domain_n"), base, DOMAIN_ROWS), HOST_ROWS)
    # P(value | language), smoothed by the value's share of all pages
    share = lambda c: F.aggregate(less(c), F.lit(0.0), lambda a, b: a + b) / F.lit(float(sum(totals)) + 1.0)
    given = lambda c: F.zip_with(less(c), size, lambda a, b: (F.greatest(a, F.lit(0.0)) + EVIDENCE_ROWS * F.greatest(share(c), F.lit(1e-6))) / (b + EVIDENCE_ROWS))
    logs_of = lambda c, w=1.0: F.transform(c, lambda x: F.lit(w) * F.log(x))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    found = found.select(
        "page_id", "host", "declared", "said", logs_of(prior).alias("prior"), logs_of(given("declared_n")).alias("markup"), logs_of(given("suffix_n"), SUFFIX_WEIGHT).alias("address")
    )
    said_so = F.when(F.col("declared") != "", F.col("markup")).otherwise(each(0.0))
    found = found.withColumn("post", _normal(add(add("said", "prior"), add(said_so, F.when(F.col("host") != "", F.col("address")).otherwise(each(0.0))))))
    names = F.array(*map(F.lit, langs))
    best = lambda c: names[(F.array_position(F.col(c), F.array_max(c)) - 1).cast("int")]
    return found.select("page_id", best("post").alias("lang"), F.array_max("post").alias("confidence"), best("said").alias("text_lang"), "declared", "host")
