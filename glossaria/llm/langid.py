"""Language identification by Bayesian evidence fusion.

The posterior of a language is proportional to: the likelihood of the text
under hashed byte-trigram frequencies of each language, tempered because
trigrams aren't independent; the probability of the declared markup language
given the language; and a prior of the address, smoothed hierarchically from
all rows to the address suffix, the registered domain and the host. The
frequencies, the declaration table and the priors are grouped aggregations
over all rows; priors and declarations count each row's most likely language
by text, and a row's own vote is taken out of the counts that judge it, so its
text is heard once. What goes to every task is one vector of ``BUCKETS`` numbers for each
language, and more than ``MAX_LANGUAGES`` languages are refused.

Defined results: null or empty text carries no evidence, so address and
declaration decide, and with neither it is ``und`` if the prior is flat; a
null address is the empty host; rows with a null training language aren't
trained on; with no training rows every language is ``und``; repeated rows
are judged alike; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaria.llm import textkit as tk
from glossaria.llm.storage import materialise
from glossaria.llm.url_filter import host_of

BUCKETS = 4096
MAX_LANGUAGES = 200
#: Trigrams that count in full; more of them are scaled down to so many.
EVIDENCE = 40.0
GLOBAL_PRIOR, SUFFIX_PRIOR, DOMAIN_PRIOR, HOST_PRIOR = 1.0, 50.0, 20.0, 10.0
#: Pseudo declarations of a language's own name, and of every other one.
DECLARED_PRIOR, OTHER_PRIOR = 5.0, 0.1
MIN_CONFIDENCE = 0.5
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_HIDDEN = re.compile(r"<(script|style|nav|header|footer)\b", re.I)
_CLOSING = re.compile(r"</(script|style|nav|header|footer)\s*>", re.I)
DECLARED = r"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"


def visible(html: str | None) -> str:
    """Text of a page without markup, scripts, styles and navigation, by one pass.

    A hidden element ends at its first closing tag; one without is a plain tag.
    """
    html = html or ""
    starts: dict[str, list[int]] = {}
    ends: dict[str, list[int]] = {}
    for m in _CLOSING.finditer(html):
        starts.setdefault(m[1].lower(), []).append(m.start())
        ends.setdefault(m[1].lower(), []).append(m.end())
    out, at, comments = [], 0, True
    while (i := html.find("<", at)) >= 0:
        out.append(html[at:i])
        end = 0
        if m := _HIDDEN.match(html, i):
            name = m[1].lower()
            k = bisect_left(starts.get(name, []), m.end())
            end = ends[name][k] if k < len(ends.get(name, [])) else 0
        elif comments and html.startswith("<!--", i):
            end = html.find("-->", i + 4) + 3
            comments = end > 2
            end = end if comments else 0
        end = end or html.find(">", i) + 1
        if not end:
            at = i
            break
        out.append(" ")
        at = end
    out.append(html[at:])
    return "".join(out)


def trigram_buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of byte trigrams (A-Z folded) that lie within a row, and row offsets."""
    each = np.maximum(np.diff(off) - 2, 0)
    rows = np.concatenate([[0], np.cumsum(each)])
    if not rows[-1]:
        return np.zeros(0, np.int64), rows
    b = _LOWER[data]
    key = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    key = (key * np.uint32(2654435761)) >> np.uint32(20)
    at = np.arange(rows[-1]) + np.repeat(off[:-1] - rows[:-1], each)
    return key[at].astype(np.int64), rows


def train(docs: DataFrame, language: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their log frequencies, (languages, BUCKETS), from all labelled rows."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in tk.slices(whole, "text"):
                langs = np.array(batch.column(1).to_pylist(), dtype=object)
                keys, rows = trigram_buckets(*tk.utf8(batch.column(0)))
                of = langs[tk.row_of(rows)]
                for x in set(langs):
                    counts = np.bincount(keys[of == x], minlength=BUCKETS)
                    total[x] = total[x] + counts if x in total else counts
        for x, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(counts[some].astype(np.int64))], names=["lang", "bucket", "n"])

    source = docs.filter(F.col(language).isNotNull() & F.col("text").isNotNull()).select("text", F.col(language).cast("string").alias("lang"))
    counts = materialise(source.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "langid-counts")
    names = [r["lang"] for r in counts.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.full((len(names), BUCKETS), 0.5)
    for r in counts.toLocalIterator():  # at most MAX_LANGUAGES * BUCKETS rows
        table[names.index(r["lang"]), r["bucket"]] += r["n"]
    return names, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def evidence(rows: DataFrame, model: tuple[list[str], np.ndarray], is_html: bool) -> DataFrame:
    """``rows``' columns without text, and ``ll``: the tempered log-likelihood of each language."""
    _, table = model
    keep = [c for c in rows.columns if c != "text"]

    def run(batches):
        for whole in batches:
            for batch in tk.slices(whole, "text"):
                column = batch.column(batch.schema.names.index("text"))
                if is_html:
                    column = pa.array([visible(x) for x in column.to_pylist()], pa.string())
                keys, at = trigram_buckets(*tk.utf8(column))
                n = np.diff(at)
                scale = np.minimum(1.0, EVIDENCE / np.maximum(n, 1))
                ll = np.zeros((len(n), len(table)))
                for i, logs in enumerate(table):
                    total = np.concatenate([[0.0], np.cumsum(logs[keys], dtype=np.float64)])
                    ll[:, i] = (total[at[1:]] - total[at[:-1]]) * scale
                ll -= ll.max(axis=1, keepdims=True) if len(table) else 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ll.size + 1, max(1, len(table)), dtype=np.int32) if len(table) else np.zeros(len(n) + 1, np.int32)), pa.array(ll.ravel().round(6)))
                cols = [batch.column(batch.schema.names.index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, lists], names=[*keep, "ll"])

    schema = rows.select(*keep).schema.add("ll", T.ArrayType(T.DoubleType()))
    return rows.select(*keep, "text").mapInArrow(run, schema)


def _summed(table: DataFrame, level: str, name: str, size: int) -> DataFrame:
    """``level`` and its votes ``name``: for each language, then all of them."""
    return table.groupBy(F.col(level).alias(f"_{name}")).agg(F.array(*[F.sum(F.get("votes", F.lit(i))) for i in range(size)]).alias(name))


def fuse(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` (host, declared, ll, ...) with lang, confidence and text_lang.

    ``rows`` should be materialised: it is read for the priors and the result.
    """
    spread = F.array_max("ll") - F.array_min("ll")
    best = F.array_position("ll", F.array_max("ll"))
    by_text = F.when((F.size("ll") > 0) & (spread > 0), F.get(F.array(*map(F.lit, names)) if names else F.lit(None).cast("array<string>"), (best - 1).cast("int")))
    rows = rows.withColumn("text_lang", by_text)
    if not names:
        return rows.withColumn("lang", F.lit("und")).withColumn("confidence", F.lit(0.0))
    k = len(names)
    votes = F.array(*[F.count_if(F.col("text_lang") == x) for x in names], F.count("text_lang")).alias("votes")
    parts = F.split("host", r"\.")
    at = rows.groupBy("host").agg(votes).withColumn("suffix", F.element_at(parts, -1)).withColumn("domain", F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2))))
    hosts = materialise(at, "langid-hosts")
    domains, suffixes = _summed(hosts, "domain", "by_domain", k + 1), _summed(hosts, "suffix", "by_suffix", k + 1)
    overall = hosts.agg(*[F.sum(F.get("votes", F.lit(i))) for i in range(k + 1)]).first()
    tables = hosts.join(domains, F.col("domain") == F.col("_by_domain")).join(suffixes, F.col("suffix") == F.col("_by_suffix")).select(F.col("host").alias("_host"), "votes", "by_domain", "by_suffix")
    tables = materialise(tables, "langid-priors")

    # P(declared | language): its declarations, with pseudo ones that favour its own name
    heard = rows.filter("declared is not null").groupBy(F.col("declared").alias("_said")).agg(votes.alias("said_by"))
    said = materialise(heard, "langid-declared")
    kinds = said.count()
    totals = said.agg(*[F.coalesce(F.sum(F.get("said_by", F.lit(i))), F.lit(0)) for i in range(k)]).first()
    known = {r["_said"] for r in said.filter(F.col("_said").isin(names)).select("_said").collect()}

    got = rows.join(tables, F.col("host") == F.col("_host"), "left").join(said, F.col("declared") == F.col("_said"), "left")
    voted = F.col("text_lang").isNotNull().cast("int")
    posts = []
    for i, x in enumerate(names):
        own = F.coalesce((F.col("text_lang") == x).cast("int"), F.lit(0))
        prior = (F.lit(overall[i] or 0) - own + GLOBAL_PRIOR / k) / (F.lit(overall[k] or 0) - voted + GLOBAL_PRIOR)
        for name, weight in (("by_suffix", SUFFIX_PRIOR), ("by_domain", DOMAIN_PRIOR), ("votes", HOST_PRIOR)):
            prior = (F.get(name, F.lit(i)) - own + weight * prior) / (F.get(name, F.lit(k)) - voted + weight)
        others = kinds - (x in known)
        pseudo = F.when(F.col("declared") == x, DECLARED_PRIOR).otherwise(OTHER_PRIOR)
        saying = (F.get("said_by", F.lit(i)) - own + pseudo) / (F.lit(totals[i]) - own + DECLARED_PRIOR + OTHER_PRIOR * others)
        posts.append(F.get("ll", F.lit(i)) + F.log(prior) + F.coalesce(F.log(saying), F.lit(0.0)))
    got = got.withColumn("_post", F.array(*posts)).withColumn("_top", F.array_max("_post"))
    confidence = 1 / F.aggregate("_post", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    lang = F.get(F.array(*map(F.lit, names)), (F.array_position("_post", F.col("_top")) - 1).cast("int"))
    got = got.withColumn("confidence", F.round(confidence, 6))
    sure = F.col("confidence") > 1.0 / k + 1e-6 if k > 1 else F.lit(True)
    return got.withColumn("lang", F.when(sure, lang).otherwise("und"))


def identify(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """kind, doc_id, page_id, host, declared, text_lang, lang, confidence, kept.

    Documents are judged by text and by their source as address, pages by
    visible text, declared markup language and host. ``kept`` is whether the
    language is known with ``MIN_CONFIDENCE``.
    """
    model = train(documents)
    docs = documents.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.coalesce("source", F.lit("")).alias("host"), F.lit(None).cast("string").alias("declared"), "text")
    said = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), DECLARED, 1))
    web = pages.select(F.lit("page").alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), F.when(said != "", said).alias("declared"), F.col("html").alias("text"))
    rows = materialise(evidence(docs, model, False).union(evidence(web, model, True)), "langid-evidence")
    out = fuse(rows, model[0])
    return out.select("kind", "doc_id", "page_id", "host", "declared", "text_lang", "lang", "confidence", ((F.col("lang") != "und") & (F.col("confidence") >= MIN_CONFIDENCE)).alias("kept"))
