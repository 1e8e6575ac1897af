"""Queries of loading and synchronising glossaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossaria.functions.identifiers import content_hash
from glossaria.operators import ingest, sync
from glossaria.queries.fixtures import frame, with_tables
from glossaria.queries.registry import query, table

_G = with_tables("lit_glossary")
_ADMIT = {"status": ["Approved", "draft"], "data_type": ["string", "text", "date", "double", "decimal", "bigint"]}
_BAD = "lower(trim(status)) NOT IN ('approved', 'draft')"
_BADTYPE = "lower(trim(data_type)) NOT IN ('string', 'text', 'date', 'double', 'decimal', 'bigint')"


@query("admit_rows", f"{_G} SELECT id, business_name FROM lit_glossary WHERE NOT ({_BAD}) AND NOT ({_BADTYPE})")
def admit_rows(spark, sf):
    return ingest.require_admitted(ingest.admit_rows(frame(spark, "lit_glossary"), _ADMIT)).select("id", "business_name")


@query("admit_refused_by_column", f"{_G} SELECT col AS \"column\", count(*) AS refused FROM (SELECT CASE WHEN {_BAD} THEN 'status' WHEN {_BADTYPE} THEN 'data_type' END AS col FROM lit_glossary) WHERE col IS NOT NULL GROUP BY col")
def admit_refused_by_column(spark, sf):
    return ingest.refused_by_column(frame(spark, "lit_glossary"), _ADMIT)


@query("admit_parts", "SELECT p_partkey, p_brand FROM part WHERE lower(trim(p_brand)) IN ('brand#11', 'brand#23') AND p_type IN (SELECT DISTINCT p_type FROM part WHERE p_size < 10)")
def admit_parts(spark, sf):
    part = table(spark, sf, "part")
    kept = ingest.admit_rows(part, {"p_brand": ["BRAND#11", " Brand#23"]})
    return kept.join(part.filter("p_size < 10").select(F.col("p_type").alias("t")).distinct(), F.col("p_type") == F.col("t"), "left_semi").select("p_partkey", "p_brand")


_REPORT = (
    "count(*) AS rows, count(*) FILTER (WHERE none) AS unmatchable, count(*) FILTER (WHERE NOT none) AS loaded, count(*) FILTER (WHERE NOT none AND trim(definition) <> '') AS with_definition, "
    "count(*) FILTER (WHERE NOT none AND trim(domain) <> '') AS with_domain, count(DISTINCT CASE WHEN NOT none THEN lower(trim(business_name)) END) AS distinct_names"
)


@query("load_report", f"{_G} SELECT {_REPORT} FROM (SELECT *, trim(business_name) = '' AND trim(definition) = '' AS none FROM lit_glossary)")
def load_report(spark, sf):
    return ingest.load_report(frame(spark, "lit_glossary"))


@query("load_stats", "SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed, round(count(*) FILTER (WHERE ok) / count(*), 6) AS success_rate FROM (SELECT c_acctbal >= 0 AS ok FROM customer)")
def load_stats(spark, sf):
    return ingest.load_stats(table(spark, sf, "customer"), F.when(F.col("c_acctbal") < 0, "negative balance"))


@query("validation_quarantine", f"{_G} SELECT id, CASE WHEN trim(business_name) = '' THEN 'no business name' END AS reason FROM lit_glossary WHERE trim(business_name) = ''")
def validation_quarantine(spark, sf):
    return ingest.validate(frame(spark, "lit_glossary"))[1].select("id", "reason")


_DERIVED = "substr(sha256(concat_ws('|', p_name, p_brand)), 1, 16)"


@query(
    "entry_ids",
    f"SELECT p_partkey, CASE WHEN own <> '' THEN own WHEN n = 1 THEN base ELSE base || '-' || n END AS entry_id FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN own = '' THEN base END ORDER BY p_partkey) AS n FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'P' || p_partkey ELSE '' END AS own, {_DERIVED} AS base FROM part))",
)
def entry_ids(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("P"), F.col("p_partkey").cast("string"))).otherwise("").alias("id"), F.col("p_name").alias("business_name"), F.col("p_brand").alias("logical_name"))
    return ingest.entry_ids(rows, "p_partkey").select("p_partkey", "entry_id")


_META = "[{'k': 'brand', 'v': p_brand}, {'k': 'name', 'v': p_name || ' ' || p_name}, {'k': 'note', 'v': repeat('x', CAST(p_size AS INTEGER))}, {'k': 'type', 'v': p_type}]"


@query(
    "metadata_bound",
    f"WITH e AS (SELECT p_partkey, unnest({_META}) AS m FROM part), s AS (SELECT p_partkey, m.k AS k, octet_length(encode(m.k)) + octet_length(encode(m.v)) AS n FROM e), c AS (SELECT *, sum(n) OVER (PARTITION BY p_partkey ORDER BY n, k ROWS UNBOUNDED PRECEDING) AS total FROM s) "
    "SELECT p_partkey, coalesce(string_agg(k, ',' ORDER BY k) FILTER (WHERE total <= 80), '') AS kept, count(*) FILTER (WHERE total > 80) > 0 AS metadata_truncated FROM c GROUP BY p_partkey",
)
def metadata_bound(spark, sf):
    m = F.create_map(F.lit("brand"), "p_brand", F.lit("name"), F.concat_ws(" ", "p_name", "p_name"), F.lit("note"), F.expr("repeat('x', cast(p_size AS int))"), F.lit("type"), "p_type")
    rows = ingest.bound_metadata(table(spark, sf, "part").select("p_partkey", m.alias("source_metadata")), 80)
    return rows.select("p_partkey", F.array_join(F.array_sort(F.map_keys("source_metadata")), ",").alias("kept"), "metadata_truncated")


_CELLS = "SELECT p_name || ';' || p_brand AS cell FROM part"


@query("delimiter_detect", f"SELECT name, round(avg(hit), 6) AS share, count(*) AS n FROM (SELECT unnest([{{'name': 'comma', 'hit': contains(cell, ',')::INT}}, {{'name': 'semicolon', 'hit': contains(cell, ';')::INT}}, {{'name': 'tab', 'hit': contains(cell, chr(9))::INT}}, {{'name': 'pipe', 'hit': contains(cell, '|')::INT}}], recursive := true) FROM ({_CELLS})) GROUP BY name")
def delimiter_detect(spark, sf):
    cells = table(spark, sf, "part").select(F.concat_ws(";", "p_name", "p_brand").alias("cell"))
    return ingest.delimiter_shares(cells, {"comma": ",", "semicolon": ";", "tab": "\t", "pipe": "|"})


@query("wrong_delimiter", "SELECT 'semicolon' AS name, 1.0::DOUBLE AS share")
def wrong_delimiter(spark, sf):
    return ingest.wrong_delimiter(delimiter_detect(spark, sf), "comma")


@query("value_tally_top5", "SELECT p_type AS value, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, value LIMIT 5")
def value_tally_top5(spark, sf):
    return ingest.value_tally(table(spark, sf, "part"), "p_type")


_LEFT = "SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part WHERE p_size <= 30"
_RIGHT = "SELECT p_name, p_retailprice, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part WHERE p_size > 20"


@query("nth_occurrence_join", f"SELECT l.p_partkey, l.p_name, CAST(l.n AS INTEGER) AS occurrence, r.p_retailprice FROM ({_LEFT}) l LEFT JOIN ({_RIGHT}) r ON r.p_name = l.p_name AND r.n = l.n")
def nth_occurrence_join(spark, sf):
    p = table(spark, sf, "part")
    return ingest.nth_occurrence_join(p.filter("p_size <= 30").select("p_partkey", "p_name"), p.filter("p_size > 20").select("p_partkey", "p_name", "p_retailprice"), "p_name", "p_partkey").select("p_partkey", "p_name", "occurrence", "p_retailprice")


@query("ffill_merged", "SELECT p_partkey, last_value(CASE WHEN p_partkey % 3 = 1 THEN p_name END IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS cell FROM part")
def ffill_merged(spark, sf):
    cell = F.when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise("")
    return ingest.fill_merged(table(spark, sf, "part").select("p_partkey", "p_brand", cell.alias("cell")), "cell", "p_brand", "p_partkey").select("p_partkey", "cell")


def _snapshots(spark, sf):
    d = table(spark, sf, "documents").filter("doc_id is not null")
    changed = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" [MODIFIED]"))).otherwise(F.col("text"))
    hashed = lambda text: F.coalesce(content_hash(text), F.lit(""))
    before = d.filter("doc_id % 10 <> 0").select(F.col("doc_id").alias("entry_id"), hashed(changed).alias("hash"))
    after = d.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("entry_id"), hashed(F.col("text")).alias("hash"))
    return before, after


_DIFF = (
    "WITH p AS (SELECT doc_id AS entry_id, coalesce(sha256(CASE WHEN doc_id % 11 = 0 THEN text || ' [MODIFIED]' ELSE text END), '') AS hash FROM documents WHERE doc_id % 10 <> 0), c AS (SELECT doc_id AS entry_id, coalesce(sha256(text), '') AS hash FROM documents WHERE doc_id % 7 <> 0), "
    "d AS (SELECT coalesce(p.entry_id, c.entry_id) AS entry_id, CASE WHEN p.hash IS NULL THEN 'added' WHEN c.hash IS NULL THEN 'removed' WHEN p.hash <> c.hash THEN 'updated' ELSE 'unchanged' END AS change FROM p FULL OUTER JOIN c ON c.entry_id = p.entry_id)"
)


@query("sync_diff", f"{_DIFF} SELECT entry_id, change FROM d")
def sync_diff(spark, sf):
    return sync.diff(*_snapshots(spark, sf)).select("entry_id", "change")


@query("change_detect", f"{_DIFF} SELECT change, count(*) AS n, min(entry_id) AS first_id FROM d GROUP BY change")
def change_detect(spark, sf):
    return sync.diff(*_snapshots(spark, sf)).groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.min("entry_id").alias("first_id"))


@query(
    "sync_report",
    f"{_DIFF}, k AS (SELECT count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'updated') AS updated, count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'unchanged') AS unchanged, count(*) AS n FROM d) "
    "SELECT added, updated, removed, unchanged, added + updated AS to_embed, round(100.0 * unchanged / (added + updated + unchanged), 6) AS savings_pct, round((added + updated + removed) / n, 6) AS change_ratio FROM k",
)
def sync_report(spark, sf):
    return sync.report(sync.diff(*_snapshots(spark, sf)))


@query("sync_embed_plan", f"{_DIFF} SELECT entry_id, CASE WHEN change = 'unchanged' THEN 'keep' ELSE 'embed' END AS action FROM d WHERE change <> 'removed'")
def sync_embed_plan(spark, sf):
    before, after = _snapshots(spark, sf)
    fresh, kept = sync.embed_plan(sync.diff(before, after), after, before)
    return fresh.select("entry_id", F.lit("embed").alias("action")).union(kept.select("entry_id", F.lit("keep").alias("action")))
