"""Queries of benchmark building."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossaria.operators import benchmarks, rerank
from glossaria.queries import sql
from glossaria.queries.fixtures import frame, with_tables
from glossaria.queries.registry import query, table

_COLS = f"{with_tables('lit_fields')}, c AS (SELECT lower(parent_path || '.' || name) AS id, min({{'t': parent_path, 'n': name, 'd': trim(regexp_replace(description, '\\s+', ' ', 'g')), 'k': data_type}}) AS r FROM lit_fields WHERE trim(description) <> '' AND parent_path <> '' GROUP BY 1)"


def _columns(spark):
    return frame(spark, "lit_fields").filter("parent_path <> ''").select(F.col("parent_path").alias("table_name"), F.col("name").alias("column_name"), "description", "data_type")


@query("benchmark_queries", f"{_COLS} SELECT 'q:' || id AS id, r.n AS field_name, r.t || '.' || r.n AS field_path, lower(r.k) AS data_type, r.t AS parent_path, id AS gold_id FROM c")
def benchmark_queries(spark, sf):
    return benchmarks.build(_columns(spark))[1]


@query("benchmark_entries", f"{_COLS} SELECT id, {sql.humanize('r.d')} AS lowered_name, lower(r.n) AS logical_name, r.t AS domain FROM c")
def benchmark_entries(spark, sf):
    return benchmarks.build(_columns(spark))[0].select("id", F.lower("business_name").alias("lowered_name"), "logical_name", "domain")


@query("truth_pipe_split", "SELECT p_partkey, CAST(len(ids) AS INTEGER) AS n, array_to_string(ids, ',') AS ids FROM (SELECT p_partkey, list_filter(string_split(p_brand || '|' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END, '|'), lambda x: x <> '') AS ids FROM part)")
def truth_pipe_split(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.concat_ws("|", "p_brand", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("")).alias("correct_ids"))
    return benchmarks.split_truth(rows).select("p_partkey", F.size("correct_ids").alias("n"), F.array_join("correct_ids", ",").alias("ids"))


_H = lambda x: f"CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT) / 4294967296.0"


@query(
    "distractors",
    f"{with_tables('lit_glossary')}, e AS (SELECT id, business_name, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM lit_glossary WHERE business_name <> ''), x AS (SELECT i, CAST(floor({_H(chr(39) * 2 + ' || i || ' + repr('|1|a'))} * (SELECT max(n) FROM e)) AS BIGINT) AS a, CAST(floor({_H(chr(39) * 2 + ' || i || ' + repr('|1|b'))} * (SELECT max(n) FROM e)) AS BIGINT) AS b FROM range(0, 300 - (SELECT max(n) FROM e)) t(i)) "
    "SELECT id, business_name FROM e UNION ALL SELECT 'X-' || i, string_split(l.business_name, ' ')[1] || ' ' || string_split(r.business_name, ' ')[-1] FROM x JOIN e l ON l.k = a JOIN e r ON r.k = b",
)
def distractors(spark, sf):
    return benchmarks.distractors(frame(spark, "lit_glossary").filter("business_name <> ''").select("id", "business_name"), 300)


@query(
    "degrade_catalog",
    f"{with_tables('lit_abbrev')}, k AS (SELECT long, min(short) AS short FROM lit_abbrev GROUP BY long), u AS (SELECT *, row_number() OVER (ORDER BY {_H('long || ' + repr('|1|keep'))}, long) AS r, count(*) OVER () AS n FROM k), kept AS (SELECT * FROM u WHERE r <= round(0.6 * n)), "
    f"w AS (SELECT *, row_number() OVER o AS w, count(*) OVER () AS m, coalesce(lead(short) OVER o, first_value(short) OVER o) AS other FROM kept WINDOW o AS (ORDER BY {_H('long || ' + repr('|1|wrong'))}, long)) SELECT long, CASE WHEN w <= round(m * 0.2) THEN other ELSE short END AS short, w <= round(m * 0.2) AS wrong FROM w",
)
def degrade_catalog(spark, sf):
    standard = frame(spark, "lit_abbrev").groupBy("long").agg(F.min("short").alias("short"))
    return benchmarks.degrade(standard, 0.6, 0.2)


@query("naming_standard")
def naming_standard(spark, sf):
    words = [w for r in frame(spark, "lit_glossary").select("business_name").collect() for w in r[0].split()]
    standard = benchmarks.naming_standard(words)
    table_ = F.create_map(*[F.lit(x) for kv in standard.items() for x in kv])
    return frame(spark, "lit_glossary").select("id", benchmarks.abbreviate(F.col("business_name"), table_).alias("short_name"))


@query("mirror_pairs", f"{with_tables('lit_fields')}, n AS (SELECT field_key AS key, full_path AS path, CASE WHEN ordinal % 5 = 0 THEN 'mirror of ' || lag(full_path) OVER (ORDER BY ordinal) ELSE '' END AS note FROM lit_fields) SELECT a.key AS mirror, b.key AS mirrored FROM n a JOIN n b ON a.note = 'mirror of ' || b.path")
def mirror_pairs(spark, sf):
    from pyspark.sql import Window

    before = F.lag("full_path").over(Window.orderBy("ordinal"))
    rows = frame(spark, "lit_fields").select(F.col("field_key").alias("key"), F.col("full_path").alias("path"), F.when(F.col("ordinal") % 5 == 0, F.coalesce(F.concat(F.lit("mirror of "), before), F.lit(""))).otherwise("").alias("note"))
    return benchmarks.mirror_pairs(rows)


@query("rerank_pairs", "SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY (rank <= 3) DESC, CASE WHEN rank <= 3 THEN s END DESC, rank) AS INTEGER) AS rank FROM (SELECT l_orderkey AS query_id, l_partkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice) AS rank, round(l_discount, 6) AS s FROM lineitem)")
def rerank_pairs(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), F.row_number().over(order).alias("rank"), "l_discount")
    return rerank.rerank(rows, F.col("l_discount"), 3).select("query_id", "doc_id", "rank")
