"""Queries of the type, protection and flag coercions."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossaria.functions import types
from glossaria.functions.constants import AVRO_TYPES, COLUMN_ALIASES, DDL_TYPES, FALSE_WORDS, FROM_STRING, GLOSSARY_TYPES, LEVELS, PROTECTION_WORDS, TRUE_WORDS
from glossaria.functions.identifiers import header_key
from glossaria.operators import ingest
from glossaria.queries import sql
from glossaria.queries.fixtures import HEADERS, frame, with_tables
from glossaria.queries.registry import query

_T = with_tables("lit_types")


def _from_string() -> str:
    tests = [(" AND ".join([f"contains(t, '{w}')" for w in need] + [f"NOT contains(t, '{w}')" for w in bar]), f"'{kind}'") for need, bar, kind in FROM_STRING]
    return sql.first_case(tests, "'unknown'")


@query("type_from_string", f"{_T} SELECT type_name, CASE WHEN type_name = '' THEN 'unknown' ELSE {_from_string()} END AS data_type FROM (SELECT type_name, lower(trim(type_name)) AS t FROM lit_types)")
def type_from_string(spark, sf):
    return frame(spark, "lit_types").select("type_name", types.from_string(F.col("type_name")).alias("data_type"))


@query("type_coerce", f"{_T} SELECT type_name, coalesce({sql._map(GLOSSARY_TYPES)}[trim(string_split(lower(trim(type_name)), '(')[1])], 'unknown') AS data_type FROM lit_types")
def type_coerce(spark, sf):
    return frame(spark, "lit_types").select("type_name", types.coerce_glossary(F.col("type_name")).alias("data_type"))


@query("type_map_avro", f"{_T} SELECT type_name, coalesce({sql._map(AVRO_TYPES)}[lower(trim(type_name))], {sql._map(AVRO_TYPES)}[trim(regexp_extract(lower(trim(type_name)), '^([^(<\\[]*)', 1))], 'unknown') AS data_type FROM lit_types")
def type_map_avro(spark, sf):
    return frame(spark, "lit_types").select("type_name", types.coerce_avro(F.col("type_name")).alias("data_type"))


@query("type_parse_ddl", f"{_T} SELECT type_name, {sql.first_case([(f'regexp_matches(upper(trim(type_name)), {chr(39)}^{p}{chr(39)})', f'{chr(39)}{k}{chr(39)}') for p, k in DDL_TYPES], chr(39) + 'unknown' + chr(39))} AS data_type FROM lit_types")
def type_parse_ddl(spark, sf):
    return frame(spark, "lit_types").select("type_name", types.coerce_ddl(F.col("type_name")).alias("data_type"))


@query(
    "protection_coerce",
    f"{with_tables('lit_protection')} SELECT text, CASE WHEN text = '' THEN 'INTERNAL' ELSE {sql.first_case([(f'regexp_matches(t, {chr(39)}(^|[^0-9a-z_]){w}($|[^0-9a-z_]){chr(39)})', f'{chr(39)}{v}{chr(39)}') for w, v in PROTECTION_WORDS], chr(39) + 'INTERNAL' + chr(39))} END AS level "
    "FROM (SELECT text, regexp_replace(regexp_replace(lower(trim(text)), '[-_/]+', ' ', 'g'), '\\s+', ' ', 'g') AS t FROM lit_protection)",
)
def protection_coerce(spark, sf):
    return frame(spark, "lit_protection").select("text", types.protection_level(F.col("text")).alias("level"))


@query("parse_flags", f"{with_tables('lit_flags')} SELECT text, CASE WHEN lower(trim(text)) IN ({sql.quoted(TRUE_WORDS)}) THEN TRUE WHEN lower(trim(text)) IN ({sql.quoted(FALSE_WORDS)}) THEN FALSE END AS flag FROM lit_flags")
def parse_flags(spark, sf):
    return frame(spark, "lit_flags").select("text", types.parse_flag(F.col("text")).alias("flag"))


_ALIAS_ROWS = ", ".join(f"('{field}', '{name}', {i})" for field, names in COLUMN_ALIASES.items() for i, name in enumerate(names))


@query(
    "column_alias_map",
    f"{with_tables('lit_headers')}, a AS (SELECT * FROM (VALUES {_ALIAS_ROWS}) AS t(field, alias, preference)), h AS (SELECT ordinal, header, regexp_replace(lower(header), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS k FROM lit_headers) "
    "SELECT field, header FROM (SELECT field, header, row_number() OVER (PARTITION BY field ORDER BY preference, ordinal) AS r FROM a JOIN h ON a.alias = h.k) WHERE r = 1",
)
def column_alias_map(spark, sf):
    rows = [(field, name, i) for field, names in COLUMN_ALIASES.items() for i, name in enumerate(names)]
    aliases = spark.createDataFrame(rows, "field string, alias string, preference int")
    hit = aliases.join(frame(spark, "lit_headers").withColumn("alias", header_key(F.col("header"))), "alias")
    return hit.groupBy("field").agg(F.min_by("header", F.struct("preference", "ordinal")).alias("header"))


def _column_map_rows() -> list[tuple[str, str]]:
    return sorted(ingest.map_columns(HEADERS).items())


@query("column_map_driver", "SELECT * FROM (VALUES ('business_name', 'Business Name'), ('data_type', 'SQL Type'), ('definition', 'Description'), ('domain', 'Subject Area'), ('governance_code', 'Protection Class'), ('id', 'Term ID'), ('logical_name', 'Logical-Name'), ('protection_level', 'Sensitivity')) AS t(field, header)")
def column_map_driver(spark, sf):
    return spark.createDataFrame(_column_map_rows(), "field string, header string")


_PAIRS = f"{with_tables('lit_category_of')} SELECT a.type_name AS src, b.type_name AS dst FROM lit_category_of a, lit_category_of b"


def _type_pairs(spark):
    kinds = [r[0] for r in frame(spark, "lit_category_of").select("type_name").collect()]
    return spark.createDataFrame([(a, b) for a in kinds for b in kinds], "src string, dst string")


@query("type_signal", f"SELECT src, dst, CAST({sql.type_signal('src', 'dst')} AS DOUBLE) AS score FROM ({_PAIRS})")
def type_signal(spark, sf):
    return _type_pairs(spark).select("src", "dst", types.type_signal(F.col("src"), F.col("dst")).alias("score"))


_COMPAT = (
    f"{with_tables('lit_category_of', 'lit_matrix', 'lit_categories')}, p AS (SELECT a.type_name AS src, b.type_name AS dst, a.category AS ca, b.category AS cb FROM lit_category_of a, lit_category_of b), "
    "s AS (SELECT p.src, p.dst, CASE WHEN p.src = p.dst THEN 1.0 ELSE coalesce(m.score, c.score, 0.5) END AS score FROM p LEFT JOIN lit_matrix m ON m.src = p.src AND m.dst = p.dst LEFT JOIN lit_categories c ON c.src = ca AND c.dst = cb)"
)


@query("type_compat", f"{_COMPAT} SELECT src, dst, score, {sql.first_case([(f'score >= {v}', f'{chr(39)}{n}{chr(39)}') for v, n in LEVELS[:-1]], chr(39) + LEVELS[-1][1] + chr(39))} AS level FROM s")
def type_compat(spark, sf):
    score = types.type_compatibility(F.col("src"), F.col("dst"))
    return _type_pairs(spark).select("src", "dst", score.alias("score")).withColumn("level", types.compatibility_level(F.col("score")))


@query("compatible_types", f"{_COMPAT} SELECT src, string_agg(dst, ',' ORDER BY dst) AS targets, count(*) AS n FROM s WHERE score >= 0.5 GROUP BY src")
def compatible_types(spark, sf):
    hit = _type_pairs(spark).filter(types.type_compatibility(F.col("src"), F.col("dst")) >= 0.5)
    return hit.groupBy("src").agg(F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("targets"), F.count(F.lit(1)).alias("n"))


@query(
    "type_vocab",
    f"{with_tables('lit_types', 'lit_category_of')}, v AS (SELECT type_name AS word, row_number() OVER (ORDER BY type_name) AS id FROM lit_category_of), t AS (SELECT DISTINCT lower(trim(type_name)) AS name FROM lit_types), "
    "hit AS (SELECT name, v.id, row_number() OVER (PARTITION BY name ORDER BY (name = word) DESC, length(word) DESC, id) AS r FROM t JOIN v ON starts_with(name, word)), known AS (SELECT name, id FROM hit WHERE r = 1), "
    "fresh AS (SELECT name, (SELECT max(id) FROM v) + row_number() OVER (ORDER BY name) AS id FROM t WHERE name NOT IN (SELECT name FROM known)) SELECT name, id FROM known UNION ALL SELECT name, id FROM fresh",
)
def type_vocab(spark, sf):
    """Ids of type names: the word itself, else its longest known prefix, else a new id."""
    from pyspark.sql import Window

    words = frame(spark, "lit_category_of").select(F.col("type_name").alias("word")).withColumn("id", F.row_number().over(Window.orderBy("word")))
    names = frame(spark, "lit_types").select(F.lower(F.trim("type_name")).alias("name")).distinct()
    best = names.join(words, F.col("name").startswith(F.col("word"))).groupBy("name").agg(F.min_by("id", F.struct((F.col("name") != F.col("word")).alias("x"), (-F.length("word")).alias("l"), "id")).alias("id"))
    fresh = names.join(best, "name", "left_anti").withColumn("id", F.row_number().over(Window.orderBy("name")) + words.count())
    return best.union(fresh).select("name", F.col("id").cast("long").alias("id"))
