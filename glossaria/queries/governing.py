"""Queries of the protection classes and domain trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossaria.functions import scoring
from glossaria.functions.constants import FALSE_WORDS, NAME_DOMAINS, PATH_DOMAINS, TRUE_WORDS
from glossaria.functions.identifiers import identifier_tokens
from glossaria.operators import domains, governance
from glossaria.queries import sql
from glossaria.queries.fixtures import frame, with_tables
from glossaria.queries.registry import query

_G = with_tables("lit_glossary", "lit_classes", "lit_aliases")
_N = lambda x: f"regexp_replace(upper({x}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_RES = (
    f"{_G}, r AS (SELECT g.*, {_N('g.code')} AS k, d.code AS direct_code, a.token IS NOT NULL AS is_alias, v.code AS via FROM lit_glossary g LEFT JOIN lit_classes d ON {_N('d.code')} = {_N('g.code')} "
    f"LEFT JOIN lit_aliases a ON {_N('a.token')} = {_N('g.code')} LEFT JOIN lit_classes v ON {_N('v.code')} = {_N('a.target')}), "
    "res AS (SELECT *, CASE WHEN k = '' THEN 'absent' WHEN coalesce(direct_code, via) IS NOT NULL THEN 'known' WHEN is_alias AND via IS NULL THEN 'dropped' ELSE 'unknown' END AS resolution, CASE WHEN k <> '' THEN coalesce(direct_code, via) END AS class_code FROM r)"
)


def _three(spark):
    g = frame(spark, "lit_glossary").withColumnRenamed("status", "row_status")
    return g, frame(spark, "lit_classes"), frame(spark, "lit_aliases")


@query("governance_resolve", f"{_RES} SELECT id, resolution, class_code FROM res")
def governance_resolve(spark, sf):
    return governance.resolve(*_three(spark)).select("id", F.col("status").alias("resolution"), "class_code")


_FLAG = lambda x: f"CASE WHEN lower(trim({x})) IN ({sql.quoted(TRUE_WORDS)}) THEN TRUE WHEN lower(trim({x})) IN ({sql.quoted(FALSE_WORDS)}) THEN FALSE END"
_TIER = lambda x: f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


@query(
    "governance_problems",
    f"{_RES} SELECT id, problems FROM (SELECT res.id, concat_ws(',', CASE WHEN resolution = 'unknown' THEN 'unknown code' END, CASE WHEN resolution = 'known' AND trim(res.classification) <> '' AND {_TIER('res.classification')} <> {_TIER('c.classification')} THEN 'classification' END, "
    f"CASE WHEN resolution = 'known' AND {_FLAG('personal')} <> c.personal_information THEN 'personal information' END, CASE WHEN resolution = 'known' AND {_FLAG('direct')} <> c.direct_identifier THEN 'direct identifier' END) AS problems FROM res LEFT JOIN lit_classes c ON c.code = res.class_code) WHERE problems <> ''",
)
def governance_problems(spark, sf):
    return governance.problems(*_three(spark)).select("id", F.array_join("problems", ",").alias("problems"))


@query("governance_unresolved", f"{_RES} SELECT id, code FROM res WHERE resolution = 'unknown'")
def governance_unresolved(spark, sf):
    return governance.unresolved(*_three(spark))


@query("governance_norm", f"{_G} SELECT id, {_N('code')} AS code_key, {_TIER('classification')} AS tier_key FROM lit_glossary")
def governance_norm(spark, sf):
    return frame(spark, "lit_glossary").select("id", governance.norm_code(F.col("code")).alias("code_key"), governance.norm_tier(F.col("classification")).alias("tier_key"))


@query("governance_changed", f"{_G} SELECT id, nullif(code, '') AS before, CASE WHEN ordinal % 3 = 0 THEN 'P4' ELSE nullif(code, '') END AS after FROM lit_glossary WHERE nullif(code, '') IS DISTINCT FROM CASE WHEN ordinal % 3 = 0 THEN 'P4' ELSE nullif(code, '') END")
def governance_changed(spark, sf):
    g = frame(spark, "lit_glossary").select("id", "ordinal", F.nullif("code", F.lit("")).alias("code"))
    now = g.select("id", F.when(F.col("ordinal") % 3 == 0, "P4").otherwise(F.col("code")).alias("code"))
    return governance.changed(g.select("id", "code"), now)


_CLOSURE = f"{with_tables('lit_domains')}, up AS (SELECT name, name AS ancestor, 0 AS distance, parent AS nxt FROM lit_domains UNION ALL SELECT up.name, up.nxt, up.distance + 1, d.parent FROM up JOIN lit_domains d ON d.name = up.nxt)"


@query("domain_closure", f"{_CLOSURE} SELECT name, ancestor, distance FROM up")
def domain_closure(spark, sf):
    return domains.closure(frame(spark, "lit_domains"))


@query("domain_paths", f"{_CLOSURE} SELECT name, string_agg(ancestor, '/' ORDER BY distance DESC) AS path, max(distance) AS depth FROM up GROUP BY name")
def domain_paths(spark, sf):
    return domains.paths(frame(spark, "lit_domains"))


_REL = (
    f"{_CLOSURE}, n AS (SELECT name FROM lit_domains UNION ALL SELECT 'NOWHERE'), p AS (SELECT x.name AS a, y.name AS b FROM n x, n y), "
    "c AS (SELECT p.a, p.b, l.distance AS da, r.distance AS db, row_number() OVER (PARTITION BY p.a, p.b ORDER BY r.distance, l.distance) AS k FROM p JOIN up l ON l.name = p.a JOIN up r ON r.name = p.b AND r.ancestor = l.ancestor), "
    "rel AS (SELECT p.a, p.b, CASE WHEN da = 0 AND db = 0 THEN 'EXACT' WHEN da = 0 THEN 'PARENT' WHEN db = 0 THEN 'CHILD' WHEN da = 1 AND db = 1 THEN 'SIBLING' WHEN da <= 2 AND db <= 2 THEN 'COUSIN' ELSE 'UNRELATED' END AS relation, p.a = 'NOWHERE' OR p.b = 'NOWHERE' AS outside FROM p LEFT JOIN c ON c.a = p.a AND c.b = p.b AND c.k = 1)"
)
_SCORE = "CAST(CASE WHEN outside THEN 0.5 ELSE CASE relation WHEN 'EXACT' THEN 1.0 WHEN 'PARENT' THEN 0.85 WHEN 'CHILD' THEN 0.80 WHEN 'SIBLING' THEN 0.70 WHEN 'COUSIN' THEN 0.50 ELSE 0.25 END END AS DOUBLE)"


@query("domain_score", f"{_REL} SELECT a, b, relation, {_SCORE} AS score FROM rel")
def domain_score(spark, sf):
    tree = frame(spark, "lit_domains")
    names = [r[0] for r in tree.select("name").collect()] + ["NOWHERE"]
    return domains.relations(spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string"), tree)


def _contained(x: str, pairs) -> str:
    return sql.first_case([(f"contains({x}, '{p}')", f"'{d}'") for p, d in pairs], "NULL")


INFERRED = f"coalesce(nullif(declared_domain, ''), {_contained('lower(parent_path)', PATH_DOMAINS)}, {_contained('lower(name)', NAME_DOMAINS)})"


@query("domain_infer", f"{with_tables('lit_fields')} SELECT field_key, {INFERRED} AS inferred FROM lit_fields")
def domain_infer(spark, sf):
    return frame(spark, "lit_fields").select("field_key", scoring.inferred_domain(F.col("declared_domain"), F.col("parent_path"), F.col("name")).alias("inferred"))


_PRIOR = "'com.example.customer.accounts'"


@query("domain_prior_score", f"{with_tables('lit_glossary')} SELECT id, len({sql.tokens('domain')}) > 0 AND list_has_all({sql.tokens(_PRIOR)}, {sql.tokens('domain')}) AS within_prior FROM lit_glossary")
def domain_prior_score(spark, sf):
    own, prior = identifier_tokens(F.col("domain")), identifier_tokens(F.lit("com.example.customer.accounts"))
    return frame(spark, "lit_glossary").select("id", ((F.size(own) > 0) & (F.size(F.array_except(own, prior)) == 0)).alias("within_prior"))
