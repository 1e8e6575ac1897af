"""Queries of the matching plan over the literal schemas and glossary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaria.functions import scoring
from glossaria.operators import graph, lexical, review
from glossaria.plans import index
from glossaria.plans import match as plan
from glossaria.plans.config import MatchConfig
from glossaria.queries import sql
from glossaria.queries.fixtures import frame, with_tables
from glossaria.queries.governing import INFERRED
from glossaria.queries.registry import query, table
from glossaria.scratch import is_there, materialise

CFG = MatchConfig()


def _inputs(spark):
    return frame(spark, "lit_fields"), frame(spark, "lit_glossary").filter("business_name <> ''"), frame(spark, "lit_domains")


_BASE = (
    f"{with_tables('lit_fields', 'lit_glossary', 'lit_domains')}, e AS (SELECT * FROM lit_glossary WHERE business_name <> ''), "
    f"qt AS (SELECT field_key AS query_id, lower({sql.enrich('name', 'full_path', 'is_array', 'description')}) AS text FROM lit_fields), "
    "et AS (SELECT id AS doc_id, concat_ws(' ', nullif(business_name, ''), nullif(replace(logical_name, '_', ' '), ''), nullif(definition, '')) AS text FROM e), "
    f"qw AS (SELECT query_id, {sql.bm25_tokens('text')} AS t FROM qt), ew AS (SELECT doc_id, {sql.bm25_tokens('text')} AS t FROM et), "
    "tf AS (SELECT doc_id, len(t) AS dl, u.term AS term, count(*) AS tf FROM ew, unnest(t) AS u(term) GROUP BY ALL), n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM ew), "
    "df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, n), mean AS (SELECT CAST(sum(CAST(round(raw, 10) AS DECIMAL(28, 10))) AS DOUBLE) / count(*) AS mean FROM raw), "
    "w AS (SELECT tf.term, doc_id, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS weight FROM tf JOIN raw USING (term), mean, n), "
    "q AS (SELECT query_id, u.term AS term, count(*) AS qtf FROM qw, unnest(t) AS u(term) GROUP BY ALL), sparse AS (SELECT query_id, doc_id, round(sum(qtf * weight), 6) AS score FROM q JOIN w USING (term) GROUP BY ALL HAVING round(sum(qtf * weight), 6) > 0), "
    "qg AS (SELECT query_id AS k, u.term AS term FROM qw, unnest(t) AS u(term) UNION ALL SELECT query_id, substr('#' || u.term || '#', CAST(i.i AS INTEGER), 3) FROM qw, unnest(t) AS u(term), unnest(range(1, length(u.term) + 1)) AS i(i)), "
    "eg AS (SELECT doc_id AS k, u.term AS term FROM ew, unnest(t) AS u(term) UNION ALL SELECT doc_id, substr('#' || u.term || '#', CAST(i.i AS INTEGER), 3) FROM ew, unnest(t) AS u(term), unnest(range(1, length(u.term) + 1)) AS i(i)), "
    "qv AS (SELECT k, bucket, n / sqrt(CAST(sum(n * n) OVER (PARTITION BY k) AS DOUBLE)) AS wq FROM (SELECT k, CAST(('0x' || substr(md5(term), 1, 6)) AS BIGINT) % 256 AS bucket, count(*) AS n FROM qg GROUP BY ALL)), "
    "ev AS (SELECT k, bucket, n / sqrt(CAST(sum(n * n) OVER (PARTITION BY k) AS DOUBLE)) AS we FROM (SELECT k, CAST(('0x' || substr(md5(term), 1, 6)) AS BIGINT) % 256 AS bucket, count(*) AS n FROM eg GROUP BY ALL)), "
    "dense AS (SELECT qv.k AS query_id, ev.k AS doc_id, round(sum(wq * we), 6) AS score FROM qv JOIN ev USING (bucket) GROUP BY ALL)"
)
_FUSE = (
    ", dr AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r, (score - min(score) OVER k) / CASE WHEN max(score) OVER k > min(score) OVER k THEN max(score) OVER k - min(score) OVER k ELSE 1 END AS v FROM dense WINDOW k AS (PARTITION BY query_id)), "
    "sr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r, (score - min(score) OVER k) / CASE WHEN max(score) OVER k > min(score) OVER k THEN max(score) OVER k - min(score) OVER k ELSE 1 END AS v FROM sparse WINDOW k AS (PARTITION BY query_id)), "
    "fu AS (SELECT coalesce(dr.query_id, sr.query_id) AS query_id, coalesce(dr.doc_id, sr.doc_id) AS doc_id, dr.r AS d, sr.r AS s, dr.score AS cosine, round(0.9 * coalesce(dr.v, 0) + (1 - 0.9) * coalesce(sr.v, 0), 6) AS fused FROM dr FULL OUTER JOIN sr ON dr.query_id = sr.query_id AND dr.doc_id = sr.doc_id), "
    "pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, d NULLS LAST, s NULLS LAST, doc_id) AS fr FROM fu) WHERE fr <= 20)"
)
_UP = ", up AS (SELECT name, name AS ancestor, 0 AS distance, parent AS nxt FROM lit_domains UNION ALL SELECT up.name, up.nxt, up.distance + 1, d.parent FROM up JOIN lit_domains d ON d.name = up.nxt), near AS (SELECT l.name AS a, r.name AS b, min({'db': r.distance, 'da': l.distance}) AS m FROM up l JOIN up r ON l.ancestor = r.ancestor GROUP BY ALL)"
_SIGNALS = (
    f", sg AS (SELECT pool.query_id, pool.doc_id, fused, fr, cosine, {sql.tokens('f.name')} AS ft, {sql.tokens('e.logical_name')} AS lt, {sql.tokens('e.business_name')} AS bt, f.data_type AS fty, e.data_type AS ety, {INFERRED.replace('declared_domain', 'f.declared_domain').replace('parent_path', 'f.parent_path').replace('lower(name)', 'lower(f.name)')} AS fd, nullif(e.domain, '') AS ed "
    "FROM pool JOIN lit_fields f ON f.field_key = pool.query_id JOIN e ON e.id = pool.doc_id), "
    "sc AS (SELECT query_id, doc_id, fr, cosine, least(fused, 1.0) AS s1, round(CASE WHEN len(ft) = 0 OR len(list_distinct(list_concat(lt, bt))) = 0 THEN 0.0 ELSE len(list_intersect(ft, list_distinct(list_concat(lt, bt)))) / len(ft) END, 6) AS s2, "
    f"round({sql.edit_similarity('array_to_string(ft, chr(32))', 'array_to_string(lt, chr(32))')}, 6) AS s3, CAST({sql.type_signal('ety', 'fty')} AS DOUBLE) AS s4, "
    "CAST(CASE WHEN fd IS NULL OR ed IS NULL OR fd NOT IN (SELECT name FROM lit_domains) OR ed NOT IN (SELECT name FROM lit_domains) THEN 0.5 ELSE CASE WHEN m.da = 0 AND m.db = 0 THEN 1.0 WHEN m.da = 0 THEN 0.85 WHEN m.db = 0 THEN 0.80 WHEN m.da = 1 AND m.db = 1 THEN 0.70 WHEN m.da <= 2 AND m.db <= 2 THEN 0.50 ELSE 0.25 END END AS DOUBLE) AS s5 "
    "FROM sg LEFT JOIN near ON near.a = fd AND near.b = ed), "
    "cf AS (SELECT *, round(least(greatest(0.70 * s1 + 0.05 * s2 + 0.05 * s3 + 0.05 * s4 + 0.15 * s5, 0), 1), 6) AS confidence FROM sc), "
    "rk AS (SELECT *, row_number() OVER k AS rank, round(confidence - lead(confidence) OVER k, 6) AS margin FROM cf WINDOW k AS (PARTITION BY query_id ORDER BY confidence DESC, fr)), "
    "m AS (SELECT query_id AS field_key, doc_id AS entry_id, CAST(rank AS INTEGER) AS rank, CAST(confidence AS DOUBLE) AS confidence, CAST(margin AS DOUBLE) AS margin, CASE WHEN rank = 1 AND confidence >= 0.87 AND (margin IS NULL OR margin >= 0.10) THEN 'AUTO_APPROVE' WHEN confidence >= 0.5 THEN 'REVIEW' ELSE 'REJECT' END AS decision, cosine AS absolute_cosine, CAST(s1 AS DOUBLE) AS s1, CAST(s2 AS DOUBLE) AS s2, CAST(s3 AS DOUBLE) AS s3, s4, s5 FROM rk WHERE rank <= 5)"
)
E2E = _BASE + _FUSE + _UP + _SIGNALS


def _arms(fields, entries):
    """The hits of the dense and the sparse arm."""
    found, texts = index.build(entries), plan.field_texts(fields, CFG)
    return materialise(plan.dense_hits(texts, found, CFG), "dense-arm"), materialise(plan.sparse_hits(texts, found, CFG), "sparse-arm")


_MATCHED: dict[str, DataFrame] = {}


def _matches(spark):
    """The matches of the literal schemas, made once in an application for all queries that look at them."""
    app = spark.sparkContext.applicationId
    if app not in _MATCHED or not is_there(_MATCHED[app]):
        _MATCHED[app] = materialise(plan.match(*_inputs(spark), CFG), "matches")
    return _MATCHED[app]


@query("match_schema_e2e", f"{E2E} SELECT * FROM m")
def match_schema_e2e(spark, sf):
    return plan.match(*_inputs(spark), CFG)


@query("signal_scores", f"{E2E} SELECT field_key, entry_id, s1, s2, s3, s4, s5 FROM m WHERE rank <= 3")
def signal_scores(spark, sf):
    return _matches(spark).filter("rank <= 3").select("field_key", "entry_id", "s1", "s2", "s3", "s4", "s5")


@query("match_topk", f"{E2E} SELECT field_key, entry_id, rank FROM m WHERE rank <= 2")
def match_topk(spark, sf):
    return _matches(spark).filter("rank <= 2").select("field_key", "entry_id", "rank")


@query("match_decision", f"{E2E} SELECT field_key, rank, margin, decision FROM m")
def match_decision(spark, sf):
    return _matches(spark).select("field_key", "rank", "margin", "decision")


@query("weighted_confidence", "SELECT l_orderkey, l_linenumber, round(least(greatest(0.70 * l_discount * 10 + 0.05 * l_tax + 0.05 * 0.5 + 0.05 * 1.0 + 0.15 * 0.5, 0), 1), 6) AS confidence FROM lineitem")
def weighted_confidence(spark, sf):
    s = [F.col("l_discount") * 10, F.col("l_tax"), F.lit(0.5), F.lit(1.0), F.lit(0.5)]
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(scoring.weighted_confidence(s, CFG), 6).alias("confidence"))


@query("field_decision", f"{E2E} SELECT f.field_key, CASE WHEN coalesce(m.absolute_cosine, -1) < 0.4 THEN 'NO_MATCH' ELSE coalesce(m.decision, 'NO_MATCH') END AS verdict FROM lit_fields f LEFT JOIN m ON m.field_key = f.field_key AND m.rank = 1")
def field_decision(spark, sf):
    return plan.session(_matches(spark), frame(spark, "lit_fields"), MatchConfig(absolute_floor=0.4)).select("field_key", "verdict")


@query("confidence_floor", f"{E2E} SELECT CASE WHEN min(confidence) >= 0.63 THEN 0.63 END::DOUBLE AS floor, min(confidence) AS lowest, count(*) AS fields FROM m WHERE rank = 1")
def confidence_floor(spark, sf):
    top = _matches(spark).filter("rank = 1").agg(F.min("confidence").alias("lowest"), F.count(F.lit(1)).alias("fields"))
    return top.select(F.when(F.col("lowest") >= round(CFG.structural_floor, 6), F.lit(round(CFG.structural_floor, 6))).alias("floor"), "lowest", "fields")


@query("top_matches", f"{E2E} SELECT field_key, entry_id, confidence FROM m WHERE rank = 1")
def top_matches(spark, sf):
    return _matches(spark).filter("rank = 1").select("field_key", "entry_id", "confidence")


@query("low_confidence_fields", f"{E2E} SELECT f.field_key FROM lit_fields f LEFT JOIN m ON m.field_key = f.field_key AND m.rank = 1 WHERE m.field_key IS NULL OR m.decision <> 'AUTO_APPROVE' OR m.confidence < 0.9")
def low_confidence_fields(spark, sf):
    if CFG.structural_floor >= 0.9:
        raise ValueError("the threshold is not above the structural floor")
    sure = _matches(spark).filter("rank = 1 and decision = 'AUTO_APPROVE' and confidence >= 0.9").select("field_key")
    return frame(spark, "lit_fields").select("field_key").join(sure, "field_key", "left_anti")


@query("auto_approval_rate", f"{E2E} SELECT count(*) AS fields, round(avg((decision = 'AUTO_APPROVE')::INT), 6) AS rate, (SELECT count(*) FROM m) AS total_matches FROM m WHERE rank = 1")
def auto_approval_rate(spark, sf):
    m = _matches(spark)
    first = F.col("rank") == 1
    return m.agg(F.count_if(first).alias("fields"), F.round(F.count_if(first & (F.col("decision") == "AUTO_APPROVE")) / F.count_if(first), 6).alias("rate"), F.count(F.lit(1)).alias("total_matches"))


@query("decision_counts", f"{E2E} SELECT decision, count(*) AS n FROM m GROUP BY decision")
def decision_counts(spark, sf):
    return _matches(spark).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query("export_threshold", f"{E2E} SELECT field_key, entry_id, rank, confidence FROM m WHERE confidence >= 0.6 AND rank <= 3")
def export_threshold(spark, sf):
    return _matches(spark).filter("confidence >= 0.6 and rank <= 3").select("field_key", "entry_id", "rank", "confidence")


@query("explain_reproduce", f"{E2E} SELECT field_key, entry_id, abs(0.70 * s1 + 0.05 * s2 + 0.05 * s3 + 0.05 * s4 + 0.15 * s5 - confidence) <= 1e-6 AS reproduced FROM m")
def explain_reproduce(spark, sf):
    again = scoring.weighted_confidence([F.col(f"s{i}") for i in range(1, 6)], CFG)
    return _matches(spark).select("field_key", "entry_id", (F.abs(again - F.col("confidence")) <= 1e-6).alias("reproduced"))


@query("conservation_check", f"{E2E} SELECT (SELECT count(*) FROM lit_fields) AS fields_in, count(DISTINCT field_key) AS fields_out, count(*) FILTER (WHERE field_key NOT IN (SELECT field_key FROM lit_fields)) AS strangers FROM m")
def conservation_check(spark, sf):
    fields = frame(spark, "lit_fields").select("field_key", F.lit(True).alias("known"))
    rows = _matches(spark).join(fields, "field_key", "full_outer")
    return rows.agg(F.count_distinct(F.when(F.col("known"), F.col("field_key"))).alias("fields_in"), F.count_distinct(F.when(F.col("rank").isNotNull(), F.col("field_key"))).alias("fields_out"), F.count_if(F.col("known").isNull()).alias("strangers"))


@query("fields_by_parent", f"{with_tables('lit_fields')} SELECT parent_path, count(*) AS n, string_agg(name, ',' ORDER BY ordinal) AS names FROM lit_fields GROUP BY parent_path")
def fields_by_parent(spark, sf):
    g = frame(spark, "lit_fields").groupBy("parent_path")
    return g.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.struct("ordinal", "name"))).getField("name"), ",").alias("names"))


@query("duplicate_paths", f"{with_tables('lit_fields')} SELECT full_path, count(*) AS n FROM lit_fields GROUP BY full_path HAVING count(*) > 1")
def duplicate_paths(spark, sf):
    return frame(spark, "lit_fields").groupBy("full_path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("unique_result_key", f"{with_tables('lit_fields')} SELECT field_key, CASE WHEN n = 1 THEN full_path ELSE full_path || '#' || n END AS result_key FROM (SELECT *, row_number() OVER (PARTITION BY full_path ORDER BY ordinal) AS n FROM lit_fields)")
def unique_result_key(spark, sf):
    return review.unique_keys(frame(spark, "lit_fields"), "full_path", "ordinal").select("field_key", "result_key")


@query(
    "diag_channels",
    f"{_BASE}{_FUSE}, ch AS (SELECT 'dense' AS channel, query_id, doc_id, CAST(r AS INTEGER) AS rank FROM dr UNION ALL SELECT 'sparse', query_id, doc_id, CAST(r AS INTEGER) FROM sr UNION ALL SELECT 'fused', query_id, doc_id, CAST(fr AS INTEGER) FROM pool) SELECT * FROM ch WHERE rank <= 3",
)
def diag_channels(spark, sf):
    from glossaria.operators import fusion

    f, e, _ = _inputs(spark)
    d, s = _arms(f, e)
    one = lambda rows, name, rank: rows.filter(F.col(rank) <= 3).select(F.lit(name).alias("channel"), "query_id", "doc_id", F.col(rank).alias("rank"))
    fused = fusion.fuse(d, s, "linear", CFG.fusion_alpha, top=CFG.pool_size)
    return one(fusion.ranked(d, "dense"), "dense", "dense_rank").union(one(fusion.ranked(s, "sparse"), "sparse", "sparse_rank")).union(one(fused, "fused", "rank"))


@query("diag_rank_by_channel", f"{_BASE}{_FUSE} SELECT f.field_key, max(dr.r)::INTEGER AS dense_rank, max(sr.r)::INTEGER AS sparse_rank FROM lit_fields f LEFT JOIN dr ON dr.query_id = f.field_key AND dr.doc_id = 'T-002' LEFT JOIN sr ON sr.query_id = f.field_key AND sr.doc_id = 'T-002' GROUP BY f.field_key")
def diag_rank_by_channel(spark, sf):
    from glossaria.operators import fusion

    f, e, _ = _inputs(spark)
    dense, sparse = _arms(f, e)
    d = fusion.ranked(dense, "dense").filter("doc_id = 'T-002'").select(F.col("query_id").alias("field_key"), "dense_rank")
    s = fusion.ranked(sparse, "sparse").filter("doc_id = 'T-002'").select(F.col("query_id").alias("field_key"), "sparse_rank")
    return f.select("field_key").join(d, "field_key", "left").join(s, "field_key", "left")


@query("status_warnings", f"{with_tables('lit_glossary')} SELECT count(*) AS entries, round(count(*) / 688.0, 6)::DOUBLE AS size_ratio, count(*) < 688 AS smaller_than_calibrated FROM lit_glossary WHERE business_name <> ''")
def status_warnings(spark, sf):
    n = F.count(F.lit(1))
    return _inputs(spark)[1].agg(n.alias("entries"), F.round(n / 688.0, 6).alias("size_ratio"), (n < 688).alias("smaller_than_calibrated"))


@query("signals_merge", f"{with_tables('lit_fields')} SELECT field_key, CASE WHEN ordinal % 2 = 0 THEN name ELSE 'request' END AS entity, 'request' AS domain, CASE WHEN ordinal % 2 = 0 THEN 'field' END AS extra FROM lit_fields")
def signals_merge(spark, sf):
    from glossaria.functions.identifiers import overlay

    request = F.create_map(F.lit("entity"), F.lit("request"), F.lit("domain"), F.lit("request"))
    own = F.when(F.col("ordinal") % 2 == 0, F.create_map(F.lit("entity"), F.col("name"), F.lit("extra"), F.lit("field"))).otherwise(F.create_map().cast("map<string,string>"))
    m = overlay(request, own)
    return frame(spark, "lit_fields").select("field_key", F.try_element_at(m, F.lit("entity")).alias("entity"), F.try_element_at(m, F.lit("domain")).alias("domain"), F.try_element_at(m, F.lit("extra")).alias("extra"))


@query("signal_blend", "SELECT event_id, round(CASE WHEN value IS NOT NULL AND value > 50 THEN 0.7 * (user_id % 10) / 10 + 0.3 * value / 100 ELSE (user_id % 10) / 10 END, 6) AS blended FROM events")
def signal_blend(spark, sf):
    name, val = (F.col("user_id") % 10) / 10, F.col("value")
    return table(spark, sf, "events").select("event_id", F.round(F.when(val > 50, 0.7 * (F.col("user_id") % 10) / 10 + 0.3 * val / 100).otherwise(name), 6).alias("blended"))


@query("rerank_order", f"{E2E} SELECT field_key, entry_id, rank AS original_rank, CAST(row_number() OVER (PARTITION BY field_key ORDER BY round(s2 + s3, 6) DESC, rank) AS INTEGER) AS new_rank FROM m")
def rerank_order(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("field_key").orderBy(F.desc(F.round(F.col("s2") + F.col("s3"), 6)), "rank")
    return _matches(spark).select("field_key", "entry_id", F.col("rank").alias("original_rank"), F.row_number().over(order).alias("new_rank"))


@query("bypass_split", f"{with_tables('lit_fields')} SELECT field_key, CASE WHEN ordinal % 9 = 0 THEN 'APPROVED_PAIR' ELSE 'MATCHED' END AS provenance FROM lit_fields WHERE ordinal % 9 = 0 OR TRUE")
def bypass_split(spark, sf):
    f, e, d = _inputs(spark)
    verdicts = f.filter("ordinal % 9 = 0").select("field_key", F.lit("T-001").alias("entry_id"))
    return plan.match_with_bypass(f, e, d, verdicts, CFG).filter("rank = 1").select("field_key", "provenance")


_EDGES = (
    f"{with_tables('lit_fields')}, g AS (SELECT *, CASE WHEN data_type IN ('integer', 'long', 'float', 'double', 'decimal') THEN 'numeric' WHEN data_type IN ('string', 'uuid', 'enum') THEN 'string' WHEN data_type IN ('date', 'timestamp') THEN 'temporal' WHEN data_type IN ('array', 'record', 'json') THEN 'complex' ELSE data_type END AS gr FROM lit_fields), "
    "pc AS (SELECT a.field_key AS src, b.field_key AS dst FROM g a JOIN g b ON a.schema_name = b.schema_name AND a.full_path = b.parent_path), "
    "sb AS (SELECT a.field_key AS src, b.field_key AS dst FROM g a JOIN g b ON a.schema_name = b.schema_name AND a.parent_path = b.parent_path AND a.parent_path <> '' AND a.field_key <> b.field_key), "
    "one AS (SELECT src, dst, 'parent_child' AS kind, 1.0::DOUBLE AS weight FROM pc UNION ALL SELECT src, dst, 'sibling', 0.5 FROM sb WHERE (src, dst) NOT IN (SELECT (src, dst) FROM pc)), "
    "ts AS (SELECT a.field_key AS src, b.field_key AS dst FROM g a JOIN g b ON a.schema_name = b.schema_name AND a.gr = b.gr AND a.ordinal < b.ordinal), "
    "edges AS (SELECT * FROM one UNION ALL SELECT src, dst, 'type_similar', 0.3 FROM ts WHERE (src, dst) NOT IN (SELECT (src, dst) FROM one))"
)


@query("graph_edges", f"{_EDGES} SELECT src, dst, kind, weight FROM edges")
def graph_edges(spark, sf):
    return graph.edges(frame(spark, "lit_fields"))


@query("graph_stats", f"{_EDGES} SELECT (SELECT count(DISTINCT field_key) FROM g) AS nodes, count(*) AS edges, (SELECT max(length(full_path) - length(replace(full_path, '.', '')))::INTEGER FROM g) AS max_depth FROM edges")
def graph_stats(spark, sf):
    f = frame(spark, "lit_fields")
    return graph.stats(f, graph.edges(f))


_GM = (
    f"{_EDGES}, ar AS (SELECT src AS field_key, list_sort(list_distinct(list(gr))) AS around FROM edges JOIN g ON g.field_key = dst GROUP BY src), p AS (SELECT g.field_key, schema_name, length(full_path) - length(replace(full_path, '.', '')) AS depth, length(name) AS len, data_type, gr, around FROM g LEFT JOIN ar USING (field_key)), "
    "sc AS (SELECT l.field_key AS l_field_key, r.field_key AS r_field_key, round(0.4 * (0.6 * (1 - abs(l.depth - r.depth) / greatest(l.depth, r.depth, 1)) + 0.4 * (1 - abs(l.len - r.len) / greatest(l.len, r.len, 1))) + 0.3 * CASE WHEN l.around IS NULL OR r.around IS NULL THEN 0.5 ELSE len(list_intersect(l.around, r.around)) / len(list_distinct(list_concat(l.around, r.around))) END "
    "+ 0.3 * CASE WHEN l.data_type = r.data_type THEN 1.0 WHEN l.gr = r.gr THEN 0.8 WHEN l.data_type = 'string' OR r.data_type = 'string' THEN 0.3 ELSE 0.0 END, 6) AS score FROM p l, p r WHERE l.schema_name = 'tpch' AND r.schema_name = 'bank'), "
    "gm AS (SELECT l_field_key, r_field_key, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY l_field_key ORDER BY score DESC, r_field_key) AS INTEGER) AS rank FROM sc)"
)


def _graph_match(spark, k=3):
    f = frame(spark, "lit_fields")
    p = graph.profiles(f, graph.edges(f)).join(f.select("field_key", "schema_name"), "field_key")
    return graph.match(p.filter("schema_name = 'tpch'").drop("schema_name"), p.filter("schema_name = 'bank'").drop("schema_name"), k)


@query("graph_match", f"{_GM} SELECT l_field_key, r_field_key, score, rank FROM gm WHERE rank <= 3")
def graph_match(spark, sf):
    return _graph_match(spark)


@query("graph_rerank", f"{_GM} SELECT l_field_key AS query_id, r_field_key AS doc_id, CAST(round(0.6 * (1.0 / rank) + 0.4 * CASE WHEN rank <= 2 THEN score ELSE 0 END, 6) AS DOUBLE) AS score FROM gm WHERE rank <= 3")
def graph_rerank(spark, sf):
    m = _graph_match(spark).select(F.col("l_field_key").alias("query_id"), F.col("r_field_key").alias("doc_id"), "score", "rank")
    return graph.rerank(m.select("query_id", "doc_id", (1.0 / F.col("rank")).alias("score")), m.filter("rank <= 2").select("query_id", "doc_id", "score"))


@query("eval_systems", f"{_BASE}{_FUSE}, gold AS (SELECT field_key AS query_id, 'T-' || lpad((ordinal % 30)::VARCHAR, 3, '0') AS gold FROM lit_fields), r AS (SELECT 'bm25' AS system, gold.query_id, sr.r FROM gold LEFT JOIN sr ON sr.query_id = gold.query_id AND sr.doc_id = gold UNION ALL SELECT 'dense', gold.query_id, dr.r FROM gold LEFT JOIN dr ON dr.query_id = gold.query_id AND dr.doc_id = gold) SELECT system, count(*) AS n, round(avg(coalesce((r <= 5)::INT, 0)), 6) AS recall_at_5, round(avg(CASE WHEN r <= 10 THEN 1.0 / r ELSE 0 END), 6) AS mrr_at_10 FROM r GROUP BY system")
def eval_systems(spark, sf):
    from glossaria.operators import evaluation, fusion

    f, e, _ = _inputs(spark)
    gold = f.select(F.col("field_key").alias("query_id"), F.format_string("T-%03d", F.col("ordinal") % 30).alias("gold_id"))
    out = None
    for name, hits in zip(("dense", "bm25"), _arms(f, e)):
        ranked = fusion.ranked(hits, "x").select("query_id", "doc_id", F.col("x_rank").alias("rank"))
        one = evaluation.retrieval_metrics(evaluation.gold_ranks(ranked, gold), (5,)).select(F.lit(name).alias("system"), "n", "recall_at_5", "mrr_at_10")
        out = one if out is None else out.union(one)
    return out


@query("bm25_glossary", f"{_BASE} SELECT query_id, doc_id, score FROM sparse")
def bm25_glossary(spark, sf):
    f, e, _ = _inputs(spark)
    hits = lexical.scores(plan.field_texts(f, CFG), lexical.build_index(index.entry_texts(e)))
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score")).filter("score > 0")
