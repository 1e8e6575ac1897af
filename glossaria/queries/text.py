"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glossaria.functions import identifiers as ident
from glossaria.functions import redaction
from glossaria.functions.constants import TYPE_PHRASES
from glossaria.queries import sql
from glossaria.queries.fixtures import frame, with_tables
from glossaria.queries.registry import query, table

_F = with_tables("lit_fields")
_PARTS = "SELECT p_partkey, p_name, p_brand, p_type FROM part"


@query("tokenize_identifier", f"SELECT p_partkey, {sql.token_text('p_name')} AS name_tokens, {sql.token_text('p_brand')} AS brand_tokens, {sql.token_text('p_type')} AS type_tokens FROM part")
def tokenize_identifier(spark, sf):
    join = lambda c: F.array_join(ident.identifier_tokens(F.col(c)), " ")
    return table(spark, sf, "part").select("p_partkey", join("p_name").alias("name_tokens"), join("p_brand").alias("brand_tokens"), join("p_type").alias("type_tokens"))


@query("tokenize_fields", f"{_F} SELECT field_key, {sql.token_text('name')} AS tokens FROM lit_fields")
def tokenize_fields(spark, sf):
    return frame(spark, "lit_fields").select("field_key", F.array_join(ident.identifier_tokens(F.col("name")), " ").alias("tokens"))


@query("bm25_tokenize", f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {sql.bm25_tokens('text')} AS t FROM documents)")
def bm25_tokenize(spark, sf):
    t = ident.bm25_tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query("humanize", f"{_F} SELECT field_key, {sql.humanize('name')} AS words, {sql.humanize('full_path')} AS path_words FROM lit_fields")
def humanize(spark, sf):
    return frame(spark, "lit_fields").select("field_key", ident.humanize(F.col("name")).alias("words"), ident.humanize(F.col("full_path")).alias("path_words"))


@query("context_enrich", f"{_F} SELECT field_key, {sql.enrich('name', 'full_path', 'is_array', 'description')} AS enriched FROM lit_fields")
def context_enrich(spark, sf):
    c = F.col
    return frame(spark, "lit_fields").select("field_key", ident.enrich(c("name"), c("full_path"), c("is_array"), c("description")).alias("enriched"))


_PHRASE = sql.first_case([("is_array", "concat('array of ', coalesce(" + sql._map(TYPE_PHRASES) + "[item_type], 'data'))")], "concat(coalesce(" + sql._map(TYPE_PHRASES) + "[data_type], 'data'), ' field')")


@query("type_phrase", f"{_F} SELECT field_key, {_PHRASE} AS phrase FROM (SELECT *, CASE WHEN is_array THEN data_type ELSE 'unknown' END AS item_type FROM lit_fields)")
def type_phrase(spark, sf):
    c = F.col
    return frame(spark, "lit_fields").select("field_key", ident.type_phrase(c("data_type"), c("is_array"), F.when(c("is_array"), c("data_type")).otherwise("unknown")).alias("phrase"))


_TEXT = sql.enrich("name", "full_path", "is_array", "description")


@query("query_text", f"{_F} SELECT field_key, lower(e) AS plain, lower(array_to_string(list_transform(string_split(e, ', '), lambda x: {sql.expand('x')}), ', ')) AS expanded FROM (SELECT field_key, {_TEXT} AS e FROM lit_fields)")
def query_text(spark, sf):
    args = [F.col(x) for x in ("name", "full_path", "is_array", "description")]
    return frame(spark, "lit_fields").select("field_key", ident.query_text(*args).alias("plain"), ident.query_text(*args, expand=True).alias("expanded"))


@query(
    "entity_prefix",
    f"{_F} SELECT field_key, CASE WHEN contains(full_path, '.') AND {sql.token_text(chr(40) + 'string_split(full_path, chr(46))[1])')} = {sql.token_text('entity')} THEN full_path WHEN entity = '' THEN full_path ELSE concat_ws('.', entity, full_path) END AS path "
    "FROM (SELECT *, CASE ordinal % 4 WHEN 0 THEN 'Customer' WHEN 1 THEN 'region' WHEN 2 THEN '' ELSE 'part' END AS entity FROM lit_fields)",
)
def entity_prefix(spark, sf):
    n = F.col("ordinal") % 4
    entity = F.when(n == 0, "Customer").when(n == 1, "region").when(n == 2, "").otherwise("part")
    return frame(spark, "lit_fields").select("field_key", ident.entity_prefixed(F.col("full_path"), entity).alias("path"))


@query("abbrev_expand", f"{with_tables('lit_expansions')} SELECT text, {sql.expand('text')} AS expanded FROM lit_expansions UNION ALL SELECT p_name, {sql.expand('p_name')} FROM (SELECT DISTINCT p_name FROM part)")
def abbrev_expand(spark, sf):
    texts = frame(spark, "lit_expansions").union(table(spark, sf, "part").select("p_name").distinct())
    return texts.select("text", ident.expand_abbreviations(F.col("text")).alias("expanded"))


@query(
    "abbrev_overlay",
    f"{with_tables('lit_abbrev')}, over AS (SELECT * FROM (VALUES ('acct', 'accounting'), ('kyc', 'know your customer'), ('id', 'ident')) AS t(short, long)) "
    "SELECT coalesce(o.short, b.short) AS short, coalesce(o.long, b.long) AS long, o.short IS NOT NULL AS overlaid FROM lit_abbrev b FULL OUTER JOIN over o ON b.short = o.short",
)
def abbrev_overlay(spark, sf):
    over = spark.createDataFrame([("acct", "accounting"), ("kyc", "know your customer"), ("id", "ident")], "s string, l string")
    rows = frame(spark, "lit_abbrev").join(over, F.col("short") == F.col("s"), "full_outer")
    return rows.select(F.coalesce("s", "short").alias("short"), F.coalesce("l", "long").alias("long"), F.col("s").isNotNull().alias("overlaid"))


_NAMES = f"{with_tables('lit_glossary')}, names AS (SELECT id, business_name FROM lit_glossary UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name FROM part), words AS (SELECT id, business_name, {sql.content_words('business_name')} AS w FROM names)"


@query("alias_generate", f"{_NAMES} SELECT id, coalesce(array_to_string({sql.aliases('w')}, '|'), '') AS aliases FROM words")
def alias_generate(spark, sf):
    return _names(spark, sf).select("id", F.array_join(ident.aliases(F.col("business_name")), "|").alias("aliases"))


def _names(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("business_name"))
    return frame(spark, "lit_glossary").select("id", "business_name").union(parts)


_WORTHY = f"{_NAMES}, worthy AS (SELECT *, count(*) OVER (PARTITION BY lower(trim(business_name))) AS shared FROM words)"


def _worthy(spark, sf):
    shared = F.count(F.lit(1)).over(Window.partitionBy(F.lower(F.trim("business_name"))))
    rows = _names(spark, sf).withColumn("shared", shared).withColumn("n_words", F.size(ident.content_words(F.col("business_name"))))
    return rows.withColumn("worthy", (F.col("shared") <= 3) & (F.col("n_words") >= 2))


@query("alias_worthy", f"{_WORTHY} SELECT id, shared, CAST(len(w) AS INTEGER) AS n_words, shared <= 3 AND len(w) >= 2 AS worthy FROM worthy")
def alias_worthy(spark, sf):
    return _worthy(spark, sf).select("id", "shared", "n_words", "worthy")


@query("alias_expand", f"{_WORTHY} SELECT id AS owner, unnest({sql.aliases('w')}) AS alias FROM worthy WHERE shared <= 3 AND len(w) >= 2")
def alias_expand(spark, sf):
    return _worthy(spark, sf).filter("worthy").select(F.col("id").alias("owner"), F.explode(ident.aliases(F.col("business_name"))).alias("alias"))


@query("edit_similarity", f"SELECT a.p_partkey, round({sql.edit_similarity('a.p_name', 'b.p_name')}, 6) AS similarity FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def edit_similarity(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    other = p.select((F.col("p_partkey") - 1).alias("k"), F.col("p_name").alias("other"))
    return p.join(other, F.col("p_partkey") == F.col("k")).select("p_partkey", F.round(ident.edit_similarity(F.col("p_name"), F.col("other")), 6).alias("similarity"))


_TOK = sql.tokens("p_name"), sql.tokens("p_type")


@query(
    "token_overlap",
    f"SELECT p_partkey, CAST(len(list_intersect(a, b)) AS INTEGER) AS common, CAST(len(list_distinct(list_concat(a, b))) AS INTEGER) AS together, round(len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b)))), 6) AS jaccard, len(list_intersect(a, b)) = len(a) AS subset FROM (SELECT p_partkey, {_TOK[0]} AS a, {_TOK[1]} AS b FROM part)",
)
def token_overlap(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", ident.identifier_tokens(F.col("p_name")).alias("a"), ident.identifier_tokens(F.col("p_type")).alias("b"))
    both, all_ = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    return rows.select("p_partkey", both.alias("common"), all_.alias("together"), F.round(both / F.greatest(F.lit(1), all_), 6).alias("jaccard"), (F.size(F.array_except("a", "b")) == 0).alias("subset"))


_G = with_tables("lit_glossary")


@query("searchable_text", f"{_G} SELECT id, concat_ws(' ', nullif(business_name, ''), nullif(replace(logical_name, '_', ' '), ''), nullif(definition, ''), nullif(array_to_string(list_sort(string_split(lower(status), ' ')), ' '), '')) AS searchable FROM lit_glossary")
def searchable_text(spark, sf):
    c = F.col
    return frame(spark, "lit_glossary").select("id", ident.searchable_text(c("business_name"), c("logical_name"), c("definition"), F.split(F.lower("status"), " ")).alias("searchable"))


def _mode_sql(parts: str) -> str:
    kept = f"list_filter([{parts}], lambda p: p IS NOT NULL AND trim(p) <> '')"
    lows = f"list_transform({kept}, lambda p: lower(p))"
    return f"coalesce(array_to_string(list_filter({kept}, lambda p, i: list_position({lows}, lower(p)) = i), ' '), '')"


_LOGICAL = "replace(logical_name, '_', ' ')"


@query("searchable_modes", f"{_G} SELECT id, {_mode_sql('business_name, ' + _LOGICAL + ', definition')} AS everything, {_mode_sql('business_name, definition')} AS described, {_mode_sql('business_name')} AS named FROM lit_glossary")
def searchable_modes(spark, sf):
    args = [F.col(x) for x in ("business_name", "logical_name", "definition")]
    return frame(spark, "lit_glossary").select("id", *[ident.searchable_mode(m, *args).alias(n) for m, n in (("all", "everything"), ("business_desc", "described"), ("business", "named"))])


def _cut(x: str, at: str) -> str:
    return f"list_filter(string_split_regex({x}, '{at}'), lambda s: s <> '')"


@query("flatten_split", f"{_F} SELECT field_key, contains(full_path, '__') AS boundary, array_to_string(CASE WHEN contains(full_path, '.') THEN {_cut('full_path', '[.]')} ELSE {_cut('full_path', '_+')} END, '/') AS segments FROM lit_fields")
def flatten_split(spark, sf):
    return frame(spark, "lit_fields").select("field_key", F.col("full_path").contains("__").alias("boundary"), F.array_join(ident.flattened_segments(F.col("full_path")), "/").alias("segments"))


@query("path_segments", f"{_F} SELECT field_key, CAST(len(s) AS INTEGER) AS n, array_to_string(s, '/') AS segments FROM (SELECT field_key, CASE WHEN contains(full_path, '.') THEN {_cut('full_path', '[.]')} WHEN contains(full_path, '__') THEN {_cut('full_path', '__')} ELSE [full_path] END AS s FROM lit_fields)")
def path_segments(spark, sf):
    s = ident.path_segments(F.col("full_path"))
    return frame(spark, "lit_fields").select("field_key", F.size(s).alias("n"), F.array_join(s, "/").alias("segments"))


@query("result_key", f"{_F} SELECT field_key, coalesce(nullif(CASE WHEN contains(name, '__') THEN name ELSE '' END, ''), nullif(full_path, ''), name) AS result_key FROM lit_fields")
def result_key(spark, sf):
    flat = F.when(F.col("name").contains("__"), F.col("name")).otherwise("")
    return frame(spark, "lit_fields").select("field_key", ident.result_key(flat, F.col("full_path"), F.col("name")).alias("result_key"))


@query("normalise_words", "SELECT conv_id, turn, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS words_md5 FROM conversations")
def normalise_words(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(ident.normalise_words(F.col("text"))).alias("words_md5"))


_V = ("name", "full_path", "is_array", "description")


@query(
    "query_variants",
    f"{_F} SELECT field_key, name AS raw, replace(name, '_', ' ') AS underscores, {sql.humanize('name')} AS split, lower({sql.expand('name')}) AS abbrev, lower({sql.enrich('name', 'full_path', 'FALSE', chr(39) * 2)}) AS context, lower({sql.enrich('name', 'full_path', 'is_array', 'description')}) AS full_no_type, "
    f"lower({sql.enrich('name', 'full_path', 'is_array', 'description', phrase=_PHRASE)}) AS everything FROM (SELECT *, CASE WHEN is_array THEN data_type ELSE 'unknown' END AS item_type FROM lit_fields)",
)
def query_variants(spark, sf):
    n, p, a, d = (F.col(x) for x in _V)
    phrase = ident.type_phrase(F.col("data_type"), a, F.when(a, F.col("data_type")).otherwise("unknown"))
    return frame(spark, "lit_fields").select(
        "field_key",
        n.alias("raw"),
        F.replace(n, F.lit("_"), F.lit(" ")).alias("underscores"),
        ident.humanize(n).alias("split"),
        F.lower(ident.expand_abbreviations(n)).alias("abbrev"),
        F.lower(ident.enrich(n, p, F.lit(False), F.lit(""))).alias("context"),
        F.lower(ident.enrich(n, p, a, d)).alias("full_no_type"),
        F.lower(ident.enrich(n, p, a, d, phrase=phrase)).alias("everything"),
    )


@query("opaque_names", f"{_F} SELECT field_key, len(t) <= 2 AND coalesce(list_max(list_transform(t, lambda w: length(w))), 0) <= 6 AS opaque FROM (SELECT field_key, {sql.tokens('name')} AS t FROM lit_fields)")
def opaque_names(spark, sf):
    return frame(spark, "lit_fields").select("field_key", ident.name_is_opaque(F.col("name")).alias("opaque"))


@query("multi_value_split", "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_type || ' ; ;' || p_brand, ';'), lambda v: trim(v)), lambda v: v <> ''), '|') AS parts FROM part")
def multi_value_split(spark, sf):
    text = F.concat(F.col("p_type"), F.lit(" ; ;"), F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(ident.split_values(text, ";"), "|").alias("parts"))


@query("dominant_pattern")
def dominant_pattern(spark, sf):
    p = table(spark, sf, "customer").select("c_mktsegment", ident.char_pattern(F.col("c_name")).alias("pattern"))
    return p.groupBy("c_mktsegment").agg(F.mode("pattern", True).alias("pattern"), F.count(F.lit(1)).alias("n"))


@query(
    "instance_query_text",
    "WITH v AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS k FROM v) "
    "SELECT p_brand, 'p_type: ' || string_agg(p_type, ', ' ORDER BY k) AS query FROM r WHERE k <= 5 GROUP BY p_brand",
)
def instance_query_text(spark, sf):
    v = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    top = v.withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_type"))).filter("k <= 5")
    return top.groupBy("p_brand").agg(F.concat(F.lit("p_type: "), F.array_join(F.array_sort(F.collect_list(F.struct("k", "p_type"))).getField("p_type"), ", ")).alias("query"))


def _redacted_sql(x: str) -> str:
    for pattern, mask in redaction.PII:
        x = f"regexp_replace({x}, '{pattern}', '{mask}', 'g')"
    return x


@query("redact_pii", f"SELECT doc_id, md5(r) AS redacted_md5, CAST(length(r) AS INTEGER) AS n FROM (SELECT doc_id, {_redacted_sql('text')} AS r FROM documents)")
def redact_pii(spark, sf):
    r = table(spark, sf, "documents").select("doc_id", redaction.redact_pii(F.col("text")).alias("r"))
    return r.select("doc_id", F.md5("r").alias("redacted_md5"), F.length("r").alias("n"))


@query("redact_props", "SELECT event_id, '[REDACTED]' AS token, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def redact_props(spark, sf):
    props = F.from_json("props", "map<string,string>")
    hidden = redaction.redact_map(F.map_concat(props, F.create_map(F.lit("Token"), F.col("user_id").cast("string"))))
    return table(spark, sf, "events").select("event_id", hidden.alias("m")).select("event_id", F.col("m")["Token"].alias("token"), F.col("m")["k"].alias("k"))


@query("content_hash", "SELECT doc_id, sha256(text) AS plain, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS folded FROM documents")
def content_hash(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", ident.content_hash(t).alias("plain"), ident.content_hash(t, fold=True).alias("folded"))


@query("props_extract", "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS total, count(json_extract_string(props, '$.k')) AS n FROM events GROUP BY event_type")
def props_extract(spark, sf):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k.cast("long")).alias("total"), F.count(k).alias("n"))


@query("embed_dedupe", "SELECT count(*) AS n, count(DISTINCT sha256(text)) AS distinct_texts, count(*) - count(DISTINCT sha256(text)) AS saved FROM documents WHERE text IS NOT NULL")
def embed_dedupe(spark, sf):
    by = table(spark, sf, "documents").filter("text is not null").groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("c"))
    return by.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("distinct_texts"), (F.sum("c") - F.count(F.lit(1))).alias("saved"))
