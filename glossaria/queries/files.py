"""Queries of sources, sinks, saved indexes and streams, over files that they write themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossaria.functions import encoders
from glossaria.operators import evaluation, governance, ingest, lexical, sync
from glossaria.plans import batch, config, index
from glossaria.plans import match as plan
from glossaria.queries.fixtures import frame, with_tables
from glossaria.queries.indexing import _IDF, _LISTS, _RANKED, _TF, _docs, _lists
from glossaria.queries.ingesting import _DIFF, _snapshots
from glossaria.queries.matching import E2E, _inputs, _matches
from glossaria.queries.parsing import AVRO, DDL, JSON_SCHEMA
from glossaria.queries.registry import query, table
from glossaria.scratch import materialise, scratch_path
from glossaria.sources import schemas, sinks, tabular
from glossaria.streaming import changes, feedback


def _written(df, kind: str, suffix: str, **options) -> str:
    path = f"{scratch_path(df.sparkSession, 'files')}{suffix}"
    df.write.options(**options).format(kind).save(path)
    return path


def _parts(spark, sf):
    """Parts as lines: every fourth row has cells beyond the header, and names have quotes, commas and blanks."""
    part = table(spark, sf, "part")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit(', ""x"""'))
    beyond = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(","), F.array_join(F.array_repeat(F.lit("more"), 20), ","))).otherwise(F.lit(""))
    return part.select(F.concat(F.col("p_partkey").cast("string"), F.lit(","), quoted("p_name"), F.lit(","), F.col("p_brand"), beyond).alias("value"))


_PARTS = "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ', \"x\"' AS name, p_brand AS name_1, CASE WHEN p_partkey % 4 = 0 THEN array_to_string(list_transform(range(20), lambda i: 'more'), ',') ELSE '' END AS _extra_columns FROM part"


@query("csv_scan", _PARTS)
def csv_scan(spark, sf):
    lines = spark.createDataFrame([("id,name,name",)], "value string").coalesce(1)
    path = f"{scratch_path(spark, 'files')}.csv"
    # each file has its header
    rows = materialise(_parts(spark, sf), "csv-lines")
    lines.union(rows).coalesce(1).write.text(path)
    return tabular.read_source(spark, path)


@query("csv_scan_header_row", f"SELECT id, name, name_1 FROM ({_PARTS})")
def csv_scan_header_row(spark, sf):
    head = spark.createDataFrame([("a title",), ("id;name;name",)], "value string").coalesce(1)
    rows = materialise(table(spark, sf, "part").select(F.concat_ws(";", F.col("p_partkey").cast("string"), F.concat("p_name", F.lit(', ""x""')), "p_brand").alias("value")), "csv-lines")
    path = f"{scratch_path(spark, 'files')}.txt"
    head.union(rows.select(F.regexp_replace("value", "^([0-9]+);(.*);(.*)$", '$1;"$2";$3'))).coalesce(1).write.text(path)
    return tabular.read_source(spark, path, delimiter=";", header_row=1).select("id", "name", "name_1")


_NATION = "SELECT n_nationkey, n_name FROM nation"


@query("json_scan", f"SELECT 'lines' AS shape, * FROM ({_NATION}) UNION ALL SELECT 'list', * FROM ({_NATION}) UNION ALL SELECT 'wrapped', * FROM ({_NATION})")
def json_scan(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name")
    one = rows.agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))
    paths = {"lines": _written(rows, "json", ".jsonl"), "list": _written(one, "text", ".json"), "wrapped": _written(one.select(F.concat(F.lit('{"note": 1, "terms": '), "value", F.lit("}"))), "text", ".json")}
    out = None
    for shape, path in paths.items():
        part = tabular.read_source(spark, path).select(F.lit(shape).alias("shape"), F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")
        out = part if out is None else out.unionByName(part)
    return out


@query("parquet_scan", "SELECT c_custkey, c_name FROM customer")
def parquet_scan(spark, sf):
    return tabular.read_source(spark, _written(table(spark, sf, "customer"), "parquet", ".parquet")).select("c_custkey", "c_name")


@query("rows_scan", "SELECT * FROM (VALUES ('1', 'x', ''), ('', 'true', '2.5')) AS t(a, b, c)")
def rows_scan(spark, sf):
    return tabular.read_source(spark, [{"a": 1, "b": "x"}, {"b": "true", "c": 2.5}])


@query("options_refused", "SELECT * FROM (VALUES ('csv', 'sheet', TRUE), ('csv', 'delimiter', FALSE), ('json', 'delimiter', TRUE), ('parquet', 'query', TRUE), ('rows', 'encoding', TRUE)) AS t(kind, option, refused)")
def options_refused(spark, sf):
    out = []
    for kind, option in (("csv", "sheet"), ("csv", "delimiter"), ("json", "delimiter"), ("parquet", "query"), ("rows", "encoding")):
        source = [{"a": 1}] if kind == "rows" else f"/nowhere/x.{kind}"
        try:
            tabular.read_source(spark, source, **{option: ","})
            refused = False
        except ValueError as error:
            refused = "unknown options" in str(error)
        except Exception:
            refused = False
        out.append((kind, option, refused))
    return spark.createDataFrame(out, "kind string, option string, refused boolean")


@query("flatten_avro", "SELECT * FROM (VALUES (0, 'id', 'long', 'key'), (1, 'email', 'string', 'A customer'), (2, 'home_street', 'string', 'A customer'), (3, 'home_since', 'date', 'A customer'), (4, 'others__street', 'string', 'A customer'), (5, 'others__since', 'date', 'A customer'), (6, 'tags', 'array', 'A customer'), (7, 'limits', 'json', 'A customer'), (8, 'kind', 'enum', 'A customer'), (9, 'parent', 'record', 'A customer')) AS t(ordinal, flattened, data_type, description)")
def flatten_avro(spark, sf):
    rows = [(i, f.source_metadata["flattenedName"], f.data_type, f.description) for i, f in enumerate(schemas.flatten_avro(AVRO))]
    return spark.createDataFrame(rows, "ordinal int, flattened string, data_type string, description string")


@query("struct_leaves", "SELECT * FROM (VALUES ('doc_id', 'bigint'), ('meta.lang', 'string'), ('meta.hits[].n', 'int'), ('meta.tags', 'array<string>')) AS t(path, kind)")
def struct_leaves(spark, sf):
    docs = table(spark, sf, "documents")
    nested = docs.select("doc_id", F.struct("lang", F.array(F.struct(F.lit(1).alias("n"))).alias("hits"), F.array(F.lit("a")).alias("tags")).alias("meta"))
    return spark.createDataFrame(schemas.struct_fields(nested.schema), "path string, kind string")


@query("bm25_saved", f"WITH {_TF}{_IDF} SELECT term, df, round(idf, 6) AS idf FROM idf WHERE df > 1")
def bm25_saved(spark, sf):
    path = scratch_path(spark, "bm25")
    lexical.build_index(_docs(spark, sf)).save(path)
    return lexical.Index.load(spark, path).stats.filter("df > 1").select("term", "df", F.round("idf", 6).alias("idf"))


@query("glossary_index", f"{E2E} SELECT field_key, entry_id, rank FROM m")
def glossary_index(spark, sf):
    """Matching over an index that was loaded, saved and read again."""
    fields, entries, tree = _inputs(spark)
    path = scratch_path(spark, "glossary")
    index.build(entries).save(path)
    found = index.GlossaryIndex.load(spark, path)
    return plan.match(fields, found.entries, tree, index=found).select("field_key", "entry_id", "rank")


@query("glossary_load", f"{with_tables('lit_glossary')} SELECT count(*) AS n, count(*) FILTER (WHERE trim(business_name) = '') AS refused, any_value(rows) AS rows FROM lit_glossary, (SELECT count(*) AS rows FROM lit_glossary) AS r WHERE trim(business_name) <> '' OR trim(definition) <> ''")
def glossary_load(spark, sf):
    good, refused, report = index.load(frame(spark, "lit_glossary").select("id", "business_name", "logical_name", "definition", "data_type"))
    return good.unionByName(refused.drop("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("business_name") == "").alias("refused")).join(report.select("rows"))


@query("snapshot_saved", f"{_DIFF} SELECT change, count(*) AS n FROM d GROUP BY change")
def snapshot_saved(spark, sf):
    path = scratch_path(spark, "snapshot")
    before, after = _snapshots(spark, sf)
    text = lambda df: df.select(F.col("entry_id").cast("string").alias("entry_id"), "hash")
    sync.save_snapshot(text(before), path)
    return sync.diff(sync.load_snapshot(spark, path), text(after)).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("csv_sink", f"{E2E} SELECT field_key, entry_id, CAST(rank AS VARCHAR) AS rank, decision FROM m WHERE rank <= 2 AND confidence >= 0.3")
def csv_sink(spark, sf):
    path = f"{scratch_path(spark, 'sink')}.csv"
    sinks.write_csv(_matches(spark), path, 2, 0.3)
    return spark.read.option("header", True).csv(path).select("field_key", "entry_id", "rank", "decision")


@query("console_lines", f"{E2E} SELECT field_key, rank, rpad(CASE WHEN length(field_key) > 32 THEN substr(field_key, 1, 31) || '~' ELSE field_key END, 32, ' ') || '  ' || rpad(entry_id, 16, ' ') || '  ' || printf('%3d  %.6f  ', rank, confidence) || decision AS line FROM m WHERE rank <= 1")
def console_lines(spark, sf):
    return sinks.console_lines(_matches(spark))


_EVENTS = "SELECT 'f' || user_id AS field_key, CASE WHEN event_type <> 'error' THEN 'g' || (event_id % 7) END AS entry_id, CASE WHEN event_type = 'error' THEN 'REJECTED' WHEN event_type = 'click' THEN 'APPROVED' ELSE 'UNSPECIFIED' END AS verdict, CAST(event_id AS VARCHAR) AS ts FROM events WHERE user_id IS NOT NULL"


def _trail(spark, sf) -> str:
    path = scratch_path(spark, "trail")
    e = table(spark, sf, "events").filter("user_id is not null")
    rows = e.select(F.col("event_id").cast("string").alias("ts"), F.lit("r").alias("reviewer"), F.concat(F.lit("f"), "user_id").alias("field"), F.concat(F.lit("g"), F.col("event_id") % 7).alias("chosenGovernanceId"), (F.col("event_type") == "click").alias("wasCorrect"), F.when(F.col("event_type") == "error", "REJECTED").alias("verdict"))
    for half in (0, 1):
        sinks.append_feedback(rows.filter(F.col("ts").cast("long") % 2 == half), path)
    return path


@query("feedback_trail", _EVENTS)
def feedback_trail(spark, sf):
    return sinks.read_trail(spark, _trail(spark, sf)).select("field_key", "entry_id", "verdict", "ts")


@query("manifest_scan", "SELECT * FROM (VALUES ('a.avsc', 14), ('b.sql', 6)) AS t(file, fields)")
def manifest_scan(spark, sf):
    """Files that a manifest names, each by the parser of its suffix."""
    folder = scratch_path(spark, "manifest")
    for name, text in (("a.avsc", AVRO), ("b.sql", DDL), ("c.schema.json", JSON_SCHEMA)):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", " ").text(f"{folder}/{name}")
    spark.createDataFrame([("# files",), ("a.avsc",), ("",), ("b.sql",)], "value string").coalesce(1).write.text(f"{folder}/list.txt")
    out = None
    for name in schemas.read_manifest(spark, f"{folder}/list.txt"):
        rows = schemas.parse_documents(schemas.read_directory(spark, f"{folder}/{name}", "part-*"), schemas.parser_for(name))
        part = rows.agg(F.lit(name).alias("file"), F.count("name").alias("fields"))
        out = part if out is None else out.unionByName(part)
    return out


@query("schema_stream", "SELECT * FROM (VALUES ('avro', 14, FALSE), ('broken', 0, TRUE), ('ddl', 6, FALSE)) AS t(kind, fields, failed)")
def schema_stream(spark, sf):
    """Schema files parsed as they arrive, one file a batch, with a checkpoint."""
    base = scratch_path(spark, "schemas")
    rows = spark.createDataFrame([("avro", AVRO), ("ddl", DDL), ("broken", "{nothing")], "kind string, value string")
    rows.repartition(3, "kind").write.partitionBy("kind").option("lineSep", " ").text(f"{base}/in")
    handle = lambda found, n: found.select("source", "name", "error").write.mode("append").parquet(f"{base}/out")
    feedback.match_dropped_schemas(spark, f"{base}/in", f"{base}/checkpoint", handle, 1).awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.groupBy(F.regexp_extract("source", "kind=(\\w+)", 1).alias("kind")).agg(F.count("name").alias("fields"), F.bool_or(F.col("error").isNotNull()).alias("failed"))


@query("verdict_stream", f"WITH e AS ({_EVENTS}), l AS (SELECT field_key, max_by(entry_id, ts) AS entry_id, max(ts) AS ts FROM e GROUP BY field_key), k AS (SELECT field_key, arg_max(CASE WHEN verdict = 'REJECTED' THEN '' ELSE entry_id END, ts) AS entry_id FROM e GROUP BY field_key) SELECT field_key, nullif(entry_id, '') AS entry_id FROM k")
def verdict_stream(spark, sf):
    """The standing verdict of each field after the whole trail came as a stream."""
    base = scratch_path(spark, "verdicts")
    events = feedback.read_trail_stream(spark, _trail(spark, sf))
    out = feedback.standing_verdicts_stream(events)
    put = lambda rows, n: rows.withColumn("n", F.lit(n)).write.mode("append").parquet(f"{base}/out")
    out.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("field_key").agg(F.max_by("entry_id", "n").alias("entry_id"))


@query("change_feed", f"{_DIFF}, u AS (SELECT change, count(*) AS n FROM d WHERE change <> 'unchanged' GROUP BY change) SELECT 0 AS batch, 'added' AS change, count(*) AS n FROM p UNION ALL SELECT 1, change, n FROM u")
def change_feed(spark, sf):
    """Two revisions of a glossary as a stream: the first adds everything, the second what differs."""
    base = scratch_path(spark, "feed")
    before, after = _snapshots(spark, sf)
    gone = before.join(after.select("entry_id"), "entry_id", "left_anti").select("entry_id", F.lit(None).cast("string").alias("hash"))
    for n, rows in enumerate((before, after.unionByName(gone))):
        out = rows.select(F.col("entry_id").cast("string").alias("entry_id"), "hash", (F.timestamp_seconds(F.lit(n))).alias("ts"))
        materialise(out, "feed-in").coalesce(1).write.mode("append").parquet(f"{base}/in")
    put = lambda found, n: found.select(F.lit(n).cast("int").alias("batch"), "change").write.mode("append").parquet(f"{base}/out")
    changes.change_feed(spark, f"{base}/in", f"{base}/snapshot", f"{base}/checkpoint", put).awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("batch", "change").agg(F.count(F.lit(1)).alias("n"))


@query("expiring_state", "SELECT count(DISTINCT user_id) AS n FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL")
def expiring_state(spark, sf):
    """First events of the users, whose state goes 60 days after; all events are within."""
    base = scratch_path(spark, "expiring")
    path = _written(table(spark, sf, "events").filter("ts is not null and user_id is not null").select("user_id", "ts"), "parquet", "")
    rows = changes.first_within(spark.readStream.schema("user_id long, ts timestamp").parquet(path), "user_id", "ts", "60 days")
    rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long, ts timestamp").parquet(f"{base}/out").agg(F.count(F.lit(1)).alias("n"))


@query("tumbling_windows", "SELECT epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def tumbling_windows(spark, sf):
    return feedback.windowed_counts(table(spark, sf, "events").filter("ts is not null")).select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query("sliding_windows", "SELECT epoch(time_bucket(INTERVAL '30 minutes', ts))::BIGINT - 1800 * k AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) AS s(k) WHERE ts IS NOT NULL GROUP BY ALL")
def sliding_windows(spark, sf):
    return feedback.windowed_counts(table(spark, sf, "events").filter("ts is not null"), "1 hour", "30 minutes").select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query("session_windows", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, s")
def session_windows(spark, sf):
    rows = table(spark, sf, "events").filter("ts is not null and user_id is not null")
    return feedback.sessions(rows).select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "n")


@query("config_profiles", "SELECT * FROM (VALUES ('default', 0.87, 0.1, FALSE, 0.63), ('expanding', 0.87, 0.1, TRUE, 0.63), ('strict', 0.95, 0.15, FALSE, 0.63)) AS t(profile, auto_threshold, min_gap, expands, floor)")
def config_profiles(spark, sf):
    rows = [(n, c.auto_threshold, c.min_gap, c.expand_abbreviations, round(c.structural_floor, 6)) for n, c in config.PROFILES.items()]
    return spark.createDataFrame(rows, "profile string, auto_threshold double, min_gap double, expands boolean, floor double")


@query("config_refused", "SELECT * FROM (VALUES ('bounds', TRUE), ('good', FALSE), ('order', TRUE), ('toml', FALSE), ('unknown', TRUE), ('weights', TRUE)) AS t(name, refused)")
def config_refused(spark, sf):
    texts = {"good": '{"auto_threshold": 0.9}', "unknown": '{"auto": 1}', "weights": '{"semantic_weight": 0.9}', "bounds": '{"min_gap": 2}', "order": '{"review_threshold": 0.95}', "toml": "min_gap = 0.2\nsparse_top_k = 7"}
    out = []
    for name, text in texts.items():
        try:
            config.MatchConfig.load(text, "toml" if name == "toml" else "json")
            out.append((name, False))
        except ValueError:
            out.append((name, True))
    return spark.createDataFrame(out, "name string, refused boolean")


@query("vocabulary_shapes", "SELECT * FROM (VALUES ('by_code', 2, 0, FALSE), ('list', 2, 1, FALSE), ('nested', 2, 1, FALSE), ('taken_alias', 0, 0, TRUE), ('twice', 0, 0, TRUE)) AS t(shape, classes, aliases, refused)")
def vocabulary_shapes(spark, sf):
    a, b = {"name": "A", "classification": "Open"}, {"name": "B", "classification": "Closed"}
    documents = {
        "list": {"classes": [{"code": "c1", **a}, {"code": "c2", **b}], "aliases": {"one": "C-1"}, "tiers_most_open_first": ["open", "closed"]},
        "nested": {"classes": {"c1": a, "c2": b}, "aliases": {"x": None}},
        "by_code": {"c1": a, "c2": b},
        "twice": {"classes": [{"code": "c1", **a}, {"code": "C 1", **b}]},
        "taken_alias": {"classes": [{"code": "c1", **a}], "aliases": {"C1": "c1"}},
    }
    out = []
    for shape, document in documents.items():
        try:
            classes, names = governance.frames(spark, governance.check_vocabulary(document))
            out.append((shape, classes.count(), names.count(), False))
        except ValueError:
            out.append((shape, 0, 0, True))
    return spark.createDataFrame(out, "shape string, classes int, aliases int, refused boolean")


@query("encode_external", "SELECT item_id, length(text)::DOUBLE AS length, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS blanks FROM benchmark WHERE text IS NOT NULL")
def encode_external(spark, sf):
    """A user's function over batches of texts, equal texts encoded once."""
    rows = table(spark, sf, "benchmark").filter("text is not null")
    encoded = encoders.encode_distinct(rows, encoders.external(lambda texts: [[len(t), t.count(" ")] for t in texts]))
    return encoded.select("item_id", F.col("vector")[0].cast("double").alias("length"), F.col("vector")[1].cast("double").alias("blanks"))


@query("cache_statistics", "WITH b AS (SELECT user_id, epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS age FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL) SELECT count(*) AS requests, count(*) FILTER (WHERE age <= 3600) AS hits, count(*) FILTER (WHERE age IS NULL OR age > 3600) AS misses, count(*) FILTER (WHERE age > 3600) AS evictions, round(count(*) FILTER (WHERE age <= 3600) / count(*), 6) AS hit_rate FROM b")
def cache_statistics(spark, sf):
    return evaluation.cache_statistics(table(spark, sf, "events"), "user_id", "ts", 3600)


@query("abbreviation_rows", "SELECT lower(n_name[1:3]) AS short, CASE WHEN n_nationkey % 5 = 0 THEN '' WHEN n_nationkey % 5 = 1 THEN upper(n_name[1:3]) ELSE n_name END AS expansion, CASE WHEN n_nationkey % 5 = 0 THEN 'empty' WHEN n_nationkey % 5 = 1 THEN 'expands to itself' ELSE 'good' END AS verdict FROM nation")
def abbreviation_rows(spark, sf):
    n = F.col("n_nationkey") % 5
    rows = table(spark, sf, "nation").select(F.lower(F.substring("n_name", 1, 3)).alias("short"), F.when(n == 0, F.lit("  ")).when(n == 1, F.upper(F.substring("n_name", 1, 3))).otherwise(F.col("n_name")).alias("expansion"))
    good, bad = ingest.validate_abbreviations(rows)
    return good.withColumn("verdict", F.lit("good")).unionByName(bad.withColumnRenamed("reason", "verdict"))


_ALPHAS = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
_SWEEP = " UNION ALL ".join(
    f"SELECT CAST({a} AS DOUBLE) AS alpha, count(*) AS queries, count(*) FILTER (WHERE rank = 1) AS at_1, count(*) FILTER (WHERE rank <= 5) AS at_k FROM gold LEFT JOIN (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round({a} * dn + (1 - {a}) * sn, 6) DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, doc_id) AS rank FROM j) AS f ON f.query_id = gold.query_id AND f.doc_id = gold.gold"
    for a in _ALPHAS
)


@query("fusion_sweep", f"{_LISTS}{_RANKED}, gold AS (SELECT vec_id AS query_id, vec_id + 20 AS gold FROM embeddings WHERE vec_id % 20 = 0) {_SWEEP}")
def fusion_sweep(spark, sf):
    d, s = _lists(spark, sf)
    gold = table(spark, sf, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") + 20).alias("gold_id"))
    return evaluation.fusion_sweep(d, s, gold, _ALPHAS)


@query("batch_status", "SELECT * FROM (VALUES ('avro', 14, FALSE), ('broken', 0, TRUE), ('ddl', 6, FALSE)) AS t(source, fields, failed)")
def batch_status(spark, sf):
    docs = spark.createDataFrame([("avro", AVRO), ("ddl", DDL), ("broken", "{nothing")], "source string, content string")
    _, entries, tree = _inputs(spark)
    return batch.match_documents(docs, entries, tree)[1].select("source", "fields", F.col("error").isNotNull().alias("failed"))
