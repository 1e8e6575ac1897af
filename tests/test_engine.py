import json

import pytest
from pyspark.sql import functions as F

from glossaria.functions import encoders, identifiers
from glossaria.operators import dense, evaluation, governance, ingest, lexical, review, sync
from glossaria.plans import match as plan
from glossaria.plans.config import MatchConfig
from glossaria.queries.fixtures import frame
from glossaria.sources import sinks, tabular
from glossaria.streaming import feedback


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("text, want", [("acct", "account"), ("cust_acct_bal", "customer_account_balance"), ("customer_account", "customer_account"), ("", ""), ("custAcctBal", "customerAccountBalance"), ("CUST_ACCT", "CUSTOMER_ACCOUNT")])
def test_abbreviations(spark, text, want):
    assert one(spark, identifiers.expand_abbreviations(F.lit(text))) == want


@pytest.mark.parametrize("key, n", [("a.b.c", 3), ("CUST_ACCT__BAL_AMT", 2), ("CUST_ACCT_BAL_AMT", 1), ("", 0)])
def test_path_segments(spark, key, n):
    assert len(one(spark, identifiers.path_segments(F.lit(key)))) == n


def test_aliases(spark):
    assert one(spark, identifiers.aliases(F.lit("Number of Test Takers"), 4)) == ["number test takers", "num tst takers", "numb test take", "ntt"]


def test_humanize_keeps_other_scripts(spark):
    assert one(spark, identifiers.humanize(F.lit("CaféPrix_日本HTTPUrl2"))) == "café prix 日本http url 2"


def test_consistency(spark):
    rows = [("a", "T-1"), ("a", "T-1"), ("b", "x"), ("b", "x"), ("b", "y"), ("c", "x"), ("c", None), ("d", "x"), ("d", "y")]
    got = {r["concept"]: (r["verdict"], r["majority"], r["majority_n"]) for r in review.consistency(spark.createDataFrame(rows, "concept string, answer string")).collect()}
    assert got == {"a": ("AGREE", "T-1", 2), "b": ("DISAGREE", "x", 2), "c": ("UNDECIDED", "x", 1), "d": ("DISAGREE", None, 0)}


def test_bypass_and_session(spark):
    f, e, d = frame(spark, "lit_fields").filter("ordinal < 6"), frame(spark, "lit_glossary").filter("business_name <> ''"), frame(spark, "lit_domains")
    verdicts = f.filter("ordinal = 0").select("field_key", F.lit("T-003").alias("entry_id"))
    rows = plan.match_with_bypass(f, e, d, verdicts).filter("field_key like '%:0'").collect()
    assert [(r["rank"], r["confidence"], r["decision"], r["absolute_cosine"], r["s1"], r["provenance"]) for r in rows] == [(1, 1.0, "AUTO_APPROVE", None, 0.0, "APPROVED_PAIR")]
    verdict = plan.session(plan.match(f, e.limit(0), d), f).collect()
    assert len(verdict) == 6 and {r["verdict"] for r in verdict} == {"NO_MATCH"}


def test_config():
    assert MatchConfig().structural_floor == pytest.approx(0.63)
    assert MatchConfig.load('{"auto_threshold": 0.9}').auto_threshold == 0.9
    assert MatchConfig.load("min_gap = 0.2", "toml").min_gap == 0.2
    for bad in ('{"nope": 1}', '{"semantic_weight": 0.9}', '{"auto_threshold": 2}', '{"review_threshold": 0.95}'):
        with pytest.raises(ValueError):
            MatchConfig.load(bad)


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red apple"), (2, "green apple tree"), (3, ""), (4, "blue")], "doc_id long, text string")
    index = lexical.build_index(docs)
    index.save(str(tmp_path / "i"))
    again = lexical.Index.load(spark, str(tmp_path / "i"))
    q = spark.createDataFrame([(1, "apple tree")], "query_id long, text string")
    assert [tuple(r) for r in lexical.search(q, index).collect()] == [tuple(r) for r in lexical.search(q, again).collect()]
    assert lexical.search(q, again).filter("rank = 1").first()["doc_id"] == 2


def test_approximate_neighbours_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("entry_id"), F.col("embedding").alias("vector"))
    q = e.filter("entry_id % 20 = 0").select(F.col("entry_id").alias("query_id"), "vector")
    exact = {(r["query_id"], r["entry_id"]) for r in dense.top_k(q, e, 10).collect()}
    near = {(r["query_id"], r["entry_id"]) for r in dense.top_k_cells(q, e, 10, cells=8, probes=6).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_vectors_of_another_length_are_refused(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0])], "entry_id long, vector array<double>")
    with pytest.raises(ValueError):
        dense.upsert(e, spark.createDataFrame([(2, [1.0])], e.schema))
    assert dense.top_k(e.limit(0).withColumnRenamed("entry_id", "query_id"), e, 3).count() == 0


def test_external_encoder_once_for_equal_texts(spark):
    rows = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, None)], "id long, text string")
    got = {r["id"]: list(r["vector"]) for r in encoders.encode_distinct(rows, encoders.external(lambda texts: [[len(t), 1.0] for t in texts])).collect()}
    assert got == {1: [2.0, 1.0], 2: [1.0, 1.0], 3: [2.0, 1.0], 4: [0.0, 1.0]}


def test_vocabulary_checks(spark):
    doc = {"tiers_most_open_first": ["Public", "Restricted"], "open_classification": "public", "aliases": {"none": None, "pii": "P-2"}, "classes": [{"code": "P1", "classification": "Public"}, {"code": "P2", "classification": " restricted"}]}
    classes, aliases = governance.frames(spark, governance.check_vocabulary(doc))
    got = governance.resolve(spark.createDataFrame([(1, "p 2"), (2, "PII"), (3, "None"), (4, ""), (5, "Z"), (6, None)], "id long, code string"), classes, aliases)
    assert {r["id"]: (r["status"], r["class_code"]) for r in got.collect()} == {1: ("known", "P2"), 2: ("known", "P2"), 3: ("dropped", None), 4: ("absent", None), 5: ("unknown", None), 6: ("absent", None)}
    for change in ({"classes": doc["classes"] * 2}, {"aliases": {"x": "P9"}}, {"aliases": {"p1": "P2"}}, {"tiers_most_open_first": ["Public"]}, {"open_classification": "x"}):
        with pytest.raises(ValueError):
            governance.check_vocabulary({**doc, **change})


def test_column_mapping_and_admission(spark):
    assert ingest.map_columns(["Term", "Name", "Definition"]) == {"business_name": "Term", "definition": "Definition"}
    df = spark.createDataFrame([("a", " Yes ", None), ("b", "no", "y")], "Term string, Keep string, Note string")
    got = ingest.map_frame(df).collect()
    assert got[0]["business_name"] == "a" and got[0]["source_metadata"] == {"Keep": " Yes "}
    assert ingest.admit_rows(df, {"Keep": ["YES"]}).count() == 1
    for bad in ({"Nope": ["x"]}, {"Keep": []}):
        with pytest.raises(ValueError):
            ingest.admit_rows(df, bad)
    with pytest.raises(ValueError):
        ingest.require_admitted(ingest.admit_rows(df, {"Keep": ["maybe"]}))


def test_sources(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes("﻿id,name,name\n1,a,b\n2,\"x, y\"\n3,q,r,extra\n".encode())
    got = tabular.read_source(spark, str(tmp_path / "g.csv"))
    assert got.columns == ["id", "name", "name_1", "_extra_columns"]
    assert [tuple(r) for r in got.orderBy("id").collect()] == [("1", "a", "b", ""), ("2", "x, y", "", ""), ("3", "q", "r", "extra")]
    (tmp_path / "h.tsv").write_text("title\nid\tv\n1\t2\n")
    assert [tuple(r)[:2] for r in tabular.read_source(spark, str(tmp_path / "h.tsv"), header_row=1).collect()] == [("1", "2")]
    (tmp_path / "w.json").write_text(json.dumps({"entries": [{"id": "1"}, {"id": "2"}]}))
    (tmp_path / "l.jsonl").write_text('{"id": "1"}\n{"id": "2"}\n')
    for name in ("w.json", "l.jsonl"):
        assert {r["id"] for r in tabular.read_source(spark, str(tmp_path / name)).collect()} == {"1", "2"}
    assert tabular.read_source(spark, [{"a": 1}, {"b": None}]).collect()[0]["a"] == "1"
    with pytest.raises(ValueError):
        tabular.read_source(spark, str(tmp_path / "g.csv"), sheet=1)
    with pytest.raises(ValueError):
        tabular.read_source(spark, "x.bin")


def test_sinks(spark, tmp_path):
    f, e, d = frame(spark, "lit_fields").filter("ordinal < 4"), frame(spark, "lit_glossary").filter("business_name <> ''"), frame(spark, "lit_domains")
    m = plan.match(f, e, d).cache()
    sinks.write_json(m, str(tmp_path / "j"), MatchConfig().weights, top_k=2)
    rows = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert len(rows) == 8 and list(rows[0]) == sorted(rows[0])
    with pytest.raises(Exception, match="don't give its confidence"):
        sinks.result_records(m.withColumn("confidence", F.lit(0.123)), MatchConfig().weights).collect()
    sinks.write_csv(m, str(tmp_path / "c"), top_k=1)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 4


def test_snapshots(spark, tmp_path):
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "entry_id string, hash string")
    path = str(tmp_path / "s")
    assert {r["change"] for r in sync.diff(sync.load_snapshot(spark, path), now).collect()} == {"added"}
    sync.save_snapshot(now, path)
    assert {r["change"] for r in sync.diff(sync.load_snapshot(spark, path), now).collect()} == {"unchanged"}


def trail(rows):
    return "".join(json.dumps({"ts": f"2024-01-01T00:00:{i:02d}Z", "reviewer": "r", "field": f, "chosenGovernanceId": c, "verdict": v}) + "\n" for i, (f, c, v) in enumerate(rows))


def test_feedback_stream_equals_batch(spark, tmp_path):
    events = [("f1", "a", "APPROVED"), ("f2", "b", "APPROVED"), ("f1", "a", "REJECTED"), ("f1", "c", "MANUAL_OVERRIDE"), ("f2", "b", "REJECTED"), ("f3", "d", None), ("f2", "x", "REJECTED")]
    (tmp_path / "in").mkdir()
    text = trail(events).splitlines(keepends=True)
    (tmp_path / "in/1.jsonl").write_text("".join(text[:3]))
    (tmp_path / "in/2.jsonl").write_text("".join(text[3:]))
    batch, revoked = review.standing_verdicts(sinks.read_trail(spark, str(tmp_path / "in")), ["ts"])
    want = {r["field_key"]: (r["entry_id"], r["verdict"]) for r in batch.collect()}
    assert want == {"f1": ("c", "MANUAL_OVERRIDE"), "f3": ("d", "UNSPECIFIED")} and revoked == 2
    stream = feedback.standing_verdicts_stream(feedback.read_trail_stream(spark, str(tmp_path / "in"), 1))
    run = stream.writeStream.format("memory").queryName("verdicts").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    last = {}
    for r in spark.table("verdicts").collect():
        last[r["field_key"]] = (r["entry_id"], r["verdict"]) if r["standing"] else None
    assert {k: v for k, v in last.items() if v} == want
    assert spark.table("verdicts").groupBy("field_key").agg(F.max("revoked").alias("n")).agg(F.sum("n")).first()[0] == 2


def test_schema_drop_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.sql").write_text("CREATE TABLE t (a INT, b TEXT)")
    seen = []
    run = feedback.match_dropped_schemas(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda df, n: seen.extend(r["name"] for r in df.orderBy("ordinal").collect()))
    run.awaitTermination()
    assert seen == ["a", "b"]


def test_windows_over_events(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert feedback.windowed_counts(e).agg(F.sum("n")).first()[0] == e.filter("ts is not null").count()
    assert feedback.sessions(e).agg(F.sum("n")).first()[0] == e.filter("ts is not null").count()


def test_exact_p_value(spark):
    pairs = spark.createDataFrame([(False, True)] * 8 + [(True, True)] * 5, "a boolean, b boolean")
    assert evaluation.mcnemar(pairs).first()["p"] == pytest.approx(2 / 2**8, abs=1e-6)


def test_the_rest_works_without_the_llm_parts(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, sum(n.startswith('op') and n[2].isdigit() for n in q)); e.oracle_sql()"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env={**os.environ, "PYTHONPATH": str(tmp_path / "r")}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    n, pipeline, ops = out.stdout.split()
    assert int(n) > 100 and pipeline == "False" and ops == "0"


def test_command_line(spark, tmp_path, capsys):
    from glossaria.__main__ import main

    (tmp_path / "g.csv").write_text("ID,Business Name,Definition,Data Type\n1,Customer Name,Name of a customer,varchar(10)\n2,Order Date,Day of an order,date\n")
    (tmp_path / "h.csv").write_text("ID,Business Name,Definition,Data Type\n1,Customer Name,Other,varchar(10)\n3,New,x,int\n")
    (tmp_path / "s.sql").write_text("CREATE TABLE orders (cust_nm VARCHAR(9), order_date DATE)")
    assert main(["info"]) == 0 and "avro" in capsys.readouterr().out
    assert main(["match", str(tmp_path / "g.csv"), str(tmp_path / "s.sql"), "--format", "ddl", "--out", str(tmp_path / "o"), "--as", "csv", "--top-k", "1"]) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).filter("entry_id = '2'").count() >= 1
    assert main(["sync", str(tmp_path / "g.csv"), str(tmp_path / "h.csv")]) == 0


def test_hooks_and_registry(spark):
    from glossaria.plans.hooks import Hooks, Registry, Stop

    def broken(df):
        raise RuntimeError

    def stop(df):
        raise Stop

    h = Hooks()
    h.register("score", lambda df: df.withColumn("a", F.lit(1)), 10)
    h.register("score", broken, 20)
    h.register("score", lambda df: None, 30)
    h.register("score", stop, 40)
    h.register("score", lambda df: df.withColumn("b", F.lit(1)), 50)
    assert h.run("score", spark.range(1)).columns == ["id", "a"]
    with pytest.raises(ValueError):
        h.register("nowhere", stop)
    r = Registry("encoder", encoders.REGISTRY)
    assert r.get("onnx") is encoders.onnx
    for f in (lambda: r.get("x"), lambda: r.add("onnx", 1)):
        with pytest.raises(ValueError):
            f()


def test_token_vectors(spark):
    from glossaria.operators.rerank import pair_scorer, token_maxsim

    row = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0], [0.6, 0.8]], "a", "ab")], "q array<array<double>>, d array<array<double>>, x string, y string")
    got = row.select(token_maxsim(F.col("q"), F.col("d")).alias("m"), pair_scorer(lambda p: [len(a + b) for a, b in p])(F.col("x"), F.col("y")).alias("s")).first()
    assert (got["m"], got["s"]) == (pytest.approx(0.9), 3.0)


def test_scratch_tables_go_when_told(spark, tmp_path):
    import os

    from glossaria import scratch

    one, two = (scratch.materialise(spark.range(n), "t") for n in (1, 2))
    assert scratch.is_there(one) and os.path.isdir(one._scratch_path)
    scratch.discard(one)
    assert not scratch.is_there(one) and not os.path.isdir(one._scratch_path) and two.count() == 2


def test_collections_are_made_and_deleted(spark, tmp_path):
    from glossaria.operators import dense

    held = dense.Collections(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b")], "entry_id long, vector array<double>, note string")
    held.create("c", rows)
    with pytest.raises(ValueError):
        held.create("c", rows)
    assert held.names() == ["c"] and held.info("c").first().asDict() == {"collection": "c", "entries": 2, "dimensions": 2}
    assert [r["note"] for r in held.get("c", spark.createDataFrame([(2,), (9,), (2,)], "entry_id long")).collect()] == ["b"]
    held.replace("c", dense.delete(held.read("c"), spark.createDataFrame([(1,)], "entry_id long")))
    assert held.read("c").count() == 1 and "vector" not in held.read("c", False).columns
    assert held.delete("c") and not held.exists("c") and not held.delete("c")
    with pytest.raises(KeyError):
        held.read("c")


def test_hooks_see_the_matching_plan(spark):
    from glossaria.plans.hooks import Hooks
    from glossaria.plans.match import match
    from glossaria.queries.matching import _inputs

    hooks, seen = Hooks(), []
    for stage in ("fields", "index", "enrich", "dense", "sparse", "fuse", "pool", "score", "decide"):
        hooks.register(stage, lambda df, stage=stage: seen.append(stage))
    hooks.register("fields", lambda df: df.filter("field_key like '%1'"))
    out = match(*_inputs(spark), hooks=hooks)
    assert seen == ["fields", "index", "enrich", "dense", "sparse", "fuse", "pool", "score", "decide"]
    assert {r["field_key"][-1] for r in out.select("field_key").collect()} == {"1"}


def test_bm25_search_with_common_terms_is_exact(spark):
    import random

    from glossaria.operators import lexical

    r = random.Random(3)
    words = ["the", "of", "and"] + [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(r.choice(words[: r.choice((3, 40, 303))]) for _ in range(n))
    docs = spark.createDataFrame([(i, text(20)) for i in range(400)] + [(999, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(i, text(6)) for i in range(20)] + [(50, "w1 w2 w3 w4 w5"), (51, "the"), (52, "")], "query_id long, text string")
    index = lexical.build_index(docs)
    rows = lambda df: sorted(tuple(x) for x in df.select("query_id", "doc_id", "score", "rank").collect())
    whole = rows(lexical.search(asked, index, 5, common=10**9))
    assert rows(lexical.search(asked, index, 5, common=30)) == whole and len(whole) > 60
