"""The pipeline's stages: contracts on odd tables, and the whole of it against its stages by hand."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from brute import components, contained, text_counts
from pyspark.sql import functions as F

from glossaria.llm import decontaminate, near_dedup, quality_rules, secret_scan

SF = "/root/testdata/sf0.001"
#: Names that stages use inside.
CLASHING = "kept base_failed failed_rules q_text q_n_words _q_text _q_n_words q_failed q_stratum kept_id kept_id_rows found _found component component_id n_shingles stratum unit good rank score path item_id h n _w KEPT_ID2".split()


def odd_docs(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = text(80)
    rows = [(1, base), (1, base), (2, base + " more"), (3, None), (3, None), (4, ""), (None, text(60)), (None, text(60)), (5, text(50)), (5, text(55)), (6, text(3000)), (7, "short one"), (8, f"{text(40)} password = 'hunter2xyz' {text(5)}")]
    docs = spark.createDataFrame([(i, t, r.choice(("en", None)), "src0", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHING:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    return docs, rows


def as_counter(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_keep_rows_as_they_are(spark):
    docs, rows = odd_docs(spark)
    docs = docs.cache()
    every = as_counter(docs)
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    kept = quality_rules.quality_filter(docs, labels)
    assert kept.columns == docs.columns
    good = {t for _, t in rows if (n := text_counts(t))[0] >= 20 and 100 * n[4] <= 30 * n[0]}
    assert as_counter(kept) == Counter({x: n for x, n in every.items() if x[1] in good})

    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    got = as_counter(kept)
    assert all(x in every for x in got) and Counter(x[0] for x in got.elements()) == {1: 1, 3: 1, 4: 1, None: 2, 5: 1, 6: 1, 7: 1, 8: 1}
    assert len(next(x[1] for x in got if x[0] == 5).split()) == 55

    items = spark.createDataFrame([(1, rows[10][1][:200].rsplit(" ", 1)[0]), (1, None), (None, rows[8][1])], "item_id long, text string")
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert as_counter(kept) == Counter({x: n for x, n in every.items() if x[0] != 6})

    kept = secret_scan.redact(docs, secret_scan.fitted(docs))
    assert kept.columns == docs.columns
    got = as_counter(kept)
    assert Counter({x: n for x, n in got.items() if x[0] != 8}) == Counter({x: n for x, n in every.items() if x[0] != 8})
    masked = next(x for x in got if x[0] == 8)
    assert "hunter2xyz" not in masked[1] and secret_scan.MASK in masked[1] and masked[4] == len(masked[1]) and masked[5:] == next(x for x in every if x[0] == 8)[5:]


@pytest.mark.parametrize("stage", range(4))
def test_stages_take_an_empty_table(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    out = corpus_pipeline.STAGES[stage][1](spark, docs, SF)
    assert out.columns == docs.columns and out.count() == 0


def test_the_pipeline_is_its_stages_in_a_row(spark, tmp_path):
    got = Counter(tuple(sorted(r.asDict().items())) for r in corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    step = docs
    seen = set(rows)
    for name, f in corpus_pipeline.STAGES[:4]:
        f(spark, step, SF).write.parquet(f"{tmp_path}/{name}")
        step = spark.read.parquet(f"{tmp_path}/{name}")
        out = {r["doc_id"]: r["text"] for r in step.collect()}
        assert out.keys() <= seen
        if name == "quality_rules":
            base = {i for i, r in rows.items() if (n := text_counts(r["text"]))[0] >= 20 and 100 * n[4] <= 30 * n[0]}
            assert out.keys() <= base and len(out) >= 0.9 * len(base)
        elif name == "near_dedup":
            want = components([(i, rows[i]["text"]) for i in seen], 5, 80)
            assert out.keys() == {i for i, (_, c) in want.items() if i == c}
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert out.keys() == seen - {d for d, *_ in contained([(i, rows[i]["text"]) for i in seen], items, decontaminate.K, decontaminate.PERCENT)}
        else:
            assert out.keys() == seen
            assert all(re.sub(r"\[SECRET\]", "", t) != "" for t in out.values() if t)
        seen = set(out)
    last = stages["packing"](spark, step, SF).collect()
    assert Counter(tuple(sorted({c: r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}.items())) for r in last) == got
    places = {}
    for r in last:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))] and sum(n for _, n in p) <= 1024
