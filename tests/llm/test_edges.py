"""Empty tables, very long texts, repeated rows."""

import pyarrow as pa
import pytest
from brute import shingles, text_counts
from pyspark.sql import functions as F

from glossaria.llm import decontaminate, langid, near_dedup, packing, perplexity, quality_rules, secret_scan
from glossaria.llm import textkit as tk
from glossaria.llm.queries import vocabulary

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LABEL = "doc_id long, quality int, toxic int"


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOC), spark.createDataFrame([], LABEL)
    some = spark.createDataFrame([(1, "one two three four five six", "en", "s", 3)], DOC)
    items = spark.createDataFrame([], "item_id long, text string")
    assert quality_rules.quality_verdicts(docs, labels).count() == 0
    assert quality_rules.quality_filter(docs, labels).count() == 0
    assert quality_rules.quality_verdicts(some, labels).first()["base_failed"]
    assert perplexity.classify(docs, labels).count() == 0
    assert near_dedup.deduplicate(docs).count() == 0
    assert decontaminate.contaminated(docs, items).count() == 0
    assert decontaminate.decontaminate(some, items).count() == 1
    assert langid.identify(docs, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    trees = secret_scan.fitted(docs)
    assert secret_scan.redact(docs, trees).count() == 0


def test_a_text_longer_than_a_slice(spark):
    text = " ".join(f"w{i}" for i in range(420_000))
    assert len(text) > tk.SLICE_BYTES
    rows = [(1, "short " * 30, "en", "s", 1), (2, text, "en", "s", 1), (3, text + " more", "en", "s", 1), (2, text, "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOC)
    got = quality_rules.quality_verdicts(docs, spark.createDataFrame([], LABEL)).filter("doc_id = 2").collect()
    assert [r["n_words"] for r in got] == [420_000] * 2 and got[0]["n_repeat_words"] == text_counts(rows[1][1])[4]
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, 4).collect()}
    assert near == {1: (1, 1), 2: (419_997, 2), 3: (419_998, 2)}
    pieces = packing.pack_documents(docs.filter("doc_id = 3"), vocabulary("byte_bpe_50k.json"), 2, 1024)
    assert pieces.agg(F.sum("length"), F.max("length"), F.min("start")).first()[1:] == (1024, 0)
    assert pieces.filter("length < 1024").count() <= 1


@pytest.mark.parametrize("k", [1, 4, 5])
def test_shingle_sets_of_odd_texts(k):
    texts = ["", None, " ", "a", "A a", "a b c d e", "a b c d e a b c d e", "é É", "x\x00y z", "\n\n", "tab\tb\x0bc\x0cd\re"]
    found, rows = tk.distinct_sets(*tk.utf8(pa.array(texts, pa.string())), k)
    assert [int(rows[i + 1] - rows[i]) for i in range(len(texts))] == [len(shingles(t, k)) for t in texts]
    sliced = pa.array(["skip", *texts], pa.string()).slice(1)
    again, rows2 = tk.distinct_sets(*tk.utf8(sliced), k)
    assert (found == again).all() and (rows == rows2).all()
