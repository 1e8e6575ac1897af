"""Text encoders: a registry of ways to get vectors for texts.

``hashed_ngram`` needs no model: words and their character trigrams are hashed
into buckets and counted, as rows (id, bucket, weight) of unit length;
``hashed_vectors`` has them as arrays for vector search. ``precomputed`` takes a
vector column as it is; ``external`` wraps a function over batches of texts;
``onnx`` runs a model directory of the user's, if onnxruntime is there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaria.functions.identifiers import bm25_tokens

BUCKETS = 256


def ngram_terms(text: Column) -> Column:
    """Words, and the trigrams of each word between ``#`` marks."""
    words = bm25_tokens(text)
    marked = F.transform(words, lambda w: F.concat(F.lit("#"), w, F.lit("#")))
    grams = F.flatten(F.transform(marked, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3)))))
    return F.concat(words, grams)


def hashed_ngram(rows: DataFrame, key: str) -> DataFrame:
    """key, bucket, weight: unit-length sparse vectors of ``rows`` (key, text)."""
    terms = rows.select(key, F.explode(ngram_terms(F.col("text"))).alias("t"))
    bucket = F.conv(F.substring(F.md5(F.encode("t", "utf-8")), 1, 6), 16, 10).cast("long") % BUCKETS
    counts = terms.groupBy(key, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    size = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)).cast("double"))
    return counts.select(key, "bucket", (F.col("n") / size).alias("weight"))


def hashed_vectors(rows: DataFrame, key: str) -> DataFrame:
    """key, vector: ``hashed_ngram`` as arrays of ``BUCKETS`` numbers."""
    held = hashed_ngram(rows, key).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("w"))
    at = F.sequence(F.lit(0).cast("long"), F.lit(BUCKETS - 1).cast("long"))
    return held.select(key, F.transform(at, lambda i: F.coalesce(F.try_element_at("w", i), F.lit(0.0))).alias("vector"))


def external(function: Callable[[list[str]], list[list[float]]], batch: int = 32) -> Callable[[Column], Column]:
    """A column function from a batch encoder; texts of a batch are encoded in order of length."""
    @F.pandas_udf("array<float>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            order = series.fillna("").str.len().sort_values(kind="stable").index
            out = pd.Series([None] * len(series), index=series.index, dtype=object)
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                for i, v in zip(part, function(series.loc[part].fillna("").tolist())):
                    out.at[i] = [float(x) for x in v]
            yield out

    return encode


def onnx(directory: str, role: str = "query", instruction: str = "", max_tokens: int = 512) -> Callable[[Column], Column]:
    """Encoder over ``model.onnx`` and ``tokenizer.json`` of a directory: first-token pooling, unit length.

    ``instruction`` is put before queries and not before documents.
    """
    lead, state = instruction if role == "query" else "", {}

    def run(texts: list[str]) -> list[list[float]]:
        import numpy as np
        import onnxruntime
        from tokenizers import Tokenizer

        if not state:
            state["session"] = onnxruntime.InferenceSession(f"{directory}/model.onnx", providers=["CPUExecutionProvider"])
            state["tokenizer"] = Tokenizer.from_file(f"{directory}/tokenizer.json")
            state["tokenizer"].enable_truncation(max_tokens)
            state["tokenizer"].enable_padding()
        got = state["tokenizer"].encode_batch([lead + t for t in texts])
        feeds = {"input_ids": np.array([e.ids for e in got], np.int64), "attention_mask": np.array([e.attention_mask for e in got], np.int64)}
        names = {i.name for i in state["session"].get_inputs()}
        if "token_type_ids" in names:
            feeds["token_type_ids"] = np.zeros_like(feeds["input_ids"])
        first = state["session"].run(None, {k: v for k, v in feeds.items() if k in names})[0][:, 0, :]
        return (first / np.maximum(np.linalg.norm(first, axis=1, keepdims=True), 1e-9)).tolist()

    return external(run)


def encode_distinct(rows: DataFrame, encoder: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """``rows`` with ``vector``; equal texts are encoded once."""
    keyed = rows.withColumn("_hash", F.sha2(F.coalesce(text, F.lit("")), 256))
    distinct = keyed.groupBy("_hash").agg(F.first(text).alias("_text")).select("_hash", encoder(F.col("_text")).alias("vector"))
    return keyed.join(distinct, "_hash").drop("_hash")


REGISTRY = {"hashed_ngram": hashed_vectors, "external": external, "onnx": onnx}
