"""BM25 over an inverted index held as tables.

``build_index`` tokenises every document once, into a table of counts, and
makes postings (term, doc_id, weight) of it; they can be saved and read again.
Searching is an equi-join on the term with partial sums. Rare terms come
first: the best k of their sums bound what a result must reach, and the terms
that very many documents share are joined only with the documents that can
still reach it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossaria.functions.identifiers import bm25_tokens
from glossaria.scratch import materialise

K1, B, EPSILON = 1.5, 0.75, 0.25


@dataclass
class Index:
    """``postings``: term, doc_id, weight; ``stats``: term, df, idf."""

    postings: DataFrame
    stats: DataFrame

    def save(self, path: str) -> None:
        """Postings clustered by term, so that a query's terms prune row groups."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats"))


def term_frequencies(docs: DataFrame) -> DataFrame:
    """doc_id, term, tf, dl for ``docs`` (doc_id, text)."""
    tokens = docs.select("doc_id", bm25_tokens(F.col("text")).alias("tokens"))
    return tokens.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")).select("doc_id", "term", "tf", "dl")


def corpus_size(docs: DataFrame) -> tuple[int, float]:
    """Documents and their mean length, empty ones included."""
    row = docs.agg(F.count(F.lit(1)), F.avg(F.size(bm25_tokens(F.col("text"))))).first()
    return row[0], float(row[1] or 0.0)


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def raw_idf(df: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def inverse_frequencies(df: DataFrame, n: int) -> DataFrame:
    """term, df, idf; negative values become EPSILON times the mean over the vocabulary.

    The mean is taken over exact decimals, so that it doesn't depend on the order of rows.
    """
    raw = df.withColumn("raw", raw_idf(F.col("df"), n))
    mean = raw.agg(F.sum(F.round("raw", 10).cast("decimal(28,10)")).cast("double") / F.count(F.lit(1))).first()[0] or 0.0
    return raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw")).alias("idf"))


def weight(idf: Column, tf: Column, dl: Column, avgdl: float) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))


def build_index(docs: DataFrame) -> Index:
    tf = materialise(term_frequencies(docs), "bm25-counts")
    n = docs.count()
    words = tf.agg(F.sum("tf")).first()[0] or 0
    stats = materialise(inverse_frequencies(document_frequencies(tf), n), "bm25-terms")
    postings = tf.join(stats, "term").select("term", "doc_id", weight(F.col("idf"), F.col("tf"), F.col("dl"), max(words / max(n, 1), 1e-9)).alias("weight"))
    return Index(postings, stats)


def add_documents(docs: DataFrame, new: DataFrame) -> DataFrame:
    """Documents with ``new`` put in, replacing equal ids; the index is then built anew, as idf changes."""
    return docs.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new)


def remove_documents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id"), "doc_id", "left_anti")


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf: query terms count as often as they occur."""
    return queries.select("query_id", F.explode(bm25_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def _summed(terms: DataFrame, postings: DataFrame) -> DataFrame:
    return terms.join(postings, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * F.col("weight")).alias("score"))


def scores(queries: DataFrame, index: Index) -> DataFrame:
    """query_id, doc_id, score: every pair with a common term."""
    return _summed(query_terms(queries), index.postings)


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= k) & (F.col("score") > 0))


def search(queries: DataFrame, index: Index, k: int = 10, common: int = 1000) -> DataFrame:
    """query_id, doc_id, score (6 digits), rank; only positive scores.

    Terms of more than ``common`` documents are joined only with documents
    that can still be among the best ``k``; the result doesn't depend on it.
    """
    terms = materialise(query_terms(queries).join(index.stats.select("term", "df", "idf"), "term"), "bm25-query")
    # a weight is at most idf * (K1 + 1); terms of negative weight bound nothing, so all terms are then taken at once
    often = terms.filter(F.col("df") > common)
    if not often.limit(1).count() or terms.filter("idf <= 0").limit(1).count():
        return _best(_summed(terms.select("query_id", "term", "qtf"), index.postings), k)
    rare = materialise(_summed(terms.filter(F.col("df") <= common).select("query_id", "term", "qtf"), index.postings), "bm25-rare")
    reach = often.groupBy("query_id").agg(F.sum(F.col("qtf") * F.col("idf") * (K1 + 1)).alias("reach"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    # the k-th best sum of rare terms; queries with fewer such documents need all their postings
    least = rare.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k).select("query_id", F.col("score").alias("least"))
    bounds = materialise(terms.select("query_id").distinct().join(reach, "query_id", "left").join(least, "query_id", "left").select("query_id", F.coalesce("reach", F.lit(0.0)).alias("reach"), "least"), "bm25-bounds")
    sure = F.col("least").isNotNull() & (F.col("reach") < F.col("least") - 1e-5)
    open_ = bounds.filter(~sure).select("query_id")
    whole = _summed(terms.join(open_, "query_id").select("query_id", "term", "qtf"), index.postings)
    kept = rare.join(bounds.filter(sure), "query_id").filter(F.col("score") + F.col("reach") >= F.col("least") - 1e-5)
    kept = materialise(kept.select("query_id", "doc_id", "score"), "bm25-kept")
    pairs = kept.select("query_id", "doc_id").join(often.select("query_id", "term", "qtf"), "query_id")
    more = pairs.join(index.postings, ["term", "doc_id"]).select("query_id", "doc_id", (F.col("qtf") * F.col("weight")).alias("score"))
    summed = kept.unionByName(more).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
    return _best(whole.unionByName(summed), k)
