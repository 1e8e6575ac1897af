"""Queries of the lexical and dense indexes and of fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossaria.functions import vectors
from glossaria.operators import dense, fusion, lexical
from glossaria.queries import sql
from glossaria.queries.registry import query, table
from glossaria.scratch import scratch_path


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _asked(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_TF = f"toks AS (SELECT doc_id, {sql.bm25_tokens('coalesce(text, chr(32))')} AS t FROM documents), tf AS (SELECT doc_id, len(t) AS dl, u.term AS term, count(*) AS tf FROM toks, unnest(t) AS u(term) GROUP BY ALL), n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks)"
_IDF = (
    ", df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, n), mean AS (SELECT CAST(sum(CAST(round(raw, 10) AS DECIMAL(28, 10))) AS DOUBLE) / count(*) AS mean FROM raw), "
    "idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raw, mean)"
)
_W = ", w AS (SELECT tf.term, doc_id, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS weight FROM tf JOIN idf USING (term), n)"
_HITS = f", q AS (SELECT item_id AS query_id, u.term AS term, count(*) AS qtf FROM (SELECT item_id, {sql.bm25_tokens('text')} AS t FROM benchmark), unnest(t) AS u(term) GROUP BY ALL), hits AS (SELECT query_id, doc_id, round(sum(qtf * weight), 6) AS score FROM q JOIN w USING (term) GROUP BY ALL)"


@query("bm25_tf", f"WITH {_TF} SELECT doc_id, CAST(dl AS INTEGER) AS dl, count(*) AS terms, max(tf) AS max_tf FROM tf GROUP BY doc_id, dl")
def bm25_tf(spark, sf):
    return lexical.term_frequencies(_docs(spark, sf)).groupBy("doc_id", "dl").agg(F.count(F.lit(1)).alias("terms"), F.max("tf").alias("max_tf"))


@query("bm25_df", f"WITH {_TF} SELECT term, count(*) AS df FROM tf GROUP BY term")
def bm25_df(spark, sf):
    return lexical.document_frequencies(lexical.term_frequencies(_docs(spark, sf)))


@query("bm25_idf", f"WITH {_TF}{_IDF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark, sf):
    docs = _docs(spark, sf)
    return lexical.inverse_frequencies(lexical.document_frequencies(lexical.term_frequencies(docs)), lexical.corpus_size(docs)[0]).select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_weights", f"WITH {_TF}{_IDF}{_W} SELECT doc_id, count(*) AS terms, round(sum(weight), 4) AS total, round(max(weight), 5) AS heaviest FROM w GROUP BY doc_id")
def bm25_weights(spark, sf):
    return lexical.build_index(_docs(spark, sf)).postings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 4).alias("total"), F.round(F.max("weight"), 5).alias("heaviest"))


_TOP = "SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hits) WHERE rank <= 100 AND score > 0"


@query("bm25_topk", f"WITH {_TF}{_IDF}{_W}{_HITS} {_TOP}")
def bm25_topk(spark, sf):
    return lexical.search(_asked(spark, sf), lexical.build_index(_docs(spark, sf)), 100)


@query(
    "bm25_add_remove",
    f"WITH kept AS (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT item_id + 1000000, text FROM benchmark), {_TF.replace('FROM documents', 'FROM kept')}{_IDF} SELECT term, df, round(idf, 6) AS idf FROM idf",
)
def bm25_add_remove(spark, sf):
    docs = _docs(spark, sf)
    docs = lexical.remove_documents(docs, docs.filter("doc_id % 3 = 0").select("doc_id"))
    docs = lexical.add_documents(docs, table(spark, sf, "benchmark").select((F.col("item_id") + 1_000_000).alias("doc_id"), "text"))
    return lexical.build_index(docs).stats.select("term", "df", F.round("idf", 6).alias("idf"))


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("entry_id"), F.col("embedding").alias("vector"), "label")
    return e.filter("entry_id % 20 = 0").select(F.col("entry_id").alias("query_id"), "vector"), e


_VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
_COS = "round(list_dot_product(a.e, b.e) / (greatest(sqrt(list_dot_product(a.e, a.e)), 1e-9) * greatest(sqrt(list_dot_product(b.e, b.e)), 1e-9)), 6)"


@query("cosine_pairs", f"WITH {_VEC} SELECT a.vec_id, {_COS} AS cosine FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, sf):
    e = _vectors(spark, sf)[1]
    other = e.select((F.col("entry_id") - 1).alias("k"), F.col("vector").alias("w"))
    return e.join(other, F.col("entry_id") == F.col("k")).select(F.col("entry_id").alias("vec_id"), F.round(vectors.cosine(F.col("vector"), F.col("w")), 6).alias("cosine"))


@query("distance_metrics", f"WITH {_VEC} SELECT a.vec_id, {_COS} AS cosine, round(list_dot_product(a.e, b.e), 5) AS dot, round(list_distance(a.e, b.e), 5) AS euclidean FROM v a JOIN v b ON b.vec_id = a.vec_id + 7")
def distance_metrics(spark, sf):
    e = _vectors(spark, sf)[1]
    other = e.select((F.col("entry_id") - 7).alias("k"), F.col("vector").alias("w"))
    m = dense.distances(F.col("vector"), F.col("w"))
    return e.join(other, F.col("entry_id") == F.col("k")).select(F.col("entry_id").alias("vec_id"), F.round(m["cosine"], 6).alias("cosine"), F.round(m["dot"], 5).alias("dot"), F.round(m["euclidean"], 5).alias("euclidean"))


def _dense_sql(k: int, where: str = "TRUE") -> str:
    return f"WITH {_VEC}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS entry_id, {_COS} AS score FROM v a, v b WHERE a.vec_id % 20 = 0 AND {where}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM s) SELECT query_id, entry_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {k}"


@query("dense_topk", _dense_sql(20))
def dense_topk(spark, sf):
    return dense.top_k(*_vectors(spark, sf), 20)


@query("dense_topk_filtered", _dense_sql(5, "b.label = 3"))
def dense_topk_filtered(spark, sf):
    return dense.top_k_filtered(*_vectors(spark, sf), 5, {"label": 3})


@query("dense_topk_cells")
def dense_topk_cells(spark, sf):
    return dense.top_k_cells(*_vectors(spark, sf), 10)


@query(
    "dense_recall",
    "SELECT least(10, (SELECT count(*) FROM embeddings)) * (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) AS n_exact, TRUE AS enough",
)
def dense_recall(spark, sf):
    """Whether the approximate search finds nine of ten exact neighbours."""
    q, e = _vectors(spark, sf)
    found = dense.recall(dense.top_k_cells(q, e, 10), dense.top_k(q, e, 10))
    return found.select("n_exact", (F.col("n_found") >= 0.9 * F.col("n_exact")).alias("enough"))


@query("collection_info", "SELECT 'some' AS collection, count(*) AS entries, max(len(embedding)) AS dimensions FROM embeddings WHERE label <> 4")
def collection_info(spark, sf):
    held = _collection(spark, sf)
    held.replace("some", dense.delete(held.read("some"), held.read("some").filter("label = 4").select("entry_id")))
    return held.info("some")


@query("collection_get", "SELECT vec_id AS entry_id, label FROM embeddings WHERE vec_id % 20 = 0")
def collection_get(spark, sf):
    held = _collection(spark, sf)
    return held.get("some", held.read("some").filter("entry_id % 20 = 0").select("entry_id").unionByName(spark.range(-3, 0).select(F.col("id").alias("entry_id"))))


def _collection(spark, sf):
    held = dense.Collections(spark, scratch_path(spark, "collections"))
    held.create("gone", _vectors(spark, sf)[1].limit(1))
    held.delete("gone")
    held.create("some", _vectors(spark, sf)[1])
    return held


_NEW = "SELECT vec_id + 400 AS vec_id, label + 100 AS label FROM embeddings WHERE vec_id < 300"


@query("vector_upsert", f"WITH n AS ({_NEW}) SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM n) UNION ALL SELECT vec_id, label FROM n")
def vector_upsert(spark, sf):
    e = _vectors(spark, sf)[1]
    new = e.filter("entry_id < 300").select((F.col("entry_id") + 400).alias("entry_id"), "vector", (F.col("label") + 100).alias("label"))
    return dense.upsert(e, new).select(F.col("entry_id").alias("vec_id"), "label")


@query("vector_delete", "SELECT vec_id, label FROM embeddings WHERE label <> 4")
def vector_delete(spark, sf):
    e = _vectors(spark, sf)[1]
    return dense.delete(e, e.filter("label = 4").select("entry_id")).select(F.col("entry_id").alias("vec_id"), "label")


@query("scroll_page", "SELECT vec_id, label FROM embeddings WHERE vec_id > 100 ORDER BY vec_id LIMIT 50")
def scroll_page(spark, sf):
    return dense.page(_vectors(spark, sf)[1], 100, 50).select(F.col("entry_id").alias("vec_id"), "label")


# Two candidate lists over the same keys: neighbours by vector, and neighbours of the same label by id.
_LISTS = (
    f"WITH {_VEC}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, {_COS} AS score FROM v a, v b WHERE a.vec_id % 20 = 0), d AS (SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= 30), "
    "p AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(10.0 / (1 + abs(a.vec_id - b.vec_id)), 6) AS score FROM v a JOIN v b ON a.label = b.label WHERE a.vec_id % 20 = 0)"
)
_RANKED = (
    ", dr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS dense_rank, (score - min(score) OVER q) / CASE WHEN max(score) OVER q > min(score) OVER q THEN max(score) OVER q - min(score) OVER q ELSE 1 END AS dn FROM d WINDOW q AS (PARTITION BY query_id)), "
    "sr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS sparse_rank, (score - min(score) OVER q) / CASE WHEN max(score) OVER q > min(score) OVER q THEN max(score) OVER q - min(score) OVER q ELSE 1 END AS sn FROM p WINDOW q AS (PARTITION BY query_id)), "
    "j AS (SELECT coalesce(dr.query_id, sr.query_id) AS query_id, coalesce(dr.doc_id, sr.doc_id) AS doc_id, dense_rank, sparse_rank, coalesce(dn, 0) AS dn, coalesce(sn, 0) AS sn FROM dr FULL OUTER JOIN sr ON dr.query_id = sr.query_id AND dr.doc_id = sr.doc_id)"
)


def _lists(spark, sf):
    q, e = _vectors(spark, sf)
    d = dense.top_k(q, e, 30).select("query_id", F.col("entry_id").alias("doc_id"), "score")
    labels = e.select("entry_id", "label")
    a = labels.filter("entry_id % 20 = 0").select(F.col("entry_id").alias("query_id"), "label")
    p = a.join(labels, "label").select("query_id", F.col("entry_id").alias("doc_id"), F.round(10.0 / (1 + F.abs(F.col("query_id") - F.col("entry_id"))), 6).alias("score"))
    return d, p


_FUSED = {
    "rrf": "coalesce(1.0 / (60 + dense_rank), 0) + coalesce(1.0 / (60 + sparse_rank), 0)",
    "linear": "0.9 * dn + (1 - 0.9) * sn",
    "combsum": "0.5 * dn + 0.5 * sn",
    "combmnz": "(0.5 * dn + 0.5 * sn) * ((dense_rank IS NOT NULL)::INT + (sparse_rank IS NOT NULL)::INT)",
    "max": "greatest(dn, sn)",
}


def _fuse_query(method: str) -> None:
    text = f"{_LISTS}{_RANKED}, f AS (SELECT *, round({_FUSED[method]}, 6) AS fused FROM j) SELECT query_id, doc_id, CAST(fused AS DOUBLE) AS fused, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, doc_id) AS INTEGER) AS rank FROM f"

    @query(f"fuse_{method}", text)
    def run(spark, sf):
        return fusion.fuse(*_lists(spark, sf), method)


for _m in fusion.METHODS:
    _fuse_query(_m)


@query("minmax_norm", f"{_LISTS}{_RANKED} SELECT query_id, doc_id, CAST(sparse_rank AS INTEGER) AS sparse_rank, round(sn, 6) AS norm FROM sr")
def minmax_norm(spark, sf):
    return fusion.ranked(_lists(spark, sf)[1], "sparse").select("query_id", "doc_id", "sparse_rank", F.round("sparse_norm", 6).alias("norm"))


@query(
    "fusion_overlap",
    f"{_LISTS}, k AS (SELECT coalesce(d.query_id, p.query_id) AS query_id, d.doc_id IS NOT NULL AS a, p.doc_id IS NOT NULL AS b FROM d FULL OUTER JOIN p ON d.query_id = p.query_id AND d.doc_id = p.doc_id) "
    "SELECT query_id, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE NOT b) AS dense_only, count(*) FILTER (WHERE NOT a) AS sparse_only, round(count(*) FILTER (WHERE a AND b) / count(*), 6) AS overlap FROM k GROUP BY query_id",
)
def fusion_overlap(spark, sf):
    return fusion.overlap(*_lists(spark, sf))


@query("alias_maxpool", f"{_LISTS} SELECT query_id, CASE WHEN doc_id % 2 = 1 THEN doc_id - 1 ELSE doc_id END AS doc_id, max(score) AS score FROM d GROUP BY ALL")
def alias_maxpool(spark, sf):
    d, _ = _lists(spark, sf)
    owners = d.select("doc_id").distinct().filter("doc_id % 2 = 1").select(F.col("doc_id").alias("alias_id"), (F.col("doc_id") - 1).alias("owner_id"))
    return fusion.pool_aliases(d, owners)


@query("squash_score", "SELECT event_id, round(CASE WHEN v BETWEEN 0 AND 1 THEN v ELSE 1 / (1 + exp(-greatest(least(v, 30.0), -30.0))) END, 6) AS squashed FROM (SELECT event_id, CAST(value AS DOUBLE) / 10 - 5 AS v FROM events WHERE value IS NOT NULL)")
def squash_score(spark, sf):
    v = table(spark, sf, "events").filter("value is not null").select("event_id", (F.col("value").cast("double") / 10 - 5).alias("v"))
    return v.select("event_id", F.round(vectors.squash(F.col("v")), 6).alias("squashed"))


@query(
    "maxsim_tokens",
    f"WITH s AS (SELECT p_partkey, {sql.tokens('p_name')} AS a, {sql.tokens('p_type')} AS b FROM part), x AS (SELECT p_partkey, len(a) AS n, t.term AS t, b FROM s, unnest(a) AS t(term)), "
    "y AS (SELECT p_partkey, n, t, max(CASE WHEN t = u.term THEN 1.0 WHEN contains(t, u.term) OR contains(u.term, t) THEN 0.7 ELSE 0.4 * len(list_intersect(list_distinct(string_split(t, '')), list_distinct(string_split(u.term, '')))) / len(list_distinct(list_concat(string_split(t, ''), string_split(u.term, '')))) END) AS best FROM x, unnest(b) AS u(term) GROUP BY ALL) "
    "SELECT p_partkey, CAST(round(sum(best) / any_value(n), 6) AS DOUBLE) AS maxsim FROM y GROUP BY p_partkey",
)
def maxsim_tokens(spark, sf):
    from glossaria.functions.identifiers import identifier_tokens

    rows = table(spark, sf, "part").select("p_partkey", identifier_tokens(F.col("p_name")).alias("a"), identifier_tokens(F.col("p_type")).alias("b"))
    letters = lambda w: F.array_distinct(F.split(w, ""))
    like = lambda t, u: F.when(t == u, 1.0).when(t.contains(u) | u.contains(t), 0.7).otherwise(0.4 * F.size(F.array_intersect(letters(t), letters(u))) / F.size(F.array_union(letters(t), letters(u))))
    best = F.transform("a", lambda t: F.array_max(F.transform("b", lambda u: like(t, u))))
    return rows.filter("size(a) > 0 and size(b) > 0").select("p_partkey", F.round(F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size("a"), 6).alias("maxsim"))


@query("encode_hashed", f"WITH t AS (SELECT item_id, {sql.bm25_tokens('text')} AS w FROM benchmark), g AS (SELECT item_id, u.term AS term FROM t, unnest(w) AS u(term) UNION ALL SELECT item_id, substr('#' || u.term || '#', CAST(i.i AS INTEGER), 3) FROM t, unnest(w) AS u(term), unnest(range(1, length(u.term) + 1)) AS i(i)), c AS (SELECT item_id, CAST(('0x' || substr(md5(term), 1, 6)) AS BIGINT) % 256 AS bucket, count(*) AS n FROM g GROUP BY ALL) SELECT item_id, bucket, round(n / sqrt(CAST(sum(n * n) OVER (PARTITION BY item_id) AS DOUBLE)), 6) AS weight FROM c")
def encode_hashed(spark, sf):
    from glossaria.functions.encoders import hashed_ngram

    return hashed_ngram(table(spark, sf, "benchmark"), "item_id").select("item_id", "bucket", F.round("weight", 6).alias("weight"))
