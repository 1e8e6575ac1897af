"""Matching schema fields to glossary entries, as one plan.

Candidates come from a sparse (BM25) and a dense (vector) arm over the
indexes of :mod:`glossaria.plans.index`, which are built once and can be kept;
they are fused, cut to a pool, scored by five signals, ranked and decided.
Attributes are joined after the pool is cut. Hooks see each stage's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossaria.functions import encoders, identifiers, scoring, types
from glossaria.operators import dense as vector_search
from glossaria.operators import domains, fusion, lexical
from glossaria.plans.config import MatchConfig
from glossaria.plans.hooks import Hooks
from glossaria.plans.index import Encoder, GlossaryIndex, build
from glossaria.scratch import materialise


def field_texts(fields: DataFrame, cfg: MatchConfig) -> DataFrame:
    """query_id, text."""
    return fields.select(F.col("field_key").alias("query_id"), identifiers.query_text(F.col("name"), F.col("full_path"), F.col("is_array"), F.col("description"), cfg.expand_abbreviations).alias("text"))


def sparse_hits(texts: DataFrame, index: GlossaryIndex, cfg: MatchConfig) -> DataFrame:
    """query_id, doc_id, score of the sparse arm."""
    return lexical.search(texts, index.postings, cfg.sparse_top_k).select("query_id", "doc_id", "score")


def dense_hits(texts: DataFrame, index: GlossaryIndex, cfg: MatchConfig, encoder: Encoder = encoders.hashed_vectors) -> DataFrame:
    """query_id, doc_id, score (cosine) of the dense arm; entries that have nothing in common are no hits."""
    found = vector_search.top_k(encoder(texts, "query_id").select("query_id", "vector"), index.vectors, cfg.dense_top_k)
    return found.filter("score > 0").select("query_id", F.col("entry_id").alias("doc_id"), "score")


def _tokens_text(name: str):
    return F.array_join(identifiers.identifier_tokens(F.col(name)), " ")


def signals(pool: DataFrame, fields: DataFrame, entries: DataFrame, tree: DataFrame) -> DataFrame:
    """``pool`` (query_id, doc_id, fused, rank, ...) with the five signals s1..s5."""
    f = fields.select(
        F.col("field_key").alias("query_id"), F.col("name").alias("_name"), F.col("data_type").alias("_ft"), scoring.inferred_domain(F.col("declared_domain"), F.col("parent_path"), F.col("name")).alias("_fd")
    )
    e = entries.select(F.col("id").alias("doc_id"), F.col("business_name").alias("_business"), F.col("logical_name").alias("_logical"), F.col("data_type").alias("_et"), F.nullif("domain", F.lit("")).alias("_ed"))
    rows = pool.join(f, "query_id").join(e, "doc_id")
    related = materialise(domains.relations(rows.filter("_fd is not null and _ed is not null").select(F.col("_fd").alias("a"), F.col("_ed").alias("b")), tree), "match-domains")
    rows = rows.join(related.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("score").alias("_ds")), (F.col("_fd") == F.col("_a")) & (F.col("_ed") == F.col("_b")), "left")
    ft = identifiers.identifier_tokens(F.col("_name"))
    et = F.array_union(identifiers.identifier_tokens(F.col("_logical")), identifiers.identifier_tokens(F.col("_business")))
    lexical_share = F.when((F.size(ft) == 0) | (F.size(et) == 0), 0.0).otherwise(F.size(F.array_intersect(ft, et)) / F.size(ft))
    return rows.withColumns(
        {
            "s1": F.least("fused", F.lit(1.0)),
            "s2": F.round(lexical_share, 6),
            "s3": F.round(identifiers.edit_similarity(_tokens_text("_name"), _tokens_text("_logical")), 6),
            "s4": types.type_signal(F.col("_et"), F.col("_ft")),
            "s5": F.coalesce("_ds", F.lit(0.5)),
        }
    ).drop("_name", "_ft", "_fd", "_business", "_logical", "_et", "_ed", "_a", "_b", "_ds")


def match(
    fields: DataFrame,
    entries: DataFrame,
    tree: DataFrame,
    cfg: MatchConfig | None = None,
    dense: DataFrame | None = None,
    sparse: DataFrame | None = None,
    index: GlossaryIndex | None = None,
    encoder: Encoder = encoders.hashed_vectors,
    hooks: Hooks | None = None,
) -> DataFrame:
    """field_key, entry_id, rank, confidence, margin, decision, absolute_cosine, s1..s5 of the best entries.

    ``fields``: field_key, name, full_path, parent_path, data_type, description,
    is_array, declared_domain; ``entries``: id, business_name, logical_name,
    definition, data_type, domain; ``tree``: name, parent. The margin is the
    lead over the next in the pool, null if there is none. Without ``index``
    one is built; ``encoder`` must be the one that its vectors come from.
    """
    cfg, hooks = cfg or MatchConfig(), hooks or Hooks()
    fields = hooks.run("fields", fields)
    if dense is None or sparse is None:
        index = index or build(entries, encoder, hooks)
        texts = materialise(hooks.run("enrich", field_texts(fields, cfg)), "match-texts")
    dense = hooks.run("dense", dense_hits(texts, index, cfg, encoder) if dense is None else dense)
    sparse = hooks.run("sparse", sparse_hits(texts, index, cfg) if sparse is None else sparse)
    dense = materialise(dense, "match-dense")
    pool = hooks.run("fuse", fusion.fuse(dense, sparse, "linear", cfg.fusion_alpha, top=max(cfg.pool_size, cfg.results_per_field)))
    pool = pool.withColumnRenamed("rank", "fused_rank").join(dense.select("query_id", "doc_id", F.col("score").alias("absolute_cosine")), ["query_id", "doc_id"], "left")
    pool = materialise(hooks.run("pool", pool), "match-pool")
    scored = signals(pool, fields, entries, tree).withColumn("confidence", F.round(scoring.weighted_confidence([F.col(f"s{i}") for i in range(1, 6)], cfg), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "fused_rank")
    ranked = hooks.run("score", scored).withColumn("rank", F.row_number().over(order)).withColumn("margin", F.round(F.col("confidence") - F.lead("confidence").over(order), 6))
    out = ranked.withColumn("decision", scoring.decision(F.col("rank"), F.col("confidence"), F.col("margin"), cfg)).filter(F.col("rank") <= cfg.results_per_field)
    out = out.select(F.col("query_id").alias("field_key"), F.col("doc_id").alias("entry_id"), "rank", "confidence", "margin", "decision", "absolute_cosine", "s1", "s2", "s3", "s4", "s5")
    return hooks.run("decide", out)


def match_with_bypass(fields: DataFrame, entries: DataFrame, tree: DataFrame, verdicts: DataFrame, cfg: MatchConfig | None = None) -> DataFrame:
    """``match`` where fields with a standing verdict (field_key, entry_id) get it as their one result."""
    approved = fields.select("field_key").join(verdicts.select("field_key", "entry_id"), "field_key")
    rest = match(fields.join(verdicts.select("field_key"), "field_key", "left_anti"), entries, tree, cfg)
    zero = {f"s{i}": F.lit(0.0) for i in range(1, 6)}
    fixed = approved.withColumns({"rank": F.lit(1), "confidence": F.lit(1.0), "margin": F.lit(None).cast("double"), "decision": F.lit("AUTO_APPROVE"), "absolute_cosine": F.lit(None).cast("double"), **zero})
    return rest.withColumn("provenance", F.lit("MATCHED")).unionByName(fixed.withColumn("provenance", F.lit("APPROVED_PAIR")))


def session(matches: DataFrame, fields: DataFrame, cfg: MatchConfig | None = None) -> DataFrame:
    """One verdict per field: field_key, entry_id, confidence, verdict; NO_MATCH where nothing matched."""
    cfg = cfg or MatchConfig()
    top = matches.filter("rank = 1")
    rows = fields.select("field_key").join(top, "field_key", "left")
    return rows.select("field_key", "entry_id", "confidence", scoring.field_decision(F.col("decision"), F.col("absolute_cosine"), cfg.absolute_floor).alias("verdict"))
