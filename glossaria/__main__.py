"""Command line: match a schema to a glossary, compare two glossaries, show what there is."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from glossaria import __version__
from glossaria.functions.constants import DOMAINS
from glossaria.functions.identifiers import content_hash
from glossaria.operators import sync
from glossaria.plans import index
from glossaria.plans.config import MatchConfig
from glossaria.plans.match import match
from glossaria.sources import schemas, sinks, tabular


def glossary(spark: SparkSession, path: str):
    """Entries of a glossary file, with ids and types."""
    return index.load(tabular.read_source(spark, path))[0]


def fields(spark: SparkSession, path: str, kind: str | None):
    """Fields of the schema documents at ``path``; a document that fails is an error."""
    rows = schemas.parse_documents(schemas.read_directory(spark, path), kind)
    failed = rows.filter("error is not null").select("source", "error").limit(10).collect()
    if failed:
        raise SystemExit("\n".join(f"{r['source']}: {r['error']}" for r in failed))
    key = F.concat_ws("#", "source", F.col("ordinal").cast("string"))
    return rows.withColumn("field_key", key).withColumn("declared_domain", F.lit(""))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="glossaria", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    m = sub.add_parser("match", help="match schema fields to glossary entries")
    m.add_argument("glossary")
    m.add_argument("schema")
    m.add_argument("--format", choices=sorted(schemas.PARSERS))
    m.add_argument("--config", help="JSON or TOML file of settings")
    m.add_argument("--top-k", type=int, default=5)
    m.add_argument("--threshold", type=float, default=0.0)
    m.add_argument("--out", help="folder for the result; shown if left out")
    m.add_argument("--as", dest="kind", choices=("json", "csv"), default="json")
    s = sub.add_parser("sync", help="what changed from one glossary file to another")
    s.add_argument("previous")
    s.add_argument("current")
    sub.add_parser("info", help="version and formats")
    args = parser.parse_args(argv)
    if args.command == "info":
        print(json.dumps({"version": __version__, "schemas": sorted(schemas.PARSERS), "sources": sorted(set(tabular.KINDS.values()) | {"jdbc"})}))
        return 0
    spark = SparkSession.builder.appName("glossaria").getOrCreate()
    if args.command == "sync":
        hashed = lambda p: glossary(spark, p).select(F.col("id").alias("entry_id"), content_hash(F.concat_ws("|", "business_name", "logical_name", "definition")).alias("hash"))
        sync.report(sync.diff(hashed(args.previous), hashed(args.current))).show(truncate=False)
        return 0
    cfg = MatchConfig()
    if args.config:
        with open(args.config, encoding="utf-8") as f:
            cfg = MatchConfig.load(f.read(), "toml" if args.config.endswith(".toml") else "json")
    out = match(fields(spark, args.schema, args.format), glossary(spark, args.glossary), spark.createDataFrame(list(DOMAINS), "name string, parent string"), cfg)
    if not args.out:
        out.filter((F.col("rank") <= args.top_k) & (F.col("confidence") >= args.threshold)).orderBy("field_key", "rank").show(1000, truncate=False)
    elif args.kind == "csv":
        sinks.write_csv(out, args.out, args.top_k, args.threshold)
    else:
        sinks.write_json(out, args.out, cfg.weights, top_k=args.top_k, threshold=args.threshold)
    return 0


if __name__ == "__main__":
    sys.exit(main())
