"""Reading glossaries and tables from files, databases and rows."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPTIONS = {
    "csv": {"delimiter", "encoding", "header_row"},
    "json": {"encoding"},
    "parquet": set(),
    "excel": {"sheet", "header_row", "fill_merged"},
    "jdbc": {"query", "user", "password", "driver"},
    "rows": set(),
}
KINDS = {".csv": "csv", ".tsv": "csv", ".txt": "csv", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".parquet": "parquet", ".xlsx": "excel", ".xlsm": "excel", ".xls": "excel"}
#: Cells beyond the header that a row of a file with quoted line breaks keeps at least.
EXTRA_CELLS = 16
WRAPPERS = ("entries", "terms", "rows", "data", "items")


def kind_of(source) -> str:
    if not isinstance(source, str):
        return "rows"
    if source.startswith("jdbc:"):
        return "jdbc"
    for suffix, kind in KINDS.items():
        if source.lower().endswith(suffix):
            return kind
    raise ValueError(f"no reader for {source}")


def read_source(spark: SparkSession, source: str | Iterable[dict], **options) -> DataFrame:
    """Rows of strings from a path, a JDBC URL or dictionaries; unknown options are refused."""
    kind = kind_of(source)
    if unknown := sorted(set(options) - OPTIONS[kind]):
        raise ValueError(f"unknown options for {kind}: {', '.join(unknown)}")
    return {"csv": _csv, "json": _json, "parquet": _parquet, "excel": _excel, "jdbc": _jdbc, "rows": _rows}[kind](spark, source, **options)


def distinct_headers(names: list[str]) -> list[str]:
    """Repeated names get ``_1``, ``_2`` and so on."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(name if n == 0 else f"{name}_{n}")
    return out


def _csv(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str = "UTF-8", header_row: int = 0) -> DataFrame:
    """Missing cells are empty; cells beyond the header go to ``_extra_columns``."""
    sep = delimiter or ("\t" if path.lower().endswith(".tsv") else ",")
    read = lambda: spark.read.option("sep", sep).option("encoding", encoding).option("header", False).option("multiLine", True).option("escape", '"')
    if header_row == 0 and encoding.upper().replace("-", "") in ("UTF8", "UTF8SIG"):
        head = spark.read.text(path).limit(1).collect()
        names = distinct_headers(_split_line(head[0][0].lstrip("﻿"), sep)) if head else []
        skip = 1
    else:
        lines = spark.read.option("encoding", encoding).text(path).limit(header_row + 1).collect()
        names = distinct_headers(_split_line(lines[header_row][0].lstrip("﻿"), sep)) if len(lines) > header_row else []
        skip = header_row + 1
    if not names:
        return spark.createDataFrame([], "_extra_columns string")
    # no row has more cells than its lines have separators, and quotes that stay open on a line span several
    found = spark.read.option("encoding", encoding).text(path).agg(F.max(F.size(F.split("value", re.escape(sep)))), F.max(F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'))), F.lit(2)))).first()
    width = max(len(names), found[0] or 0)
    schema = ", ".join(f"_c{i} string" for i in range(width))
    if skip == 1 and not found[1]:
        body = read().option("multiLine", False).option("header", True).schema(schema).csv(path)
    else:
        width = max(width, len(names) + EXTRA_CELLS)
        raw = read().schema(", ".join(f"_c{i} string" for i in range(width))).csv(path).withColumn("_file", F.col("_metadata.file_path")).withColumn("_n", F.monotonically_increasing_id())
        # with multiLine a file is read in order by one task, so its first rows are its smallest numbers
        first = raw.groupBy(F.col("_file").alias("_f")).agg(F.min("_n").alias("_least"))
        body = raw.join(F.broadcast(first), F.col("_file") == F.col("_f")).filter(F.col("_n") >= F.col("_least") + skip)
    blank = [F.coalesce(F.col(f"_c{i}"), F.lit("")).alias(n) for i, n in enumerate(names)]
    extra = F.concat_ws(sep, *[F.col(f"_c{i}") for i in range(len(names), width)])
    return body.select(*blank, extra.alias("_extra_columns"))


def _split_line(line: str, sep: str) -> list[str]:
    import csv
    import io

    return next(csv.reader(io.StringIO(line), delimiter=sep), [])


def _json(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """JSON lines, a list, an object that wraps a list, or a single object."""
    if path.lower().endswith((".jsonl", ".ndjson")):
        return spark.read.option("encoding", encoding).json(path)
    df = spark.read.option("multiLine", True).option("encoding", encoding).json(path)
    for name in WRAPPERS:
        if name in df.columns and df.schema[name].dataType.typeName() == "array":
            return df.select(F.inline(name))
    return df


def _parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _jdbc(spark: SparkSession, url: str, query: str = "SELECT * FROM glossary", **options) -> DataFrame:
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def _excel(spark: SparkSession, path: str, sheet: str | int = 0, header_row: int = 0, fill_merged: bool = True) -> DataFrame:
    """A worksheet; a merged range's value goes to its empty cells below the header."""
    try:
        import openpyxl
    except ImportError as missing:
        raise ImportError("reading Excel files needs openpyxl") from missing
    import io

    files = spark.read.format("binaryFile").load(path).select("path", "content").orderBy("path")
    several = files.select("path").limit(2).collect()
    if len(several) > 1:
        raise ValueError(f"{path} holds several workbooks; read each by its own path")
    raw = files.first()["content"]
    book = openpyxl.load_workbook(io.BytesIO(raw), data_only=True)
    ws = book.worksheets[sheet] if isinstance(sheet, int) else book[sheet]
    rows = [["" if v is None else str(v) for v in row] for row in ws.iter_rows(values_only=True)]
    if fill_merged:
        for span in ws.merged_cells.ranges:
            value = rows[span.min_row - 1][span.min_col - 1]
            for r in range(max(span.min_row - 1, header_row + 1), span.max_row):
                for c in range(span.min_col - 1, span.max_col):
                    rows[r][c] = rows[r][c] or value
    names = distinct_headers(rows[header_row])
    return spark.createDataFrame([tuple(r) for r in rows[header_row + 1 :]], ", ".join(f"`{n}` string" for n in names))


def _rows(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    rows = list(rows)
    names = list(dict.fromkeys(k for r in rows for k in r))
    text = lambda v: "" if v is None else v if isinstance(v, str) else str(v)
    return spark.createDataFrame([tuple(text(r.get(n)) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names) or "empty string")
