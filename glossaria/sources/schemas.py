"""Parsers of schema documents: Avro, JSON Schema, SQL DDL, flattened fields.

Each parser turns a document into field rows (``Field``); ``parse_documents``
applies one to a DataFrame of documents and puts those that fail aside. A
document is small and its nesting has no bound, so parsing is plain Python
within Arrow batches.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaria.functions.constants import AVRO_TYPES, DDL_TYPES

FIELD_SCHEMA = "ordinal int, name string, data_type string, full_path string, parent_path string, description string, is_nullable boolean, is_array boolean, array_item_type string, default_value string, source_metadata map<string,string>"


class SchemaError(ValueError):
    """A document that isn't of the parser's format."""


@dataclass
class Field:
    name: str
    data_type: str
    full_path: str
    parent_path: str = ""
    description: str = ""
    is_nullable: bool = False
    is_array: bool = False
    array_item_type: str | None = None
    default_value: str | None = None
    source_metadata: dict[str, str] = field(default_factory=dict)


@dataclass
class Schema:
    name: str
    fields: list[Field]
    namespace: str = ""
    metadata: dict = field(default_factory=dict)


def _text(value) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value)


def _document(content) -> object:
    if not isinstance(content, str):
        return content
    try:
        return json.loads(content)
    except ValueError as error:
        raise SchemaError(f"not JSON: {error}") from error


# --- Avro -------------------------------------------------------------------

_CARRIERS = {"string": "string", "bytes": "bytes", "int": "integer", "long": "long", "float": "float", "double": "double", "boolean": "boolean", "null": "unknown"}
_LOGICAL = {"decimal": "decimal", "date": "date", "time-millis": "timestamp", "time-micros": "timestamp", "timestamp-millis": "timestamp", "timestamp-micros": "timestamp", "local-timestamp-millis": "timestamp", "local-timestamp-micros": "timestamp", "uuid": "uuid"}


class _Avro:
    def __init__(self):
        self.named: dict[str, dict] = {}

    def remember(self, spec: dict, space: str) -> str:
        name = spec.get("name", "")
        own = spec.get("namespace", space)
        if name:
            self.named[name] = self.named[f"{own}.{name}" if own else name] = spec
        return own

    def unwrap(self, spec, space: str):
        """Type without union and reference: (spec, nullable)."""
        nullable = False
        if isinstance(spec, list):
            nullable = "null" in spec
            spec = next((s for s in spec if s != "null"), "null")
        if isinstance(spec, str) and spec not in _CARRIERS:
            spec = self.named.get(spec) or self.named.get(f"{space}.{spec}") or spec
        if isinstance(spec, dict) and isinstance(spec.get("type"), (dict, list)):
            inner, more = self.unwrap(spec["type"], space)
            return inner, nullable or more
        return spec, nullable

    def kind(self, spec) -> str:
        if isinstance(spec, str):
            return _CARRIERS.get(spec, "unknown")
        base, logical = spec.get("type"), spec.get("logicalType")
        if logical in _LOGICAL:
            return _LOGICAL[logical]
        return {"record": "record", "error": "record", "enum": "enum", "array": "array", "map": "record", "fixed": "bytes"}.get(base, _CARRIERS.get(base, "unknown"))

    def fields(self, record: dict, prefix: str, space: str, open_: tuple[str, ...]) -> Iterator[Field]:
        space = self.remember(record, space)
        name = record.get("name", "")
        if name and name in open_:
            return
        for f in record.get("fields", []):
            spec, nullable = self.unwrap(f["type"], space)
            path = f"{prefix}.{f['name']}" if prefix else f["name"]
            meta = {k: _text(v) for k, v in f.items() if k not in ("name", "type", "doc", "default")}
            if isinstance(spec, dict):
                meta |= {k: _text(spec[k]) for k in ("symbols", "logicalType") if k in spec}
            out = Field(f["name"], self.kind(spec), path, prefix, f.get("doc", "") or "", nullable, default_value=_text(f.get("default")), source_metadata=meta)
            inner, at = spec, path
            if isinstance(spec, dict) and spec.get("type") == "array":
                inner, _ = self.unwrap(spec.get("items", "null"), space)
                at = f"{path}[]"
                out.is_array, out.array_item_type = True, self.kind(inner)
            elif isinstance(spec, dict) and spec.get("type") == "map":
                inner, _ = self.unwrap(spec.get("values", "null"), space)
                at = f"{path}{{}}"
            yield out
            yield from self.below(inner, at, space, (*open_, name) if name else open_)

    def below(self, spec, at: str, space: str, open_: tuple[str, ...]) -> Iterator[Field]:
        if not isinstance(spec, dict):
            return
        if spec.get("type") in ("record", "error"):
            yield from self.fields(spec, at, space, open_)
        elif spec.get("type") in ("array", "map"):
            mark = "[]" if spec["type"] == "array" else "{}"
            inner, _ = self.unwrap(spec.get("items" if mark == "[]" else "values", "null"), space)
            yield from self.below(inner, at + mark, space, open_)
        elif spec.get("type") == "enum":
            self.remember(spec, space)


def parse_avro(content) -> Schema:
    doc = _document(content)
    if not isinstance(doc, dict) or doc.get("type") not in ("record", "error") or "fields" not in doc:
        raise SchemaError("not an Avro record")
    return Schema(doc.get("name", ""), list(_Avro().fields(doc, "", doc.get("namespace", ""), ())), doc.get("namespace", ""), {"doc": doc.get("doc", ""), "aliases": doc.get("aliases", [])})


# --- JSON Schema ------------------------------------------------------------

_JSON = {"string": "string", "integer": "integer", "number": "double", "boolean": "boolean", "object": "record", "array": "array", "null": "unknown"}
_FORMATS = {"date": "date", "date-time": "timestamp", "time": "timestamp", "uuid": "uuid", "byte": "bytes", "binary": "bytes", "int64": "long", "float": "float", "double": "double", "decimal": "decimal"}


class _Json:
    def __init__(self, root: dict):
        self.root = root

    def target(self, ref: str):
        at = self.root
        for part in ref.lstrip("#/").split("/"):
            part = part.replace("~1", "/").replace("~0", "~")
            at = at.get(part) if isinstance(at, dict) else None
        return at

    def flat(self, spec, seen: tuple[str, ...] = ()) -> tuple[dict, bool, tuple[str, ...]]:
        """A spec with references followed and combinations merged: (spec, nullable, references followed)."""
        if not isinstance(spec, dict):
            return {}, False, seen
        nullable = bool(spec.get("nullable"))
        if "$ref" in spec:
            ref = spec["$ref"]
            if ref in seen:
                return {"type": "object", "description": spec.get("description", "")}, nullable, seen
            inner, more, seen = self.flat(self.target(ref) or {}, (*seen, ref))
            return inner | {k: v for k, v in spec.items() if k != "$ref"}, nullable or more, seen
        out = {k: v for k, v in spec.items() if k not in ("allOf", "anyOf", "oneOf")}
        parts: dict = {}
        for part in spec.get("allOf", []):
            inner, more, seen = self.flat(part, seen)
            nullable = nullable or more
            props = {**parts.get("properties", {}), **inner.get("properties", {})}
            need = [*parts.get("required", []), *inner.get("required", [])]
            parts = {**parts, **inner, **({"properties": props} if props else {}), **({"required": need} if need else {})}
        if parts:
            both = {k: {**parts.get(k, {}), **out.get(k, {})} for k in ("properties",) if k in parts or k in out}
            out = {**parts, **out, **both, "required": [*parts.get("required", []), *out.get("required", [])]}
        for key in ("anyOf", "oneOf"):
            options = spec.get(key, [])
            nullable = nullable or any(isinstance(o, dict) and o.get("type") == "null" for o in options)
            real = [o for o in options if not (isinstance(o, dict) and o.get("type") == "null")]
            if real:
                inner, more, seen = self.flat(real[0], seen)
                out, nullable = {**inner, **out}, nullable or more
        kinds = out.get("type")
        if isinstance(kinds, list):
            nullable = nullable or "null" in kinds
            out["type"] = next((t for t in kinds if t != "null"), "null")
        return out, nullable, seen

    def kind(self, spec: dict) -> str:
        if "enum" in spec:
            return "enum"
        base = spec.get("type") or ("object" if "properties" in spec else "array" if "items" in spec else None)
        if base in ("string", "number", "integer") and spec.get("format") in _FORMATS:
            return _FORMATS[spec["format"]]
        return _JSON.get(base, "unknown")

    def fields(self, spec: dict, prefix: str, seen: tuple[str, ...]) -> Iterator[Field]:
        need = set(spec.get("required", []))
        for name, raw in spec.get("properties", {}).items():
            got, nullable, below = self.flat(raw, seen)
            path = f"{prefix}.{name}" if prefix else name
            kind = self.kind(got)
            meta = {k: _text(got[k]) for k in ("format", "enum", "pattern", "title", "minLength", "maxLength", "minimum", "maximum") if k in got}
            out = Field(name, kind, path, prefix, got.get("description", "") or "", nullable or name not in need, default_value=_text(got.get("default")), source_metadata=meta)
            if kind == "array":
                yield from self.items(out, got, path, below)
            else:
                yield out
                if kind == "record":
                    yield from self.fields(got, path, below)

    def items(self, out: Field, spec: dict, path: str, seen: tuple[str, ...]) -> Iterator[Field]:
        out.is_array = True
        each = spec.get("prefixItems") or spec.get("items", {})
        if isinstance(each, list):
            flat = [self.flat(e, seen) for e in each]
            out.array_item_type = self.kind(flat[0][0]) if flat else "unknown"
            yield out
            for i, (inner, _, below) in enumerate(flat):
                if self.kind(inner) == "record":
                    yield from self.fields(inner, f"{path}[{i}]", below)
        else:
            inner, _, below = self.flat(each, seen)
            out.array_item_type = self.kind(inner)
            yield out
            if out.array_item_type == "record":
                yield from self.fields(inner, f"{path}[]", below)


def parse_json_schema(content) -> Schema:
    doc = _document(content)
    if not isinstance(doc, dict) or not ({"$schema", "properties", "$ref", "allOf", "definitions", "$defs"} & set(doc)):
        raise SchemaError("not a JSON Schema")
    walker = _Json(doc)
    root, _, seen = walker.flat(doc)
    return Schema(doc.get("title", "") or doc.get("$id", ""), list(walker.fields(root, "", seen)), doc.get("$id", ""), {"description": doc.get("description", "")})


# --- SQL DDL ----------------------------------------------------------------

_QUOTES = {'"': '"', "`": "`", "[": "]"}
_CONSTRAINTS = ("PRIMARY", "FOREIGN", "UNIQUE", "CONSTRAINT", "CHECK", "INDEX", "KEY", "EXCLUDE", "LIKE")
_STOP = re.compile(r"\b(NOT\s+NULL|NULL|DEFAULT|PRIMARY\s+KEY|UNIQUE|REFERENCES|CHECK|CONSTRAINT|COMMENT|COLLATE|GENERATED|AUTO_INCREMENT|AUTOINCREMENT|IDENTITY)\b", re.I)


def _scan(sql: str) -> Iterator[tuple[int, str, str]]:
    """(offset, kind, text) of comments, quoted pieces and single characters."""
    i = 0
    while i < len(sql):
        two = sql[i : i + 2]
        if two == "--" or sql[i] == "#":
            j = sql.find("\n", i)
            j = len(sql) if j < 0 else j
            yield i, "comment", sql[i:j]
        elif two == "/*":
            j = sql.find("*/", i + 2)
            j = len(sql) if j < 0 else j + 2
            yield i, "comment", sql[i:j]
        elif sql[i] == "'" or sql[i] in _QUOTES:
            close, j = _QUOTES.get(sql[i], "'"), i + 1
            while j < len(sql) and (sql[j] != close or (sql[j + 1 : j + 2] == close and close != "]")):
                j += 2 if sql[j] == close else 1
            j = min(len(sql), j + 1)
            yield i, "string" if sql[i] == "'" else "name", sql[i:j]
        else:
            j = i + 1
            yield i, "char", sql[i]
        i = j


def _clean(sql: str) -> str:
    return "".join(" " if kind == "comment" else text for _, kind, text in _scan(sql))


def _closing(sql: str, start: int) -> int:
    depth = 0
    for i, kind, text in _scan(sql[start:]):
        if kind == "char" and text in "()":
            depth += 1 if text == "(" else -1
            if not depth:
                return start + i
    raise SchemaError("unbalanced parentheses")


def _pieces(body: str, at: str = ",") -> list[str]:
    out, depth, last = [], 0, 0
    for i, kind, text in _scan(body):
        if kind == "char":
            depth += (text == "(") - (text == ")")
            if text == at and not depth:
                out.append(body[last:i])
                last = i + 1
    return [p.strip() for p in [*out, body[last:]] if p.strip()]


def _unquote(name: str) -> str:
    return name[1:-1].replace(name[-1] * 2, name[-1]) if len(name) > 1 and name[0] in _QUOTES and name[-1] == _QUOTES[name[0]] else name


def _ddl_type(text: str) -> str:
    up = text.strip().upper()
    return next((kind for pattern, kind in DDL_TYPES if re.match(pattern, up)), "unknown")


def _column(piece: str) -> Field | None:
    found = re.match(r'\s*("(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\]|[^\s"`\[]+)\s*(.*)$', piece, re.S)
    if not found:
        return None
    raw, rest = found[1], found[2].strip()
    if raw[0] not in _QUOTES and raw.upper().rstrip("(") in _CONSTRAINTS:
        return None
    stop = _STOP.search(rest)
    kind = (rest[: stop.start()] if stop else rest).strip()
    tail = rest[stop.start() :] if stop else ""
    up = " ".join(tail.upper().split())
    default = re.search(r"\bDEFAULT\s+('(?:[^']|'')*'|\([^)]*\)|[^\s,]+(?:\([^)]*\))?)", tail, re.I)
    value = default[1] if default else None
    if value and value[0] == "'":
        value = value[1:-1].replace("''", "'") or None
    name = _unquote(raw)
    primary = "PRIMARY KEY" in up
    is_array = kind.endswith("[]") or kind.upper().startswith("ARRAY")
    base = _ddl_type(kind.removesuffix("[]"))
    return Field(name, "array" if is_array else base, name, "", "", not primary and "NOT NULL" not in up, is_array, base if is_array else None, value, {"sql_type": kind} | ({"primary_key": "true"} if primary else {}))


def parse_ddl_all(content: str) -> list[Schema]:
    """Every CREATE TABLE of a script."""
    sql, out, at = _clean(content), [], 0
    start = re.compile(r"\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:GLOBAL\s+|LOCAL\s+)?(?:TEMP(?:ORARY)?\s+|EXTERNAL\s+|UNLOGGED\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?", re.I)
    while found := start.search(sql, at):
        open_ = next((found.end() + i for i, kind, text in _scan(sql[found.end() :]) if kind == "char" and text == "("), None)
        if open_ is None:
            break
        close = _closing(sql, open_)
        parts = [_unquote(p) for p in _pieces(sql[found.end() : open_].strip(), ".")]
        pieces = _pieces(sql[open_ + 1 : close])
        fields = [f for f in map(_column, pieces) if f]
        keys = {_unquote(k) for p in pieces if (m := re.match(r"\s*(?:CONSTRAINT\s+\S+\s+)?PRIMARY\s+KEY\s*\((.*)\)", p, re.I | re.S)) for k in _pieces(m[1])}
        fields = [replace(f, is_nullable=False, source_metadata=f.source_metadata | {"primary_key": "true"}) if f.name in keys else f for f in fields]
        out.append(Schema(parts[-1] if parts else "", fields, ".".join(parts[:-1])))
        at = close + 1
    if not out:
        raise SchemaError("no CREATE TABLE")
    return out


def parse_ddl(content: str) -> Schema:
    """The first table; the others are named in the metadata."""
    tables = parse_ddl_all(content)
    if len(tables) > 1:
        tables[0].metadata |= {"table_count": len(tables), "additional_tables": [t.name for t in tables[1:]]}
    return tables[0]


# --- Flattened fields -------------------------------------------------------

# Keys under which flattened files give a field's parts.
NAME_KEYS = ("flattenedName", "flattened_name", "fieldName", "field_name", "columnName", "column_name", "name", "path")
DOC_KEYS = ("doc", "description", "definition", "comment")
TYPE_KEYS = ("dataType", "data_type", "type", "logicalType")
NULL_KEYS = ("nullable", "isNullable", "is_nullable")
ARRAY_KEYS = ("isArraySerialized", "is_array_serialized", "isArray", "is_array")
PATH_KEYS = ("fullPath", "full_path", "originalPath", "original_path")


def _first(row: dict, keys) -> object:
    return next((row[k] for k in keys if row.get(k) not in (None, "")), None)


def _flag(value) -> bool:
    return value if isinstance(value, bool) else str(value or "").strip().lower() in ("true", "1", "yes", "y", "t")


def flat_type(raw) -> str:
    if isinstance(raw, list):
        return flat_type(next((x for x in raw if str(x).lower() != "null"), None))
    if isinstance(raw, dict):
        return flat_type(raw.get("logicalType") or raw.get("type"))
    text = str(raw or "").strip().lower()
    return AVRO_TYPES.get(text) or AVRO_TYPES.get(re.split(r"[(<\[]", text)[0].strip(), "unknown")


def _flat_rows(content) -> tuple[str, list[dict]]:
    if isinstance(content, str):
        text = content.strip()
        if text[:1] in "{[":
            try:
                content = json.loads(text)
            except ValueError:
                content = [json.loads(line) for line in text.splitlines() if line.strip()]
        else:
            content = list(csv.DictReader(io.StringIO(text)))
    if isinstance(content, dict):
        for key in ("fields", "columns"):
            if isinstance(content.get(key), list) and content.get("type") != "record":
                return content.get("name", ""), content[key]
        if _first(content, NAME_KEYS):
            return "", [content]
        raise SchemaError("not a list of flattened fields")
    return "", list(content)


def parse_flattened(content) -> Schema:
    name, rows = _flat_rows(content)
    used = {*NAME_KEYS, *DOC_KEYS, *TYPE_KEYS, *NULL_KEYS, *ARRAY_KEYS, *PATH_KEYS}
    fields = []
    for row in rows:
        if not isinstance(row, dict) or not _first(row, NAME_KEYS):
            raise SchemaError("a flattened field without a name")
        flat = str(_first(row, NAME_KEYS))
        path = str(_first(row, PATH_KEYS) or flat)
        parts = path.split(".")
        meta = {k: _text(v) for k, v in row.items() if k not in used and v not in (None, "")} | {"flattenedName": flat}
        fields.append(Field(parts[-1], flat_type(_first(row, TYPE_KEYS)), path, ".".join(parts[:-1]), str(_first(row, DOC_KEYS) or ""), _flag(_first(row, NULL_KEYS)), _flag(_first(row, ARRAY_KEYS)) or "__" in flat, source_metadata=meta))
    return Schema(name, fields)


def flatten_avro(content, separator: str = "_", boundary: str = "__", inherit_doc: bool = True) -> list[Field]:
    """Leaf columns of an Avro record: parents joined by ``separator``, ``boundary`` after an array of records."""
    doc, walk = _document(content), _Avro()

    def leaves(record: dict, prefix: str, path: str, docs: str, space: str, open_: tuple[str, ...]) -> Iterator[Field]:
        space = walk.remember(record, space)
        for f in record.get("fields", []):
            spec, nullable = walk.unwrap(f["type"], space)
            flat, at = prefix + f["name"], f"{path}.{f['name']}" if path else f["name"]
            about = f.get("doc") or (docs if inherit_doc else "")
            kind = spec.get("type") if isinstance(spec, dict) else spec
            inner = walk.unwrap(spec.get("items", "null"), space)[0] if kind == "array" else spec
            nested = isinstance(inner, dict) and inner.get("type") in ("record", "error")
            if nested and inner.get("name") not in open_:
                yield from leaves(inner, flat + (boundary if kind == "array" else separator), at, about, space, (*open_, inner.get("name", "")))
            else:
                out = "record" if nested else "json" if kind == "map" else "array" if kind == "array" else walk.kind(spec)
                yield Field(f["name"], out, at, path, about or "", nullable, kind == "array", walk.kind(inner) if kind == "array" else None, _text(f.get("default")), {"flattenedName": flat} | ({"isArraySerialized": "true"} if kind == "array" else {}))

    return list(leaves(doc, "", "", doc.get("doc", ""), doc.get("namespace", ""), (doc.get("name", ""),)))


# --- Dispatch ---------------------------------------------------------------

PARSERS: dict[str, Callable] = {"avro": parse_avro, "json_schema": parse_json_schema, "ddl": parse_ddl, "flattened": parse_flattened}
SUFFIXES = {".avsc": "avro", ".sql": "ddl", ".ddl": "ddl", ".schema.json": "json_schema", ".jsonl": "flattened", ".csv": "flattened"}


def detect(content) -> str:
    """The format of a document by its content."""
    if isinstance(content, str) and re.search(r"\bCREATE\s+(?:\w+\s+)*TABLE\b", content, re.I):
        return "ddl"
    for name in ("avro", "json_schema", "flattened"):
        try:
            PARSERS[name](content)
            return name
        except (SchemaError, ValueError, TypeError, KeyError, AttributeError):
            continue
    raise SchemaError("no parser knows this document")


def parser_for(path: str) -> str:
    for suffix, name in SUFFIXES.items():
        if path.lower().endswith(suffix):
            return name
    raise SchemaError(f"no parser for {path}")


def parse_documents(docs: DataFrame, kind: str | None = None) -> DataFrame:
    """Field rows of ``docs`` (source, content): source, schema_name, error and ``FIELD_SCHEMA``; a failed document is one row with its error."""
    schema = f"source string, schema_name string, error string, {FIELD_SCHEMA}"
    columns = [c.split(" ")[0] for c in schema.replace("map<string,string>", "map").split(", ")]

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for source, content in zip(frame["source"], frame["content"]):
                try:
                    found = PARSERS[kind or detect(content)](content)
                except Exception as error:
                    rows.append((source, None, f"{type(error).__name__}: {error}", *[None] * 11))
                    continue
                for i, f in enumerate(found.fields):
                    rows.append((source, found.name, None, i, f.name, f.data_type, f.full_path, f.parent_path, f.description, f.is_nullable, f.is_array, f.array_item_type, f.default_value, f.source_metadata))
            yield pd.DataFrame(rows, columns=columns).astype({"ordinal": "Int32"})

    return docs.select("source", "content").mapInPandas(run, schema)


def read_directory(spark, path: str, pattern: str = "*") -> DataFrame:
    """source, content of every matching file below ``path``."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("content"))


def read_manifest(spark, path: str) -> list[str]:
    """The paths a manifest lists; blank lines and ``#`` comments are passed over."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> '' and not startswith(v, '#')")
    return [r["v"] for r in lines.collect()]


def struct_fields(schema, prefix: str = "") -> list[tuple[str, str]]:
    """(path, type) of the leaves of a Spark StructType."""
    from pyspark.sql import types as T

    out = []
    for f in schema.fields:
        path, kind = f"{prefix}.{f.name}" if prefix else f.name, f.dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            kind, path = kind.elementType, path + "[]"
        out += struct_fields(kind, path) if isinstance(kind, T.StructType) else [(path, kind.simpleString())]
    return out
