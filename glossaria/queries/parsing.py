"""Queries of the schema parsers over literal documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossaria.queries.registry import query
from glossaria.sources import schemas

AVRO = """{"type": "record", "name": "Customer", "namespace": "com.example", "doc": "A customer", "fields": [
 {"name": "id", "type": "long", "doc": "key"},
 {"name": "email", "type": ["null", "string"], "default": null},
 {"name": "home", "type": {"type": "record", "name": "Address", "fields": [{"name": "street", "type": "string"}, {"name": "since", "type": {"type": "int", "logicalType": "date"}}]}},
 {"name": "others", "type": {"type": "array", "items": "Address"}},
 {"name": "tags", "type": {"type": "array", "items": "string"}},
 {"name": "limits", "type": {"type": "map", "values": "Address"}},
 {"name": "kind", "type": {"type": "enum", "name": "Kind", "symbols": ["A", "B"]}},
 {"name": "parent", "type": ["null", "Customer"]}]}"""

JSON_SCHEMA = """{"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "Order", "type": "object", "required": ["id", "lines"], "$defs": {"line": {"type": "object", "required": ["sku"], "properties": {"sku": {"type": "string"}, "qty": {"type": "integer"}, "sub": {"$ref": "#/$defs/line"}}}, "alias": {"$ref": "#/$defs/line"}},
 "properties": {"id": {"type": "string", "format": "uuid"}, "placed": {"type": ["string", "null"], "format": "date-time"}, "lines": {"type": "array", "items": {"$ref": "#/$defs/alias"}}, "state": {"enum": ["new", "old"]}, "price": {"anyOf": [{"type": "number"}, {"type": "null"}]}, "pair": {"type": "array", "items": [{"type": "string"}, {"type": "object", "properties": {"x": {"type": "boolean"}}}]}, "who": {"allOf": [{"type": "object", "properties": {"name": {"type": "string"}}}, {"properties": {"age": {"type": "integer"}}, "required": ["age"]}]}}}"""

DDL = """-- two tables; 'not a table'
CREATE TABLE IF NOT EXISTS [dbo].[Accounts] (
  id BIGINT PRIMARY KEY, "full name" VARCHAR(100) NOT NULL DEFAULT 'it''s, (fine)', `bal` NUMERIC(10,2) DEFAULT 0.0, /* note, here */
  opened TIMESTAMP WITH TIME ZONE, tags TEXT[], CHECK (bal > 0 AND (id <> 3)), CONSTRAINT u UNIQUE (id), empty TEXT DEFAULT '');
create table "my.schema"."my.table" (a int not null, b DOUBLE PRECISION, PRIMARY KEY (a));"""

FLAT = """[{"flattenedName": "customer.name", "dataType": "string", "doc": "Name", "owner": "crm"}, {"flattenedName": "orders__sku", "dataType": "varchar(10)", "nullable": "true"}, {"column_name": "bal_amt", "type": "decimal(10,2)", "full_path": "acct.bal_amt", "is_array": false}]"""


def _run(spark, kind: str, content: str):
    rows = schemas.parse_documents(spark.createDataFrame([(kind, content)], "source string, content string"), kind)
    return rows.select("ordinal", "name", "data_type", "full_path", "parent_path", "is_nullable", "is_array", F.coalesce("array_item_type", F.lit("")).alias("item_type"))


def _sql(rows: list[tuple]) -> str:
    body = ", ".join(f"({i}, '{n}', '{t}', '{p}', '{pp}', {str(nul).upper()}, {str(arr).upper()}, '{it}')" for i, (n, t, p, pp, nul, arr, it) in enumerate(rows))
    return f"SELECT * FROM (VALUES {body}) AS t(ordinal, name, data_type, full_path, parent_path, is_nullable, is_array, item_type)"


@query(
    "parse_avro",
    _sql(
        [
            ("id", "long", "id", "", False, False, ""),
            ("email", "string", "email", "", True, False, ""),
            ("home", "record", "home", "", False, False, ""),
            ("street", "string", "home.street", "home", False, False, ""),
            ("since", "date", "home.since", "home", False, False, ""),
            ("others", "array", "others", "", False, True, "record"),
            ("street", "string", "others[].street", "others[]", False, False, ""),
            ("since", "date", "others[].since", "others[]", False, False, ""),
            ("tags", "array", "tags", "", False, True, "string"),
            ("limits", "record", "limits", "", False, False, ""),
            ("street", "string", "limits{}.street", "limits{}", False, False, ""),
            ("since", "date", "limits{}.since", "limits{}", False, False, ""),
            ("kind", "enum", "kind", "", False, False, ""),
            ("parent", "record", "parent", "", True, False, ""),
        ]
    ),
)
def parse_avro(spark, sf):
    return _run(spark, "avro", AVRO)


@query(
    "parse_json_schema",
    _sql(
        [
            ("id", "uuid", "id", "", False, False, ""),
            ("placed", "timestamp", "placed", "", True, False, ""),
            ("lines", "array", "lines", "", False, True, "record"),
            ("sku", "string", "lines[].sku", "lines[]", False, False, ""),
            ("qty", "integer", "lines[].qty", "lines[]", True, False, ""),
            ("sub", "record", "lines[].sub", "lines[]", True, False, ""),
            ("state", "enum", "state", "", True, False, ""),
            ("price", "double", "price", "", True, False, ""),
            ("pair", "array", "pair", "", True, True, "string"),
            ("x", "boolean", "pair[1].x", "pair[1]", True, False, ""),
            ("who", "record", "who", "", True, False, ""),
            ("name", "string", "who.name", "who", True, False, ""),
            ("age", "integer", "who.age", "who", False, False, ""),
        ]
    ),
)
def parse_json_schema(spark, sf):
    return _run(spark, "json_schema", JSON_SCHEMA)


@query(
    "parse_ddl",
    _sql(
        [
            ("id", "long", "id", "", False, False, ""),
            ("full name", "string", "full name", "", False, False, ""),
            ("bal", "decimal", "bal", "", True, False, ""),
            ("opened", "timestamp", "opened", "", True, False, ""),
            ("tags", "array", "tags", "", True, True, "string"),
            ("empty", "string", "empty", "", True, False, ""),
        ]
    ),
)
def parse_ddl(spark, sf):
    return _run(spark, "ddl", DDL)


@query("parse_flattened", _sql([("name", "string", "customer.name", "customer", False, False, ""), ("orders__sku", "string", "orders__sku", "", True, True, ""), ("bal_amt", "decimal", "acct.bal_amt", "acct", False, False, "")]))
def parse_flattened(spark, sf):
    return _run(spark, "flattened", FLAT)


@query("parse_quarantine", "SELECT * FROM (VALUES ('avro', 14, FALSE), ('broken', 1, TRUE), ('ddl', 6, FALSE), ('json', 13, FALSE)) AS t(source, n, failed)")
def parse_quarantine(spark, sf):
    docs = spark.createDataFrame([("avro", AVRO), ("json", JSON_SCHEMA), ("ddl", DDL), ("broken", "{nothing")], "source string, content string")
    return schemas.parse_documents(docs).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("error").isNotNull()).alias("failed"))
