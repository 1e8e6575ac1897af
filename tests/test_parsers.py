import pytest

from glossaria.queries.parsing import AVRO, DDL, FLAT, JSON_SCHEMA
from glossaria.sources import schemas as s


def test_avro_documents():
    got = s.parse_avro(AVRO)
    assert (got.name, got.namespace) == ("Customer", "com.example")
    by = {f.full_path: f for f in got.fields}
    assert by["id"].description == "key" and by["kind"].source_metadata["symbols"] == '["A", "B"]'
    assert by["home.since"].source_metadata["logicalType"] == "date"
    with pytest.raises(s.SchemaError):
        s.parse_avro('{"type": "enum", "name": "x"}')
    with pytest.raises(s.SchemaError):
        s.parse_avro("nothing")


def test_flattened_avro():
    flat = {f.source_metadata["flattenedName"]: f for f in s.flatten_avro(AVRO)}
    assert list(flat) == ["id", "email", "home_street", "home_since", "others__street", "others__since", "tags", "limits", "kind", "parent"]
    assert flat["tags"].source_metadata["isArraySerialized"] == "true" and flat["limits"].data_type == "json" and flat["parent"].data_type == "record"
    assert flat["home_street"].description == "A customer" and s.flatten_avro(AVRO, inherit_doc=False)[2].description == ""


def test_ddl_scripts():
    first, second = s.parse_ddl_all(DDL)
    assert (first.namespace, first.name, second.namespace, second.name) == ("dbo", "Accounts", "my.schema", "my.table")
    by = {f.name: f for f in first.fields}
    assert by["full name"].default_value == "it's, (fine)" and by["bal"].default_value == "0.0" and by["empty"].default_value is None
    assert by["id"].source_metadata["primary_key"] == "true" and not second.fields[0].is_nullable
    one = s.parse_ddl(DDL)
    assert one.metadata == {"table_count": 2, "additional_tables": ["my.table"]}
    with pytest.raises(s.SchemaError):
        s.parse_ddl("SELECT 1")


def test_json_schemas():
    got = s.parse_json_schema(JSON_SCHEMA)
    assert got.name == "Order" and {f.full_path: f for f in got.fields}["id"].source_metadata["format"] == "uuid"
    with pytest.raises(s.SchemaError):
        s.parse_json_schema("[1]")


def test_flattened_shapes():
    rows = s.parse_flattened(FLAT).fields
    assert rows[0].source_metadata == {"owner": "crm", "flattenedName": "customer.name"} and rows[0].parent_path == "customer"
    assert rows[1].is_array and rows[1].is_nullable
    lines = "\n".join(['{"name": "a", "type": "int"}', '{"name": "b", "type": ["null", "long"]}'])
    assert [f.data_type for f in s.parse_flattened(lines).fields] == ["integer", "long"]
    assert [f.data_type for f in s.parse_flattened("columnName,dataType,comment\nx,bigint,hi\n").fields] == ["long"]
    assert s.parse_flattened({"name": "T", "fields": [{"name": "q", "type": {"logicalType": "uuid"}}]}).name == "T"
    with pytest.raises(s.SchemaError):
        s.parse_flattened({"type": "record", "fields": []})


def test_detection():
    assert [s.detect(x) for x in (AVRO, JSON_SCHEMA, DDL, FLAT)] == ["avro", "json_schema", "ddl", "flattened"]
    assert (s.parser_for("a/B.AVSC"), s.parser_for("x.sql"), s.parser_for("y.schema.json")) == ("avro", "ddl", "json_schema")
    with pytest.raises(s.SchemaError):
        s.parser_for("z.bin")


def test_directory_and_manifest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.avsc").write_text(AVRO)
    (tmp_path / "in/b.sql").write_text(DDL)
    (tmp_path / "list.txt").write_text("# schemas\n\n a.avsc \nb.sql\n")
    rows = s.parse_documents(s.read_directory(spark, str(tmp_path / "in"), "*.sql"))
    assert {r["schema_name"] for r in rows.collect()} == {"Accounts"}
    assert s.read_manifest(spark, str(tmp_path / "list.txt")) == ["a.avsc", "b.sql"]
    assert s.struct_fields(spark.createDataFrame([], "a int, b struct<c string, d array<struct<e date>>>").schema) == [("a", "int"), ("b.c", "string"), ("b.d[].e", "date")]
