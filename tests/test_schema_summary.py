"""A schema summary keeps its counts; the texts are not read again."""

from clickwise.sources.schema_catalog import schema_summary


def test_a_summary_keeps_its_counts(spark):
    lines = spark.createDataFrame([('{"a":1,"b":{"c":[1,2.5,{"d":null},[3,[]]],"":{}}}',), ("[1]",), (None,), ("x",), ("{}",), ('{"a":"s","b":1e3}',)], "value string")
    summary = schema_summary(lines)
    assert {r.path: (r.kinds, r.n) for r in summary.collect()} == {
        "a": (["BIGINT", "STRING"], 2), "b": (["DOUBLE", "OBJECT"], 2), "b.": (["OBJECT"], 1), "b.c": (["ARRAY"], 1),
        "b.c[]": (["ARRAY", "BIGINT", "DOUBLE", "OBJECT"], 4), "b.c[].d": (["VOID"], 1), "b.c[][]": (["ARRAY", "BIGINT"], 2)}
    assert "parse_json" not in summary._jdf.queryExecution().toString()
    assert schema_summary(lines.where("false")).collect() == []
