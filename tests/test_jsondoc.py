import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import jsondoc
from corpusloom.operators.evaluate import merged_settings


def run(spark, rows, make):
    """``make`` of the documents (JSON text or None) of each row, as Python values."""
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a string, b string").select("k", F.parse_json("a").alias("a"), F.parse_json("b").alias("b"))
    got = df.select("k", F.to_json(make(F.col("a"), F.col("b"))).alias("out")).orderBy("k").collect()
    return [None if r["out"] is None else json.loads(r["out"]) for r in got]


def test_merge_of_each_kind(spark):
    rows = [
        ('{"a":{"x":1,"y":2},"b":[1,2],"c":1}', '{"a":{"y":3,"z":null},"b":[3],"d":{}}'),
        ('{"a":1}', '{"a":{"x":1}}'),
        ('{"a":{"x":1}}', '{"a":null}'),
        ('{"a":{"x":{"y":{"z":1}}}}', '{"a":{"x":{"y":{"w":2.5}}}}'),
        ("[1]", '{"a":1}'),
        ('{"a":1}', "7"),
        (None, '{"a":1}'),
        ('{"a":1}', None),
        (None, None),
        ("{}", "{}"),
        ('{"a.b":{"":1},"ü \\"q":2}', '{"a.b":{"":2},"ü \\"q":{}}'),
        ('{"a":12345678901234567890.5}', '{"b":true}'),
    ]
    want = [
        {"a": {"x": 1, "y": 3, "z": None}, "b": [3], "c": 1, "d": {}},
        {"a": {"x": 1}},
        {"a": None},
        {"a": {"x": {"y": {"z": 1, "w": 2.5}}}},
        {"a": 1},
        7,
        {"a": 1},
        {"a": 1},
        None,
        {},
        {"a.b": {"": 2}, 'ü "q': {}},
        {"a": 12345678901234567890.5, "b": True},
    ]
    assert run(spark, rows, jsondoc.merged) == want


def test_merge_that_is_too_deep_is_an_error(spark):
    deep = lambda n, x: json.dumps(x) if n == 0 else f'{{"a":{deep(n - 1, x)}}}'
    assert run(spark, [(deep(8, 1), deep(8, 2))], jsondoc.merged) == [json.loads(deep(8, 2))]
    assert run(spark, [(deep(8, 1), deep(20, 2))], jsondoc.merged) == [json.loads(deep(20, 2))]
    with pytest.raises(Exception, match="nested too deep"):
        run(spark, [(deep(9, 1), deep(9, 2))], jsondoc.merged)


def test_set_and_remove(spark):
    doc = '{"a":{"x":1,"y":{"z":2}},"b":null}'
    make = lambda path: lambda a, b: jsondoc.with_member(a, path, b)
    base = json.loads(doc)
    assert run(spark, [(doc, '{"n":1}')], make(["c"])) == [base | {"c": {"n": 1}}]
    assert run(spark, [(doc, "null")], make(["a"])) == [base | {"a": None}]
    assert run(spark, [(doc, "5")], make(["a", "y", "z"])) == [{"a": {"x": 1, "y": {"z": 5}}, "b": None}]
    assert run(spark, [(doc, "5")], make(["a", "w"])) == [{"a": {"x": 1, "y": {"z": 2}, "w": 5}, "b": None}]
    for path in (["c", "x"], ["b", "x"], ["a", "x", "q"]):
        assert run(spark, [(doc, "5")], make(path)) == [base]
    assert run(spark, [(doc, None), (None, "5"), ("[1]", "5")], make(["a"])) == [base, None, [1]]
    assert run(spark, [(doc, None), (None, None), ("[1]", None), ('{"a":1}', None)], lambda a, b: jsondoc.without(a, "a", "q")) == [{"b": None}, None, [1], {}]
    df = spark.createDataFrame([('{"b":1,"a":2}',), ("{}",), ("[1]",), (None,)], "a string")
    assert [r[0] for r in df.select(jsondoc.names(F.parse_json("a"))).collect()] == [["a", "b"], [], None, None]


_VALUE = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab", max_size=2), lambda v: st.lists(v, max_size=2) | st.dictionaries(st.text("abc", max_size=1), v, max_size=3), max_leaves=8)
_DOC = st.dictionaries(st.text("abc", max_size=1), _VALUE, max_size=3)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(_DOC, _DOC), min_size=20, max_size=40))
def test_merge_as_on_the_driver(spark, pairs):
    rows = [(json.dumps(a), json.dumps(b)) for a, b in pairs]
    assert run(spark, rows, jsondoc.merged) == [merged_settings(a, b) for a, b in pairs]
