import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.operators.nested import explode_nested, node_links, nodes_of, read_deep, read_json, subtype_table, variant_counts

ROOTS = ("std_info", "file_name")


def links(text):
    return [(n, p) for n, p, *_ in nodes_of(text, ROOTS)]


def test_paths():
    text = json.dumps({"std_info": {"a": 1, "owner": {"sid": "S", "quota": {}}}, "file_name": [None, {"attr_val": "x", "streams": [{"name": ""}, {"name": "b", "runs": {"lcn": 1, "length": 2}}]}], "other": {"x": 1}})
    assert links(text) == [("std_info[0]", ""), ("std_info[0].owner[0]", "std_info[0]"), ("file_name[1]", ""), ("file_name[1].streams[0]", "file_name[1]"), ("file_name[1].streams[1]", "file_name[1]"), ("file_name[1].streams[1].runs[0]", "file_name[1].streams[1]")]


def test_json_in_strings():
    inner = json.dumps({"attr_val": "x", "parent": json.dumps({"reference": 1})})
    assert links(json.dumps({"file_name": inner})) == [("file_name[0]", ""), ("file_name[0].parent[0]", "file_name[0]")]
    assert links(json.dumps({"file_name": json.dumps([inner])})) == [("file_name[0]", ""), ("file_name[0].parent[0]", "file_name[0]")]
    assert links(json.dumps({"file_name": {"note": "{not json"}})) == [("file_name[0]", "")]


def test_nothing_to_find():
    for text in (None, "", " ", "null", "[]", "{}", '{"std_info": {}}', '{"std_info": {"a": 1}', '{"std_info": {"a": NaN}}', "x" * 100_000, "[" * 100_000):
        assert links(text) == []


def test_tables(spark):
    text = json.dumps({"file_name": [{"attr_val": "x", "file_name": "a", "parent_reference": 7, "streams": [{"name": "s", "size": 5}, {"odd": 1}]}]})
    frame = spark.createDataFrame([(1, text, "clash"), (1, text, "clash"), (2, None, None)], "row_id bigint, attribute string, node string")
    nodes = explode_nested(frame, "attribute", ROOTS)
    assert nodes.count() == 6
    streams = subtype_table(nodes, "stream").collect()
    assert {(r["node"], r["parent_node"], r["f_name"], r["f_size"]) for r in streams} == {("file_name[0].streams[0]", "file_name[0]", "s", 5)}
    assert {r["subtype"]: r["objects"] for r in variant_counts(nodes).collect()} == {"file_name": 2, "stream": 2, "other": 2}
    assert node_links(frame.limit(0), "attribute", ROOTS).count() == 0


def test_deep_records():
    for deep in (900, 3000):
        text = '{"std_info": ' + '{"a": ' * deep + '{"b": 1}' + "}" * deep + "}"
        nodes = nodes_of(text, ("std_info",))
        assert len(nodes) == deep + 1 and nodes[-1][4] == deep and nodes[-1][1] == nodes[-2][0]


def test_any_depth():
    for deep in (5_000, 20_000, 100_000):
        arrays = '{"std_info": ' + "[" * deep + '{"b": 1}' + "]" * deep + "}"
        assert [(n[0], n[1]) for n in nodes_of(arrays, ("std_info",))] == [("std_info" + "[0]" * deep, "")]
        objects = '{"deep": ' + '{"a": ' * deep + "1" + "}" * deep + ', "std_info": {"b": 1}}'
        assert [(n[0], n[1]) for n in nodes_of(objects, ("std_info",))] == [("std_info[0]", "")]
        assert nodes_of(objects[:-2], ("std_info",)) == []
    mixed = '{"std_info": ' + '{"a": [' * 3_000 + '{"b": 1}' + "]}" * 3_000 + "}"
    nodes = nodes_of(mixed, ("std_info",))
    assert len(nodes) == 3_001 and all(b[1] == a[0] for a, b in zip(nodes, nodes[1:], strict=False))


def outcome(read, text):
    try:
        return read(text)
    except ValueError:
        return "broken"


VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(max_size=3), v, max_size=3), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(VALUES, st.integers(0, 60), st.sampled_from(["", ",", "}", "]", '"', "{", "[", " ", "\\", "1", "e", "NaN", "\n"]))
def test_the_deep_reader_agrees_with_the_standard_one(value, place, extra):
    text = json.dumps(value, indent=place % 3 or None)
    assert read_deep(text) == read_json(text) == value
    cut = text[:place] + extra + text[place + place % 2 :]
    assert repr(outcome(read_deep, cut)) == repr(outcome(read_json, cut))
