import json

from parchment.operators import nested

S = "raw_id long, payload string, item_key string"


def rows(spark, payloads):
    df = spark.createDataFrame([(i, p, "clash") for i, p in enumerate(payloads)], S)
    return {(r.raw_id, r.item_kind, r.item_key, r.parent_key) for r in nested.emit_items(df).collect()}


def test_shapes(spark):
    tree = {"root": {"node_id": "r", "children": {"node_id": "a", "children": [{"node_id": "b"}, None, "text", {"children": []}]}}}
    cases = [{"name": "c", "expected": {"condition": {"span": {"start": 1, "end": 9}, "operands": [{"span": {"start": 2, "end": 3}, "operands": {"span": {"start": 2}}}]}, "exceptions": [{"span": {"start": 4, "end": 5}}], "diagnostics": {"span": {"start": 6, "end": 7}}}}, {"name": None, "expected": None}]
    got = rows(spark, [json.dumps(tree), "﻿" + json.dumps(cases), json.dumps(json.dumps({"conditions": cases[:1]})), '{"root": ', None, "", "[]", "3", '"text"', json.dumps({"root": None})])
    assert {x[1:] for x in got if x[0] == 0} == {("node", "r", ""), ("node", "a", "r"), ("node", "b", "a"), ("node", "", "a")}
    one = {("case", "c", ""), ("condition", "c/1-9", "c"), ("condition", "c/2-3", "c/1-9"), ("condition", "c/2-", "c/2-3"), ("exception", "c/4-5", "c"), ("diagnostic", "c/6-7", "c")}
    assert {x[1:] for x in got if x[0] == 1} == one | {("case", "", "")}
    assert {x[1:] for x in got if x[0] == 2} == one
    assert {x for x in got if x[1] == "unreadable"} == {(3, "unreadable", "", ""), (5, "unreadable", "", "")}
    assert not {x for x in got if x[0] in (4, 6, 7, 8, 9)}


def test_deep_and_repeated(spark):
    deep = {"node_id": "0"}
    for i in range(1, 400):
        deep = {"node_id": str(i), "children": [deep]}
    text = json.dumps({"root": deep})
    df = spark.createDataFrame([(1, text), (1, text)], "raw_id long, payload string")
    items = nested.emit_items(df)
    assert items.count() == 400 and items.agg({"depth": "max"}).first()[0] == 399


def test_tables_and_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, json.dumps([{"name": "c", "expected": {"condition": {"type": "comparison", "operator": "<", "threshold": {"value": 2.5, "unit": "mm"}, "span": {"start": 0, "end": 1}}}}]))], "raw_id long, payload string")
    items = nested.emit_items(df)
    t = nested.item_tables(items)["condition"].first()
    assert (t.operator, t.threshold, t.unit, t.parent_key) == ("<", 2.5, "mm", "c")
    nested.write_tables(items, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"item_kind=case", "item_kind=condition"}


def test_empty(spark):
    assert nested.emit_items(spark.createDataFrame([], "raw_id long, payload string")).count() == 0


def test_deeper_than_the_call_stack(spark):
    n = 20_000
    text = '{"root": ' + "".join(f'{{"node_id": "{i}", "children": [' for i in range(n)) + "]}" * n + "}"
    got = rows(spark, [text, text[:-1], '{"conditions": {"name": "c", "x": ' + "[" * n + "]" * n + "}}"])
    assert {x[1:] for x in got if x[0] == 0} == {("node", str(i), str(i - 1) if i else "") for i in range(n)}
    assert {x[1:] for x in got if x[0] == 1} == {("unreadable", "", "")} and {x[1:] for x in got if x[0] == 2} == {("case", "c", "")}


def test_the_deep_reader_reads_as_json():
    good = ['{"a": [1, -2.5e3, true, null, "x\\u00e9"], "b": {}, "c": [], "d": [[], {"e": {"f": [{}]}}]}', "[]", " [1 ,2 ] ", '"x"', "3", "{}", '[[1,[2]],"a"]', "[1e5]"]
    for t in good:
        assert nested._read_deep(t) == json.loads(t) and nested._write_deep(json.loads(t)) == json.dumps(json.loads(t), sort_keys=True), t
    for t in ("", "[", "]", "{", '{"a"}', '{"a":}', "[1,]", "[,1]", '{"a":1,}', "[1 2]", "1 2", "[1]]", "{1:2}", '{"a":1 "b":2}', "[01]", "tru", '"x'):
        for read in (json.loads, nested._read_deep):
            try:
                read(t)
            except ValueError:
                continue
            raise AssertionError((read, t))
