"""Golden cases of the evidence, provision, layout, relation, graph and geometry operators."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F, types as T

from parchment.functions import ids, locators
from parchment.operators import evidence as ev, geometry, graphs, layout, provisions as pv, relations as rel, trees, vectors
from parchment.sources import readers, sinks


def parsed(spark, text):
    return pv.parse(spark.createDataFrame([(text,)], "sentence string")).first()


def test_provision_golden(spark):
    r = parsed(spark, "Research facilities exceeding 40 feet in height shall provide two marked evacuation routes, except as permitted by Section 12.4.")
    assert (r.modality, r.subject, r.condition_type, r.verb, r.object, r.exception_section) == ("requirement", "Research facilities", "comparison", "provide", "two marked evacuation routes", "12.4")
    c = r.comparisons[0]
    assert (c.property, c.operator, c.value, c.unit) == ("height", ">", 40.0, "ft") and r.diagnostics == ""
    assert "Research facilities exceeding 40 feet in height "[: r.modal_start].rstrip() and r.modal_end - r.modal_start == 5


@pytest.mark.parametrize(
    "text, kind, code",
    [
        ("Halls exceeding 4 feet in width and at least 9 inches in depth shall have doors.", "all_of", ""),
        ("Halls exceeding 4 feet in width or at least 9 inches in depth shall have doors.", "any_of", ""),
        ("Halls exceeding 4 feet in width or at least 9 inches in depth and more than 2 ft in run shall have doors.", None, "ambiguous-condition-connectors"),
        ("Halls exceeding many feet shall have doors.", None, "unsupported-condition-clause"),
        ("Halls exceeding (4 feet in width) shall have doors.", None, "unsupported-condition-grouping"),
        ("Halls shall dance.", None, "unsupported-action-shape"),
        ("Halls have doors.", None, "missing-modality"),
    ],
)
def test_provision_cases(spark, text, kind, code):
    r = parsed(spark, text)
    assert (r.condition_type, r.diagnostics) == (kind, code)


def test_provision_nulls(spark):
    assert parsed(spark, None).modality == "unknown"
    assert parsed(spark, "").diagnostics == "missing-modality"


def test_reference_spans(spark):
    text = "See Table 3.1 and Section 4.2.1; é Figure 9."
    rows = pv.reference_spans(spark.createDataFrame([(1, text)], "k int, text string"), "k").collect()
    assert [(text[r.start : r.end]) for r in rows] == ["Table 3.1", "Section 4.2.1", "Figure 9"]


def test_search(spark):
    s = "evidence_id string, source_id string, pdf_page int, block_index int, text string, bbox array<double>, observed_metadata map<string,string>, loaded_at timestamp_ntz"
    at = datetime(2020, 1, 1)
    df = spark.createDataFrame([("b", "s", 1, 2, "Exit exit EXIT", None, None, at), ("a", "s", 1, 1, "the exit", None, {"font_size": "x"}, at), ("c", "s", None, None, None, None, None, at), ("a", "s", 1, 1, "the exit", None, None, None)], s)
    cur = ev.current(df)
    assert cur.count() == 3
    assert [(r.evidence_id, r.score) for r in ev.search_exact(cur, "exit").collect()] == [("a", 1.0), ("b", 1.0)]
    assert [(r.evidence_id, r.score) for r in ev.search_phrase(cur, "exit", 1).collect()] == [("a", 1.0)]
    assert [(r.evidence_id, r.score) for r in ev.search_tokens(cur, "exit the").collect()] == [("a", 1.0)]
    assert {r.evidence_id for r in ev.search_ranked(cur, "exit exit", "evidence_id").collect()} == {"a", "b"}
    assert ev.structural(cur).where("heading").count() == 0
    assert ev.structural_search(cur, "exit", min_font=1.0).count() == 0
    assert {r.citation: r.supported for r in ev.check_citations(ev.grounding_packet(cur.where("pdf_page is not null"), "the"), spark.createDataFrame([("a",), ("z",)], "citation string")).collect()} == {"a": True, "z": False}


def test_ids(spark):
    import hashlib

    df = spark.createDataFrame([('a"b\\c\n', 3)], "s string, n int")
    got = df.select(ids.stable_id("x:", s=ids.json_text(F.col("s")), n=ids.number_text(F.col("n"))).alias("i")).first().i
    assert got == "x:" + hashlib.sha256(b'{"n":3,"s":"a\\"b\\\\c\\n"}').hexdigest()


def test_locators(spark):
    df = spark.createDataFrame([("1.2(a)(b).3",), ("1.10",), ("1.9",), ("section:1.1/list:2",), ("7",)], "k string")
    r = {x.k: x for x in df.select("k", locators.parent(F.col("k")).alias("p"), locators.depth(F.col("k")).alias("d"), locators.natural_key(F.col("k")).alias("n")).collect()}
    assert (r["1.2(a)(b).3"].p, r["1.2(a)(b).3"].d) == ("1.2(a)(b)", 5)
    assert r["1.9"].n < r["1.10"].n and r["section:1.1/list:2"].p == "section:1.1" and r["7"].p is None


def test_weighted_median(spark):
    r = random.Random(1)
    rows = [("a", float(r.randrange(8)), r.randrange(1, 9)) for _ in range(40)]
    import statistics

    want = round(statistics.median([v for _, v, w in rows for _ in range(w)]), 3)
    got = layout.weighted_median(spark.createDataFrame(rows, "p string, v double, w int"), "p", F.col("v"), F.col("w")).first()
    assert got.body == want


def test_spacing_repair(spark):
    df = spark.createDataFrame([("fire door",), ("fire door firedoor",), ("fire door",), (None,)], "text string")
    assert [tuple(r) for r in layout.spacing_repairs(df).collect()] == [("firedoor", "fire", "door", 3)]


def test_components_and_cycles(spark):
    r = random.Random(9)
    edges = [(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(34)] + [("solo", "solo")]
    df = spark.createDataFrame(edges, "source string, target string")
    reach = {a: {a} for e in edges for a in e}
    for _ in range(len(reach)):
        for a, b in edges:
            reach[a] |= reach[b]
    want = {}
    for a in reach:
        group = {b for b in reach if b in reach[a] and a in reach[b]}
        if len(group) > 1 or (a, a) in edges:
            want[a] = max(group)
    for bound in (0, 10_000):
        assert {x.node: x.component for x in graphs.cycles(df, local_edges=bound).collect()} == want
    near = {a: {a} for a in reach}
    for _ in range(len(reach)):
        for a, b in edges:
            near[a] = near[b] = near[a] | near[b]
            for c in near[a]:
                near[c] = near[a]
    assert {x.node: x.component for x in graphs.components(df).collect()} == {a: min(near[a]) for a in near}
    empty = spark.createDataFrame([], "source string, target string")
    assert graphs.cycles(empty).count() == 0 and graphs.components(empty).count() == 0


def test_intervals(spark):
    r = random.Random(4)
    rows = [("k", i, s := r.randrange(50), None if i % 7 == 0 else s + 1 + r.randrange(20)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, i int, s int, e int")
    big = 10**6
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[2] < (b[3] or big) and b[2] < (a[3] or big)}
    assert {(x.a, x.b) for x in rel.overlaps_within(df, "k", "i", "s", "e", 7).collect()} == want
    assert rel.active_at(df, "s", "e", F.lit(10)).count() == sum(x[2] <= 10 and (x[3] is None or 10 < x[3]) for x in rows)


def test_as_of_and_sessions(spark):
    left = spark.createDataFrame([("a", 5, "x"), ("a", 1, "y"), ("b", 9, "z")], "k string, t int, n string")
    right = spark.createDataFrame([("a", 3, "three"), ("a", 5, "five")], "k string, t int, v string")
    assert {(r.n, r.v) for r in rel.as_of(left, right, ["k"], "t", "v", F.floor(F.col("t") / 2)).collect()} == {("x", "five"), ("y", None), ("z", None)}
    s = rel.gap_sessions(spark.createDataFrame([("u", 0, 1), ("u", 5, 2), ("u", 50, 3)], "u string, t int, i int"), ["u"], "t", F.col("_step") > 10, "i", F.floor(F.col("t") / 4))
    assert [(x.i, x.session) for x in s.orderBy("i").collect()] == [(1, 1), (2, 1), (3, 2)]


def test_ownership(spark):
    cap = spark.createDataFrame([("c1", "p", 10.0, 0.0, 5.0), ("c2", "p", 11.0, 50.0, 55.0), ("c3", "q", 10.0, 0.0, 5.0)], "caption_id string, page string, x0 double, y0 double, y1 double")
    can = spark.createDataFrame([("t1", "p", 10.0, 60.0, 80.0, False), ("t2", "p", 10.0, 20.0, 30.0, False), ("t3", "p", 90.0, 1.0, 2.0, False), ("t4", "q", 12.0, 1.0, 2.0, False), ("t5", "p", 10.0, 51.0, 80.0, True)], "candidate_id string, page string, x0 double, y0 double, y1 double, ruled boolean")
    got = {r.candidate_id: (r.caption_id, r.state) for r in rel.ownership(cap, can).collect()}
    assert got == {"t1": ("c2", "owned"), "t2": ("c1", "owned"), "t3": (None, "unresolved"), "t4": ("c3", "owned"), "t5": ("c2", "owned")}


def test_geometry(spark):
    s = "source_id string, pdf_page int, id string, x0 double, y0 double, x1 double, y1 double"
    df = spark.createDataFrame([("s", 1, "a", 0.0, 0.0, 10.0, 9.0), ("s", 1, "b", 40.0, 1.0, 50.0, 10.0), ("s", 1, "c", 0.0, 60.0, 10.0, 69.0)], s)
    r = geometry.table_rows(df).collect()
    assert [(x.row_no, x.cells) for x in r] == [(1, 2)]
    assert sorted(x.members for x in geometry.box_clusters(df, 31.0).collect()) == [1, 2]
    kind = "source_id string, pdf_page int, x0 double, y0 double, x1 double, y1 double"
    upper = [("s", 1, 0.0, y, 200.0, y) for y in (0.0, 10.0, 10.5, 20.0)] + [("s", 1, x, 0.0, x, 20.0) for x in (0.0, 100.0, 200.0)]
    lower = [("s", 1, 0.0, y, 200.0, y) for y in (300.0, 320.0, 340.0)] + [("s", 1, 0.0, 300.0, 0.0, 340.0)]
    beside = [("s", 1, 300.0, y, 500.0, y) for y in (5.0, 15.0, 25.0)]
    stray = [("s", 1, 0.0, 600.0, 590.0, 600.0), ("s", 1, 10.0, 700.0, 30.0, 700.0), ("s", 2, 0.0, 0.0, 200.0, 0.0)]
    text = spark.createDataFrame([("s", 1, "f1", "left", 10.0, 2.0, 40.0, 8.0), ("s", 1, "f2", "cell", 50.0, 2.0, 90.0, 8.0), ("s", 1, "f3", "right", 110.0, 12.0, 150.0, 18.0), ("s", 1, "f4", "outside", 10.0, 100.0, 40.0, 108.0), ("s", 1, "f5", "low", 10.0, 305.0, 40.0, 312.0)], "source_id string, pdf_page int, id string, text string, x0 double, y0 double, x1 double, y1 double")
    got = geometry.ruled_tables(spark.createDataFrame(upper + lower + beside + stray, kind), text).orderBy("table_no").collect()
    assert [(t.table_no, t.rows, t["columns"], t.x0, t.y0, t.x1, t.y1) for t in got] == [(1, 2, 2, 0.0, 0.0, 200.0, 20.0), (2, 2, 1, 300.0, 5.0, 500.0, 25.0), (3, 2, 1, 0.0, 300.0, 200.0, 340.0)]
    assert [[(c.row_no, c.column_no, c.text) for c in t.cells] for t in got] == [[(1, 1, "left cell"), (2, 2, "right")], [], [(1, 1, "low")]]
    assert geometry.cluster_positions([1.0, 2.5, 9.0, 3.0, 12.0]) == [2.167, 9.0, 12.0] and geometry.cluster_positions([]) == []


def test_markers_and_prefixes(spark):
    got = trees.marker_parents([("1", "(A)"), ("2", "(1)"), ("3", "(2)"), ("4", "(a)"), ("5", "(b)"), ("6", "(3)"), ("7", "(ii)"), ("8", "(5)"), ("9", "(B)"), ("10", "(1)")])
    assert got == [("1", None, "ok"), ("2", "1", "ok"), ("3", "1", "ok"), ("4", "3", "ok"), ("5", "3", "ok"), ("6", "1", "ok"), ("7", "6", "ok"), ("8", "7", "ok"), ("9", None, "ok"), ("10", "9", "ok")]
    assert trees.marker_parents([("1", "(1)"), ("2", "(2)")]) == [("1", None, "ambiguous"), ("2", None, "ok")]
    df = spark.createDataFrame([("o", "1"), ("o", "1.2.3.4"), ("o", "1.2"), ("p", "1.2.9")], "owner string, key string")
    assert {(r.owner, r.key): r.parent for r in trees.nearest_parent(df, "owner", "key").collect()} == {("o", "1"): None, ("o", "1.2.3.4"): "1.2", ("o", "1.2"): "1", ("p", "1.2.9"): None}


def test_top_k(spark):
    r = random.Random(2)
    rows = [(i, [r.random() for _ in range(4)]) for i in range(50)] + [(50, None), (51, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vectors.top_k(df.where("vec_id < 3"), df, 4).collect()
    import numpy as np

    m = np.array([np.float32(v) for i, v in rows[:50]], np.float64)
    for q in range(3):
        s = m @ m[q]
        want = sorted((-round(float(x), 9), i) for i, x in enumerate(s) if i != q)[:4]
        assert [x.neighbour_id for x in sorted(got, key=lambda x: x["rank"]) if x.query_id == q] == [i for _, i in want]


def test_readers(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"pdf_page": 1, "lines": [{"text": "a", "bbox": [0,0,1,1], "line_id": "x"}]}\n{"pdf_page": 3, "lines": [{"text": "b", "bbox": null, "line_id": "y"}]}\n')
    lines = readers.page_lines(spark, str(tmp_path / "p.jsonl"))
    assert [r.pdf_page for r in readers.missing_pages(lines, 1, 3).collect()] == [2]
    s = T.StructType([T.StructField("k", T.IntegerType())])
    r = readers.strict_json(spark.createDataFrame([('{"k": 1}',), ('{"k": 1, "z": 2}',), ("{}",), ("{",), (None,)], "j string"), "j", s).collect()
    assert [x.problem for x in r] == [None, "unknown-field", "missing-field", "malformed", "malformed"] and r[0].record.k == 1
    html = spark.createDataFrame([(1, "<nav><p>x</p></nav><h1>A &amp; B</h1><script>p</script><p>c <b>d</b></p>")], "k int, html string")
    assert [(x.tag, x.text) for x in readers.html_blocks(html, "k").orderBy("block_no").collect()] == [("h1", "A & B"), ("p", "c d")]
    e = readers.errata_entries(spark.createDataFrame([(1, "intro\nPage 3, Section 2: Replace this\nand that\nPage 4, Table 1: Delete it")], "k int, text string"), "k").orderBy("entry_no").collect()
    assert [(x.page, x.target, x.directive, x.operation) for x in e] == [(3, "Section 2", "Replace this and that", "replace"), (4, "Table 1", "Delete it", "delete")]
    b = readers.labelled_blocks(spark.createDataFrame([(1, "G12-05\nProponent: A\nReason: long\ntext\nG13\nReason: x")], "k int, text string"), "k").collect()
    assert {(x.block_id, x.label, x.value) for x in b} == {("G12-05", "Proponent", "A"), ("G12-05", "Reason", "long text"), ("G13", "Reason", "x")}
    import hashlib

    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"abc")
    want = spark.createDataFrame([("a.bin", 3, hashlib.sha256(b"abc").hexdigest()), ("b.bin", 1, "")], "name string, size long, sha256 string")
    assert {x.name: x.state for x in readers.verify_files(spark, str(tmp_path / "f"), want).collect()} == {"a.bin": "verified", "b.bin": "missing"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("e1", "s", 1, 1, [1.0]), ("e2", "s", 1, 2, None)], "evidence_id string, source_id string, pdf_page int, block_index int, bbox array<double>")
    sinks.write_evidence_store(df, str(tmp_path / "s"), {"sha": "x"})
    assert sinks.read_evidence_store(spark, str(tmp_path / "s"), {"sha": "x"}).count() == 2
    with pytest.raises(ValueError):
        sinks.read_evidence_store(spark, str(tmp_path / "s"), {"sha": "y"})
    with pytest.raises(ValueError):
        sinks.write_evidence_store(df.unionByName(df), str(tmp_path / "t"), {"sha": "x"})
    assert sinks.content_digest(df) == sinks.content_digest(df.repartition(3).orderBy(F.desc("evidence_id")))
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == sorted(df.columns)
    assert "| 1 | 2 |" in sinks.state_markdown(df, "Pages", "pdf_page")
    (tmp_path / "own").mkdir()
    (tmp_path / "own" / "x").write_text("")
    with pytest.raises(ValueError):
        sinks.prepare_folder(spark, str(tmp_path / "own"))
    for _ in range(2):
        sinks.prepare_folder(spark, str(tmp_path / "new"))
    assert (tmp_path / "new" / "manifest.json").exists()


def test_running_values_over_cells(spark):
    r = random.Random(6)
    rows = [("hot" if i % 3 else None, r.randrange(40), i, r.choice([None, None, "x", "y"])) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v string")
    want = {}
    for k in ("hot", None):
        last, n = None, 0
        for x in sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2])):
            last, n = x[3] or last, n + (x[3] == "x")
            want[x[2]] = (last, n)
    for width in (1, 7, 1000):
        cell = F.floor(F.col("t") / width)
        d = rel.running_count(rel.carry_forward(df, ["k"], ["t", "i"], F.col("v"), "last", cell), ["k"], ["t", "i"], F.coalesce(F.col("v") == "x", F.lit(False)), "n", cell)
        assert {x.i: (x.last, x.n) for x in d.collect()} == want


def test_context_over_cells(spark):
    r = random.Random(7)
    rows = [(f"e{i:03}", r.choice(["s", "t", None]), r.choice([None, *range(30)]), r.randrange(3)) for i in range(80)]
    df = spark.createDataFrame(rows, "evidence_id string, source_id string, pdf_page int, block_index int")
    low = lambda x: (x[2] is not None, x[2] or 0, x[3], x[0])
    for b, a in ((1, 1), (3, 0), (0, 4), (5, 2)):
        want = {}
        for s in ("s", "t", None):
            own = [x[0] for x in sorted((x for x in rows if x[1] == s), key=low)]
            want |= {e: ",".join(own[max(0, i - b) : i + a + 1]) for i, e in enumerate(own)}
        for pages in (1, 4, 1000):
            assert {x.evidence_id: x.context for x in ev.with_context(df, b, a, pages=pages).collect()} == want
