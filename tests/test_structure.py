"""Golden cases of document structure and observations, with nulls, empty tables and repeated rows."""

from pyspark.sql import functions as F

from parchment.operators import observations as ob, structure as st

L = "source_id string, pdf_page int, line_id string, text string, x0 double, y0 double, x1 double, y1 double, level int"


def page(spark, rows, schema=L):
    return spark.createDataFrame([(*r, 0) for r in rows], schema)


def two_columns():
    return [("s", 1, f"l{i}", "left", 40.0, 20.0 * i, 280.0, 20.0 * i + 10) for i in range(5)] + [("s", 1, f"r{i}", "right", 330.0, 20.0 * i, 570.0, 20.0 * i + 10) for i in range(5)] + [("s", 1, "t", "title", 40.0, -30.0, 570.0, -20.0)]


def test_page_order(spark):
    rows = two_columns() + [("s", 2, f"a{i}", "one", 40.0, 20.0 * i, 300.0, 20.0 * i + 10) for i in range(4)] + [("s", 3, "n", None, None, None, None, None), (None, None, "x", "y", 1.0, 1.0, 2.0, 2.0)]
    df = page(spark, rows)
    got = {r.pdf_page: r for r in st.inferred_order(df).collect()}
    assert (got[1].mode, got[1].split_x, got[1].left_lines, got[1].right_lines) == ("two_column", 305.0, 5, 5) and got[1].confidence == round(0.62 + 290 / 612 * 0.35 + 0.12, 3)
    assert got[2].mode == "top_to_bottom" and got[2].split_x is None and 3 not in got
    order = [r.line_id for r in st.ordered_lines(df, st.inferred_order(df), "line_id").where("pdf_page = 1").orderBy("reading_no").collect()]
    assert order == ["t", *[f"l{i}" for i in range(5)], *[f"r{i}" for i in range(5)]]
    assert st.inferred_order(df.limit(0)).count() == 0


def test_visual_lines_and_blocks(spark):
    rows = [("s", 1, "a", "one", 10.0, 10.0, 20.0, 20.0), ("s", 1, "b", "two", 30.0, 11.0, 40.0, 21.0), ("s", 1, "c", None, 0.0, 30.0, 5.0, 40.0), ("s", 1, "d", "x", None, None, None, None)]
    assert [(r.text, r.fragments) for r in st.visual_lines(page(spark, rows), "line_id").orderBy("line_no").collect()] == [("one two", 2), ("", 1)]
    text = ["Plain text", "goes on", "(1) an item", "of two lines", "Table 3.1 Loads", "after", "NOTE: mind", "Exception No. 1: none", "far below"]
    at = [0.0, 10.0, 20.0, 30.0, 40.0, 50.0, 60.0, 70.0, 120.0]
    got = st.direct_blocks(page(spark, [("s", 1, f"l{i}", t, 0.0, y, 90.0, y + 9) for i, (t, y) in enumerate(zip(text, at))]), "line_id").orderBy("block_no").collect()
    assert [(r.kind, r.lines) for r in got] == [("paragraph", 2), ("list_item", 2), ("table", 1), ("paragraph", 1), ("note", 1), ("exception", 1), ("paragraph", 1)]
    clip = st.caption_clips(page(spark, [("s", 1, "t", "Table 3.1 Loads", 0.0, 100.0, 90.0, 110.0), ("s", 1, "b", "Figure 2", 0.0, 300.0, 90.0, 310.0), ("s", 2, "u", "TABLE A4", 0.0, 10.0, 9.0, 20.0)]), "line_id")
    assert {(r.line_id, r.locator, r.y0, r.y1) for r in clip.collect()} == {("t", "table:3.1", 99.0, 299.0), ("u", "table:A4", 55.0, 729.0)}


def test_meanings_and_labels(spark):
    df = spark.createDataFrame([(1, "Where required to, it shall  not apply to doors, except stairs, except ramps."), (2, None), (3, ""), (1, "Where required to, it shall  not apply to doors, except stairs, except ramps.")], "k int, text string")
    got = {(r.type, r.start, r.end) for r in st.meaning_spans(df, "k").collect()}
    text = df.first().text
    assert {(t, text[a:b].lower()) for t, a, b in got} == {("condition", "where"), ("prohibition", "shall  not"), ("applicability", "apply to"), ("exception", "except")}
    labels = spark.createDataFrame([(x,) for x in ("14", "xiv", "3-12", "B-5", "", "Intro", None, "MCMXC")], "t string")
    assert [tuple(r.p) if r.p else None for r in labels.select(st.page_label(F.col("t")).alias("p")).collect()] == [("decimal", 14), ("roman", 14), ("chapter_page", 12), ("letter_page", 5), ("other", None), ("other", None), ("other", None), ("roman", 1990)]


def test_findings(spark):
    s = "node_id string, artifact_id string, locator string, parent_locator string, span_start int, span_end int, text_sha256 string, first_page int, last_page int, code string"
    h = "a" * 64
    rows = [("1", "x", "a", None, 0, 5, h, 1, 2, "c"), ("2", "x", " ", None, 5, 1, "z", 3, 2, "c"), ("3", "x", "b", None, 0, 1, h, 1, 1, "c"), ("3", "y", "b", None, 0, 1, h, 1, 1, "c"), ("4", None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows + rows[:2], s)
    got = {(r.node_id, r.code) for r in st.section_findings(df).collect()}
    assert got == {("2", "empty-locator"), ("2", "bad-span"), ("2", "bad-text-hash"), ("2", "pages-reversed"), ("3", "identity-in-several-artifacts"), *[("4", c) for c in ("empty-locator", "empty-artifact", "bad-text-hash", "bad-span")]}
    spans = spark.createDataFrame([("p", "a", 0, 10), ("p", "b", 5, 8), ("p", "c", 9, 12), ("p", "d", 12, 13), ("q", "e", 1, 2), ("p", "f", None, 3), ("p", "g", 90_000, 90_001), ("p", "h", 50_000, 95_000)], "part string, i string, s int, e int")
    assert {r.i for r in st.sibling_overlaps(spans, ["part"], "i", "s", "e").collect()} == {"b", "c", "g"}
    pages = lambda x: spark.createDataFrame(x, "source_id string, pdf_page int")
    assert {tuple(r) for r in st.page_findings(pages([("s", 1), ("s", 3), ("s", 3), ("s", None)]), pages([("s", 1), ("s", 1), ("s", 4)])).collect()} == {("s", 1, "several-profiles"), ("s", 3, "no-profile"), ("s", 4, "no-page"), ("s", 2, "page-left-out")}


def test_observed_lines_and_parents(spark):
    text = ["Chapter 3 Loads", "3.1 Scope", "Table 3.1 Values", "3.1.2 Snow", "Figure 3.2", "prose", None, "3.2 Wind", "Equation 3.4", "Appendix B", "Table B1"]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(text)], "source string, i int, text string")
    found = ob.observed(df)
    got = {r.i: (r.kind, r.number, r.parent) for r in ob.observed_hierarchy(found, ["source"], ["i"], "i", F.floor(F.col("i") / 2)).collect()}
    assert got == {0: ("chapter", "3", None), 1: ("section", "3.1", 0), 2: ("table", "3.1", 1), 3: ("subsection", "3.1.2", 1), 4: ("figure", "3.2", 3), 7: ("section", "3.2", 0), 8: ("equation", "3.4", 7), 9: ("appendix", "B", None), 10: ("table", "B1", 9)}
    assert ob.observed(df.limit(0)).count() == 0


def test_captions_gate_and_cells(spark):
    rows = [("s", 1, "k1", "Table", 10.0, 19.0, 40.0, 28.0), ("s", 1, "n1", "3.1", 45.0, 21.0, 60.0, 30.0), ("s", 1, "k2", "FIGURE", 10.0, 100.0, 40.0, 109.0), ("s", 1, "n2", "4", 45.0, 100.0, 60.0, 109.0), ("s", 1, "n3", "5", 50.0, 101.0, 60.0, 109.0), ("s", 2, "k3", "table", 10.0, 0.0, 40.0, 9.0), ("s", 2, "n4", "6", 90.0, 0.0, 95.0, 9.0), ("s", None, "z", None, None, None, None, None)]
    assert [(r.line_id, r.kind, r.number) for r in ob.split_captions(page(spark, rows), "line_id").collect()] == [("k1", "table", "3.1")]
    made = lambda x, s: spark.createDataFrame(x, s)
    got = ob.gate(made([("a", "1"), ("a", "1"), ("b", "1"), ("b", "2"), ("c", "9"), ("d", None)], "k string, sha string"), made([("a", "1"), ("b", "1"), ("d", None)], "k string, sha string"), "k", ["sha"])
    assert {tuple(r) for r in got.collect()} == {("a", True, ""), ("b", False, "sha"), ("c", False, "unregistered"), ("d", True, "")}
    cells = ob.cell_findings(made([(1, "a"), (1, "b"), (1, "b"), (1, "x")], "r int, f string"), made([(1, "a"), (1, "b"), (1, "c")], "r int, f string"), ["r"], "f")
    assert {tuple(r) for r in cells.collect()} == {(1, "b", "in-several-cells"), (1, "x", "outside-its-row"), (1, "c", "in-no-cell")}


def test_definitions(spark):
    n = spark.createDataFrame([("o", "1", "Exit  stair"), ("o", "2", "exit stair"), ("o", "3", None), ("p", "1", "Exit stair"), ("o", "4", "ramp")], "owner string, key string, label string")
    r = spark.createDataFrame([("a", "o", "1"), ("a", "o", "1"), ("b", "o", "1"), ("a", "o", "2"), ("a", "p", "1"), (None, "o", "4"), ("a", "q", "9")], "source string, owner string, key string")
    inv, graph = st.definitions(n, r, "owner", "key", "label")
    assert {(x.owner, x.key): (x.normalized_term, x.uses, x.alternates) for x in inv.collect()} == {("o", "1"): ("EXIT STAIR", 2, 1), ("o", "2"): ("EXIT STAIR", 1, 1), ("p", "1"): ("EXIT STAIR", 1, 0)}
    assert graph.count() == 4
