from pyspark.sql import functions as F

from parchment.operators import inventory as inv


def test_sibling_ranges(spark):
    known = spark.createDataFrame([("o", "1(a)"), ("o", "1(b)"), ("o", "2")], "o string, k string")
    refs = spark.createDataFrame([("r1", "o", "1(a)-(b)"), ("r2", "o", "1(b) to (d)"), ("r3", "o", "2"), ("r4", "o", "9"), ("r5", "o", "1(d)-(a)"), ("r6", "o", None)], "r string, o string, raw string")
    assert {x.r: x.state for x in inv.sibling_ranges(refs, known, "r", "raw", "o", "k").collect()} == {"r1": "resolved", "r2": "partial", "r3": "resolved", "r4": "nonexistent", "r5": "malformed"}


def test_glyphs_and_context(spark):
    df = spark.createDataFrame([([(5.0, 9.0, "b"), (0.0, 4.0, "a"), (20.0, 24.0, "c")], "L", None, "x  y z")], "g array<struct<x0: double, x1: double, c: string>>, l string, t string, c string")
    r = df.select(inv.glyph_line(F.col("g")).alias("line"), inv.context_text(F.col("l"), F.col("t"), F.col("c"), 3).alias("text")).first()
    assert (r.line, r.text) == ("ab c", "L x y")


def test_lineage_and_agreement(spark):
    ev = spark.createDataFrame([("a", 1, "first"), ("a", 2, "end"), ("b", 1, "end"), ("b", 1, "end"), ("c", 1, "x"), ("c", 2, "first"), ("c", 3, "first")], "c string, s int, k string")
    got = {(r.c, r.finding) for r in inv.lineage_findings(ev, "c", "s", "k", "first", ["end"]).collect()}
    assert got == {("b", "duplicate-sequence"), ("b", "no-first"), ("b", "several-final"), ("c", "several-first"), ("c", "first-not-at-start")}
    left = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "k string, p int")
    right = spark.createDataFrame([("a", 1), ("b", 3), ("c", 9), ("e", 4)], "k string, p int")
    assert {r.agreement: r.n for r in inv.agreement(left, right, ["k"], "p").collect()} == {"exact": 1, "near": 1, "far": 1, "left_only": 1, "right_only": 1}


def test_empty(spark):
    e = spark.createDataFrame([], "k string, o string, x double, y double")
    assert inv.families(e, "k", "o").count() == 0 and inv.shared_targets(e, "k", "o").count() == 0
    assert inv.fingerprints(e, ["k"], ["x", "y"]).count() == 0 and inv.far_from(e, e, "k", "o", "y", 5.0).count() == 0


def test_stream_terms_and_frames(spark):
    from parchment.operators import stream_text as st

    df = spark.createDataFrame([("o", i, t) for i, t in enumerate(["ab", None, "", "xyz"])], "o string, i int, t string")
    got = [(r.start, r.end) for r in st.text_stream(df, "o", ["i"], "t", F.floor(F.col("i") / 2)).orderBy("i").collect()]
    assert got == [(0, 2), (3, 3), (4, 4), (5, 8)]
    docs = spark.createDataFrame([(1, "The Exit door, exit DOOR; exits"), (2, None), (3, "")], "k int, t string")
    terms = spark.createDataFrame([("exit door",), ("Exit",), ("door exit door",), (None,)], "n string")
    assert {(r.k, r.term): r.mentions for r in st.term_mentions(docs, "k", "t", terms, "n").collect()} == {(1, "exit door"): 2, (1, "exit"): 2, (1, "door exit door"): 1}
    box = spark.createDataFrame([([1.0, 2.0, 5.0, 3.0], 0.0, 1.0)], "b array<double>, x double, y double")
    assert box.select(st.in_writing_frame(F.col("b"), F.col("x"), F.col("y")).alias("b")).first().b == [2.0, -5.0, 3.0, -1.0]
