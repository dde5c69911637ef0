import random

from pyspark.sql import functions as F

from parchment.operators import copies

KEYS, VALUES = ["k"], ["a", "b"]
S = "k string, a string, b int, at timestamp_ntz, `_n` string, bucket int"


def frame(spark, rows):
    return spark.createDataFrame([(k, a, b, t, "x", 1) for k, a, b, t in rows], S)


def brute(left, right):
    def last(rows):
        out = {}
        for k, a, b, t in rows:
            rank = (t is not None, t or 0, a is not None, a or "", b is not None, b or 0)
            if k not in out or rank > out[k][0]:
                out[k] = (rank, a, b)
        return {k: v[1:] for k, v in out.items()}

    e, a = last(left), last(right)
    found = set()
    for k in e.keys() | a.keys():
        if k not in a:
            found.add((k, None, "missing"))
        elif k not in e:
            found.add((k, None, "unexpected"))
        else:
            found |= {(k, c, "differs") for c, x, y in zip(VALUES, e[k], a[k]) if x != y}
    return found


def got(df):
    return {(r.k, r.field, r.side) for r in df.collect()}


def test_against_brute_force(spark):
    from datetime import datetime

    r = random.Random(5)
    when = [None, datetime(2020, 1, 1), datetime(2021, 1, 1)]
    make = lambda: [(r.choice([None, *"abcdefghij"]), r.choice([None, "", "x", "y"]), r.choice([None, 1, 2]), r.choice(when)) for _ in range(60)]
    for _ in range(3):
        left, right = make(), make()
        for buckets in (1, 7, 65_536):
            assert got(copies.compare_copies(frame(spark, left), frame(spark, right), KEYS, VALUES, "at", buckets=buckets)) == brute(left, right)


def test_empty_and_equal(spark):
    rows = [("a", "x", 1, None), ("a", "x", 1, None), (None, None, None, None)]
    assert got(copies.compare_copies(frame(spark, rows), frame(spark, rows), KEYS, VALUES, "at")) == set()
    assert got(copies.compare_copies(frame(spark, []), frame(spark, []), KEYS, VALUES, "at")) == set()
    assert got(copies.compare_copies(frame(spark, rows), frame(spark, []), KEYS, VALUES, "at")) == {("a", None, "missing"), (None, None, "missing")}
    assert got(copies.compare_copies(frame(spark, []), frame(spark, rows), KEYS, VALUES)) == {("a", None, "unexpected"), (None, None, "unexpected")}


def test_only_unequal_buckets_are_read(spark):
    e = spark.range(1000).select(F.col("id").cast("string").alias("k"), F.lit("x").alias("a"), F.lit(1).alias("b"))
    a = e.withColumn("b", F.when(F.col("k") == "7", 2).otherwise(F.col("b")))
    m = lambda d: copies.checksums(d, KEYS, VALUES, 4096)
    bad = copies.unequal(m(e), m(a), VALUES).collect()
    assert len(bad) == 1 and bad[0]["_columns"] == ["b"]


def test_hierarchy_titles(spark):
    s = "publication_key string, locator string, title string, parent string, ordinal int, depth int, loaded_at timestamp_ntz"
    one = spark.createDataFrame([("p", " 1.A ", "Café  Wing.", None, 1, 0, None)], s)
    two = spark.createDataFrame([("p", "1.a", "café wing", None, 1, 0, None)], s)
    assert copies.hierarchy_differences(one, two).count() == 0
    three = spark.createDataFrame([("p", "1.a", None, "1", 2, 1, None)], s)
    assert {r.code for r in copies.hierarchy_differences(one, three).collect()} == {"title-mismatch", "parent-mismatch", "depth-mismatch", "order-mismatch"}
