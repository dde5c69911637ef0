"""Differences between two copies of one dataset, by a column-by-bucket checksum matrix."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import locator, strip, title
from ..session import checkpointed, stored

#: Bound of the matrix's rows, hence of what is broadcast: 65,536 buckets of a few dozen bytes.
BUCKETS = 65_536
_LANES = 4


def _wide(c: Column) -> list[Column]:
    """Four 32-bit lanes of two seeded 64-bit hashes; lanes add up without overflow below 2**31 rows."""
    a, b = F.xxhash64(c, F.lit(17)), F.xxhash64(F.lit(71), c)
    low = F.lit(0xFFFFFFFF)
    return [a.bitwiseAND(low), F.shiftrightunsigned(a, 32), b.bitwiseAND(low), F.shiftrightunsigned(b, 32)]


def latest(df: DataFrame, keys: list[str], values: list[str], at: str) -> DataFrame:
    """One row a key: the values of the latest ``at`` (null is oldest; a tie takes the greatest values)."""
    best = F.max_by(F.struct(*values), F.struct(F.col(at).isNotNull(), F.col(at), *[F.struct(F.col(v).isNotNull(), F.col(v)) for v in values]))
    return df.groupBy(*keys).agg(best.alias("_v")).select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def checksums(df: DataFrame, keys: list[str], values: list[str], buckets: int) -> DataFrame:
    """The matrix of one copy: a row for each key bucket, for each column the added wide hash of (key, value)."""
    cells = [F.sum(lane).alias(f"{v}_{i}") for v in ["_key", *values] for i, lane in enumerate(_wide(F.struct(*keys, *([] if v == "_key" else [F.col(v)]))))]
    return bucketed(df, keys, buckets).groupBy("_bucket").agg(F.count("*").alias("_n"), *cells)


def unequal(left: DataFrame, right: DataFrame, values: list[str]) -> DataFrame:
    """Buckets that differ, with the columns that do (``_columns``; ``_key`` for the key set)."""
    cols = [f"{v}_{i}" for v in ["_key", *values] for i in range(_LANES)]
    a = left.select("_bucket", F.struct("_n", *cols).alias("a"))
    b = right.select("_bucket", F.struct("_n", *cols).alias("b"))
    same = lambda v: F.lit(True) if not v else v[0]
    tests = []
    for v in ["_key", *values]:
        eq = [F.col(f"a.{v}_{i}").eqNullSafe(F.col(f"b.{v}_{i}")) for i in range(_LANES)]
        if v == "_key":
            eq.append(F.col("a._n").eqNullSafe(F.col("b._n")))
        ok = same(eq)
        for e in eq[1:]:
            ok = ok & e
        tests.append(F.when(~ok, F.lit(v)))
    return a.join(b, "_bucket", "full").withColumn("_columns", F.array_compact(F.array(*tests))).where(F.size("_columns") > 0).select("_bucket", "_columns")


def _form(v: str) -> str:
    return f"_c_{v}"


def reduced(df: DataFrame, keys: list[str], values: list[str], at: str | None, compared: Mapping[str, Column], buckets: int) -> DataFrame:
    """One copy, read once: its counting row a key with the bucket, and beside each value its compared form, written as a table that is read by column."""
    own = bucketed(df.select(*[F.col(f"`{c}`").alias(c) for c in [*keys, *values, *([at] if at else [])]]), keys, buckets)
    last = latest(own, [*keys, "_bucket"], values, at) if at else own.select(*keys, "_bucket", *values).distinct()
    return stored(last.select(*keys, "_bucket", *values, *[c.alias(_form(v)) for v, c in compared.items()]))


class Located:
    """Two copies side by side where their checksum matrices differ.

    ``both`` has a row for each key of an unequal bucket (or of a bucket named by ``also``):
    the keys, then ``e`` and ``a``, each null where the copy lacks the key, otherwise a struct
    that holds for each column that is unequal in any bucket (or named by ``fields``) its
    value ``v`` and compared form ``c``. Other columns and buckets aren't read again.
    """

    def __init__(self, expected: DataFrame, actual: DataFrame, keys: list[str], values: list[str], at: str | None, compared: Mapping[str, Column] | None, buckets: int, also: DataFrame | None = None, fields: list[str] | None = None) -> None:
        compared = dict(compared or {})
        form = lambda v: F.col(_form(v) if v in compared else v)
        self.keys, self.sides = keys, [reduced(x, keys, values, at, compared, buckets) for x in (expected, actual)]
        matrices = [checksums(x.select(*keys, *[form(v).alias(v) for v in values]), keys, values, buckets) for x in self.sides]
        bad = checkpointed(unequal(*matrices, values))
        found = {c for r in bad.select(F.explode("_columns").alias("c")).distinct().collect() for c in [r.c]}
        self.columns = [v for v in values if v in found]
        read = [v for v in values if v in found or v in (fields or [])]
        # at most `buckets` rows: a proven bound
        wanted = bad.select("_bucket")
        if also is not None:
            wanted = wanted.unionByName(bucketed(also.select(*keys), keys, buckets).select("_bucket")).distinct()
        one = lambda x, p: x.join(F.broadcast(wanted), "_bucket", "left_semi").select(*keys, F.struct(F.lit(True).alias("_here"), *[F.struct(F.col(v).alias("v"), form(v).alias("c")).alias(v) for v in read]).alias(p))
        on = None
        for k in keys:
            t = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
            on = t if on is None else on & t
        l, r = (one(x, p).alias(side) for x, p, side in zip(self.sides, "ea", "lr"))
        self.both = l.join(r, on, "full").select(*[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys], "e", "a")

    def differences(self) -> DataFrame:
        """The keys, ``field`` (null for a whole row), ``expected``, ``actual`` as text, ``side``."""
        text = lambda c: c.cast("string")
        null = F.lit(None).cast("string")
        whole = F.array(F.struct(null.alias("field"), null.alias("expected"), null.alias("actual"), F.when(F.col("a").isNull(), "missing").otherwise("unexpected").alias("side")))
        cells = [
            F.when(~F.col(f"e.{v}.c").eqNullSafe(F.col(f"a.{v}.c")), F.struct(F.lit(v).alias("field"), text(F.col(f"e.{v}.v")).alias("expected"), text(F.col(f"a.{v}.v")).alias("actual"), F.lit("differs").alias("side")))
            for v in self.columns
        ]
        empty = F.array().cast("array<struct<field:string,expected:string,actual:string,side:string>>")
        found = self.both.withColumn("_d", F.when(F.col("e").isNull() | F.col("a").isNull(), whole).otherwise(F.array_compact(F.array(*cells)) if cells else empty))
        return found.select(*self.keys, F.inline("_d"))


def compare_copies(expected: DataFrame, actual: DataFrame, keys: list[str], values: list[str], at: str | None = None, compared: Mapping[str, Column] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Rows missing on either side and rows whose values differ, field by field.

    Columns: the keys, ``field`` (null for a whole row), ``expected``, ``actual`` as text,
    ``side`` ('missing', 'unexpected' or 'differs'). ``compared`` gives a column's form for
    comparison (default: itself). With ``at``, only the latest row a key counts; without it,
    exact duplicate rows are one row. Each copy is read and reduced once; only the unequal
    buckets and columns of the matrix are read again, from the reduced tables, and joined.
    Empty tables, null keys (null equals null) and null values (null differs from any value)
    are allowed; other columns are ignored, whatever their names.
    """
    return Located(expected, actual, keys, values, at, compared, buckets).differences()


FIELD_OF_CODE = {"title-mismatch": "title", "parent-mismatch": "parent", "depth-mismatch": "depth", "order-mismatch": "ordinal"}
HIERARCHY_VALUES = ["title", "parent", "ordinal", "depth"]


def hierarchy_rows(df: DataFrame) -> DataFrame:
    return df.select("publication_key", locator(F.col("locator")).alias("locator"), *HIERARCHY_VALUES, "loaded_at")


def hierarchy_forms() -> dict[str, Column]:
    return {"title": title(F.col("title")), "parent": locator(F.col("parent"))}


def _located(expected: DataFrame, actual: DataFrame, report: DataFrame | None = None) -> Located:
    told = {} if report is None else {"also": report.select("publication_key", locator(F.col("locator")).alias("locator")), "fields": HIERARCHY_VALUES}
    return Located(hierarchy_rows(expected), hierarchy_rows(actual), ["publication_key", "locator"], HIERARCHY_VALUES, "loaded_at", hierarchy_forms(), BUCKETS, **told)


def _coded(found: DataFrame) -> DataFrame:
    code = F.when(F.col("side") == "missing", "missing-locator").when(F.col("side") == "unexpected", "unexpected-locator")
    for c, f in FIELD_OF_CODE.items():
        code = code.when(F.col("field") == f, c)
    return found.select("publication_key", "locator", code.alias("code"), "expected", "actual")


def hierarchy_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Differences of two hierarchy copies as (publication_key, locator, code)."""
    return _coded(_located(expected, actual).differences())


def hierarchy_findings(expected: DataFrame, actual: DataFrame, report: DataFrame) -> DataFrame:
    """(publication_key, locator, code): the differences, and the report's rows that don't say what a copy holds now.

    The copies' rows in unequal buckets and in those that the report names are joined once,
    and serve both. A report row is looked up by publication and locator; a copy that lacks
    the row holds null. A report row with a code of no field is skipped; repeated rows are
    one.
    """
    told = report.where(F.col("code").isin(*FIELD_OF_CODE)).select("publication_key", locator(F.col("locator")).alias("locator"), "code", "expected", "actual").distinct()
    at = _located(expected, actual, told)
    both = checkpointed(at.both)
    at.both = both
    met = told.join(both, ["publication_key", "locator"], "left")
    plain = lambda c: {"title": title(F.col(c)), "parent": locator(F.col(c)), "ordinal": strip(F.col(c)), "depth": strip(F.col(c))}
    outdated = []
    for column, p in (("expected", "e"), ("actual", "a")):
        wrong = F.lit(False)
        for c, f in FIELD_OF_CODE.items():
            wrong = F.when(F.col("code") == c, ~F.col(f"{p}.{f}.c").cast("string").eqNullSafe(plain(column)[f])).otherwise(wrong)
        outdated.append(F.when(wrong, f"report-{column}"))
    late = met.select("publication_key", "locator", F.explode(F.array_compact(F.array(*outdated))).alias("code")).distinct()
    return _coded(at.differences()).select("publication_key", "locator", "code").unionByName(late)
