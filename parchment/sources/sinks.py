"""Sinks: evidence store and bundles in Parquet with manifests, canonical JSON, CSV and Markdown."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.ids import text_sha256


def write_evidence_store(df: DataFrame, path: str, manifest: dict[str, str]) -> None:
    """Evidence rows as Parquet clustered by source and page, with a manifest of one row; the store is rebuilt whole.

    Raises if an evidence_id comes twice.
    """
    if not df.groupBy("evidence_id").count().where("count > 1").isEmpty():
        raise ValueError("an evidence_id is not unique")
    df.repartitionByRange("source_id", "pdf_page").sortWithinPartitions("source_id", "pdf_page", "block_index").write.mode("overwrite").parquet(f"{path}/evidence")
    row = {k: str(v) for k, v in manifest.items()}
    df.sparkSession.createDataFrame([tuple(row.values())], T.StructType([T.StructField(k, T.StringType()) for k in row])).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def read_evidence_store(spark: SparkSession, path: str, manifest: dict[str, str]) -> DataFrame:
    """The store's rows; raises if its manifest isn't the expected one."""
    got = spark.read.parquet(f"{path}/manifest").first()
    if got is None or got.asDict() != {k: str(v) for k, v in manifest.items()}:
        raise ValueError("the store's manifest differs")
    return spark.read.parquet(f"{path}/evidence")


def write_bundle(tables: dict[str, DataFrame], path: str) -> str:
    """Tables side by side; returns the bundle's digest, made of each table's rows in any order."""
    digests = []
    for name in sorted(tables):
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")
        digests.append(f"{name}:{content_digest(tables[name])}")
    return "|".join(digests)


def content_digest(df: DataFrame) -> str:
    """A table's digest: row count and added hashes, the same for any order of rows and partitions."""
    cols = [F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})]
    h = F.xxhash64(*cols)
    r = df.agg(F.count("*").alias("n"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("a"), F.sum(F.shiftrightunsigned(h, 32)).alias("b")).first()
    return f"{r.n}-{r.a or 0}-{r.b or 0}"


def canonical_json(df: DataFrame) -> DataFrame:
    """(json, sha256): each row as compact JSON with sorted names and explicit nulls."""
    j = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    return df.select(j.alias("json")).withColumn("sha256", text_sha256(F.col("json")))


def _cell(c: Column, kind: T.DataType) -> Column:
    return F.to_json(c) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else c


def write_csv(df: DataFrame, path: str) -> None:
    """CSV over the sorted columns; nested values as compact JSON."""
    df.select(*[_cell(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def state_markdown(df: DataFrame, title: str, state: str) -> str:
    """A report of counts by state: one row a state, which are few by nature."""
    rows = df.groupBy(state).count().orderBy(F.col(state).asc_nulls_first()).limit(1_000).collect()
    return "\n".join([f"# {title}", "", "| state | rows |", "| --- | --- |", *[f"| {r[0] if r[0] is not None else '(none)'} | {r[1]} |" for r in rows], ""])


def prepare_folder(spark: SparkSession, path: str, marker: str = "manifest.json") -> str:
    """An output folder on any file system that Spark reaches: new, empty or earlier made here; any other content is refused."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    mark = sc._jvm.org.apache.hadoop.fs.Path(at, marker)
    if fs.exists(at) and len(fs.listStatus(at)) and not fs.exists(mark):
        raise ValueError(f"{path} holds files that were not made here")
    fs.mkdirs(at)
    out = fs.create(mark, True)
    out.write(bytearray(json.dumps({"made_by": "parchment"}, sort_keys=True).encode()))
    out.close()
    return path
