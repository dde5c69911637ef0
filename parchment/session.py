"""Session helpers: tables of a folder, checkpoints, salted joins."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of a side that a broadcast may hold; beyond it the salted shuffle join is used.
BROADCAST_ROWS = 200_000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that Python workers find it wherever they start."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    if getattr(sc, "_parchment_sent", False) or not root.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="parchment-code-")) / "parchment.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._parchment_sent = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the reliable checkpoint folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); one is made only where none is set and all runs on this machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="parchment-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read from there: smaller than a checkpoint, and read by column."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, ahead of costly work on each row.

    A large input has more splits than that and is left as it is; only a small one, of a file
    or two, is shuffled, so that it doesn't keep one core busy.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def salted_join(big: DataFrame, small: DataFrame, on: list[str], spread: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """Equi-join of a skewed ``big`` side with a ``small`` side that is unique on ``on``.

    The small side is repeated once per salt, the big side is spread by a hash of column
    ``spread``, so a key that holds a third of the big side is split over ``salts`` tasks.
    Only inner, left and left_semi keep their meaning under salting.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"salted_join can't do {how}")
    many = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(many, [*on, "_salt"], how).drop("_salt")


#: Rows of one key that a task may take; keys of more rows are split.
HOT_ROWS = 100_000


def hot_join(big: DataFrame, small: DataFrame, on: list[str], spread: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """``salted_join`` that measures first: only keys of over HOT_ROWS rows (and a thousandth of all, so at most a thousand keys) are salted, and only their rows of ``small`` repeated."""
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"hot_join can't do {how}")
    n = big.count()
    if n <= HOT_ROWS:
        return big.join(small, on, how)
    hot = checkpointed(big.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > max(HOT_ROWS, n // 1000)).select(*on, F.lit(True).alias("_hot")))
    if hot.isEmpty():
        return big.join(small, on, how)
    split = big.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    each = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    many = small.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(each)).drop("_hot")
    return split.join(many, [*on, "_salt"], how).drop("_salt")
