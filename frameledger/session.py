"""Session helpers shared by every operator: table access, checkpoint folder, delivery de-duplication."""
from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder (``spark.checkpoint.dir``). Only in local mode, where this machine is the whole
    cluster, a folder of its own serves where none is set; elsewhere that is an error."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        shared = "file://" + tempfile.mkdtemp(prefix="frameledger-", dir=os.environ.get("TMPDIR"))
    spark.sparkContext.setCheckpointDir(shared)


def ship(spark: SparkSession) -> str:
    """Sends this package to the workers, for clusters on which it is not installed; gives the archive's path."""
    base = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="frameledger-")) / f"{base.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(base.rglob("*.py")):
            z.write(f, f.relative_to(base.parent))
    spark.sparkContext.addPyFile(str(archive))
    return str(archive)


def first_delivery(df: DataFrame, key: str | list[str], arrived: str) -> DataFrame:
    """One row per key: the delivery that arrived first (a null arrival counts as the last).

    Map-side combinable (``min_by``), so a key delivered many times is reduced before the shuffle.
    Rows whose key is null are one group per the SQL rule for ``GROUP BY``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(F.col(arrived).isNull(), F.col(arrived)))
    return df.groupBy(*keys).agg(picked.alias("__first")).select(*keys, *[F.col("__first")[c].alias(c) for c in rest])


def deliveries(df: DataFrame, key: str, arrived: str, most: int = 100_000) -> DataFrame:
    """As ``first_delivery``, for wide rows that are seldom delivered again: only the keys are shuffled (in a job of
    their own), and of the rows those whose key occurs again. If more than ``most`` keys do, all rows are."""
    again = df.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__key")
    known = [r[0] for r in again.limit(most + 1).collect()]
    if len(known) > most:
        return first_delivery(df, key, arrived)
    if not known:
        return df
    few = F.broadcast(df.sparkSession.createDataFrame([(k,) for k in known], df.select(F.col(key).alias("__key")).schema))
    same = F.col(key).eqNullSafe(F.col("__key"))
    return df.join(few, same, "left_anti").unionByName(first_delivery(df.join(few, same, "left_semi"), key, arrived))


def spread_join(rows: DataFrame, small: DataFrame, on: list[str], by: str, how: str = "inner", copies: int = 16) -> DataFrame:
    """Join with a side of one row per key of which a few may hold most of ``rows``: each row of ``small`` goes out in
    so many copies, and ``rows`` of a key are spread over them by the hash of ``by``. (Where the side turns out small at
    run time, the plan broadcasts it.)"""
    part = F.pmod(F.xxhash64(by), F.lit(copies)).cast("int")
    many = small.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return rows.withColumn("__part", part).join(many, [*on, "__part"], how).drop("__part")


def small_join(rows: DataFrame, small: DataFrame, on: list[str], by: str, how: str = "inner", most: int = 20_000) -> DataFrame:
    """Join with a side that is broadcast if it has no more rows than ``most`` (it is counted), else ``spread_join``."""
    if small.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(small), on, how)
    return spread_join(rows, small, on, by, how)


def utc_month(ts: str | Column) -> Column:
    """``yyyy-MM`` of an instant in UTC, whatever the session's time zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM")


def trimmed(c: str | Column) -> Column:
    """A text without leading and trailing Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
