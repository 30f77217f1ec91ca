"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Broadcast is used only below this many bytes of a side whose size is known.
BROADCAST_LIMIT = 8 << 20


def session(app: str = "factloom", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def load(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; on a cluster that is
    an error, as every executor would write to its own disk.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet to the shared folder and read back.

    Unlike checkpoint(), the result keeps column pruning and size statistics.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def drop_staged(spark: SparkSession) -> None:
    """Removes the intermediate tables of the shared folder; for the end of a job, when no result is read from them any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/staged")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def tasks_for(rows: int, per_task: int, least: int) -> int:
    """The number of tasks for so many rows: one per ``per_task``, at least ``least``."""
    return max(least, -(-rows // per_task))


def same(left: str, right: str, columns: list[str]) -> str:
    """A null-safe join condition over columns of two aliases, as SQL."""
    return " and ".join(f"{left}.`{c}` <=> {right}.`{c}`" for c in columns)


def ranked(df: DataFrame, groups: list[str], order: list[str], out: str) -> DataFrame:
    """df with the 1-based position of each row in its group's order, whatever the group's size.

    Rows are sorted by ranges of (groups, order), so a group lies in neighbouring
    partitions; a row's position is its place in its partition and the rows of its
    group in the partitions before, of which there is one number a partition.
    """
    d = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    d = staged(d.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i")), "ranked")
    before = Window.partitionBy(*groups).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    per = d.groupBy(*groups, "_p").agg(F.count("*").alias("_c"), F.min("_i").alias("_f"))
    per = per.select(*groups, "_p", (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_f") + 1).alias("_s"))
    j = d.alias("a").join(per.alias("b"), F.expr(same("a", "b", [*groups, "_p"])))
    return j.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a._i") + F.col("b._s")).alias(out))
