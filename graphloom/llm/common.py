"""What the operators of this subpackage share: tables, the shared scratch folder, ASCII folding, skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A key that holds more than this share of all rows counts as hot; so at most 1 / HOT_SHARE keys can be hot.
HOT_SHARE = 1e-3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name under the shared checkpoint folder, removed at the latest when the driver ends.

    A temporary folder is set only where a session in local mode has none; on a cluster it would be another disk on every machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: computed once, with no lineage to replay when an executor is lost."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            remove(t.sparkSession, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else; the fast path is for pure ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int, deal: bool = False) -> DataFrame:
    """Inner join of many rows with one row per key that knows how many rows its key has.

    Keys with more than HOT_SHARE of all rows number at most 1 / HOT_SHARE, so they are broadcast, and their rows are not
    shuffled; no other key can make a partition large, so they are joined by a shuffle.  deal spreads the rows of hot keys
    evenly, where what follows in the same task is dear.
    """
    bar = max(1000, int(total * HOT_SHARE))
    hot = F.broadcast(keyed.where(F.col(count) > bar).limit(int(1 / HOT_SHARE) + 1))
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(keyed.where(F.col(count) <= bar), keys)
    spread = rows.join(hot, keys)
    if deal:
        spread = spread.repartition(shuffle_partitions(rows.sparkSession))
    return cold.unionByName(spread)
