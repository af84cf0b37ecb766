"""Tables written to the cluster's shared folder, so that lost executors cost no lineage, and joins on keys that may be hot."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as this package's word operators split on it, for Java and RE2 patterns.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot if it has over 1 / HOT_KEYS of a table's rows and over HOT_ROWS; so there are HOT_KEYS hot keys at most.
HOT_KEYS, HOT_ROWS = 1024, 200


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a new local folder is set on one machine; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = Path(tempfile.mkdtemp(prefix="chirplake-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path, on the driver's JVM."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is written there goes when the driver ends, at the latest."""
    path = f"{shared_dir(spark).rstrip('/')}/chirplake/{name}-{uuid.uuid4().hex}"
    system, at = hadoop(spark, path)
    system.deleteOnExit(at)
    return path


def frozen(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back; later jobs agree on its rows."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes frozen tables that no later job reads."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            system, at = hadoop(df.sparkSession, path)
            system.delete(at, True)


def joined(left: DataFrame, right: DataFrame, on: list[str], n: str, rows: int, how: str = "inner") -> DataFrame:
    """left with the columns of right (inner or left join); right's keys are unique, and its column n, dropped, has how many of left's `rows` rows each key has.

    Hot keys, HOT_KEYS at most, are broadcast, so that their rows stay where they are; all others meet by exchange.
    """
    hot = F.col(n) > max(HOT_ROWS, rows // HOT_KEYS)
    few = F.broadcast(right.where(hot).drop(n))
    return left.join(few, on).unionByName(left.join(few.select(*on), on, "left_anti").join(right.where(~hot).drop(n), on, how))


def kept_by_bits(df: DataFrame, ids: DataFrame, id: str) -> DataFrame:
    """Rows of df whose `id` is in the first column of ids. Ids are counted up from few starts, as `monotonically_increasing_id` gives them: they are
    sent to all tasks as bitmaps, a bit a row, so that df's rows, which may be long, stay where they are."""
    one = F.col(ids.columns[0])
    bits = ids.groupBy(F.bitmap_bucket_number(one).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("_bits"))
    at = F.bitmap_bit_position(F.col(id))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = df.withColumn("_bucket", F.bitmap_bucket_number(F.col(id))).join(F.broadcast(bits), "_bucket")
    return met.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*df.columns)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
