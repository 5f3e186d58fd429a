"""Tables of a folder, and intermediate ones in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_CONF = "spark.checkpoint.dir"
MAX_BROADCAST = 200_000  # ids that every task may hold


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.  Where the session names none, a local
    session gets a temporary one; on a cluster that is an error, as executors
    wouldn't see each other's files."""
    path = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CONF} to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set(_CONF, path)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once as Parquet in the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(tables: list[DataFrame]) -> None:
    """Deletes stashed tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_spread(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table for work that is heavy by row.  One with fewer splits than the
    cluster has cores is small, and is dealt out; any other is read as it is."""
    df, cores = read_table(spark, folder, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """``rows`` with their place, from 1, in the order of ``by``: sorted by ranges,
    each of which numbers its own; only the ranges' sizes come together."""
    dealt = stash(rows.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))  # a row for each range
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).drop("__n")
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*by))
    return dealt.join(F.broadcast(before), "__range").withColumn(name, own + F.col("__before")).drop("__range", "__before")
