"""Tables written once to the folder that all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Spark then deletes a query's shuffle files as it ends; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df``, written and read back: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Deletes the files that ``staged`` or ``numbered`` wrote for tables which nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        plain = lambda x: re.sub("^file:/+", "/", x)
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if plain(folder).startswith(plain(shared_dir(spark)) + "/weftline/"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with its rows numbered from 0 in an order: a range sort, then the counts of earlier partitions.

    Only one row a partition meets in a task.
    """
    at = staged(df.sort(*order).withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id()), "numbered")
    sizes = at.groupBy("__part").agg(F.count("*").alias("n"), F.min("__id").alias("__first"))
    before = sizes.select("__part", "__first", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    return at.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__id") - F.col("__first")).drop("__part", "__id", "__first", "__before")
