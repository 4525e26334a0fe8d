"""Intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only with a local master, as in tests, a temporary folder where it is unset."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='prismloom-')}")
        named = context.getCheckpointDir()
    return named


#: Bytes of an Arrow batch whose rows are blocks of pixels.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of about BATCH_BYTES at most: by default a batch takes 10,000 rows, of whatever size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame, kind: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, so their lineage ends there."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = f"{shared_dir(spark).rstrip('/')}/prismloom/{kind}-{uuid.uuid4().hex}"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")  # shuffle files go once the table is there
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, was)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of models that are broadcast at most; beyond, rows of an image are dealt to so many slots, each with the image's model.
MOST_BROADCAST, SLOTS = 64 << 20, 64


def beside(rows: DataFrame, models: DataFrame, bytes_each: int, most: int = MOST_BROADCAST, deal: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """Rows (image_id, ...) joined to models, a row an image, that are written or as quick to count.

    Models are counted, and broadcast if all take no more than ``most`` bytes; otherwise each is repeated for SLOTS parts of its
    image, to which rows are dealt by some of their columns, so that no task gets a whole image.
    """
    if models.count() * bytes_each <= most:
        return rows.join(F.broadcast(models), "image_id")
    slot = F.pmod(F.xxhash64(*deal), F.lit(SLOTS)).cast("int")
    spread = models.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    return rows.withColumn("_slot", slot).join(spread, ["image_id", "_slot"]).drop("_slot")
