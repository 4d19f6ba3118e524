"""Change detection over a stream of source files.

Files arrive as rows ``rel_path, content``; each micro-batch is compared with a table of
known hashes and the changed paths are handed on. The table is written anew for each batch
under the number of the batch, so that a batch that is repeated after a failure compares
with the same state and writes the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from girder.session import hadoop_path
from girder.sources.files import hashes


def watch(files: DataFrame, state: str, checkpoint: str, on_change: Callable[[DataFrame, int], None]):
    """Start the query; ``on_change`` gets ``rel_path, change`` of each batch that changes something."""
    spark = files.sparkSession

    def known(batch: int) -> tuple[DataFrame | None, int]:
        for n in range(batch - 1, -1, -1):
            fs, p = hadoop_path(spark, f"{state}/{n}")
            if fs.exists(p):
                return spark.read.parquet(f"{state}/{n}"), n
        return None, -1

    def step(rows: DataFrame, batch: int) -> None:
        last = Window.partitionBy("rel_path").orderBy(F.desc("hash"))
        new = hashes(rows).withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")
        old, _ = known(batch)
        if old is None:
            old = spark.createDataFrame([], "rel_path string, hash string")
        both = new.join(old.withColumnRenamed("hash", "_old"), "rel_path", "left")
        kind = F.when(F.col("_old").isNull(), "added").when(F.col("_old") != F.col("hash"), "modified")
        changed = both.select("rel_path", kind.alias("change")).where("change is not null").cache()
        if not changed.isEmpty():
            on_change(changed, batch)
        merged = old.join(new.select("rel_path"), "rel_path", "left_anti").unionByName(new)
        merged.write.mode("overwrite").parquet(f"{state}/{batch}")
        changed.unpersist()

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
