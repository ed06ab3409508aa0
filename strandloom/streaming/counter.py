"""An extension: counts of a stream of reads that are kept as a table. Counts add up in any order, so no
watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandloom.operators.counting import count_kmers


def keep_counts(reads: DataFrame, k: int, path: str, checkpoint: str, d: str = "d") -> StreamingQuery:
    """Count the k-mers of a streaming DataFrame as its batches come, each batch as a table of its own
    under ``path`` (a batch that is run again writes over its table, so nothing counts twice)."""

    def batch(rows: DataFrame, number: int) -> None:
        count_kmers(rows, k, d).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_counts(spark, path: str) -> DataFrame:
    """(kmer, abundance) of all batches so far."""
    return spark.read.parquet(path).groupBy("kmer").agg(F.sum("abundance").alias("abundance"))
