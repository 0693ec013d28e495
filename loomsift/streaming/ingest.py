"""Streams: samples that arrive over time, against what earlier batches kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from loomsift.functions.samples import as_samples
from loomsift.functions.text import dedup_text, squeezed
from loomsift.operators.embedding import Embedder, embedding_dedup, hashing_embedder
from loomsift.operators.gates import schema_reason


def read_documents(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def gated(samples: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """``samples`` with ``rejection_reason``: the schema gate holds for streams as it is, having no state."""
    return samples.withColumn("rejection_reason", schema_reason(**options))


def exact_dedup_stream(samples: DataFrame, time: str, lateness: str = "1 hour") -> DataFrame:
    """The first of each text that arrives within the watermark, which bounds the state."""
    keyed = samples.withColumn("_key", F.sha2(squeezed(F.lower(dedup_text())), 256))
    return keyed.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def windowed_counts(events: DataFrame, time: str, category: str, window: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """``start, category, n`` of tumbling windows; rows later than the watermark are dropped."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, window).alias("w"), F.col(category).alias("category")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "category", "n")


def cross_run_dedup(stream: DataFrame, to_samples: Callable[[DataFrame], DataFrame], index_path: str, out_path: str, checkpoint: str, threshold: float = 0.92, embedder: Embedder = hashing_embedder) -> DataStreamWriter:
    """Each batch against the index of all before it; what is kept is written and joins the index.

    A batch that is run again after a failure finds its own output and is skipped, so nothing is kept or indexed twice.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = f"{out_path}/batch={number}"
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
            return
        kept = embedding_dedup(to_samples(batch), index_path, threshold, embedder, append=False)
        kept.write.mode("overwrite").parquet(path)

    def indexed(batch: DataFrame, number: int) -> None:
        from loomsift.operators.embedding import embed

        one(batch, number)
        spark = batch.sparkSession
        kept = spark.read.parquet(f"{out_path}/batch={number}")
        vectors = embed(kept, embedder)
        kept.select("_seq", F.col("id").alias("sample_id"), "source_uri").join(vectors, "_seq").select("sample_id", "source_uri", "vec").write.mode("overwrite").parquet(f"{index_path}/batch={number}")

    return stream.writeStream.foreachBatch(indexed).option("checkpointLocation", checkpoint)


def documents_to_samples(documents: DataFrame) -> DataFrame:
    return as_samples(documents, "doc_id", "stream", id=F.col("doc_id").cast("string"), output="text", task_type=F.lit("language_modeling"))
