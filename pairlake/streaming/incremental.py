"""Work only on inputs that have no output yet: as a batch, or as a file stream."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def only_new(source: DataFrame, destination: DataFrame, key: str) -> DataFrame:
    """The source rows whose key the destination lacks."""
    return source.join(destination.select(key), key, "left_anti")


def stream_derive(
    spark: SparkSession, source: str, schema, fn: Callable[[DataFrame], DataFrame],
    sink: str, progress: str, glob: str | None = None, files_per_trigger: int = 10_000, key: str | None = None,
) -> DataFrame:
    """Runs ``fn`` over the files that came since the last call and returns the whole sink.

    The file stream keeps its progress under ``progress``; a restart after a
    lost executor or driver neither skips nor repeats a file in the sink.

    ``key``: rows whose key the sink has already are left out, and of several new rows with
    one key one stays (the least by a hash of its values, so a repeated batch chooses the
    same). A batch has a folder of its own, by the stream and its number: one that is
    run again, as its progress was not yet noted, replaces its folder. The null key is a key.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    derived = fn(reader.parquet(source))
    writer = derived.writeStream.option("checkpointLocation", progress).trigger(availableNow=True)
    if key is None:
        query = writer.format("parquet").outputMode("append").option("path", sink).start()
    else:
        query = writer.foreachBatch(lambda rows, number: _add_new(rows, number, sink, progress, key)).start()
    query.awaitTermination()
    if key is None:
        return spark.read.schema(derived.schema).parquet(sink)
    return _stored(spark, sink, derived.schema).select(*derived.columns)


#: Names the folder of a batch in the sink.
BATCH = "_from_batch"


def _stored(spark: SparkSession, sink: str, schema) -> DataFrame:
    """All rows of the sink with the batch they came in; none where there is no sink yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema).withColumn(BATCH, F.lit(""))
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.StringType())])).parquet(sink)


def _add_new(rows: DataFrame, number: int, sink: str, progress: str, key: str) -> None:
    spark, columns = rows.sparkSession, rows.columns
    # a stream whose progress was lost begins at 0 again, under another name
    own = f"{json.loads(spark.read.text(f'{progress}/metadata').first()[0])['id']}.{number}"
    whole = F.struct(*[F.col(f"`{c}`") for c in columns])
    # kept by partial aggregation, so a key in very many rows is no hot task
    one = rows.groupBy(F.col(key).alias("_key")).agg(F.min_by(whole, F.xxhash64(whole)).alias("_row"))
    one = one.persist()
    try:
        others = _stored(spark, sink, rows.schema).where(F.col(BATCH) != own).select(F.col(key).alias("_known"))
        # few new keys pass by the sink's keys, not the other way round
        known = others.join(one.select("_key"), F.col("_known").eqNullSafe(F.col("_key")), "left_semi").distinct()
        new = one.join(known, F.col("_key").eqNullSafe(F.col("_known")), "left_anti").select("_row.*")
        new.write.mode("overwrite").parquet(f"{sink}/{BATCH}={own}")
    finally:
        one.unpersist()
