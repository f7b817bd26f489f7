"""Meter readings as they arrive: quarter-hours, revisions, and months so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import LOCAL_TZ, local_time


def quarter_hours(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """(meter_id, window, import_kwh, export_kwh) of a stream (meter_id, ts, channel, kwh); a window closes once the watermark passes it."""
    kwh = lambda c: F.coalesce(F.sum(F.when(F.col("channel") == c, F.col("kwh"))), F.lit(0.0)).alias(f"{c}_kwh")
    return events.withWatermark("ts", lateness).groupBy("meter_id", F.window("ts", "15 minutes")).agg(kwh("import"), kwh("export"))


def priced(usage: DataFrame, prices: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Intervals with the price of their start, which may arrive days later; unpriced ones come out null once it cannot come any more."""
    u = usage.withWatermark("ts", lateness).alias("u")
    p = prices.withWatermark("price_ts", lateness).alias("p")
    on = (F.col("u.ts") == F.col("p.price_ts")) & (F.col("p.price_ts") >= F.col("u.ts")) & (F.col("p.price_ts") <= F.col("u.ts"))
    return u.join(p, on, "leftOuter").select("u.*", "p.price_usd_kwh")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at path, in whatever file system it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def month_state(usage: DataFrame, lateness: str = "2 days") -> DataFrame:
    """(meter_id, month, import_kwh, export_kwh, intervals) so far, of a stream of intervals (meter_id, ts, import_kwh, export_kwh).

    The month is the local one. Each change of a month comes out again (update mode), so a bill of the
    running month follows the readings; readings later than the watermark are left out.
    """
    rows = usage.withWatermark("ts", lateness).withColumn("month", F.date_format(local_time("ts", LOCAL_TZ), "yyyy-MM"))
    return rows.groupBy("meter_id", "month").agg(F.sum("import_kwh").alias("import_kwh"), F.sum("export_kwh").alias("export_kwh"), F.count(F.lit(1)).alias("intervals"))


def export_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet exports of readings as they arrive under path: several exports merge in the upsert, the newest reading of an interval winning."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", "*.parquet").parquet(path)


def journal(rows: list):
    """A listener that appends (batch, input rows, seconds) of each finished micro-batch to `rows`."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Journal(StreamingQueryListener):
        def onQueryStarted(self, event):  # noqa: N802
            pass

        def onQueryProgress(self, event):  # noqa: N802
            p = event.progress
            rows.append((p.batchId, p.numInputRows, (p.batchDuration or 0) / 1000))

        def onQueryIdle(self, event):  # noqa: N802
            pass

        def onQueryTerminated(self, event):  # noqa: N802
            pass

    return Journal()


def upserted(batch: DataFrame, path: str, spark: SparkSession, months: str = "month") -> None:
    """Merges a micro-batch of readings (meter_id, ts, import_kwh, export_kwh, modified) into the table at path: the newest reading of an interval wins.

    Only the months the batch touches are rewritten. A repeated batch changes nothing, so a restarted
    query may send one again.
    """
    new = batch.withColumn(months, F.date_format(local_time("ts", LOCAL_TZ), "yyyy-MM"))
    touched = [r[0] for r in new.select(months).distinct().collect()]  # months, a handful
    both = new
    if exists(spark, path):  # any failure to read what is there ends the batch: nothing is overwritten
        old = spark.read.parquet(path).where(F.col(months).isin(*touched))
        both = old.unionByName(new.select(*old.columns))
    rest = [c for c in new.columns if c not in ("meter_id", "ts", months)]
    best = both.groupBy("meter_id", "ts", months).agg(F.max_by(F.struct(*rest), "modified").alias("r")).select("meter_id", "ts", "r.*", months)
    # Written aside first: a table cannot be overwritten while it is read.
    best.write.mode("overwrite").partitionBy(months).parquet(f"{path}.next")
    spark.read.parquet(f"{path}.next").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(months).parquet(path)


def sink(stream: DataFrame, path: str, checkpoint: str):
    """Starts the upsert of a stream of readings."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: upserted(df, path, df.sparkSession)).trigger(availableNow=True).start()
