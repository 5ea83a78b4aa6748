"""Streaming forms of the workers: price windows, signals once a key, exposure by day."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
WATERMARK = "3 days"


def quote_stream(spark: SparkSession, path: str, files_a_batch: int | None = 10) -> DataFrame:
    """Quotes from a growing folder of event files; ``None`` reads all that is there in one batch, whatever its order in time."""
    reader = spark.readStream.schema(EVENTS)
    raw = (reader if files_a_batch is None else reader.option("maxFilesPerTrigger", files_a_batch)).parquet(path)
    return raw.select(F.col("event_id").alias("quote_id"), (F.col("user_id") % 50).alias("match_id"), F.col("ts").cast("timestamp").alias("observed_at"), F.col("event_type").alias("book"), (1.0 + F.col("event_id") % 400 * 1e-2).alias("price"))


def price_windows(quotes: DataFrame, size: str = "1 day") -> DataFrame:
    """Count and mean price by book and window; late rows beyond the watermark are dropped by the engine."""
    return quotes.withWatermark("observed_at", WATERMARK).groupBy(F.window("observed_at", size), "book").agg(F.count("*").alias("n"), F.avg("price").alias("price")).select(F.col("window.start").alias("start"), "book", "n", "price")


def signals_once(quotes: DataFrame, least: float = 4.5) -> DataFrame:
    """Hot quotes, one a match, book and day: the key is kept as state until the watermark passes its day."""
    hot = quotes.where(F.col("price") >= least).withColumn("day", F.date_trunc("day", "observed_at"))
    return hot.withWatermark("day", WATERMARK).dropDuplicates(["match_id", "book", "day"]).select("match_id", "book", "day")


def exposure_stream(bets: DataFrame, cap: float = 0.05) -> DataFrame:
    """Accept stakes of a day (``day, bet_id, stake_pct``) while its cap lasts; the used share is the state.

    State is one number a day and stays, so bets of any day may come late; a timeout would drop them.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values("bet_id")  # a day's rows of one micro-batch
        taken = []
        for s in rows["stake_pct"]:
            ok = used + s <= cap + 1e-12
            used += s if ok else 0.0
            taken.append(ok)
        state.update((used,))
        yield pd.DataFrame({"day": rows["day"], "bet_id": rows["bet_id"], "accepted": taken})

    return bets.groupBy("day").applyInPandasWithState(fold, "day date, bet_id long, accepted boolean", "used double", "append", GroupStateTimeout.NoTimeout)


def shared_folder(spark: SparkSession, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="touchline-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read back: what several plans read is made once, and Spark knows its size."""
    folder = shared_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and read its result; complete results replace the table batch by batch."""
    spark = stream.sparkSession
    out, log = shared_folder(spark, name), shared_folder(spark, f"{name}-log")
    writer = stream.writeStream.option("checkpointLocation", log).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").outputMode("append").option("path", out).start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
