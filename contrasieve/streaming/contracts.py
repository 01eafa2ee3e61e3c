"""Continuous ingest, scoring and case state with Structured Streaming.

Every job takes a streaming DataFrame, so the source can be landed files or a log. ``run``
drains what is available and stops; with a processing-time trigger the same job runs on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from contrasieve.operators.rules import EVENT_STATES

SEEN_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def read_landed(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*", per_batch: int = 64, kind: str = "parquet") -> DataFrame:
    """Stream of files as they land in ``folder``."""
    return (
        spark.readStream.format(kind).schema(schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", per_batch).load(folder)
    )


def run(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", interval: str | None = None) -> None:
    """Write to Parquet; with no ``interval`` drain the source and return."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint)
    query = (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
    query.awaitTermination()


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", interval: str | None = None) -> None:
    writer = stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", checkpoint)
    query = (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
    query.awaitTermination()


def clean_records(stream: DataFrame, record: str, schema: str, keys: Sequence[str], valid: Callable[[DataFrame], Column]) -> DataFrame:
    """Parse a JSON column, flatten it next to the key columns and drop rows that fail ``valid``."""
    parsed = stream.select(*keys, F.from_json(record, schema).alias("_r")).select(*keys, "_r.*")
    return parsed.filter(valid(parsed))


def insert_unseen(path: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """Batch step: append the rows whose key is not in the table yet, one per key.

    A batch that is replayed after a failure overwrites its own folder, so the table holds
    each key once.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(list(keys))
        try:
            have = spark.read.parquet(path).filter(F.col("batch") != batch_id)
            fresh = fresh.join(have.select(*keys), list(keys), "left_anti")
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return step


def insert_new(stream: DataFrame, keys: Sequence[str], sink: str, checkpoint: str, interval: str | None = None) -> None:
    """Append the rows whose key has not come before, one per key, without reading the table.

    The keys seen so far are state, dealt over the shuffle partitions and kept on disk; a batch looks up
    and logs its own keys only, so its cost does not follow the history. A replayed batch finds the state of the batch
    before it and writes the same files once more, of which the sink counts one set.
    """
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in SEEN_STORE}
    try:
        for k, v in SEEN_STORE.items():
            spark.conf.set(k, v)
        run(stream.dropDuplicates(list(keys)), sink, checkpoint, interval=interval)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drop_seen(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """One row per key within the watermark; state older than that is released."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def score_stream(stream: DataFrame, model, key: str, limit: float = 0.6) -> DataFrame:
    """Score rows on arrival: ``novo`` from the limit on, else ``baixa``."""
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("probability")[1]
    return model.transform(stream).select(key, p.alias("p"), F.when(p >= limit, "novo").otherwise("baixa").alias("status"))


def case_states(stream: DataFrame, case: str, event: str, ts: str, event_id: str, delay: str = "7 days", span: str = "30 days") -> DataFrame:
    """Running state of every case and ``span`` of time from review events, in update mode.

    The latest event of a span decides its state. A span's state is released once the watermark, ``delay``
    behind the newest event, has passed its end; :func:`read_cases` puts the spans of a case together.
    """
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(EVENT_STATES.items())])
    events = stream.select(
        F.col(case).alias("case_id"), names[F.col(event)].alias("state"), F.col(ts).cast("timestamp").alias("ts"), F.col(event_id).cast("long").alias("event_id")
    ).filter("state IS NOT NULL")
    last = F.struct("ts", "event_id")
    per = events.withWatermark("ts", delay).groupBy("case_id", F.window("ts", span).alias("w"))
    out = per.agg(F.max_by("state", last).alias("state"), F.count("*").alias("n_events"), F.max(last).alias("last"))
    return out.select("case_id", F.col("w.start").alias("since"), "state", "n_events", "last")


def latest_table(path: str) -> Callable[[DataFrame, int], None]:
    """Batch step for update-mode results: one folder per batch, the newest row of a key counts."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return step


def read_latest(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_r"))
    return best.select(*keys, "_r.*")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, state, n_events) over all spans that :func:`case_states` has emitted."""
    spans = read_latest(spark, path, "case_id", "since")
    return spans.groupBy("case_id").agg(F.max_by("state", "last").alias("state"), F.sum("n_events").alias("n_events"))


def retrain_trigger(path: str) -> Callable[[DataFrame, int], None]:
    """Batch step that records how many reviews came before and in each batch.

    Only counts are kept: each batch is aggregated where its rows are, and the running total
    is the sum of a one-row table per batch.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = 0
        try:
            done = spark.read.parquet(path).filter(F.col("batch") < batch_id)
            before = done.agg(F.coalesce(F.sum("n_reviews"), F.lit(0))).first()[0]
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
        row = batch.agg(F.count("*").alias("n_reviews"), F.lit(int(before)).cast("long").alias("before"))
        row.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return step


def read_triggers(spark: SparkSession, path: str, every: int = 20) -> DataFrame:
    """(training, reviews): the crossings recorded by :func:`retrain_trigger`."""
    rows = spark.read.parquet(path)
    first, last = F.floor(F.col("before") / every) + 1, F.floor((F.col("before") + F.col("n_reviews")) / every)
    crossed = rows.filter(last >= first).select(F.explode(F.sequence(first, last)).alias("training"))
    return crossed.select(F.col("training").cast("long").alias("training"), (F.col("training") * every).cast("long").alias("reviews"))


def daily_counts(stream: DataFrame, ts: str, label: str, delay: str = "1 day") -> DataFrame:
    """Rows per day and label, for update mode: open days are there too; a day's state goes once the watermark passes it."""
    day = F.window(ts, "1 day")
    counted = stream.withWatermark(ts, delay).groupBy(day.alias("w"), label).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("day"), label, "n")


def monthly_rollup(days: DataFrame, label: str) -> DataFrame:
    return days.groupBy(F.date_format("day", "yyyy-MM").alias("month"), label).agg(F.sum("n").alias("n"))
