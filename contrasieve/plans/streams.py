"""Queries on streams (ST1-ST6): each drains a file stream and returns the resulting table."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.sql import functions as F

from contrasieve.plans.registry import query, table
from contrasieve.plans.rules import EVENT_CASE, review_event
from contrasieve.plans.standin import texts
from contrasieve.session import shared_folder
from contrasieve.streaming import contracts as st


def work(spark):
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return f"{base}/table", f"{base}/progress", base


def stream_of(spark, d, name):
    """The table as a stream, be it one file or a folder of part files; a pattern as path serves both."""
    return st.read_landed(spark, f"{d}/{name}[.]parquet", table(spark, d, name).schema, "*.parquet")


@query("st1_ingest", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 20")
def st1(spark, d):
    sink, progress, _ = work(spark)
    rows = st.clean_records(stream_of(spark, d, "events"), "props", "k INT", ["event_id"], lambda t: F.col("k") >= 20)
    st.run(rows, sink, progress)
    return spark.read.parquet(sink).select("event_id", "k")


@query("st2_insert_unseen", "SELECT DISTINCT l_orderkey FROM lineitem")
def st2(spark, d):
    sink, progress, base = work(spark)
    landed = f"{base}/landed"
    table(spark, d, "lineitem").select("l_orderkey").repartition(4).write.parquet(landed)
    rows = st.read_landed(spark, landed, table(spark, d, "lineitem").select("l_orderkey").schema, "*.parquet", per_batch=2)
    st.run_batches(rows, st.insert_unseen(sink, ["l_orderkey"]), progress)
    return spark.read.parquet(sink).select("l_orderkey")


@query("st2_insert_new", "SELECT l_orderkey, 1::BIGINT AS n FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def st2n(spark, d):
    sink, progress, base = work(spark)
    landed = f"{base}/landed"
    rows = table(spark, d, "lineitem").select("l_orderkey")
    rows.repartition(4).write.parquet(landed)
    st.insert_new(st.read_landed(spark, landed, rows.schema, "*.parquet", per_batch=2), ["l_orderkey"], sink, progress)
    return spark.read.parquet(sink).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("st2_drop_seen_in_watermark", "SELECT DISTINCT user_id FROM events")
def st2w(spark, d):
    sink, progress, _ = work(spark)
    rows = stream_of(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    st.run(st.drop_seen(rows, ["user_id"], "ts", "60 days").select("user_id"), sink, progress)
    return spark.read.parquet(sink)


@query("st3_score_on_arrival")
def st3(spark, d):
    sink, progress, _ = work(spark)
    known = texts(spark, d).filter("label <> 'geral'").na.fill("", ["text"]).select("text", (F.col("label") == "engenharia").cast("double").alias("label"))
    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern="[^a-zà-ÿ]+"),
        HashingTF(inputCol="words", outputCol="features", numFeatures=1 << 18, binary=True),
        LogisticRegression(maxIter=20, regParam=0.05),
    ]
    model = Pipeline(stages=stages).fit(known)
    st.run(st.score_stream(stream_of(spark, d, "documents").na.fill("", ["text"]), model, "doc_id"), sink, progress)
    return spark.read.parquet(sink)


@query(
    "st4_case_state",
    f"""WITH e AS (SELECT user_id, {EVENT_CASE} AS s, ts, event_id FROM events), k AS (SELECT * FROM e WHERE s IS NOT NULL)
    SELECT user_id AS case_id, arg_max(s, (ts, event_id)) AS state, count(*) AS n_events FROM k GROUP BY 1""",
)
def st4(spark, d):
    sink, progress, base = work(spark)
    landed = f"{base}/landed"
    events = table(spark, d, "events")
    third = [F.to_timestamp(F.lit("1900-01-01")), *[F.timestamp_micros(F.lit(int(t))) for t in events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).approxQuantile("t", [1 / 3, 2 / 3], 0.05)], F.to_timestamp(F.lit("9999-01-01"))]
    for a, b in zip(third[:-1], third[1:]):  # files land in the order of their events
        events.filter((F.col("ts") >= a) & (F.col("ts") < b)).write.mode("append").parquet(landed)
    rows = st.read_landed(spark, landed, events.schema, "*.parquet", per_batch=1)
    states = st.case_states(rows.withColumn("event", review_event()), "user_id", "event", "ts", "event_id")
    st.run_batches(states, st.latest_table(sink), progress, mode="update")
    return st.read_cases(spark, sink)


@query(
    "st5_retrain_trigger",
    "WITH c AS (SELECT count(*) AS n FROM events WHERE event_type IN ('click', 'view')) SELECT t AS training, t * 20 AS reviews FROM (SELECT unnest(generate_series(1, n // 20)) AS t FROM c)",
)
def st5(spark, d):
    sink, progress, base = work(spark)
    landed = f"{base}/landed"
    table(spark, d, "events").repartition(3).write.parquet(landed)
    rows = st.read_landed(spark, landed, table(spark, d, "events").schema, "*.parquet", per_batch=1)
    st.run_batches(rows.filter("event_type IN ('click', 'view')"), st.retrain_trigger(sink), progress)
    return st.read_triggers(spark, sink)


@query("st6_monthly_counts", "SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st6(spark, d):
    sink, progress, _ = work(spark)
    rows = stream_of(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    st.run_batches(st.daily_counts(rows, "ts", "event_type"), st.latest_table(sink), progress, mode="update")
    return st.monthly_rollup(st.read_latest(spark, sink, "day", "event_type"), "event_type")
