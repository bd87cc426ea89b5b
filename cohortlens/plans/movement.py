"""Queries that read, write and stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import sinks, tables
from ..streaming import replay
from .cohort import read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _at(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 2 THEN '' ELSE CAST(n_regionkey AS VARCHAR) END AS n_regionkey FROM nation")
def text_csv_scan(spark, d):
    """Semicolons, all strings, empty fields that stay empty."""
    path = _at(spark, "csv")
    n = read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias(" n_name "), F.when(F.col("n_regionkey") == 2,
        "").otherwise(F.col("n_regionkey").cast("string")).alias("n_regionkey"))
    n.write.option("header", True).option("sep", ";").option("emptyValue", "").csv(path)
    return tables.text_csv(spark, path, sep=";").withColumn("n_nationkey", F.col("n_nationkey").cast("int"))


@query("SELECT c_custkey % 4 AS part, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_custkey % 4 <> 3 GROUP BY 1")
def chunked_csv_union(spark, d):
    """Result files of several chunks read together, staged ones left out."""
    root = _at(spark, "chunks")
    c = read(spark, d, "customer").select("c_custkey", "c_acctbal")
    for k in range(4):
        c.filter(F.col("c_custkey") % 4 == k).coalesce(1).write.option("header", True).csv(f"{root}/{'_staging' if k == 3 else k}")
    df = tables.csv(spark, root, "c_custkey long, c_acctbal double", pattern="part-*.csv").withColumn("file", F.input_file_name()).filter("NOT contains(file, '/_staging/')")
    return df.groupBy((F.col("c_custkey") % 4).alias("part")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) AS first_part, (SELECT count(*) "
    "FROM orders WHERE o_orderkey % 3 <> 0) AS added, (SELECT count(*) FROM orders) AS rows, (SELECT count(DISTINCT o_orderkey) "
    "FROM orders) AS ids")
def resumable_sink(spark, d):
    """A third is there already; the rest is added, and nothing twice."""
    path = _at(spark, "resume")
    o = read(spark, d, "orders").select("o_orderkey", F.lit("run").alias("identity"))
    sinks.published(o.filter("o_orderkey % 3 = 0"), path)
    first = spark.read.parquet(path).agg(F.count("*").alias("first_part")).first()[0]
    rest = sinks.resume(o, path, "o_orderkey", "run")
    n = rest.count()
    rest.write.mode("append").parquet(path)
    return spark.read.parquet(path).agg(F.lit(first).cast("long").alias("first_part"), F.lit(n).cast("long").alias("added"),
        F.count("*").alias("rows"), F.count_distinct("o_orderkey").alias("ids"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    """The events replayed as a stream, counted by day and type. Days are those of the session's time zone."""
    w = replay.drained(replay.windowed(replay.source(spark, f"{d}/events.parquet")))
    return w.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH a AS (SELECT event_type AS key, event_id, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k "
    "FROM events), s AS (SELECT key, t, max(t - k * CAST(300 AS DOUBLE)) OVER (PARTITION BY key ORDER BY k ROWS UNBOUNDED PRECEDING) + k * CAST(300 AS DOUBLE) AS start "
    "FROM a) SELECT key, count(*) AS n, round(avg(start - t), 3) AS mean_wait FROM s GROUP BY 1")
def stream_queue(spark, d):
    """Waiting times at one station for each event type, kept as state."""
    w = replay.served(replay.source(spark, f"{d}/events.parquet"), "event_type", 300.0)
    return w.groupBy("key").agg(F.count("*").alias("n"), F.round(F.avg("wait"), 3).alias("mean_wait"))
