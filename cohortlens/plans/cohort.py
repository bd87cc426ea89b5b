"""The cohort that the driver's tables stand for: orders as images, customers as patients, regions as sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import decode, draw, sigmoid

THRESHOLDS = (0.5, 1.5, 2.5, 3.5)
HEAD_THRESHOLD, TEMPERATURE = 0.5, 0.839


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _score(grade, tags, key):
    """clip(grade + noise, 0, 4) on a grid of 1/10000, in whole numbers so that any engine gets the same."""
    n = grade * 10000 + 2 * (sum(draw(t, key) for t in tags) - 15000)
    return F.greatest(F.least(n, F.lit(40000)), F.lit(0)) / F.lit(10000.0)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, group_id, source, camera, status, true_grade, score and second (two models), z5 and y5 (their referral logits), iqs, pred, pred2, head, head2."""
    geo = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    geo = geo.join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "r_name")  # 5 rows
    k = F.col("o_orderkey")
    g, s, q = draw("grade", k), draw("st", k), draw("iqs", k)
    grade = F.when(g < 4500, 0).when(g < 6000, 1).when(g < 8000, 2).when(g < 9000, 3).otherwise(4)
    status = F.when(s < 200, "error").when(s < 500, "rejected").otherwise("success")
    out = read(spark, sf_dir, "orders").join(geo, F.col("o_custkey") == F.col("c_custkey"))
    out = out.select(k.alias("image_id"), F.col("o_custkey").alias("group_id"), F.col("r_name").alias("source"),
        F.col("o_orderpriority").alias("camera"), status.alias("status"), grade.alias("true_grade"), (q / 10000.0).alias("iqs"))
    i = F.col("image_id")
    out = out.withColumns({"score": _score(F.col("true_grade"), ("a1", "a2", "a3"), i), "second": _score(F.col("true_grade"), ("b1", "b2", "b3"), i)})
    out = out.withColumns({"z5": 2 * (F.col("score") - 1.5) + 2 * (draw("r", i) / 10000.0 - 0.5), "y5": 2 * (F.col("second") - 1.5) + 2 * (draw("rb", i) / 10000.0 - 0.5)})
    return out.withColumns({"pred": decode(F.col("score"), THRESHOLDS), "pred2": decode(F.col("second"), THRESHOLDS), "head": (F.col("z5") >= 0), "head2": (F.col("y5") >= 0)})


def logits(score="score", referral="z5"):
    """Six logits: minus the squared distance to each grade, and the referral logit."""
    return F.array(*[-(F.col(score) - float(k)) * (F.col(score) - float(k)) for k in range(5)], F.col(referral))


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).filter("status = 'success'")


def head_probability():
    return sigmoid(F.col("z5"))


def _sql_draw(tag: str, key: str) -> str:
    return f"CAST(CAST(concat('0x', substr(md5(concat_ws('|', {tag}, {key})), 1, 8)) AS UBIGINT) % 10000 AS BIGINT)"


def sql_draw(tag: str, key: str) -> str:
    return _sql_draw(f"'{tag}'", key)


def _sql_score(tags) -> str:
    return "CAST(greatest(least(true_grade * 10000 + 2 * (" + " + ".join(sql_draw(t, "image_id") for t in tags) + " - 15000), 40000), 0) AS DOUBLE) / 10000"


def _sql_decode(c: str) -> str:
    return "(" + " + ".join(f"CAST({c} >= CAST({t} AS DOUBLE) AS INT)" for t in THRESHOLDS) + ")"


#: DuckDB's form of cases(), as the first common table expressions of a query; ok holds the successful rows.
CASES = f"""WITH c0 AS (
  SELECT o_orderkey AS image_id, o_custkey AS group_id, r_name AS source, o_orderpriority AS camera,
    {sql_draw('grade', 'o_orderkey')} AS g, {sql_draw('st', 'o_orderkey')} AS s, CAST({sql_draw('iqs', 'o_orderkey')} AS DOUBLE) / 10000 AS iqs
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
c1 AS (SELECT image_id, group_id, source, camera, iqs,
    CASE WHEN g < 4500 THEN 0 WHEN g < 6000 THEN 1 WHEN g < 8000 THEN 2 WHEN g < 9000 THEN 3 ELSE 4 END AS true_grade,
    CASE WHEN s < 200 THEN 'error' WHEN s < 500 THEN 'rejected' ELSE 'success' END AS status FROM c0),
c2 AS (SELECT *, {_sql_score(('a1', 'a2', 'a3'))} AS score, {_sql_score(('b1', 'b2', 'b3'))} AS second FROM c1),
c3 AS (SELECT *, 2 * (score - CAST(1.5 AS DOUBLE)) + 2 * (CAST({sql_draw('r', 'image_id')} AS DOUBLE) / 10000 - CAST(0.5 AS DOUBLE)) AS z5,
    2 * (second - CAST(1.5 AS DOUBLE)) + 2 * (CAST({sql_draw('rb', 'image_id')} AS DOUBLE) / 10000 - CAST(0.5 AS DOUBLE)) AS y5 FROM c2),
cases AS (SELECT *, {_sql_decode('score')} AS pred, {_sql_decode('second')} AS pred2, z5 >= 0 AS head, y5 >= 0 AS head2 FROM c3),
ok AS (SELECT * FROM cases WHERE status = 'success')"""
#: Softmax of the five grade logits, in a lateral form: columns p0 to p4.
PROBS = ", probs AS (SELECT *, " + ", ".join(f"e{k} / (e0 + e1 + e2 + e3 + e4) AS p{k}" for k in range(5)) + " FROM (SELECT *, " + ", ".join(f"exp(z{k} - greatest(z0, z1, z2, z3, z4)) AS e{k}" for k in range(5)) + " FROM (SELECT *, " + ", ".join(f"-(score - {k}) * (score - {k}) AS z{k}" for k in range(5)) + " FROM ok)))"
