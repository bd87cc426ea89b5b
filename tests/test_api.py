import math

import pytest
from pyspark.sql import functions as F

from cohortlens import api
from cohortlens.operators import resampling


def table(spark):
    rows = [(i, i % 5, min(4.0, (i % 5) + (i % 7 - 3) / 4 if i % 5 else i % 7 / 8), float(i % 5) - 1.6 + (i % 3) / 3) for i in range(400)]
    return spark.createDataFrame(rows, "id long, grade int, score double, referral double")


def test_report_of_predictions(spark):
    df = table(spark)
    got = {r["metric"]: r["value"] for r in api.evaluate(df).collect()}
    rows = df.collect()
    pred = [sum(r["score"] >= t for t in (0.5, 1.5, 2.5, 3.5)) for r in rows]
    assert got["n"] == 400 and math.isclose(got["accuracy"], sum(p == r["grade"] for p, r in zip(pred, rows, strict=True)) / 400)
    assert got["tp"] + got["fn"] == 240 and got["head_disagreements"] == sum((p >= 2) != (r["referral"] >= 0) for p, r in zip(pred, rows, strict=True))
    bad = df.unionByName(df.limit(3).withColumn("score", F.lit(float("nan"))))
    assert {r["status"]: r["count"] for r in api.predict(bad).groupBy("status").count().collect()} == {"success": 400, "error": 3}
    again = {r["metric"]: r["value"] for r in api.evaluate(bad).collect()}
    assert set(again) == set(got) and all(math.isclose(again[m], got[m], rel_tol=1e-12) for m in got)
    with pytest.raises(ValueError, match="missing columns: referral"):
        api.evaluate(df.drop("referral"))
    with pytest.raises(ValueError, match="beyond"):
        api.evaluate(df.withColumn("grade", F.lit(7)))
    with pytest.raises(ValueError, match="increasing"):
        api.Config(thresholds=(1.0, 1.0, 2.0, 3.0))


def test_command_line(spark, tmp_path, capsys):
    table(spark).write.parquet(str(tmp_path / "p"))
    assert api.main(["queries"]) == 0 and "confusion_qwk" in capsys.readouterr().out.split()
    assert api.main(["doctor"], spark) == 0 and "10 of 10 rows" in capsys.readouterr().out
    assert api.main(["evaluate", str(tmp_path / "p")], spark) == 0 and "qwk\t" in capsys.readouterr().out
    assert api.main(["run", "dataset_audit", "/root/testdata/sf0.001", "--out", str(tmp_path / "o")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3
    with pytest.raises(KeyError):
        api.main(["run", "nothing", "x"], spark)


def test_statistics_by_callback(spark):
    df = spark.createDataFrame([(i // 4, i % 3 == 0, i % 2 == 0) for i in range(400)], "g long, a boolean, b boolean")
    total = {"a": F.col("a"), "b": F.col("b"), "n": F.lit(True)}
    stats = {"share": lambda t: t("a") / t("n"), "gap": lambda t: (t("a") - t("b")) / t("n"), "undefined": lambda t: F.try_divide(t("a"), t("n") - t("n"))}
    got = {r["metric"]: r for r in resampling.bootstrap(df, "g", total, stats, 200, "s").collect()}
    assert math.isclose(got["share"]["point"], 134 / 400) and got["share"]["low"] <= 134 / 400 <= got["share"]["high"] and got["share"]["valid"] == 200
    assert math.isclose(got["gap"]["point"], (134 - 200) / 400) and got["undefined"]["valid"] == 0 and got["undefined"]["point"] is None
