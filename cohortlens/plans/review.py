"""Queries on whole reports, locked evaluation, files, lesion tables and mirrored similarity."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import governance as G
from ..operators import report as O
from ..operators import resampling as B
from ..operators import similarity as V
from ..session import shared_dir, ship
from ..sources import archives, arrays, documents, images, tables, workbooks
from .assembly import _HASH, _UNIT, _hashes, _unit
from .cohort import CASES, evaluated, head_probability, read, sql_draw
from .statistics import REPLICATES, query, r6, sql_draw32

QUERIES, SQL = {}, {}
#: Values in a row of a vector that is read as an image.
WIDTH = 8


def own(sql: str | None = None):
    return query(sql, QUERIES, SQL)


_REPORT = CASES + """, b AS (SELECT count(*) FILTER (WHERE true_grade >= 2 AND pred >= 2) AS tp, count(*) FILTER (WHERE true_grade >= 2 AND pred < 2) AS fn, count(*) FILTER (WHERE true_grade < 2 AND pred < 2) AS tn, count(*) FILTER (WHERE true_grade < 2 AND pred >= 2) AS fp, count(*) AS n, avg(CAST(pred = true_grade AS DOUBLE)) AS accuracy, avg(CAST(abs(pred - true_grade) AS DOUBLE)) AS mae, avg(CAST(abs(pred - true_grade) <= 1 AS DOUBLE)) AS within_one, avg((1 / (1 + exp(-z5)) - CAST(true_grade >= 2 AS DOUBLE)) ** 2) AS brier, count(*) FILTER (WHERE head <> (pred >= 2)) AS head_disagreements FROM ok),
st AS (SELECT score, count(*) FILTER (WHERE true_grade >= 2) AS pos, count(*) FILTER (WHERE true_grade < 2) AS neg FROM ok GROUP BY 1), rt AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER () AS ap, sum(neg) OVER () AS an, sum(neg) OVER (ORDER BY score) - neg AS below FROM st WINDOW d AS (ORDER BY score DESC)),
rk AS (SELECT sum(pos * (below + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc, coalesce(max(CASE WHEN CAST(an - fp AS DOUBLE) / an >= CAST(0.85 AS DOUBLE) THEN CAST(tp AS DOUBLE) / ap END), 0) AS s85, max(CASE WHEN CAST(tp AS DOUBLE) / ap >= CAST(0.85 AS DOUBLE) THEN CAST(an - fp AS DOUBLE) / an END) AS p85, sum(CAST(pos AS DOUBLE) / ap * (CAST(tp AS DOUBLE) / (tp + fp))) AS ap_ FROM rt),
bn AS (SELECT greatest(CAST(ceil(1 / (1 + exp(-z5)) * 15) AS INT) - 1, 0) AS bin, count(*) AS n, avg(1 / (1 + exp(-z5))) AS c, avg(CAST(true_grade >= 2 AS DOUBLE)) AS a FROM ok GROUP BY 1), ec AS (SELECT sum(n * abs(a - c)) / sum(n) AS ece FROM bn),
m AS (SELECT true_grade AS t, pred AS p, count(*) AS n FROM ok GROUP BY 1, 2), rs AS (SELECT t, sum(n) AS r, sum(n) FILTER (WHERE t = p) AS tp FROM m GROUP BY 1), cs AS (SELECT p, sum(n) AS c FROM m GROUP BY 1),
kq AS (SELECT 1 - (SELECT sum(power(t - p, 2) * n) FROM m) * (SELECT sum(n) FROM m) / (SELECT sum(power(t - p, 2) * r * c) FROM rs, cs) AS qwk), f AS (SELECT avg(2.0 * coalesce(rs.tp, 0) / (coalesce(r, 0) + coalesce(c, 0))) AS macro_f1 FROM rs FULL JOIN cs ON rs.t = cs.p),
rep AS (SELECT unnest(['tp', 'fn', 'tn', 'fp', 'sensitivity', 'specificity', 'n', 'accuracy', 'mae', 'within_one', 'brier', 'head_disagreements', 'ece', 'sens_at_spec85', 'spec_at_sens85', 'qwk', 'macro_f1', 'auc', 'average_precision']) AS metric, unnest([CAST(b.tp AS DOUBLE), fn, tn, fp, CAST(b.tp AS DOUBLE) / (b.tp + fn), CAST(tn AS DOUBLE) / (tn + fp), n, accuracy, mae, within_one, brier, head_disagreements, ece, s85, p85, qwk, macro_f1, auc, ap_]) AS value FROM b, rk, ec, kq, f UNION ALL SELECT 'recall_' || g.range, CAST(coalesce(rs.tp, 0) AS DOUBLE) / nullif(r, 0) FROM range(5) g LEFT JOIN rs ON rs.t = g.range)"""


def report_of(df):
    return O.grading_report(df, "true_grade", "pred", "score", head_probability(), F.col("head"))


@own(_REPORT + " SELECT metric, round(value, 6) AS value FROM rep")
def grading_report(spark, d):
    """Everything that is reported of one model on the cohort."""
    return report_of(evaluated(spark, d)).select("metric", r6("value", "value"))


@own(_REPORT + " SELECT 'report' AS step, metric, round(value, 6) AS value FROM rep UNION ALL SELECT step, outcome, CAST(NULL AS DOUBLE) "
    "FROM (VALUES ('freeze', 'frozen'), ('changed input', 'changed'), ('evaluate', 'written'), ('evaluate again', 'refused'), ('exposure', 'locked'), ('claim fresh', 'no')) t(step, outcome)")
def locked_evaluation(spark, d):
    """Freeze the cohort, evaluate it once, be refused the second time, and note the exposure; the report is read back from where it was written."""
    df = evaluated(spark, d).select("image_id", "true_grade", "pred", "score", "z5", "head")
    tables = {"cohort": (df, "image_id")}
    lock = G.freeze(tables, 7, REPLICATES)
    folder = f"{shared_dir(spark).rstrip('/')}/locked-{lock['sha256'][:8]}-{spark.sparkContext.applicationId}-{np.random.default_rng().integers(1 << 60)}"
    changed = {"cohort": (df.withColumn("pred", F.col("pred") + 1), "image_id")}
    report = report_of(df)
    steps = [("freeze", "frozen"), ("changed input", O.evaluate_locked(report, folder, lock, changed)),
        ("evaluate", O.evaluate_locked(report, folder, lock, tables)), ("evaluate again", O.evaluate_locked(report, folder, lock, tables))]
    registry = G.exposed({}, "cohort", "locked")
    steps += [("exposure", registry["cohort"]), ("claim fresh", "yes" if G.may_claim_fresh(registry, "cohort") else "no")]
    out = spark.createDataFrame([(s, m, None) for s, m in steps], "step string, metric string, value double")
    return out.unionByName(O.read_report(spark, folder, lock).select(F.lit("report").alias("step"), "metric", r6("value", "value")))


_MIRROR = _UNIT + f", w AS (SELECT id, v, list_transform(range(len(v)), lambda i: v[i - i % {WIDTH} + {WIDTH - 1} - i % {WIDTH} + 1]) AS m FROM u)"


@own(_MIRROR + " SELECT a.id AS a, b.id AS b, round(greatest(list_dot_product(a.v, b.v), list_dot_product(a.v, b.m)), 6) AS similarity "
    "FROM w a JOIN w b ON a.id < b.id WHERE round(greatest(list_dot_product(a.v, b.v), list_dot_product(a.v, b.m)), 6) >= CAST(0.4 AS DOUBLE)")
def mirrored_pairs(spark, d):
    """Pairs whose vectors correlate as they are or with one of them mirrored."""
    return V.similar_pairs(_unit(spark, d), 0.4, WIDTH)


@own(_MIRROR + ", s AS (SELECT q.id AS query, r.id AS ref, round(greatest(list_dot_product(q.v, r.v), list_dot_product(q.v, r.m)), 6) AS similarity "
    "FROM w q JOIN w r ON q.id <> r.id WHERE q.id % 50 = 0), t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, ref) AS rank "
    "FROM s) SELECT query, ref, similarity, CAST(rank AS INT) AS rank FROM t WHERE rank <= 3")
def mirrored_top_k(spark, d):
    """The three nearest of each query vector, plain or mirrored."""
    u = _unit(spark, d)
    return V.top_k(u.filter("id % 50 = 0"), u, 3, WIDTH).select("query", "ref", "similarity", "rank")


@own(_HASH + f", v AS (SELECT a, b, distance, {sql_draw('inl', 'a, b')} % 60 AS inliers, CAST({sql_draw('inr', 'a, b')} AS DOUBLE) / 10000 AS share "
    f"FROM p) SELECT a, b, distance, inliers, inliers >= 12 AND share >= CAST(0.25 AS DOUBLE) AS confirmed "
    f"FROM v")
def verified_pairs(spark, d):
    """Candidate pairs by hash, confirmed by an expensive check whose result, points that agree and their share, is a table."""
    p = V.hamming_join(*_hashes(spark, d), 7)
    seen = p.select(F.col("a").alias("x"), F.col("b").alias("y"), (S.draw("inl", F.col("a"), F.col("b")) % 60).alias("inliers"),
        (S.draw("inr", F.col("a"), F.col("b")) / 10000.0).alias("share"))
    j = p.join(seen, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left")
    return j.select("a", "b", "distance", "inliers", F.coalesce((F.col("inliers") >= 12) & (F.col("share") >= 0.25), F.lit(False)).alias("confirmed"))


_PIXELS = "WITH px AS (SELECT l_suppkey AS image, l_returnflag AS lesion, l_orderkey AS component, l_tax >= CAST(0.04 AS DOUBLE) AS truth, l_discount >= CAST(0.05 AS DOUBLE) AS pred, l_quantity >= 25 AS heuristic FROM lineitem)"


def pixels(spark, d):
    """(image, lesion, component, truth, pred, heuristic): what masks of a learned and a heuristic detector come to as a table."""
    li = read(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("image"), F.col("l_returnflag").alias("lesion"), F.col("l_orderkey").alias("component"),
        (F.col("l_tax") >= 0.04).alias("truth"), (F.col("l_discount") >= 0.05).alias("pred"), (F.col("l_quantity") >= 25).alias("heuristic"))


@own(_PIXELS + ", c AS (SELECT image, lesion, component, bool_or(truth) AS t, bool_or(truth AND pred) AS hit, bool_or(pred) AS p "
    "FROM px GROUP BY 1, 2, 3), o AS (SELECT image, lesion, count(*) FILTER (WHERE truth AND pred) AS tp, count(*) FILTER (WHERE NOT truth AND pred) AS fp, count(*) FILTER (WHERE truth AND NOT pred) AS fn "
    "FROM px GROUP BY 1, 2), k AS (SELECT image, lesion, count(*) FILTER (WHERE t) AS components, count(*) FILTER (WHERE hit) AS found, count(*) FILTER (WHERE p AND NOT hit) AS false_components "
    "FROM c GROUP BY 1, 2) SELECT image, lesion, tp, fp, fn, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS dice, round(CAST(tp AS DOUBLE) / nullif(tp + fp + fn, 0), 6) AS iou, components, found, false_components "
    "FROM o JOIN k USING (image, lesion)")
def lesion_overlap(spark, d):
    """Overlap counts and component detections of each image and lesion."""
    px = pixels(spark, d)
    t, p = F.col("truth"), F.col("pred")
    comp = px.groupBy("image", "lesion", "component").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    hit, called, there = F.col("tp") > 0, F.col("tp") + F.col("fp") > 0, F.col("tp") + F.col("fn") > 0
    o = comp.groupBy("image", "lesion").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.count_if(there).alias("components"), F.count_if(hit).alias("found"), F.count_if(called & ~hit).alias("false_components"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return o.select("image", "lesion", "tp", "fp", "fn", r6(S.ratio(2 * tp, 2 * tp + fp + fn), "dice"), r6(S.ratio(tp, tp + fp + fn), "iou"), "components", "found", "false_components")


@own(_PIXELS + f""", g AS (SELECT lesion, image, count(*) FILTER (WHERE truth AND pred) AS a, count(*) FILTER (WHERE pred) + count(*) FILTER (WHERE truth) AS an, count(*) FILTER (WHERE truth AND heuristic) AS b, count(*) FILTER (WHERE heuristic) + count(*) FILTER (WHERE truth) AS bn FROM px GROUP BY 1, 2 HAVING count(*) FILTER (WHERE truth) > 0 AND count(*) FILTER (WHERE heuristic) > 0),
cl AS (SELECT *, row_number() OVER (PARTITION BY lesion ORDER BY md5(concat_ws('|', 'idx', image)), image) - 1 AS idx, count(*) OVER (PARTITION BY lesion) AS nc FROM g), w AS (SELECT lesion, r.range AS r, {sql_draw32('les', 'lesion, r.range, idx')} % nc AS idx, count(*) AS w FROM range({REPLICATES}) r, cl GROUP BY 1, 2, 3),
s AS (SELECT lesion, r, 2.0 * sum(a * w) / sum(an * w) - 2.0 * sum(b * w) / sum(bn * w) AS v FROM w JOIN cl USING (lesion, idx) GROUP BY 1, 2), p AS (SELECT lesion, count(*) AS images, 2.0 * sum(a) / sum(an) AS learned, 2.0 * sum(b) / sum(bn) AS heuristic FROM g GROUP BY 1)
SELECT p.lesion, any_value(images) AS images, round(any_value(learned), 6) AS learned, round(any_value(heuristic), 6) AS heuristic, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, quantile_cont(v, 0.025) > 0 AS better FROM p JOIN s ON s.lesion = p.lesion GROUP BY 1""")
def lesion_summary(spark, d):
    """Pooled Dice of a learned and a heuristic detector for each lesion, on images where both gave a result, and their difference over resampled images."""
    px = pixels(spark, d)
    t, p, h = F.col("truth"), F.col("pred"), F.col("heuristic")
    g = px.groupBy("lesion", "image").agg(F.count_if(t & p).alias("a"), (F.count_if(p) + F.count_if(t)).alias("an"), F.count_if(t & h).alias("b"),
        (F.count_if(h) + F.count_if(t)).alias("bn"), F.count_if(t).alias("t"), F.count_if(h).alias("h"))
    g = g.filter("t > 0 AND h > 0").select("lesion", "image", "a", "an", "b", "bn")
    c = B.cluster_counts(g, "image", {k: F.col(k) for k in ("a", "an", "b", "bn")}, ["lesion"])
    dice = lambda x: 2 * S.ratio(F.sum(x), F.sum(f"{x}n"))
    s = B.stratum_sums(c, REPLICATES, "les", ["a", "an", "b", "bn"], ["lesion"])
    s = s.select("lesion", (2 * S.ratio(F.col("a"), F.col("an")) - 2 * S.ratio(F.col("b"), F.col("bn"))).alias("v"))
    ci = s.groupBy("lesion").agg(F.percentile("v", [0.025, 0.975]).alias("ci"))
    out = g.groupBy("lesion").agg(F.count("*").alias("images"), dice("a").alias("learned"), dice("b").alias("heuristic")).join(ci, "lesion")
    return out.select("lesion", "images", r6("learned", "learned"), r6("heuristic", "heuristic"), r6(F.col("ci")[0], "low"), r6(F.col("ci")[1], "high"), (F.col("ci")[0] > 0).alias("better"))


@own("SELECT CAST(n_nationkey AS VARCHAR) AS nation, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def workbook_scan(spark, d):
    """A named sheet of a workbook, made here of two tables of fixed size, as a table."""
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").select("n_nationkey", "n_name", "r_name")
    rows = [list(r) for r in n.collect()]  # 25 rows
    book = workbooks.workbook({"notes": [["not", "this"]], "nations": [["nation", " name", "region"], *rows, [None, " "]]})
    files = spark.createDataFrame([("book.xlsx", bytearray(book))], "path string, content binary")
    return workbooks.table_of(workbooks.workbook_rows(files, "nations"), ["nation", "name", "region"]).drop("path", "row")


@own("WITH p AS (SELECT vec_id, vec_id % 50 = 7 AS broken, list_avg(list_transform(range(64), lambda i: CAST((vec_id * 31 + i * 7) % 256 AS DOUBLE))) AS m "
    "FROM embeddings) SELECT CASE WHEN broken THEN 'error' ELSE 'success' END AS status, count(*) AS n, round(avg(CASE WHEN NOT broken THEN m END), 6) AS mean, CASE WHEN broken THEN 'chunk IDAT is broken' END AS message "
    "FROM p GROUP BY ALL")
def image_scan(spark, d):
    """Image files decoded row by row, made here of numbers; a broken file is a row with its error."""
    ship(spark)

    def draw(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            data = [images.encode_png(((k * 31 + np.arange(64) * 7) % 256).reshape(8, 8)) for k in ids]
            data = [x[:50] + bytes([x[50] ^ 255]) + x[51:] if k % 50 == 7 else x for k, x in zip(ids, data, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f"{k}.png" for k in ids]), pa.array(data, pa.binary())], ["path", "content"])

    files = read(spark, d, "embeddings").select("vec_id").mapInArrow(draw, "path string, content binary")
    return images.measure(files).groupBy("status", "message").agg(F.count("*").alias("n"), r6(F.avg("mean"), "mean"))


@own("SELECT CASE WHEN n_nationkey % 5 = 1 THEN 'not json' WHEN n_nationkey % 5 = 2 THEN 'version' WHEN n_nationkey % 5 = 3 THEN 'missing: name' END AS problem, count(*) AS n, CAST(sum(CASE WHEN n_nationkey % 5 IN (0, 4) THEN n_nationkey END) AS BIGINT) AS keys "
    "FROM nation GROUP BY 1")
def json_documents(spark, d):
    """Documents read by a declared schema and version; what is wrong with the others is told row by row."""
    k = F.col("n_nationkey")
    good = F.to_json(F.struct(F.when(k % 5 == 2, 2).otherwise(1).alias("version"), k.alias("key"), F.when(k % 5 != 3, F.col("n_name")).alias("name")))
    rows = read(spark, d, "nation").select(F.when(k % 5 == 1, F.substring(good, 1, 9)).otherwise(good).alias("text"))
    v = documents.validated(rows, "text", "version int, key long, name string", 1, ("key", "name"))
    return v.groupBy("problem").agg(F.count("*").alias("n"), F.sum(F.when(F.col("problem").isNull(), F.col("document.key"))).alias("keys"))


@own("WITH m AS (SELECT n_nationkey AS k, n_name || '.png' AS member, n_name AS content FROM nation "
    "WHERE n_regionkey = 0 UNION ALL SELECT n_nationkey, 'inner.zip/deep/' || n_name || '.PNG', CASE WHEN n_nationkey % 2 = 0 THEN 'same' ELSE n_name END "
    "FROM nation WHERE n_regionkey = 1), a AS (SELECT member, 'img_' || substr(sha256(content), 1, 16) || '.png' AS name, false AS sealed "
    "FROM m UNION ALL SELECT 'labels.csv', 'img_' || substr(sha256('secret'), 1, 16) || '.csv', true) "
    "SELECT member, name, sealed, count(*) OVER (PARTITION BY name) AS copies FROM a")
def archive_release(spark, d):
    """Members of an archive in an archive, images named by their contents, labels sealed. The archive is made here of a table of fixed size."""
    n = read(spark, d, "nation").orderBy("n_nationkey").collect()  # 25 rows

    def packed(files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in files:
                z.writestr(name, data)
        return out.getvalue()

    inner = packed((f"deep/{r['n_name']}.PNG", "same" if r["n_nationkey"] % 2 == 0 else r["n_name"]) for r in n if r["n_regionkey"] == 1)
    outer = packed([*((f"{r['n_name']}.png", r["n_name"]) for r in n if r["n_regionkey"] == 0), ("inner.zip", inner), ("labels.csv", "secret")])
    a = archives.release(spark.createDataFrame([("a.zip", bytearray(outer))], "path string, content binary"), r"(?i)\.png$", "img_")
    return a.select("member", "name", "sealed", F.count("*").over(Window.partitionBy("name")).alias("copies"))


@own("SELECT t.name, n.seen, n.seen = 'again' AS reused FROM (SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) AS name) t, (VALUES ('first'), ('again')) n(seen)")
def listed_digests(spark, d):
    """Files of a folder with their digests; listed again, unchanged ones aren't read a second time. Contents are stood for by the path, as tables may be of any size."""
    files = tables.listing(spark, d, "*.parquet").withColumn("name", F.regexp_extract("path", r"/([^/]+)\.parquet(/[^/]+)?$", 1))
    listed = files.groupBy("name").agg(F.min("path").alias("path"), F.sum("length").alias("length"), F.max("modificationTime").alias("modificationTime"))
    contents = listed.select("path", F.col("path").cast("binary").alias("content"))
    none = listed.limit(0).withColumn("sha256", F.lit(None).cast("string"))
    first = tables.digests(listed.drop("name"), none, contents)
    again = tables.digests(listed.drop("name"), first, contents)
    both = first.withColumn("seen", F.lit("first")).unionByName(again.withColumn("seen", F.lit("again")))
    return both.join(listed.select("name", F.col("path").alias("p")), F.col("path") == F.col("p")).select("name", "seen", "reused")


@own("SELECT CAST(row_number() OVER (ORDER BY c_custkey) AS INT) AS place, c_custkey FROM (SELECT c_custkey "
    "FROM customer ORDER BY md5(concat_ws('|', 'sub', c_custkey)), c_custkey LIMIT 60)")
def ordered_subsample(spark, d):
    """A random sample of 60 rows that keeps the table's order."""
    c = read(spark, d, "customer").select("c_custkey").orderBy(S.hash_order("sub", F.col("c_custkey")), "c_custkey").limit(60)
    return c.select(F.row_number().over(Window.orderBy("c_custkey")).alias("place"), "c_custkey")  # 60 rows


@own("SELECT * FROM (VALUES ('fresh without limitations', 'limitations'), ('locked without lock', 'lock'), ('development with lock', 'lock'), ('unknown tier', 'tier, lock'), ('no statement', 'statement'), ('complete', ''), ('path /vault', 'reserved'), ('path /vault/labels.csv', 'reserved'), ('path /vaults', 'free')) t(item, problems)")
def report_contracts(spark, d):
    """What reports lack, and which paths are reserved."""
    whole = {"tier": "locked", "statement": "s", "limitations": ["l"], "lock_sha256": "x"}
    reports = {"fresh without limitations": whole | {"tier": "fresh", "limitations": []}, "locked without lock": whole | {"lock_sha256": None},
        "development with lock": whole | {"tier": "development"}, "unknown tier": whole | {"tier": "other"}, "no statement": whole | {"statement": ""}, "complete": whole}
    rows = [(n, ", ".join(G.report_problems(r))) for n, r in reports.items()]
    rows += [(f"path {p}", "reserved" if G.is_reserved(p, ["/vault/"]) else "free") for p in ("/vault", "/vault/labels.csv", "/vaults")]
    return spark.createDataFrame(rows, "item string, problems string")


@own("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def utc_timestamps(spark, d):
    """Times as ISO text."""
    return read(spark, d, "events").select("event_id", S.utc_iso(F.col("ts")).alias("at"))


@own(CASES + f", e AS (SELECT CAST({sql_draw('xb', 'image_id')} AS DOUBLE) / 20000 AS b, CAST({sql_draw('xc', 'image_id')} AS DOUBLE) / 20000 AS c, CAST({sql_draw('xs', 'image_id')} AS DOUBLE) / 10000 AS s "
    f"FROM ok) SELECT concat_ws('; ', CASE WHEN b > CAST(0.25 AS DOUBLE) THEN 'border' END, CASE WHEN c < CAST(0.1 AS DOUBLE) THEN 'off_field' END, CASE WHEN s > CAST(0.6 AS DOUBLE) THEN 'diffuse' END) AS flags, count(*) AS n "
    f"FROM e GROUP BY 1")
def explanation_flag_counts(spark, d):
    """Quality flags of heat maps from their precomputed shares."""
    i = F.col("image_id")
    e = evaluated(spark, d).select(S.explanation_flags(S.draw("xb", i) / 20000.0, S.draw("xc", i) / 20000.0, S.draw("xs", i) / 10000.0).alias("flags"))
    return e.groupBy("flags").agg(F.count("*").alias("n"))


@own("WITH r AS (SELECT 'region' AS name, CAST(CAST(concat('0x', substr(md5(to_json({'r_name': r_name, 'r_regionkey': r_regionkey})), 1, 12)) AS UBIGINT) AS HUGEINT) AS h, r_regionkey AS k "
    "FROM region UNION ALL SELECT 'nation', CAST(CAST(concat('0x', substr(md5(to_json({'n_name': n_name, 'n_nationkey': n_nationkey})), 1, 12)) AS UBIGINT) AS HUGEINT), n_nationkey "
    "FROM nation) SELECT name, sha256(concat_ws('|', count(*), CAST(sum(h) AS VARCHAR), min(k), max(k))) AS digest, true AS unchanged "
    "FROM r GROUP BY 1")
def baseline_freeze(spark, d):
    """Sources frozen by digest, whatever their order of rows, and found unchanged."""
    own_tables = {"region": (read(spark, d, "region").select("r_name", "r_regionkey"), "r_regionkey"), "nation": (read(spark, d, "nation").select("n_name", "n_nationkey"), "n_nationkey")}
    lock = G.freeze(own_tables, 0, 0)
    turned = {n: (df.orderBy(F.col(k).desc()), k) for n, (df, k) in own_tables.items()}
    broken = G.broken_bindings(lock, turned)
    return spark.createDataFrame([(n, h, n not in broken) for n, h in lock["bindings"].items()], "name string, digest string, unchanged boolean")


@own("SELECT n_nationkey AS place, n_name AS name, CAST(n_nationkey AS DOUBLE) / 2 AS first, CAST(n_regionkey AS DOUBLE) AS second FROM nation")
def array_scan(spark, d):
    """Rows of an array file beside the table they belong to, after their keys were compared. The file is made here of a table of fixed size."""
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("name"), "n_regionkey")
    own_rows = n.orderBy("place").collect()  # 25 rows
    out = io.BytesIO()
    np.savez(out, logits=np.array([[r["place"] / 2, r["n_regionkey"]] for r in own_rows], float), ids=np.array([r["place"] for r in own_rows]))
    files = spark.createDataFrame([("a.npz", bytearray(out.getvalue())), ("b.npy", bytearray(b"broken"))], "path string, content binary")
    rows = arrays.array_rows(files).filter("error IS NULL")
    keys = rows.filter("name = 'ids'").select("row", F.col("values")[0].cast("long").alias("place"))
    j = arrays.aligned(n.select("place", "name"), rows.filter("name = 'logits'").select("row", "values"), "place", "place", keys)
    return j.select("place", "name", F.col("values")[0].alias("first"), F.col("values")[1].alias("second"))


@own("WITH m AS (SELECT l_suppkey AS image, l_partkey % 64 AS place, bool_or(l_discount >= CAST(0.08 AS DOUBLE)) AS a, bool_or(l_tax >= CAST(0.07 AS DOUBLE)) AS b "
    "FROM lineitem GROUP BY 1, 2) SELECT image, count(*) FILTER (WHERE a OR b) AS either, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS only_a FROM m GROUP BY 1")
def mask_union(spark, d):
    """Masks as arrays of 64 flags, united and intersected place by place."""
    li = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("image"), (F.col("l_partkey") % 64).cast("int").alias("place"),
        (F.col("l_discount") >= 0.08).alias("a"), (F.col("l_tax") >= 0.07).alias("b"))

    def mask(c):
        return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.array_contains(F.col(c), i))

    m = li.groupBy("image").agg(F.collect_set(F.when(F.col("a"), F.col("place"))).alias("pa"), F.collect_set(F.when(F.col("b"), F.col("place"))).alias("pb"))
    m = m.select("image", mask("pa").alias("a"), mask("pb").alias("b"))
    count = lambda f: F.size(F.filter(F.zip_with("a", "b", f), lambda x: x)).cast("long")
    return m.select("image", count(lambda x, y: x | y).alias("either"), count(lambda x, y: x & y).alias("both"), count(lambda x, y: x & ~y).alias("only_a"))


_STUMP = ", x AS (SELECT unnest(['score', 'z5', 'iqs']) AS feature, unnest([score / 4, least(greatest((z5 + 4) / 10, 0), 1), iqs]) AS v, true_grade >= 2 AS y, CAST(" + sql_draw("bs", "group_id") + " AS DOUBLE) / 10000 < CAST(0.7 AS DOUBLE) AS fit FROM ok)"


@own(CASES + _STUMP + ", g AS (SELECT CAST(range AS DOUBLE) / 50 AS cut FROM range(1, 50)), c AS (SELECT feature, fit, cut, avg(CASE WHEN y THEN CAST(v >= cut AS DOUBLE) END) AS sens, avg(CASE WHEN NOT y THEN CAST(v < cut AS DOUBLE) END) AS spec, avg(CAST((v >= cut) = y AS DOUBLE)) AS acc "
    "FROM x, g GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(sens + spec, 9) DESC, cut) AS r FROM c WHERE fit), m AS (SELECT avg(CAST(NOT y AS DOUBLE)) AS acc FROM x WHERE NOT fit AND feature = 'iqs') "
    "SELECT b.feature, b.cut, round((b.sens + b.spec) / 2, 6) AS fitted, round((t.sens + t.spec) / 2, 6) AS held_out, round(t.acc, 6) AS accuracy FROM b JOIN c t ON t.feature = b.feature AND t.cut = b.cut AND NOT t.fit WHERE b.r = 1 "
    "UNION ALL SELECT 'none', NULL, 0.5, 0.5, round(acc, 6) FROM m")
def baseline_rules(spark, d):
    """Interpretable baselines on a fixed split of patients: the best single cut of each feature, and calling nobody."""
    fit = (S.draw("bs", F.col("group_id")) / 10000.0 < 0.7).alias("fit")
    each = {"score": F.col("score") / 4, "z5": F.least(F.greatest((F.col("z5") + 4) / 10, F.lit(0.0)), F.lit(1.0)), "iqs": F.col("iqs")}
    x = evaluated(spark, d).select((F.col("true_grade") >= 2).alias("y"), fit,
        F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), v.alias("v")) for n, v in each.items()])).alias("f")).select("y", "fit", "f.*")
    g = x.select("*", F.explode(F.array(*[F.lit(k / 50) for k in range(1, 50)])).alias("cut"))
    on = F.col("v") >= F.col("cut")
    c = g.groupBy("feature", "fit", "cut").agg(F.avg(F.when(F.col("y"), on.cast("double"))).alias("sens"),
        F.avg(F.when(~F.col("y"), (~on).cast("double"))).alias("spec"), F.avg((on == F.col("y")).cast("double")).alias("acc"))
    both = (F.col("sens") + F.col("spec")) / 2
    best = c.filter("fit").groupBy("feature").agg(F.max_by(F.struct("cut", both.alias("fitted")),
        F.struct(F.round(F.col("sens") + F.col("spec"), 9), -F.col("cut"))).alias("b")).select(F.col("feature").alias("f"), "b.*")
    t = c.filter("NOT fit").join(F.broadcast(best.withColumnRenamed("cut", "at")), (F.col("feature") == F.col("f")) & (F.col("cut") == F.col("at")))  # a row a feature
    none = x.filter("NOT fit AND feature = 'iqs'").agg(F.avg((~F.col("y")).cast("double")).alias("a")).select(F.lit("none").alias("feature"),
        F.lit(None).cast("double").alias("cut"), F.lit(0.5).alias("fitted"), F.lit(0.5).alias("held_out"), r6("a", "accuracy"))
    return t.select("feature", "cut", r6("fitted", "fitted"), r6(both, "held_out"), r6("acc", "accuracy")).unionByName(none)
