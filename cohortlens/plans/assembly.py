"""Queries on contracts, joins, duplicates, components, similarity and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import linking as L
from ..operators import sampling as P
from ..operators import similarity as V
from ..operators.contracts import contract, rules_of_grades
from ..operators.graph import components, shared_key_components
from .cohort import CASES, PROBS, THRESHOLDS, cases, evaluated, logits, read, sql_draw

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def manifest(spark, d):
    """Documents as images: (image_id, group_id, sha256, grade, source, split)."""
    i = F.col("doc_id")
    g, s = S.draw("g", i), S.draw("split", i)
    return read(spark, d, "documents").select(
        i.alias("image_id"), F.floor(S.draw("grp", i) * 600 / 10000.0).cast("long").alias("group_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"),
        F.floor(g / 2000.0).cast("int").alias("grade"), "source", F.when(s < 7000, "train").when(s < 8500, "validation").otherwise("test").alias("split"))


MAN = f"""WITH man AS (SELECT doc_id AS image_id, CAST(floor({sql_draw('grp', 'doc_id')} * 600 / 10000.0) AS BIGINT) AS group_id, sha256(coalesce(text, '')) AS sha256, CAST(floor({sql_draw('g', 'doc_id')} / 2000.0) AS INT) AS grade, source,
CASE WHEN {sql_draw('split', 'doc_id')} < 7000 THEN 'train' WHEN {sql_draw('split', 'doc_id')} < 8500 THEN 'validation' ELSE 'test' END AS split FROM documents)"""


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT 'id_duplicated' AS rule, CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS violations FROM v
UNION ALL SELECT 'quantity_range', count(*) FROM lineitem WHERE NOT (l_quantity BETWEEN 1 AND 50) UNION ALL SELECT 'discount_domain', count(*) FROM lineitem WHERE l_discount > CAST(0.05 AS DOUBLE) UNION ALL SELECT 'flag_vocabulary', count(*) FROM lineitem WHERE lower(trim(l_returnflag)) NOT IN ('a', 'n') UNION ALL SELECT 'id_missing', count(*) FROM lineitem WHERE l_orderkey IS NULL""")
def contract_violations(spark, d):
    li = read(spark, d, "lineitem")
    rules = {"quantity_range": ~F.col("l_quantity").between(1, 50), "discount_domain": F.col("l_discount") > 0.05,
        "flag_vocabulary": ~F.lower(F.trim("l_returnflag")).isin("a", "n"), "id_missing": F.col("l_orderkey").isNull()}
    dup = L.duplicate_keys(li, ["l_orderkey", "l_linenumber"]).agg(F.lit("id_duplicated").alias("rule"), F.count("*").alias("violations"))
    return contract(li, rules).unionByName(dup)


@query(CASES + PROBS + " SELECT 'grade' AS rule, count(*) FILTER (WHERE NOT (true_grade BETWEEN 0 AND 4)) AS violations "
    "FROM ok UNION ALL SELECT 'probabilities', (SELECT count(*) FROM probs WHERE abs(p0 + p1 + p2 + p3 + p4 - 1) > 1e-9) "
    "UNION ALL SELECT 'decoded', (SELECT count(*) FROM ok WHERE pred <> CAST(round(score) AS INT) AND score NOT IN (0.5, 1.5, 2.5, 3.5)) "
    "UNION ALL SELECT 'calibrated', (SELECT count(*) FROM probs WHERE round(p1 + 2 * p2 + 3 * p3 + 4 * p4, 4) = score)")
def derived_column_audit(spark, d):
    """Stored values against what they are derived from, and probability vectors against their contract."""
    p = S.grade_probabilities(logits())
    df = evaluated(spark, d).withColumn("p", p)
    rules = rules_of_grades("true_grade", "p", 1e-9) | {"decoded": (F.col("pred") != F.round("score").cast("int")) & ~F.col("score").isin(*THRESHOLDS), "calibrated": F.round(S.expected_grade(F.col("p")), 4) == F.col("score")}
    return contract(df, rules)


@query("""WITH x AS (SELECT event_id, CASE event_type WHEN 'click' THEN '1.0' WHEN 'view' THEN ' TRUE' WHEN 'purchase' THEN '0' ELSE event_type END AS raw FROM events),
y AS (SELECT CASE WHEN lower(trim(raw)) IN ('1', '1.0', 'true') THEN TRUE WHEN lower(trim(raw)) IN ('0', '0.0', 'false') THEN FALSE END AS flag, raw FROM x) SELECT flag, count(*) AS n, count(*) FILTER (WHERE flag IS NULL AND raw IS NOT NULL) AS unknown FROM y GROUP BY 1""")
def boolean_decoding(spark, d):
    from ..operators.contracts import boolean

    raw = F.when(F.col("event_type") == "click", "1.0").when(F.col("event_type") == "view", " TRUE").when(F.col("event_type") == "purchase", "0").otherwise(F.col("event_type"))
    x = read(spark, d, "events").select(raw.alias("raw")).withColumn("flag", boolean(F.col("raw")))
    return x.groupBy("flag").agg(F.count("*").alias("n"), F.count_if(F.col("flag").isNull() & F.col("raw").isNotNull()).alias("unknown"))


@query("SELECT count(*) AS rows, count(l.doc_id) AS matched, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def label_join_coverage(spark, d):
    return L.coverage(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id")


@query("WITH a AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS k "
    "FROM orders WHERE o_orderkey % 5 <> 0) SELECT CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS side, count(*) AS n "
    "FROM a FULL JOIN b ON a.k = b.k GROUP BY 1")
def reconcile_full_outer(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return L.reconcile(o.filter("k % 3 <> 0"), o.filter("k % 5 <> 0"), "k")


@query(CASES + " SELECT (SELECT count(*) FROM cases WHERE image_id IN (SELECT image_id FROM ok)) AS semi, (SELECT count(*) "
    "FROM cases WHERE image_id NOT IN (SELECT image_id FROM ok)) AS anti, (SELECT count(DISTINCT group_id) "
    "FROM cases a WHERE source = 'ASIA' AND group_id IN (SELECT group_id FROM cases WHERE source <> 'ASIA')) AS shared_patients")
def semi_anti_guard(spark, d):
    c = cases(spark, d)
    ok = c.filter("status = 'success'").select("image_id")
    asia, rest = (c.filter(x).select("group_id").distinct() for x in ("source = 'ASIA'", "source <> 'ASIA'"))
    one = lambda df, n: df.agg(F.count("*").alias(n))
    return one(c.join(ok, "image_id", "left_semi"), "semi").crossJoin(one(c.join(ok, "image_id", "left_anti"),
        "anti")).crossJoin(one(asia.join(rest, "group_id", "left_semi"), "shared_patients"))  # three single rows


@query(CASES + ", e AS (SELECT image_id, CASE WHEN image_id % 97 = 0 THEN true_grade + 1 ELSE true_grade END AS g "
    "FROM cases WHERE image_id % 101 <> 0) SELECT count(*) FILTER (WHERE o.image_id IS NULL) AS missing, count(*) FILTER (WHERE e.image_id IS NULL) AS unexpected, count(*) FILTER (WHERE o.true_grade <> e.g) AS relabelled "
    "FROM ok o FULL JOIN e ON o.image_id = e.image_id")
def exact_cover(spark, d):
    e = cases(spark, d).filter("image_id % 101 <> 0").select("image_id", F.when(F.col("image_id") % 97 == 0, F.col("true_grade") + 1).otherwise(F.col("true_grade")).alias("true_grade"))
    return L.exact_cover(evaluated(spark, d), e, "image_id", "true_grade")


@query("SELECT s_suppkey, min_by(path, rank) AS path FROM (SELECT s_suppkey, 1 AS rank, 'png/' || s_name AS path "
    "FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT s_suppkey, 2, 'jpg/' || s_name FROM supplier "
    "WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 3, 'tif/' || s_name FROM supplier) "
    "GROUP BY 1")
def priority_lookup(spark, d):
    s = read(spark, d, "supplier")
    some = lambda rank, folder, rule: s.filter(rule).select("s_suppkey", F.lit(rank).alias("rank"), F.concat(F.lit(f"{folder}/"), "s_name").alias("path"))
    found = some(1, "png", "s_suppkey % 4 = 0").unionByName(some(2, "jpg", "s_suppkey % 2 = 0")).unionByName(some(3, "tif", "true"))
    return L.first_existing(found, "s_suppkey", F.col("rank"), "path")


@query("SELECT eye, count(*) AS n, count(value) AS present, round(sum(value), 2) AS total FROM (SELECT c_custkey, 'left' AS eye, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS value "
    "FROM customer UNION ALL SELECT c_custkey, 'right', CASE WHEN c_acctbal <= 0 THEN c_acctbal END "
    "FROM customer) GROUP BY 1")
def unpivot_eyes(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("left"), F.when(F.col("c_acctbal") <= 0, F.col("c_acctbal")).alias("right"))
    return c.unpivot(["c_custkey"], ["left", "right"], "eye", "value").groupBy("eye").agg(F.count("*").alias("n"), F.count("value").alias("present"),
        F.round(F.sum("value"), 2).alias("total"))


@query(CASES + ", b AS (SELECT image_id, score AS s0, pred AS g0 FROM ok), v AS (SELECT image_id, 'dim' AS condition, greatest(score - CAST(0.25 AS DOUBLE), 0) AS s "
    "FROM ok UNION ALL SELECT image_id, 'blur', (score + second) / 2 FROM ok), j AS (SELECT condition, s - s0 AS change, (s >= 1.5) <> (s0 >= 1.5) AS flip "
    "FROM v JOIN b USING (image_id)) SELECT condition, count(*) AS n, round(median(change), 6) AS median_change, round(avg(CAST(change < 0 AS DOUBLE)), 6) AS decreased, count(*) FILTER (WHERE flip) AS flips, round(quantile_cont(abs(change), 0.95), 6) AS p95 "
    "FROM j GROUP BY 1")
def paired_condition_change(spark, d):
    """Each variant against its own image's baseline."""
    ok = evaluated(spark, d)
    both = F.array(F.struct(F.lit("dim").alias("condition"), F.greatest(F.col("score") - 0.25, F.lit(0.0)).alias("s")),
        F.struct(F.lit("blur").alias("condition"), ((F.col("score") + F.col("second")) / 2).alias("s")))
    v = ok.select("image_id", F.explode(both).alias("v")).select("image_id", "v.*")
    j = v.join(ok.select("image_id", F.col("score").alias("s0")), "image_id").withColumn("change", F.col("s") - F.col("s0"))
    flip = (F.col("s") >= 1.5) != (F.col("s0") >= 1.5)
    return j.groupBy("condition").agg(F.count("*").alias("n"), F.round(F.median("change"), 6).alias("median_change"),
        F.round(F.avg((F.col("change") < 0).cast("double")), 6).alias("decreased"), F.count_if(flip).alias("flips"),
        F.round(F.percentile(F.abs("change"), F.lit(0.95)), 6).alias("p95"))


@query(MAN + ", h AS (SELECT sha256, count(*) AS n, count(DISTINCT split) AS splits, count(DISTINCT grade) AS grades "
    "FROM man GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS hashes, CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (WHERE splits > 1) AS across_splits, count(*) FILTER (WHERE grades > 1) AS conflicting "
    "FROM h")
def duplicate_hash_join(spark, d):
    h = manifest(spark, d).groupBy("sha256").agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits"), F.count_distinct("grade").alias("grades")).filter("n > 1")
    return h.agg(F.count("*").alias("hashes"), F.sum("n").alias("rows"), F.count_if(F.col("splits") > 1).alias("across_splits"), F.count_if(F.col("grades") > 1).alias("conflicting"))


@query(MAN + """, c AS (SELECT *, min(grade) OVER w <> max(grade) OVER w AS conflict FROM man WINDOW w AS (PARTITION BY sha256)), k AS (SELECT *, max(CAST(split = 'validation' AND NOT conflict AS INT)) OVER (PARTITION BY sha256) = 1 AS held FROM c)
SELECT CASE WHEN conflict THEN 'conflict' WHEN split = 'train' AND held THEN 'leak' ELSE 'kept' END AS status, split, count(*) AS n FROM k GROUP BY 1, 2""")
def conflict_exclusions(spark, d):
    return L.exclude_conflicts(manifest(spark, d), "sha256", "grade").groupBy("status", "split").agg(F.count("*").alias("n"))


@query(MAN + " SELECT (SELECT count(*) FROM (SELECT group_id FROM man GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS groups_in_splits, (SELECT count(*) "
    "FROM (SELECT group_id FROM man GROUP BY 1 HAVING count(DISTINCT source) > 1)) AS groups_in_sources")
def cross_split_leakage(spark, d):
    m = manifest(spark, d)
    one = lambda v, n: L.crossing(m, "group_id", v).agg(F.count("*").alias(n))
    return one("split", "groups_in_splits").crossJoin(one("source", "groups_in_sources"))  # two single rows


@query(MAN + """, e AS (SELECT a.m AS a, b.image_id AS b FROM (SELECT 'g' || group_id AS k, min(image_id) AS m FROM man GROUP BY 1 UNION ALL SELECT sha256, min(image_id) FROM man GROUP BY 1) a JOIN (SELECT 'g' || group_id AS k, image_id FROM man UNION ALL SELECT sha256, image_id FROM man) b USING (k)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), """ + ", ".join(f"l{i} AS MATERIALIZED (SELECT u.a AS a, least(min(x.c), min(self.c)) AS c FROM u JOIN {'n0' if i == 1 else f'l{i-1}'} x ON u.b = x.a JOIN {'n0' if i == 1 else f'l{i-1}'} self ON self.a = u.a GROUP BY 1)" for i in range(1, 25)).replace("l1 AS", "n0 AS (SELECT image_id AS a, image_id AS c FROM man), l1 AS", 1) + " SELECT a AS image_id, c AS component FROM l24")
def clusters_components(spark, d):
    """Rows that share a patient or a content hash, transitively."""
    out = shared_key_components(manifest(spark, d).withColumn("g", F.concat(F.lit("g"), F.col("group_id").cast("string"))), "image_id", ["g", "sha256"])
    return out.select(F.col("node").alias("image_id"), "component")


def _hashes(spark, d):
    bits = F.expr("aggregate(transform(slice(embedding, 1, 64), (v, i) -> if(v > 0, shiftleft(1L, i), 0L)), 0L, (a, x) -> a | x)")
    left = read(spark, d, "embeddings").select(F.col("vec_id").alias("a"), bits.alias("x"))
    n = S.draw("flips", F.col("a")) % 10
    flips = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.when(k < n, F.call_function("shiftleft", F.lit(1).cast("long"),
        (S.draw("bit", F.col("a"), k) % 64).cast("int"))).otherwise(F.lit(0).cast("long")))
    right = left.select((F.col("a") + 1000000).alias("b"), F.aggregate(flips, F.col("x"), lambda acc, f: acc.bitwiseXOR(f)).alias("y"))
    return left, right


_HASH = f"""WITH l AS (SELECT vec_id AS a, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CASE WHEN i = 63 THEN CAST(-9223372036854775808 AS BIGINT) ELSE (CAST(1 AS BIGINT) << i) END ELSE CAST(0 AS BIGINT) END)), lambda p, q: p | q) AS x FROM embeddings),
f AS (SELECT a, k.range AS k, {sql_draw('flips', 'a')} % 10 AS n, {sql_draw('bit', "concat_ws('|', a, k.range)")} % 64 AS bit, x FROM l, range(10) k),
r AS (SELECT a + 1000000 AS b, list_reduce(list_prepend(any_value(x), list(CASE WHEN k < n THEN CASE WHEN bit = 63 THEN CAST(-9223372036854775808 AS BIGINT) ELSE (CAST(1 AS BIGINT) << bit) END ELSE CAST(0 AS BIGINT) END)), lambda p, q: xor(p, q)) AS y FROM f GROUP BY a),
p AS (SELECT a, b, CAST(bit_count(xor(x, y)) AS INT) AS distance FROM l, r WHERE bit_count(xor(x, y)) <= 7)"""


@query(_HASH + " SELECT a, b, distance FROM p")
def hamming_pairs(spark, d):
    return V.hamming_join(*_hashes(spark, d), 7)


@query(_HASH + " SELECT distance, count(*) AS n FROM p GROUP BY 1")
def hamming_counts(spark, d):
    return V.hamming_join(*_hashes(spark, d), 7).groupBy("distance").agg(F.count("*").alias("n"))


@query(_HASH + " SELECT a, b, distance FROM p ORDER BY distance, a, b LIMIT 20")
def hamming_closest(spark, d):
    """A report of the 20 closest pairs; the counts are in hamming_counts."""
    return V.closest(V.hamming_join(*_hashes(spark, d), 7), 20)


def _unit(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    norm = S.let(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), F.sqrt)
    return e.select("id", "label", S.let(norm, lambda n: F.transform("v", lambda x: x / n)).alias("v"))


_UNIT = "WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS w FROM embeddings), u AS (SELECT id, label, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS v FROM e)"
_TOP = _UNIT + ", s AS (SELECT q.id AS query, r.id AS ref, round(list_dot_product(q.v, r.v), 6) AS similarity FROM u q JOIN u r ON q.id <> r.id WHERE q.id % 50 = 0), t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, ref) AS rank FROM s)"


@query(_TOP + " SELECT query, ref, similarity, CAST(rank AS INT) AS rank FROM t WHERE rank <= 5")
def topk_similarity(spark, d):
    u = _unit(spark, d)
    return V.top_k(u.filter("id % 50 = 0"), u, 5).select("query", "ref", "similarity", "rank")


@query(_TOP + " SELECT query, ref, similarity FROM t WHERE rank = 1")
def nearest_reference(spark, d):
    u = _unit(spark, d)
    return V.top_k(u.filter("id % 50 = 0"), u, 1).select("query", "ref", "similarity")


@query(_UNIT + ", p AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id < b.id WHERE round(list_dot_product(a.v, b.v), 6) >= CAST(0.4 AS DOUBLE)), "
    "n AS (SELECT a, b FROM p UNION SELECT b, a FROM p), l0 AS (SELECT DISTINCT a, a AS c FROM n), " + ", ".join(f"l{i} AS MATERIALIZED (SELECT n.a AS a, least(min(x.c), min(y.c)) AS c "
    f"FROM n JOIN l{i-1} x ON n.b = x.a JOIN l{i-1} y ON y.a = n.a GROUP BY 1)" for i in range(1, 25)) + " SELECT a AS node, c AS component "
    "FROM l24")
def correlation_components(spark, d):
    return components(V.similar_pairs(_unit(spark, d), 0.4))


_NEAR = "WITH c AS (SELECT event_id AS cand, CAST(value * 10 AS DOUBLE) AS cx, CAST(event_id % 1000 AS DOUBLE) AS cy FROM events), t AS (SELECT o_orderkey AS comp, round(o_totalprice / 100, 4) AS tx, CAST(o_orderkey % 1000 AS DOUBLE) AS ty FROM orders)"


@query(_NEAR + ", j AS (SELECT DISTINCT cand, comp FROM c JOIN t ON abs(cx - tx) <= 3 AND abs(cy - ty) <= 3 AND (cx - tx) * (cx - tx) + (cy - ty) * (cy - ty) <= 9) "
    "SELECT count(*) AS pairs, count(DISTINCT cand) AS candidates, count(DISTINCT comp) AS components "
    "FROM j")
def radius_join(spark, d):
    """Points within 3 of a component, by an equi-join on grid cells of that size and their neighbours."""
    c = read(spark, d, "events").select(F.col("event_id").alias("cand"), (F.col("value") * 10).alias("cx"), (F.col("event_id") % 1000).cast("double").alias("cy"))
    t = read(spark, d, "orders").select(F.col("o_orderkey").alias("comp"), F.round(F.col("o_totalprice") / 100, 4).alias("tx"), (F.col("o_orderkey") % 1000).cast("double").alias("ty"))
    cell = lambda v: F.floor(v / 3.0)
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    t = t.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).withColumns({"gx": cell(F.col("tx")) + F.col("dx"), "gy": cell(F.col("ty")) + F.col("dy")})
    c = c.withColumns({"gx": cell(F.col("cx")), "gy": cell(F.col("cy"))})
    near = (F.col("cx") - F.col("tx")) * (F.col("cx") - F.col("tx")) + (F.col("cy") - F.col("ty")) * (F.col("cy") - F.col("ty")) <= 9
    return c.join(t, ["gx", "gy"]).filter(near).agg(F.count("*").alias("pairs"), F.count_distinct("cand").alias("candidates"), F.count_distinct("comp").alias("components"))


@query(r"""WITH p AS (SELECT p_partkey, p_type, list_transform(string_split_regex(lower(p_type), '[ ,;]+'), lambda x: CASE WHEN x LIKE '%promo%' OR x LIKE '%economy%' THEN 4 WHEN starts_with(x, 'standard') THEN 3 WHEN starts_with(x, 'small') THEN 1 WHEN regexp_matches(x, '^med') THEN 2 ELSE 0 END) AS g FROM part)
SELECT list_max(g) AS grade, count(*) AS n, min(regexp_replace(p_type, '^[A-Za-z]+ ', '')) AS sample FROM p GROUP BY 1""")
def label_text_parse(spark, d):
    """Free text to a grade: split at delimiters, first rule that fits each part, worst part."""
    rule = lambda x: F.when(x.contains("promo") | x.contains("economy"), 4).when(x.startswith("standard"), 3).when(x.startswith("small"),
        1).when(x.rlike("^med"), 2).otherwise(0)
    grade = F.array_max(F.transform(F.split(F.lower("p_type"), "[ ,;]+"), rule))
    return read(spark, d, "part").groupBy(grade.alias("grade")).agg(F.count("*").alias("n"), F.min(F.regexp_replace("p_type", "^[A-Za-z]+ ", "")).alias("sample"))


@query(r"""SELECT regexp_extract(url, '^https?://(?:www\.|m\.)?([^/:?#]+)', 1) AS host, count(*) AS n, count(*) FILTER (WHERE regexp_extract(url, '/(\d+)(?:[?#]|$)', 1) <> '') AS with_id, min(regexp_extract(url, '^[a-z]+')) AS scheme, count(*) FILTER (WHERE starts_with(url, 'https')) AS secure, min(split_part(url, '/', 3)) AS netloc FROM pages GROUP BY 1""")
def url_key_parse(spark, d):
    u = F.col("url")
    return read(spark, d, "pages").groupBy(F.regexp_extract(u, r"^https?://(?:www\.|m\.)?([^/:?#]+)", 1).alias("host")).agg(F.count("*").alias("n"),
        F.count_if(F.regexp_extract(u, r"/(\d+)(?:[?#]|$)", 1) != "").alias("with_id"), F.min(F.regexp_extract(u, "^[a-z]+", 0)).alias("scheme"),
        F.count_if(u.startswith("https")).alias("secure"), F.min(F.split_part(u, F.lit("/"), F.lit(3))).alias("netloc"))


@query("SELECT p_brand, CAST(try_cast(regexp_extract(p_brand, '([0-4])[0-9]*$', 1) AS INT) AS INT) AS grade, count(*) AS n, min(concat('ext_', p_partkey)) AS first_id, sha256(min(p_name)) AS digest "
    "FROM part GROUP BY 1, 2")
def graded_text(spark, d):
    """A leading digit 0 to 4 behind a prefix, ids with a prefix, digests."""
    g = F.regexp_extract("p_brand", "([0-4])[0-9]*$", 1).try_cast("int")
    return read(spark, d, "part").groupBy("p_brand", g.alias("grade")).agg(F.count("*").alias("n"),
        F.min(F.concat(F.lit("ext_"), F.col("p_partkey").cast("string"))).alias("first_id"), F.sha2(F.min("p_name"), 256).alias("digest"))


def _order(seed, key):
    return f"md5(concat_ws('|', '{seed}', {key})), {key}"


@query(CASES + f" SELECT true_grade, image_id FROM (SELECT true_grade, image_id, row_number() OVER (PARTITION BY true_grade ORDER BY {_order('s1', 'image_id')}) AS r "
    f"FROM ok) WHERE r <= 25")
def balanced_sample(spark, d):
    """25 cases of each grade."""
    return P.per_group(evaluated(spark, d), ["true_grade"], "image_id", 25, "s1").select("true_grade", "image_id")


@query(CASES + f" SELECT CAST((r - 1) % 5 AS INT) AS fold, true_grade, count(*) AS n, CAST(sum(image_id) AS BIGINT) AS ids "
    f"FROM (SELECT true_grade, image_id, row_number() OVER (PARTITION BY true_grade ORDER BY {_order('f', 'image_id')}) AS r "
    f"FROM ok) GROUP BY ALL")
def stratified_folds(spark, d):
    return P.stratified_folds(evaluated(spark, d), "true_grade", "image_id", 5, "f").groupBy("fold", "true_grade").agg(F.count("*").alias("n"), F.sum("image_id").alias("ids"))


@query(CASES + f" SELECT source, group_id, CAST((row_number() OVER (PARTITION BY source ORDER BY {_order('cf', 'group_id')}) - 1) % 5 AS INT) AS fold "
    f"FROM (SELECT DISTINCT source, group_id FROM ok)")
def cluster_folds(spark, d):
    return P.cluster_folds(evaluated(spark, d), "group_id", "source", 5, "cf")


@query(MAN + ", g AS (SELECT DISTINCT source, group_id FROM man), r AS (SELECT *, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', concat_ws('|', 'cv', '0'), group_id)), group_id) AS r "
    "FROM g) SELECT source, group_id, r <= greatest(1, CAST(round_even(n * CAST(0.1 AS DOUBLE), 0) AS BIGINT)) AS held_out "
    "FROM r")
def carve_holdout(spark, d):
    """One seed for all sources here, as DuckDB has no crc32; carve() joins the source's."""
    m = manifest(spark, d).select("source", "group_id").distinct()
    return P.held_out(m, "group_id", "source", 0.1, S.hash_order(F.lit("cv|0"), F.col("group_id")))


@query(CASES + f", g AS (SELECT source, group_id, count(*) AS size FROM ok GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY {_order('gp', 'group_id')} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before "
    f"FROM g) SELECT source, group_id, size FROM b WHERE before < 200")
def greedy_prefix(spark, d):
    return P.greedy_prefix(evaluated(spark, d), "group_id", "source", 200, "gp")


@query(CASES + f", g AS (SELECT group_id, count(*) AS size FROM ok GROUP BY 1), t AS (SELECT *, row_number() OVER (ORDER BY size DESC, group_id) = 1 AS big, sum(size) OVER () AS total "
    f"FROM g), b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY big ORDER BY {_order('ps', 'group_id')} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before "
    f"FROM t) SELECT group_id, size, CASE WHEN NOT big AND before < total * CAST(0.2 AS DOUBLE) THEN 'valid' ELSE 'train' END AS part "
    f"FROM b")
def pinned_cluster_split(spark, d):
    return P.pinned_split(evaluated(spark, d), "group_id", 0.2, "ps")


@query(CASES + f" SELECT source, true_grade >= 2 AS referable, count(*) AS n, CAST(sum(image_id) AS BIGINT) AS ids "
    f"FROM (SELECT *, row_number() OVER (PARTITION BY source, true_grade >= 2 ORDER BY {_order('en', 'image_id')}) AS r "
    f"FROM ok) WHERE r <= CASE WHEN true_grade >= 2 THEN 50 ELSE 200 END GROUP BY 1, 2")
def enriched_draw(spark, d):
    out = P.enriched(evaluated(spark, d), ["source"], F.col("true_grade") >= 2, "image_id", 50, 200, "en")
    return out.groupBy("source", (F.col("true_grade") >= 2).alias("referable")).agg(F.count("*").alias("n"), F.sum("image_id").alias("ids"))


@query(CASES + ", g AS (SELECT source, true_grade, count(*) AS n FROM ok GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY source) AS size, count(*) OVER (PARTITION BY source) AS k "
    "FROM g), m AS (SELECT *, sqrt(size) / k AS mass FROM s) SELECT source, true_grade, n, round(mass / sum(mass) OVER () / n * 1000000, 6) AS weight "
    "FROM m")
def sampling_weights(spark, d):
    return P.sampling_weights(evaluated(spark, d), "source", "true_grade").select("source", "true_grade", "n", F.round(F.col("weight") * 1000000, 6).alias("weight"))


@query(CASES + ", z AS (SELECT source, true_grade, (score - avg(score) OVER w) / stddev_pop(score) OVER w AS z "
    "FROM ok WINDOW w AS (PARTITION BY source)) SELECT source, true_grade, round(avg(z), 6) AS mean_z, round(min(z), 6) AS low, round(max(z), 6) AS high "
    "FROM z GROUP BY 1, 2")
def within_site_zscore(spark, d):
    return P.standardised(evaluated(spark, d), "source", "score", "z").groupBy("source", "true_grade").agg(F.round(F.avg("z"), 6).alias("mean_z"),
        F.round(F.min("z"), 6).alias("low"), F.round(F.max("z"), 6).alias("high"))


@query("SELECT conv_id, turn, role, r FROM (SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS INT) AS r "
    "FROM conversations) WHERE r <= 2")
def first_rows_per_group(spark, d):
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role"))
    return read(spark, d, "conversations").withColumn("r", r).filter("r <= 2").select("conv_id", "turn", "role", "r")


@query("WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_orderkey AS k "
    "FROM lineitem WHERE l_linestatus = 'O') SELECT (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k "
    "FROM b)) AS both, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS only_a, (SELECT count(*) "
    "FROM (SELECT k FROM a UNION SELECT k FROM b)) AS either, (SELECT count(*) FROM (SELECT k "
    "FROM a EXCEPT SELECT k FROM b)) = 0 AS subset")
def set_operations(spark, d):
    li = read(spark, d, "lineitem")
    a, b = (li.filter(x).select(F.col("l_orderkey").alias("k")).distinct() for x in ("l_returnflag = 'A'", "l_linestatus = 'O'"))
    one = lambda df, n: df.agg(F.count("*").alias(n))
    out = one(a.intersect(b), "both").crossJoin(one(a.exceptAll(b), "only_a")).crossJoin(one(a.union(b).distinct(), "either"))  # single rows
    return out.withColumn("subset", F.col("only_a") == 0)


@query(MAN + ", q AS (SELECT DISTINCT group_id FROM man WHERE sha256 IN (SELECT sha256 FROM man "
    "GROUP BY 1 HAVING count(DISTINCT grade) > 1)) SELECT split, count(*) AS n, count(*) FILTER (WHERE q.group_id IS NOT NULL) AS quarantined "
    "FROM man LEFT JOIN q ON man.group_id = q.group_id GROUP BY 1")
def quarantine(spark, d):
    """Whole groups that hold a conflicting hash."""
    m = manifest(spark, d)
    bad = m.join(L.crossing(m, "sha256", "grade"), "sha256", "left_semi").select("group_id").distinct().withColumn("q", F.lit(1))
    return m.join(bad, "group_id", "left").groupBy("split").agg(F.count("*").alias("n"), F.count("q").alias("quarantined"))


@query("WITH g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 5 THEN 5 ELSE o_orderkey % 5 END AS g "
    "FROM orders), o AS (SELECT c_custkey AS k, c_custkey % 4 AS g5 FROM customer) SELECT CASE WHEN g = 5 THEN g5 ELSE g END AS grade, count(*) AS n "
    "FROM g LEFT JOIN o ON o_orderkey = k GROUP BY 1")
def override_lookup(spark, d):
    """Rows of category 5 take their grade from a second table."""
    g = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 5, F.lit(5)).otherwise(F.col("o_orderkey") % 5).alias("g"))
    o = read(spark, d, "customer").select(F.col("c_custkey").alias("o_orderkey"), (F.col("c_custkey") % 4).alias("g5"))
    return g.join(o, "o_orderkey", "left").groupBy(F.when(F.col("g") == 5, F.col("g5")).otherwise(F.col("g")).alias("grade")).agg(F.count("*").alias("n"))
