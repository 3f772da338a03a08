"""Queries of calibration, near copies, linked splits and the log of requests, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import calibration, governance, intervals, perceptual, status
from evidentia.plans.registry import query, table
from evidentia.streaming import responses

#: Isotonic regression by its min-max formula: no pooling. The rate at a score is the greatest, over the
#: starts at or before it, of the least mean, over the ends at or after it.
_FIT = """WITH c AS (SELECT lang, n_chars AS s, count(*) AS n, sum(quality) AS p FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
x AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(p) OVER w AS cp FROM c WINDOW w AS (PARTITION BY lang ORDER BY s)),
m AS (SELECT a.lang, a.i AS i, b.i AS j, (b.cp - a.cp + a.p) / (b.cn - a.cn + a.n) AS mean FROM x a JOIN x b ON a.lang = b.lang AND a.i <= b.i),
g AS (SELECT lang, i, j, min(mean) OVER (PARTITION BY lang, i ORDER BY j DESC ROWS UNBOUNDED PRECEDING) AS least FROM m),
f AS (SELECT lang, j AS i, max(least) AS rate FROM g GROUP BY ALL)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents: their length as a score, their quality as the truth."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return documents.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query(f"{_FIT} SELECT lang, min(s) AS low, max(s) AS high, sum(n)::BIGINT AS n, sum(p)::BIGINT AS positives, round(rate, 9) AS calibrated FROM x JOIN f USING (lang, i) GROUP BY lang, rate")
def score_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = calibration.isotonic_blocks(_scored(spark, sf_dir), "n_chars", "quality", ["lang"])
    return blocks.select("lang", "low", "high", "n", "positives", F.round("calibrated", 9).alias("calibrated"))


@query(f"""{_FIT}, b AS (SELECT lang, s AS low, rate FROM x JOIN f USING (lang, i)),
r AS (SELECT doc_id, d.lang, coalesce((SELECT max(rate) FROM b WHERE b.lang = d.lang AND b.low <= d.n_chars), (SELECT min(rate) FROM b WHERE b.lang = d.lang)) AS rate FROM documents d)
SELECT doc_id, round(rate, 9) AS confidence, CASE WHEN rate IS NULL THEN 'unavailable' WHEN rate >= 0.95 THEN 'suspicious' WHEN rate > 0.6 THEN 'inconclusive' ELSE 'completed' END AS status FROM r""")
def calibrated_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, labelled or not: a confidence is shown for calibrated scores alone, and decides."""
    blocks = calibration.isotonic_blocks(_scored(spark, sf_dir), "n_chars", "quality", ["lang"])
    rows = calibration.calibrated(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), blocks, "n_chars", ["lang"])
    shown = status.supported_confidence(F.col("calibrated"), F.col("calibrated").isNotNull())
    return rows.select("doc_id", F.round(shown, 9).alias("confidence"), calibration.decided(F.col("calibrated"), 0.6, 0.95).alias("status"))


@query(f"{_FIT} SELECT lang, max(s) FILTER (rate <= 0.6) AS clear_to, min(s) FILTER (rate >= 0.95) AS suspicious_from FROM x JOIN f USING (lang, i) GROUP BY lang")
def abstention_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.band(calibration.isotonic_blocks(_scored(spark, sf_dir), "n_chars", "quality", ["lang"]), ["lang"], 0.6, 0.95)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as tiles; every third also a little changed, every sixth once more as it is."""
    tiles = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("tile"))
    noise = lambda i: (F.pmod(F.col("vec_id") * 31 + i * 17, F.lit(7)) - 3) * (F.col("vec_id") % 5) * 0.001
    changed = tiles.filter("vec_id % 3 = 0").withColumn("tile", F.transform("tile", lambda x, i: x + noise(i))).withColumn("vec_id", F.col("vec_id") + 1_000_000_000)
    again = tiles.filter("vec_id % 6 = 0").select((F.col("vec_id") + 2_000_000_000).alias("vec_id"), "tile")
    return tiles.unionByName(changed).unionByName(again)


def _coefficient(u: int, v: int) -> str:
    scale = lambda k: "sqrt(0.125)" if k == 0 else "0.5"
    return f"list_dot_product(tile, [cos((2 * (i // 8) + 1) * {u} * pi() / 16) * cos((2 * (i % 8) + 1) * {v} * pi() / 16) * {scale(u)} * {scale(v)} for i in range(64)])"


_CODE = " || ".join(f"CASE WHEN {_coefficient(u, v)} > 0 THEN '1' ELSE '0' END" for u in range(8) for v in range(8))


@query(f"""WITH RECURSIVE t AS (SELECT vec_id, embedding::DOUBLE[] AS tile FROM embeddings),
c AS (SELECT * FROM t UNION ALL SELECT vec_id + 1000000000, [tile[i + 1] + ((vec_id * 31 + i * 17) % 7 - 3) * (vec_id % 5) * 0.001 for i in range(64)] FROM t WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id + 2000000000, tile FROM t WHERE vec_id % 6 = 0),
b AS (SELECT vec_id, ({_CODE})::BIT AS code FROM c),
own AS (SELECT code, min(vec_id) AS first, count(*) AS n_copies FROM b GROUP BY code),
l AS (SELECT x.first AS a, y.first AS b FROM own x JOIN own y ON x.code <> y.code AND bit_count(xor(x.code, y.code)) <= 3),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
g AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, code::VARCHAR AS code, coalesce(class_id, first) AS class_id, n_copies, coalesce(n_links, 0) AS n_links FROM b JOIN own USING (code) LEFT JOIN g ON g.a = first LEFT JOIN n ON n.a = first""")
def near_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = perceptual.near_copies(captures(spark, sf_dir), "vec_id", "tile", 3)
    return found.select("vec_id", F.lpad(F.bin("code"), 64, "0").alias("code"), "class_id", "n_copies", "n_links")


_SPLIT = """WITH RECURSIVE c AS (SELECT c_custkey AS k, [x FOR x IN [CASE WHEN c_custkey % 5 <> 0 THEN '0:' || (c_custkey // 3)::VARCHAR END, CASE WHEN c_custkey % 4 <> 0 THEN '1:' || ((c_custkey + 1) // 3)::VARCHAR END, CASE WHEN c_custkey % 10 <> 0 THEN '2:' || round(c_acctbal * 100)::BIGINT::VARCHAR END] IF x IS NOT NULL] AS v FROM customer),
l AS (SELECT DISTINCT a, b FROM (SELECT unnest(v) AS a, v FROM c), unnest(v) t(b)),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
root AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
p AS (SELECT k, coalesce(root, 'row:' || k::VARCHAR) AS component FROM c LEFT JOIN root ON root.a = c.v[1]),
s AS (SELECT component, count(*) AS size FROM p GROUP BY component),
o AS (SELECT component, 100 * (sum(size) OVER (ORDER BY md5(component), component) - size) AS before, 100 * sum(size) OVER () AS total FROM s)"""


@query(f"{_SPLIT} SELECT k AS c_custkey, component, CASE WHEN before < total * 0.8 THEN 'train' WHEN before < total * 0.9 THEN 'validation' ELSE 'test' END AS split FROM p JOIN o USING (component)")
def linked_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as samples: an identity for every three keys, a generator that straddles two of them, and equal balances as near copies."""
    k = F.col("c_custkey")
    groups = [F.when(k % 5 != 0, F.floor(k / 3)), F.when(k % 4 != 0, F.floor((k + 1) / 3)), F.when(k % 10 != 0, F.round(F.col("c_acctbal") * 100).cast("long"))]
    return governance.linked_split(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey", groups).select("c_custkey", "component", "split")


_KIND = "CASE event_type WHEN 'signup' THEN 'file' WHEN 'view' THEN 'run_started' WHEN 'purchase' THEN 'run' WHEN 'error' THEN 'run' ELSE 'health' END"


@query(f"""WITH e AS (SELECT event_id, ts, user_id, {_KIND} AS event FROM events),
f AS (SELECT *, last_value(CASE WHEN event = 'file' THEN event_id END IGNORE NULLS) OVER w AS file_id FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, max(CASE WHEN event = 'run_started' THEN event_id END) OVER w AS request_id FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT r.event_id, r.request_id, q.file_id AS asked_file, r.file_id, r.request_id IS NOT NULL AND q.file_id IS DISTINCT FROM r.file_id AS late FROM r LEFT JOIN f q ON q.event_id = r.request_id WHERE r.event = 'run'""")
def late_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which file each response was asked for, and whether another one has been chosen since."""
    events = table(spark, sf_dir, "events").selectExpr("event_id", "ts", "user_id as case_id", f"{_KIND} as event")
    return responses.attributed(events).select("event_id", "request_id", "asked_file", "file_id", "late")


@query(f"""WITH e AS (SELECT event_id, ts, user_id, {_KIND} AS event FROM events), w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM e WHERE event IN ('run_started', 'run')),
a AS (SELECT q.user_id, q.event_id, min(epoch_us(r.ts) - epoch_us(q.ts)) AS waited FROM e q LEFT JOIN e r ON r.event = 'run' AND r.user_id = q.user_id AND (r.ts, r.event_id) > (q.ts, q.event_id) AND r.ts <= q.ts + INTERVAL 3 DAY, w WHERE q.event = 'run_started' AND q.ts + INTERVAL 3 DAY <= mark GROUP BY ALL)
SELECT user_id AS case_id, event_id AS request_id, waited, CASE WHEN waited IS NULL THEN 'no_response' ELSE 'answered' END AS status FROM a""")
def response_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream: every request's wait, or that it had no response in three days. Each event comes twice."""
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    events = stream.selectExpr("event_id", "ts", "user_id as case_id", f"{_KIND} as event", "explode(array(1, 2)) as copy")
    return responses.drained(responses.verdicts(events, 3 * 86_400, "1 hour"), "response_times")


_ORDERS = "SELECT o_custkey AS k, o_orderkey AS id, epoch_us(o_orderdate) // 1000000 AS a, epoch_us(o_orderdate) // 1000000 + 3600 * CASE WHEN o_orderkey % 50 = 0 THEN 20000 ELSE o_orderkey % 1500 END AS b FROM orders"


@query(f"WITH o AS ({_ORDERS}) SELECT x.k AS o_custkey, count(*) AS n_pairs, sum(least(x.b, y.b) - greatest(x.a, y.a))::BIGINT AS seconds FROM o x JOIN o y ON x.k = y.k AND x.id < y.id AND x.a < y.b AND y.a < x.b GROUP BY x.k")
def overlapping_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often, and how long, two orders of one customer are open at once; some are open for years."""
    key, start = F.col("o_orderkey"), F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    hours = F.when(key % 50 == 0, 20_000).otherwise(key % 1_500)
    orders = table(spark, sf_dir, "orders").select("o_custkey", key.alias("id"), start.alias("start"), (start + hours * 3600).alias("stop"))
    pairs = intervals.overlapping(orders, orders, ["o_custkey"], 86_400 * 7).filter("left_id < right_id")
    return pairs.groupBy("o_custkey").agg(F.count("*").alias("n_pairs"), F.sum(F.col("stop") - F.col("start")).alias("seconds"))


@query("SELECT *, 'both' AS side FROM (SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT *, 'customers' FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT *, 'suppliers' FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer)")
def coverage_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which nations are in both tables, and which in one alone, as a check that no evaluation slice is missing."""
    customers, suppliers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    return governance.coverage(customers, suppliers, ("both", "customers", "suppliers"))
