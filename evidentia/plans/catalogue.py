"""Every query of the screening operators, with the SQL it must equal.

The fixtures hold no images and no machine-readable zones. Where an operator needs such, its query
runs on a table of the same shape, or makes a zone for every customer, some of them with faults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import client_rules as client
from evidentia.functions.mrz import check_digit, mrz_checks, parse_mrz
from evidentia.operators import document_checks, evaluation, forensics, governance, models, rule_packs, status
from evidentia.operators.document_checks import compared, rule_findings
from evidentia.plans import measures  # noqa: F401  registers its queries too
from evidentia.plans.registry import ORACLE_SQL, QUERIES, query, table  # noqa: F401
from evidentia.plans.screening import detect_media, screen_documents
from evidentia.sources import evidence
from evidentia.streaming import trail

def labelled_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cases: a toxic label is suspicious, low quality inconclusive, no label unavailable."""
    labels = table(spark, sf_dir, "labels")
    score = F.when(F.col("toxic") == 1, 1.0).when(F.col("quality") == 0, 0.5).otherwise(0.0)
    found = status.check_status(F.col("toxic").isNotNull(), score, 0.4, 0.8)
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left").withColumn("status", found)


_STATUS = "CASE WHEN toxic IS NULL THEN 'unavailable' WHEN toxic = 1 THEN 'suspicious' WHEN quality = 0 THEN 'inconclusive' ELSE 'completed' END"


@query(f"SELECT outcome, count(*) AS n, sum(CASE WHEN outcome <> 'checks_completed' THEN 1 ELSE 0 END)::BIGINT AS n_review FROM (SELECT replace({_STATUS}, 'completed', 'checks_completed') AS outcome FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY outcome")
def case_outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = labelled_outcomes(spark, sf_dir).select(F.col("doc_id").alias("case_id"), F.lit("document").alias("workflow"), "status", F.lit(None).cast("string").alias("reason"))
    return status.case_outcomes(results).groupBy("outcome").agg(F.count("*").alias("n"), F.count_if("manual_review").alias("n_review"))


@query(f"SELECT check_name, status, count(*) AS n FROM (SELECT doc_id, 'tampering' AS check_name, {_STATUS} AS status FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT doc_id, c, 'unavailable' FROM documents, (VALUES ('ocr_fields'), ('mrz_consistency'), ('metadata_provenance'), ('face_verification')) t(c)) GROUP BY check_name, status")
def check_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = labelled_outcomes(spark, sf_dir).select(F.col("doc_id").alias("case_id"), F.lit("document").alias("workflow"), F.lit("tampering").alias("check"), "status", F.lit(None).cast("string").alias("reason"))
    every = status.all_checks(results, results.select("case_id", "workflow"))
    return every.groupBy(F.col("check").alias("check_name"), "status").agg(F.count("*").alias("n"))


_CATALOG = "(VALUES ('document', 'ocr_fields'), ('document', 'mrz_consistency'), ('document', 'tampering'), ('document', 'face_verification'), ('document', 'metadata_provenance'), ('media', 'generated_image'), ('media', 'face_manipulation'), ('media', 'visual_forensics'), ('media', 'explanations')) c(workflow, check_name)"


@query(f"WITH d AS (SELECT doc_id, source, CASE WHEN lang = 'en' THEN 'document' ELSE 'media' END AS workflow, toxic IS NOT NULL AS scored FROM documents LEFT JOIN labels USING (doc_id)) SELECT source, c.workflow, check_name, count(*) AS n_cases, count(*) FILTER (scored AND check_name IN ('tampering', 'visual_forensics')) AS n_available FROM d JOIN {_CATALOG} ON c.workflow = d.workflow GROUP BY ALL")
def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source the checks that its cases have, and for how many of them each could run."""
    workflow = F.when(F.col("lang") == "en", "document").otherwise("media")
    cases = labelled_outcomes(spark, sf_dir).select(F.col("doc_id").alias("case_id"), workflow.alias("workflow"), "source", "status")
    scored = cases.filter("status <> 'unavailable'").select("case_id", "workflow", F.when(F.col("workflow") == "document", "tampering").otherwise("visual_forensics").alias("check"), "status", F.lit(None).cast("string").alias("reason"))
    every = status.all_checks(scored, cases.select("case_id", "workflow")).join(cases.select("case_id", "source"), "case_id")
    return every.groupBy("source", "workflow", F.col("check").alias("check_name")).agg(F.count("*").alias("n_cases"), F.count_if(F.col("status") != "unavailable").alias("n_available"))


@query(f"SELECT doc_id, {_STATUS} AS status, CASE WHEN {_STATUS} = 'suspicious' THEN 'The score is above the threshold.' WHEN {_STATUS} = 'inconclusive' THEN 'The capture is too poor to judge.' WHEN {_STATUS} = 'unavailable' THEN 'The model for this check is not installed.' END AS reason_text FROM documents LEFT JOIN labels USING (doc_id)")
def explained_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.create_map(F.lit("suspicious"), F.lit("score_high"), F.lit("inconclusive"), F.lit("low_quality"), F.lit("unavailable"), F.lit("no_model"))[F.col("status")]
    results = labelled_outcomes(spark, sf_dir).select("doc_id", F.col("doc_id").alias("case_id"), F.lit("document").alias("workflow"), F.lit("tampering").alias("check"), "status", reason.alias("reason"))
    return status.disclosure(results)["evidence"].select(F.col("case_id").alias("doc_id"), "status", "reason_text")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate < o_orderdate THEN 'suspicious' ELSE 'completed' END AS status, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def date_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    found = F.when(F.col("l_shipdate") < F.col("o_orderdate"), "suspicious").otherwise("completed")
    return both.groupBy("l_orderkey", "l_linenumber", found.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')")
def status_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    open_ = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'").select("l_orderkey")
    return done.join(open_, done["o_orderkey"] == open_["l_orderkey"], "left_semi")


@query("SELECT doc_id, rule FROM (SELECT doc_id, 'size_differs' AS rule FROM documents WHERE length(text) <> n_chars UNION ALL SELECT doc_id, 'bytes_differ' FROM documents WHERE strlen(text) <> n_chars UNION ALL SELECT doc_id, 'very_long' FROM documents WHERE n_chars > 10000)")
def declared_size_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"size_differs": F.length("text") != F.col("n_chars"), "bytes_differ": F.octet_length("text") != F.col("n_chars"), "very_long": F.col("n_chars") > 10_000}
    return rule_findings(table(spark, sf_dir, "documents"), rules, ["doc_id"])


_TENTHS = "CAST(floor(b * 10.0 / {u} + 0.5) AS BIGINT)"
_SHOWN = "(" + _TENTHS + " // 10)::VARCHAR || '.' || (" + _TENTHS + " % 10)::VARCHAR"


@query(f"SELECT doc_id, CASE WHEN b < 1024 THEN b::VARCHAR || ' B' WHEN b < 1048576 THEN {_SHOWN.format(u=1024)} || ' KB' ELSE {_SHOWN.format(u=1048576)} || ' MB' END AS size_text FROM (SELECT doc_id, strlen(text) AS b FROM documents UNION ALL SELECT -1 - i, v FROM (VALUES (0, 0), (1, 1023), (2, 1024), (3, 1280), (4, 1048575), (5, 1048576), (6, 5000000000)) t(i, v))")
def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.createDataFrame(list(enumerate([0, 1023, 1024, 1280, 1048575, 1048576, 5000000000])), "i long, b long").select((-1 - F.col("i")).alias("doc_id"), "b")
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("b")).unionByName(edges)
    return sizes.select("doc_id", client.format_bytes(F.col("b")).alias("size_text"))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_doc_id FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.exact_duplicates(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.benchmark_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) SELECT doc_id, line, count(*) AS n, min(i)::INT AS first_line, max(i)::INT AS last_line FROM l WHERE length(line) >= 30 GROUP BY doc_id, line HAVING count(*) > 1")
def repeated_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forensics.repeated_lines(table(spark, sf_dir, "documents"))


_BUCKET = "(('0x' || md5(source)[1:4])::BIGINT % 100)"


@query(f"SELECT source, CASE WHEN {_BUCKET} < 80 THEN 'train' WHEN {_BUCKET} < 90 THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM documents GROUP BY ALL")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", governance.split_of(F.col("source")).alias("split")).agg(F.count("*").alias("n"))


_ID_BUCKET = _BUCKET.replace("source", "doc_id::VARCHAR")


@query(f"WITH d AS (SELECT doc_id, text, CASE WHEN {_ID_BUCKET} < 80 THEN 'train' WHEN {_ID_BUCKET} < 90 THEN 'validation' ELSE 'test' END AS split FROM documents) SELECT doc_id FROM d WHERE split = 'test' AND text IN (SELECT text FROM d WHERE split = 'train')")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split by document, copies end up on both sides."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), governance.split_of(F.col("doc_id").cast("string")).alias("split"))
    return governance.split_leakage(docs.filter("split = 'train'"), docs.filter("split = 'test'"), "digest").select("doc_id")


@query("SELECT lang, source, grouping(lang, source)::INT AS level, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.class_counts(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("SELECT lang, toxic, grouping(lang, toxic)::INT AS level, count(*) AS n, round(avg(CASE WHEN (n_chars < 800) = (quality = 0) THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY CUBE (lang, toxic)")
def slice_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return governance.slice_metrics(rows, ["lang", "toxic"], (F.col("n_chars") < 800) == (F.col("quality") == 0))


@query("SELECT doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def unseen_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    training = docs.join(table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return governance.unseen(docs, training, "source").select("doc_id")


@query("SELECT sha256(text) AS digest, item_id FROM benchmark WHERE item_id % 3 <> 0")
def missing_registry_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifacts = table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("digest"), "item_id")
    third = F.col("item_id") % 3
    registry = artifacts.filter(third != 2).select("digest", F.when(third == 0, "own").alias("license"), F.lit("fixture").alias("source"))
    return governance.missing_records(artifacts, registry)


@query("WITH r AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS p FROM embeddings GROUP BY label), s AS (SELECT vec_id, round(list_dot_product(p, embedding::DOUBLE[]) / (sqrt(list_dot_product(p, p)) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS similarity FROM embeddings JOIN r USING (label)) SELECT vec_id, similarity, CASE WHEN similarity >= 0.3 THEN 'completed' WHEN similarity >= 0.0 THEN 'inconclusive' ELSE 'suspicious' END AS status FROM s")
def face_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the first of its label, as a capture against the portrait on file."""
    vectors = table(spark, sf_dir, "embeddings")
    portraits = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("portrait"))
    pairs = vectors.withColumnRenamed("embedding", "capture").join(portraits, "label")
    return models.face_comparison(pairs, 0.0, 0.3, digits=6).select("vec_id", "similarity", "status")


_T = "embedding::DOUBLE[]"


def _dct_sql(u: int, v: int) -> str:
    return f"list_dot_product({_T}, [cos((2 * (i // 8) + 1) * {u} * pi() / 16) * cos((2 * (i % 8) + 1) * {v} * pi() / 16) * {'sqrt(0.125)' if u == 0 else '0.5'} * {'sqrt(0.125)' if v == 0 else '0.5'} for i in range(64)])"


_LOW = " + ".join(f"power({_dct_sql(u, v)}, 2)" for u in range(4) for v in range(4 - u) if u + v)


@query(f"SELECT vec_id, round({_dct_sql(0, 0)}, 6) AS dc, round({_dct_sql(1, 2)}, 6) AS c12, round(1 - ({_LOW}) / (list_dot_product({_T}, {_T}) - power({_dct_sql(0, 0)}, 2)), 6) AS high_share FROM embeddings")
def tile_dct(spark: SparkSession, sf_dir: str) -> DataFrame:
    tile = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(forensics.dct_coefficient(tile, 0, 0), 6).alias("dc"), F.round(forensics.dct_coefficient(tile, 1, 2), 6).alias("c12"), F.round(forensics.high_frequency_share(tile), 6).alias("high_share"))


@query("WITH p AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, unnest(range(64)) AS i FROM embeddings), s AS (SELECT vec_id, i, lead(v) OVER (PARTITION BY vec_id ORDER BY i) - v AS d FROM p) SELECT vec_id, round(var_pop(d), 8) AS noise FROM s WHERE i % 8 <> 7 GROUP BY vec_id")
def tile_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(forensics.noise_residual(F.col("embedding")), 8).alias("noise"))


@query("WITH p AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v FROM embeddings), b AS (SELECT vec_id, least(greatest(floor((v + 0.5) / 1.0 * 8), 0), 7) AS k, count(*) AS n FROM p GROUP BY ALL), e AS (SELECT vec_id, round(-sum(n / 64.0 * log2(n / 64.0)), 6) AS entropy FROM b GROUP BY vec_id), t AS (SELECT vec_id, round(var_pop(v), 8) AS texture FROM p GROUP BY vec_id) SELECT vec_id, texture, entropy FROM t JOIN e USING (vec_id)")
def tile_texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    tile = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(forensics.texture_variance(tile), 8).alias("texture"), F.round(forensics.texture_entropy(tile, -0.5, 0.5), 6).alias("entropy"))


def pixels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run of 64 vectors as one grey image: a vector is a row of pixels."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("img_id"), (F.col("vec_id") % 64).cast("int").alias("y"), F.posexplode("embedding").alias("x", "v"))
    return rows.withColumn("v", F.col("v").cast("double"))


@query("WITH p AS (SELECT vec_id // 64 AS img_id, vec_id, unnest(embedding::DOUBLE[]) AS v, unnest(range(64)) AS x FROM embeddings), s AS (SELECT img_id, x, abs(v - lag(v) OVER (PARTITION BY vec_id ORDER BY x)) AS d FROM p) SELECT img_id, round(avg(d) FILTER (x % 8 = 0), 8) AS edge_step, round(avg(d) FILTER (x % 8 <> 0), 8) AS inner_step FROM s WHERE d IS NOT NULL GROUP BY img_id")
def block_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forensics.blockiness(pixels_of(spark, sf_dir)).select("img_id", F.round("edge_step", 8).alias("edge_step"), F.round("inner_step", 8).alias("inner_step"))


@query("WITH t AS (SELECT vec_id // 64 AS img_id, vec_id, list_aggregate(embedding::DOUBLE[], 'var_pop') AS texture FROM embeddings), z AS (SELECT vec_id, (texture - avg(texture) OVER w) / stddev_pop(texture) OVER w AS z FROM t WINDOW w AS (PARTITION BY img_id)) SELECT vec_id, round(z, 6) AS z, abs(z) > 2 AS anomalous FROM z")
def tile_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("img_id"), "vec_id", forensics.texture_variance(F.col("embedding")).alias("texture"))
    return forensics.tile_anomalies(tiles, "texture", 2.0).select("vec_id", F.round("z", 6).alias("z"), "anomalous")


#: Images of which each even one has a region of 14 by 12 pixels copied from 20 columns and 9 rows before.
_COPIED = """t AS (SELECT vec_id // 64 AS img_id, (vec_id % 64)::INT AS y, [floor(e::DOUBLE * 100)::INT FOR e IN embedding] AS r FROM embeddings),
p AS (SELECT t.img_id, t.y, CASE WHEN t.img_id % 2 = 0 AND t.y BETWEEN 30 AND 41 THEN t.r[:25] || s.r[6:19] || t.r[40:] ELSE t.r END AS r FROM t LEFT JOIN t s ON s.img_id = t.img_id AND s.y = t.y - 9),
b AS (SELECT a.img_id, a.y, x, [a.r[x + 1:x + 4], b.r[x + 1:x + 4], c.r[x + 1:x + 4], d.r[x + 1:x + 4]] AS cells FROM p a JOIN p b ON b.img_id = a.img_id AND b.y = a.y + 1 JOIN p c ON c.img_id = a.img_id AND c.y = a.y + 2 JOIN p d ON d.img_id = a.img_id AND d.y = a.y + 3, range(61) r(x))"""


def copied_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("img_id"), (F.col("vec_id") % 64).cast("int").alias("y"), F.transform("embedding", lambda e: F.floor(e.cast("double") * 100).cast("int")).alias("r"))
    above = rows.select("img_id", (F.col("y") + 9).alias("y"), F.slice("r", 6, 14).alias("from"))
    copied = F.when((F.col("img_id") % 2 == 0) & F.col("y").between(30, 41), F.concat(F.slice("r", 1, 25), "from", F.slice("r", 40, 25))).otherwise(F.col("r"))
    return rows.join(above, ["img_id", "y"], "left").select("img_id", "y", F.posexplode(copied).alias("x", "v"))


@query(f"WITH {_COPIED}, f AS (SELECT * FROM b WHERE list_min(flatten(cells)) < list_max(flatten(cells))) SELECT a.img_id, (b.x - a.x)::INT AS dx, b.y - a.y AS dy, count(*) AS n_blocks FROM f a JOIN f b ON a.img_id = b.img_id AND a.cells = b.cells AND (a.y, a.x) < (b.y, b.x) WHERE greatest(abs(b.x - a.x), abs(b.y - a.y)) >= 4 GROUP BY ALL")
def copy_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as images of whole numbers, a region of every other one copied within it."""
    found = forensics.copy_move(copied_pixels(spark, sf_dir))
    return found.select("img_id", F.col("dx").cast("int").alias("dx"), F.col("dy").cast("int").alias("dy"), "n_blocks")


@query(f"""WITH c AS (SELECT vec_id // 64 AS img_id, vec_id, unnest([{', '.join(f"{{'u': {u}, 'v': {v}, 'c': {_dct_sql(u, v)} * 200}}" for u, v in ((0, 1), (1, 1), (2, 0)))}]) AS x FROM embeddings),
q AS (SELECT img_id, x.u AS u, x.v AS v, CASE WHEN img_id % 2 = 0 THEN round(round(x.c / 9) * 9 / 3) ELSE round(x.c / 3) END::BIGINT AS q FROM c),
s AS (SELECT img_id, u, v, p, count(*) AS n, sqrt(power(sum(cos(q * 2 * pi() / p)), 2) + power(sum(sin(q * 2 * pi() / p)), 2)) / count(*) AS strength FROM q, unnest([2, 3, 4, 5, 6, 7]) t(p) WHERE q <> 0 GROUP BY ALL)
SELECT img_id, u, v, n, arg_max(p, (round(strength, 9), -p)) AS period, round(max(strength), 6) AS strength FROM s GROUP BY img_id, u, v, n""")
def double_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as tiles of images, the even images quantised twice: by 9, then by 3. Their period is three."""
    tile, frequencies = F.col("embedding"), ((0, 1), (1, 1), (2, 0))
    parts = [F.struct(F.lit(u).alias("u"), F.lit(v).alias("v"), (forensics.dct_coefficient(tile, u, v) * 200).alias("c")) for u, v in frequencies]
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("img_id"), F.inline_outer(F.array(*parts)))
    c = F.col("c")
    quantised = F.when(F.col("img_id") % 2 == 0, F.round(F.round(c / 9) * 9 / 3)).otherwise(F.round(c / 3)).cast("long")
    found = forensics.coefficient_periods(rows.select("img_id", "u", "v", quantised.alias("q")))
    return found.select("img_id", "u", "v", "n", "period", F.round("strength", 6).alias("strength"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<meta'))::INT AS n_meta, CASE WHEN contains(html, '<meta') THEN 'completed' ELSE 'unavailable' END AS metadata_status FROM pages")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<meta")).alias("n_meta"), F.when(F.contains("html", F.lit("<meta")), "completed").otherwise("unavailable").alias("metadata_status"))


@query(r"SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(split_part(url, '/', 1) || '//' || split_part(url, '/', 3)) || substr(url, length(split_part(url, '/', 1) || '//' || split_part(url, '/', 3)) + 1), '#.*$', ''), '([?&])utm_[a-z]+=[^&]*', '\1', 'g'), '[?&]+$', ''), '/+$', '') AS canonical, count(*) AS n, min(page_id) AS first_page_id FROM pages GROUP BY 1")
def canonical_url_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(governance.canonical_url(F.col("url")).alias("canonical")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page_id"))


@query("SELECT event_id, k AS key, replace(k, '_', ' ') AS label, coalesce(json_extract_string(props, '$.\"' || k || '\"'), 'null') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client.response_entries(table(spark, sf_dir, "events").select("event_id", F.col("props").alias("body")))


_REPLY = "event_id % 8"


@query(f"""SELECT event_id, CASE WHEN {_REPLY} = 1 THEN 'No image for ' || event_type || '.' WHEN {_REPLY} IN (2, 5) THEN 'Backend request failed with HTTP 500.' WHEN {_REPLY} = 3 THEN 'Backend returned a response that was not valid JSON.' END AS error, {_REPLY} NOT IN (4, 6) AS shows_panel FROM events""")
def response_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's properties as the body of a response, and in other forms: an error's text or code, no JSON, null, empty text, a list."""
    kind = (F.col("event_id") % 8).cast("int")
    own = F.to_json(F.struct(F.concat(F.lit("No image for "), "event_type", F.lit(".")).alias("error")))
    bodies = F.array(F.col("props"), own, F.lit('{"error":{"code":7}}'), F.lit("<html>"), F.lit("null"), F.lit('{"error":null}'), F.lit('""'), F.lit("[]"))
    failed = F.get(F.array(*[F.lit(x) for x in (200, 400, 500, 502, 200, 500, 200, 200)]), kind)
    rows = table(spark, sf_dir, "events").select("event_id", failed.alias("http_status"), client.response_payload(F.get(bodies, kind)).alias("payload"))
    rows = rows.withColumn("error", client.error_message(F.col("payload"), F.col("http_status")))
    return rows.select("event_id", "error", client.shows_panel(F.col("payload"), F.col("error")).alias("shows_panel"))


@query("SELECT doc_id, CASE WHEN lang = '' THEN 'Unknown browser MIME type' ELSE lang END AS type_text, CASE WHEN lang = 'en' THEN 'document' ELSE 'media' END AS route, lang <> 'de' AND trim(source) <> '' AND n_chars % 2 = 0 AS can_analyze, CASE WHEN lang <> 'de' THEN 'Ready' ELSE 'Required' END AS file_ready, CASE WHEN trim(source) <> '' THEN 'Provided' ELSE 'Required' END AS key_ready, CASE WHEN lang = 'en' THEN 'Online' ELSE 'Not checked' END AS connection_text FROM documents")
def file_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", (F.col("lang") != "de").alias("has_file"), F.col("source").alias("api_key"), F.when(F.col("lang") == "en", "online").otherwise("unknown").alias("connection"))
    workflow = F.when(F.col("lang") == "en", "document").otherwise("media")
    running = F.when(F.col("n_chars") % 2 == 0, "idle").otherwise("running")
    return client.readiness(docs).select("doc_id", client.file_type(F.col("lang")).alias("type_text"), client.route(workflow).alias("route"), client.can_analyze(F.col("has_file"), F.col("api_key"), running).alias("can_analyze"), "file_ready", "key_ready", "connection_text")


@query(f"SELECT lang, sum((f AND toxic = 1)::INT)::BIGINT AS tp, sum((f AND toxic = 0)::INT)::BIGINT AS fp, sum((NOT f AND NOT a AND toxic = 0)::INT)::BIGINT AS tn, sum((NOT f AND NOT a AND toxic = 1)::INT)::BIGINT AS fn, sum(a::INT)::BIGINT AS abstained FROM (SELECT lang, toxic, n_chars < 1000 AND toxic IS NOT NULL AS f, toxic IS NULL AS a FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY lang")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("toxic").isNull(), "unavailable").when(F.col("n_chars") < 1000, "suspicious").otherwise("completed")
    return evaluation.confusion(labelled_outcomes(spark, sf_dir), outcome, F.col("toxic"), ["lang"]).drop("false_alarm_rate", "miss_rate")


@query("SELECT lang, round(avg(CASE WHEN n_chars < 1000 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS false_alarm_rate FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 GROUP BY lang")
def false_alarm_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("n_chars") < 1000, "suspicious").otherwise("completed")
    real = labelled_outcomes(spark, sf_dir).filter("toxic = 0")
    return evaluation.confusion(real, outcome, F.col("toxic"), ["lang"]).select("lang", F.round("false_alarm_rate", 9).alias("false_alarm_rate"))


@query("SELECT source, count(*) AS n, round(avg(CASE WHEN (CASE WHEN n_chars < 800 THEN 0 ELSE 1 END) IS NOT DISTINCT FROM quality THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS accuracy FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_outcomes(spark, sf_dir).select("source", F.when(F.col("n_chars") < 800, 0).otherwise(1).alias("predicted"), F.col("quality").alias("truth"))
    return evaluation.field_accuracy(rows, ["source"]).withColumn("accuracy", F.round("accuracy", 9))


@query("WITH g AS (SELECT event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) SELECT event_type, count(gap) AS n, round(quantile_cont(gap, 0.5) / 1e6, 4) AS p50, round(quantile_cont(gap, 0.9) / 1e6, 4) AS p90, round(quantile_cont(gap, 0.99) / 1e6, 4) AS p99 FROM g GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long a user's events come after the one before."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gaps = table(spark, sf_dir, "events").select("event_type", (micros(F.col("ts")) - micros(F.lag("ts").over(order))).alias("gap"))
    found = evaluation.latency(gaps, "gap", ["event_type"])
    return found.select("event_type", "n", *[F.round(F.col(p) / 1e6, 4).alias(p) for p in ("p50", "p90", "p99")])


@query("WITH c AS (SELECT lang, n_chars AS threshold, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL) SELECT lang, threshold, (sum(p) OVER d)::BIGINT AS tp, (sum(n) OVER d)::BIGINT AS fp, round((sum(p) OVER d) / (sum(p) OVER (PARTITION BY lang)), 9)::DOUBLE AS tpr FROM c WINDOW d AS (PARTITION BY lang ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.roc_points(labelled_outcomes(spark, sf_dir), "n_chars", "quality", ["lang"]).select("lang", "threshold", "tp", "fp", F.round("tpr", 9).alias("tpr"))


@query("WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - lag(epoch_us(ts)) OVER w > 86400000000 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM g) SELECT user_id, session_no, count(*) AS n_events, min(ts) AS started, max(ts) AS ended FROM n GROUP BY ALL")
def trail_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trail.session_summary(table(spark, sf_dir, "events"), "user_id", "ts", 86_400, "event_id")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def trail_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trail.daily_counts(table(spark, sf_dir, "events"), "ts", "event_type")


@query("SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def trail_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trail.latest_action(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", ["event_type"])


_KIND = "CASE event_type WHEN 'signup' THEN 'file' WHEN 'view' THEN 'run_started' WHEN 'purchase' THEN 'run' WHEN 'error' THEN 'run' ELSE 'health' END"
_OK = "event_type IN ('purchase', 'click')"


def _client_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "ts", "user_id as case_id", f"{_KIND} as event", f"{_OK} as ok")


@query(f"WITH e AS (SELECT event_id, ts, user_id AS case_id, {_KIND} AS event, {_OK} AS ok FROM events), s AS (SELECT *, CASE WHEN event = 'health' THEN CASE WHEN ok THEN 'online' ELSE 'offline' END WHEN event = 'run' AND ok THEN 'online' END AS c, CASE event WHEN 'file' THEN 'idle' WHEN 'run_started' THEN 'running' WHEN 'run' THEN CASE WHEN ok THEN 'success' ELSE 'error' END END AS r FROM e) SELECT case_id, coalesce(arg_max(c, (ts, event_id)) FILTER (c IS NOT NULL), 'unknown') AS connection, coalesce(arg_max(r, (ts, event_id)) FILTER (r IS NOT NULL), 'idle') AS run_state FROM s GROUP BY case_id")
def client_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client.last_states(_client_events(spark, sf_dir))


@query("SELECT event_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS file_no FROM events")
def file_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client.file_sessions(_client_events(spark, sf_dir)).select("event_id", "file_no")


_K = "c_custkey"
_DIGIT = "(list_sum([(CASE WHEN {s}[i] BETWEEN '0' AND '9' THEN ascii({s}[i]) - 48 WHEN {s}[i] BETWEEN 'A' AND 'Z' THEN ascii({s}[i]) - 55 ELSE 0 END) * [7, 3, 1][(i - 1) % 3 + 1] for i in range(1, len({s}) + 1)]) % 10)"
#: What is known of every customer's document: the fields, and the faults by divisors of the key.
_FACTS = f"""WITH f AS (SELECT {_K} AS case_id, 'AB' || lpad({_K}::VARCHAR, 7, '0') AS nine, {_K} % 5 IN (2, 4) AND {_K} % 3 = 0 AS long, 'C' || (10 + {_K} % 90)::VARCHAR AS more, (50 + {_K} % 50)::VARCHAR || lpad((1 + {_K} % 12)::VARCHAR, 2, '0') || lpad((1 + {_K} % 28)::VARCHAR, 2, '0') AS birth,
 CASE WHEN {_K} % 13 = 0 THEN '15' ELSE '30' END || '0' || (1 + {_K} % 9)::VARCHAR || '28' AS expiry, ['TD3', 'MRV-A', 'TD2', 'MRV-B', 'TD1'][{_K} % 5 + 1] AS fmt, {_K} % 17 <> 0 AS zone, {_K} % 7 = 0 AS bad_digit, {_K} % 11 = 0 AS differs, {_K} % 13 = 0 AS expired,
 CASE {_K} % 4 WHEN 1 THEN 'MUELLER ' || c_mktsegment WHEN 3 THEN 'O' || c_mktsegment ELSE c_mktsegment END AS surname FROM customer),
 n AS (SELECT *, nine || CASE WHEN long THEN more ELSE '' END AS number FROM f),
 d AS (SELECT *, ({_DIGIT.format(s='number')} + bad_digit::INT) % 10 AS nd, {_DIGIT.format(s='birth')} AS bd, {_DIGIT.format(s='expiry')} AS ed FROM n),
 z AS (SELECT *, CASE WHEN NOT long THEN nine || nd::VARCHAR WHEN fmt = 'TD1' THEN nine || '<' || more || nd::VARCHAR || repeat('<', 11) ELSE nine || '<' END || CASE WHEN fmt = 'TD1' AND NOT long THEN repeat('<', 15) ELSE '' END
  || birth || bd::VARCHAR || expiry || ed::VARCHAR || CASE WHEN fmt = 'TD2' AND long THEN more || nd::VARCHAR ELSE '' END AS whole FROM d)"""


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each customer: case_id, text (printed lines and the zone), expiry, key.

    The zone's format goes by the key modulo 5. Every 7th has a wrong check digit, every 11th a printed
    number unlike the zone's, every 13th has expired, every 17th has no zone. As documents do, they
    have numbers longer than nine on cards, names that the zone transliterates or is too narrow for,
    dates in several forms, indented lines, line ends of other systems, and stray lines before the zone."""
    k, key = F.col("c_custkey"), F.col("key")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    fill = lambda n: F.lit("<" * n)
    pick = lambda by, n, *of: F.get(F.array(*[F.lit(x) if isinstance(x, str) else x for x in of]), (by % n).cast("int"))
    segment = F.col("c_mktsegment")
    rows = table(spark, sf_dir, "customer").select(
        k.alias("key"), F.concat(F.lit("AB"), F.lpad(k.cast("string"), 7, "0")).alias("nine"), F.when((k % 5).isin(2, 4) & (k % 3 == 0), F.concat(F.lit("C"), (10 + k % 90).cast("string"))).otherwise("").alias("more"),
        F.concat((50 + k % 50).cast("string"), two(1 + k % 12), two(1 + k % 28)).alias("birth"), F.concat(F.when(k % 13 == 0, "15").otherwise("30"), two(1 + k % 9), F.lit("28")).alias("end"),
        pick(k, 4, F.initcap(segment), F.concat(F.lit("Müller-"), F.initcap(segment)), F.initcap(segment), F.concat(F.lit("O’"), F.initcap(segment))).alias("printed"),
        pick(k, 4, segment, F.concat(F.lit("MUELLER<"), segment), segment, F.concat(F.lit("O"), segment)).alias("surname"),
        F.when(k % 6 == 0, "Anna Maria Magdalena Josephine Wilhelmine").otherwise("Anna").alias("given"),
    )
    wrong = F.when(key % 7 == 0, 1).otherwise(0)
    rows = rows.withColumns({"number": F.concat("nine", "more"), "nd": ((check_digit(F.concat("nine", "more")).cast("int") + wrong) % 10).cast("string"), "bd": check_digit(F.col("birth")), "ed": check_digit(F.col("end"))})
    long = F.col("more") != ""
    ends = F.when(long, F.concat("nine", F.lit("<"))).otherwise(F.concat("nine", "nd"))
    rest = F.when(long, F.concat("more", "nd")).otherwise("")
    rows = rows.withColumns({"first": ends, "rest": rest, "whole": F.concat(ends, F.when(key % 5 == 4, F.rpad(rest, 15, "<")).otherwise(""), F.concat("birth", "bd", "end", "ed"), F.when(key % 5 == 2, F.rpad(rest, 7, "<")).otherwise(""))})
    rows = rows.withColumns({"wd": check_digit(F.col("whole")), "names": F.concat("surname", F.lit("<<"), F.translate(F.upper("given"), " ", "<")), "lower": F.concat("first", F.lit("UTO"), "birth", "bd", F.lit("F"), "end", "ed")})
    # rpad also cuts what is too long, as an issuer must.
    zone = pick(
        key, 5,
        F.concat(F.lit("P<UTO"), F.rpad("names", 39, "<"), F.lit("\n"), "lower", fill(15), "wd"),
        F.concat(F.lit("V<UTO"), F.rpad("names", 39, "<"), F.lit("\n"), "lower", fill(16)),
        F.concat(F.lit("I<UTO"), F.rpad("names", 31, "<"), F.lit("\n"), "lower", F.rpad("rest", 7, "<"), "wd"),
        F.concat(F.lit("V<UTO"), F.rpad("names", 31, "<"), F.lit("\n"), "lower", fill(8)),
        F.concat(F.lit("I<UTO"), "first", F.rpad("rest", 15, "<"), F.lit("\n"), "birth", "bd", F.lit("F"), "end", "ed", F.lit("UTO"), fill(11), "wd", F.lit("\n"), F.rpad("names", 30, "<")),
    )
    born = F.to_date(F.concat(F.lit("19"), "birth"), "yyyyMMdd")
    lines = F.concat(F.lit("Surname: "), "printed", F.lit("\nGiven names: "), "given", F.lit("\nDocument No: "), F.when(key % 11 == 0, F.lit("X")).otherwise(""), "number", F.lit("\nDate of birth: "), pick(key, 3, F.date_format(born, "yyyy-MM-dd"), F.date_format(born, "d MMMM yyyy"), F.date_format(born, "dd/MM/yyyy")))
    lines = F.concat(lines, F.when(key % 2 == 0, "\nNationality: Utopian").otherwise(""), F.when(key % 10 == 0, "\n" + "X" * 30).otherwise(""))
    text = F.when(key % 17 == 0, lines).otherwise(F.concat(lines, F.lit("\n"), F.when(key % 9 == 0, F.lit("  ")).otherwise(""), zone))
    text = F.when(key % 8 == 0, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    return rows.select(key.alias("case_id"), text.alias("text"), F.lit(None).cast("string").alias("expiry"), "key")


@query(f"{_FACTS} SELECT case_id, CASE WHEN zone THEN fmt END AS mrz_format, CASE WHEN zone THEN number END AS number, CASE WHEN zone THEN NOT bad_digit END AS number_ok, CASE WHEN zone THEN true END AS birth_ok, CASE WHEN zone THEN true END AS expiry_ok, CASE WHEN zone AND fmt NOT LIKE 'MRV%' THEN true END AS composite_ok, CASE WHEN zone THEN nd::VARCHAR END AS number_digit, CASE WHEN zone AND fmt NOT LIKE 'MRV%' THEN {_DIGIT.format(s='whole')}::VARCHAR END AS composite_digit, CASE WHEN zone THEN surname END AS surname FROM z")
def mrz_check_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = mrz_checks(parse_mrz(zones(spark, sf_dir)))
    return checked.select("case_id", "mrz_format", F.col("mrz_number").alias("number"), "number_ok", "birth_ok", "expiry_ok", "composite_ok", F.col("mrz_number_check").alias("number_digit"), F.col("mrz_composite_check").alias("composite_digit"), F.col("mrz_surname").alias("surname"))


@query(f"{_FACTS} SELECT case_id, field, CASE WHEN (field = 'nationality' AND case_id % 2 <> 0) OR field = 'expiry' THEN CASE WHEN zone THEN 'inconclusive' ELSE 'unavailable' END WHEN NOT zone THEN 'inconclusive' WHEN field = 'number' AND differs THEN 'suspicious' ELSE 'completed' END AS status FROM z, (VALUES ('surname'), ('given'), ('number'), ('nationality'), ('birth'), ('expiry')) t(field)")
def mrz_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of every case; the expiry stands in the zone only, the nationality in print on every other."""
    found = compared(parse_mrz(zones(spark, sf_dir)), "text", F.lit("2026-01-01").cast("date"))
    # Outer, for an inner one would first filter by the array's size, and so make it twice.
    return found.select("case_id", F.inline_outer("fields")).select("case_id", "field", "status")


_COSINE = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query(f"""{_FACTS}, s AS (SELECT c_custkey AS case_id, {_COSINE} AS similarity FROM customer JOIN embeddings a ON a.vec_id = c_custkey % 400 JOIN embeddings b ON b.vec_id = (c_custkey % 400) + (c_custkey % 23 = 0)::INT),
r AS (SELECT case_id, unnest([CASE WHEN zone AND bad_digit THEN {{'s': 3, 'r': 'check_digit'}} WHEN zone AND differs THEN {{'s': 3, 'r': 'field_mismatch'}} WHEN zone AND expired THEN {{'s': 3, 'r': 'expired'}} WHEN NOT zone THEN {{'s': 0, 'r': 'no_zone'}} ELSE {{'s': 1, 'r': NULL}} END,
 CASE WHEN case_id % 19 = 0 THEN {{'s': 3, 'r': 'repeated_region'}} END, CASE WHEN case_id % 3 = 0 THEN {{'s': 0, 'r': 'no_metadata'}} END, CASE WHEN case_id % 29 = 0 THEN {{'s': 2, 'r': 'low_quality'}} END,
 CASE WHEN similarity IS NULL THEN {{'s': 0, 'r': 'no_model'}} WHEN similarity < 0.4 THEN {{'s': 3, 'r': 'face_differs'}} WHEN similarity < 0.6 THEN {{'s': 2, 'r': 'score_band'}} END]) AS x FROM z LEFT JOIN s USING (case_id))
SELECT case_id, CASE max(x.s) WHEN 3 THEN 'suspicious' WHEN 2 THEN 'inconclusive' ELSE 'checks_completed' END AS outcome, coalesce(bool_or(x.s <> 1), false) AS manual_review, array_to_string(list_sort(coalesce(list(DISTINCT x.r) FILTER (x.r IS NOT NULL), [])), ',') AS reasons FROM r GROUP BY case_id""")
def document_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All document checks: the capture's quality, zones, a forensic indicator, faces, files' metadata. Some cases need no review."""
    cases = zones(spark, sf_dir).withColumn("quality", F.when(F.col("key") % 29 == 0, "inconclusive").otherwise("completed"))
    indicators = cases.select("case_id", F.lit("repeated_region").alias("indicator"), F.when(F.col("key") % 19 == 0, 20.0).otherwise(0.0).alias("value"))
    facts = cases.select("case_id", F.when(F.col("key") % 3 == 0, "unavailable").otherwise("completed").alias("provenance_status"))
    vectors, own = table(spark, sf_dir, "embeddings"), F.col("c_custkey") % 400
    faces = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), own.alias("one"), (own + F.when(F.col("c_custkey") % 23 == 0, 1).otherwise(0)).alias("other"))
    faces = faces.join(vectors.select(F.col("vec_id").alias("one"), F.col("embedding").alias("portrait")), "one").join(vectors.select(F.col("vec_id").alias("other"), F.col("embedding").alias("capture")), "other")
    results = screen_documents(cases, F.lit("2026-01-01").cast("date"), quality="quality", indicators=indicators, limits={"repeated_region": (5, 16)}, faces=faces.select("case_id", "portrait", "capture"), facts=facts)
    return status.case_outcomes(results).select("case_id", "outcome", "manual_review", F.array_join("reasons", ",").alias("reasons"))


_GRADE = "CASE WHEN {s} >= 0.8 THEN 'suspicious' WHEN {s} >= 0.4 THEN 'inconclusive' ELSE 'completed' END"


@query(f"WITH s AS (SELECT vec_id, vec_id % 2 = 0 AS face, (vec_id % 256) / 255.0 AS g, 1 - (vec_id % 256) / 255.0 AS m FROM embeddings) SELECT vec_id, 'generated_image' AS check_name, {_GRADE.format(s='g')} AS status, round(g, 6)::DOUBLE AS score FROM s UNION ALL SELECT vec_id, 'face_manipulation', CASE WHEN face THEN {_GRADE.format(s='m')} ELSE 'unavailable' END, CASE WHEN face THEN round(m, 6)::DOUBLE END FROM s UNION ALL SELECT vec_id, 'visual_forensics', 'unavailable', NULL FROM s UNION ALL SELECT vec_id, 'explanations', 'completed', NULL FROM s")
def media_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both media models given, as scorers of the content's first byte; faces in every other image."""
    return _media_results(spark, sf_dir).select(F.col("case_id").alias("vec_id"), F.col("check").alias("check_name"), "status", F.round("score", 6).alias("score"))


def _media_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("case_id"), F.unhex(F.lpad(F.hex(F.col("vec_id") % 256), 2, "0")).alias("content"), (F.col("vec_id") % 2 == 0).alias("face_found"))
    generated = lambda: lambda batch: batch.map(lambda b: b[0] / 255).to_numpy()
    manipulated = lambda: lambda batch: batch.map(lambda b: 1 - b[0] / 255).to_numpy()
    return detect_media(rows, generated, manipulated)


@query(f"SELECT doc_id, outcome, CASE outcome WHEN 'suspicious' THEN 'Escalate to a reviewer with the findings.' WHEN 'inconclusive' THEN 'Ask for a better capture and review by hand.' ELSE 'Run the missing checks before deciding.' END AS action FROM (SELECT doc_id, {_STATUS} AS outcome FROM documents LEFT JOIN labels USING (doc_id)) WHERE outcome <> 'completed' ORDER BY CASE outcome WHEN 'suspicious' THEN 0 WHEN 'inconclusive' THEN 1 ELSE 2 END, doc_id LIMIT 50")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty cases to see first."""
    results = labelled_outcomes(spark, sf_dir).select(F.col("doc_id").alias("case_id"), F.lit("document").alias("workflow"), F.lit("tampering").alias("check"), "status", F.lit(None).cast("string").alias("reason"))
    return status.review_queue(status.disclosure(results)["summary"], 50).select(F.col("case_id").alias("doc_id"), "outcome", "action")


@query("SELECT c_custkey AS case_id, 2 AS n_items, 'metadata_provenance,tampering' AS checks, CASE WHEN c_custkey % 3 = 0 THEN round(c_acctbal / 10000, 6) END AS confidence FROM customer")
def assembled_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two checks of each case as one row; a confidence only where the score is calibrated."""
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.lit("document").alias("workflow"), (F.col("c_acctbal") / 10000).alias("score"))
    made = lambda check, score: own.select("case_id", "workflow", F.lit(check).alias("check"), F.lit("completed").alias("status"), F.lit(None).cast("string").alias("reason"), score.alias("score"))
    whole = status.assembled(made("tampering", F.col("score")), made("metadata_provenance", F.lit(None).cast("double")))
    score = F.element_at(F.filter("evidence", lambda e: e["check"] == "tampering"), 1)["score"]
    shown = status.supported_confidence(score, F.col("case_id") % 3 == 0)
    return whole.select("case_id", F.size("evidence").alias("n_items"), F.array_join(F.transform("evidence", lambda e: e["check"]), ",").alias("checks"), F.round(shown, 6).alias("confidence"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'image/png' END AS media_type, CASE WHEN page_id % 4 = 0 THEN 0 ELSE 2 + (page_id % 3 = 0)::INT END AS n_parts, page_id % 4 <> 0 AND page_id % 3 = 0 AS has_data,
 page_id % 4 <> 0 AND (page_id % 5 = 0 OR (page_id % 3 = 0 AND page_id % 7 = 0)) AS damaged, CASE WHEN page_id % 4 <> 0 AND page_id % 3 = 0 THEN 'completed' ELSE 'unavailable' END AS status FROM pages""")
def file_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A PNG file for each page: every third has the page's title as text, every fifth is cut off, every seventh has a
    wrong checksum there; every fourth is no image but the page itself, whatever letters it has."""
    four = lambda n: F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))
    chunk = lambda name, data, wrong=F.lit(0): F.concat(four(F.octet_length(data)), F.lit(name), data, four(F.crc32(F.concat(F.lit(name), data)).bitwiseXOR(wrong.cast("long"))))
    title = F.concat(F.lit(b"Title\x00"), F.encode(F.regexp_extract("html", "<title>([^<]*)</title>", 1), "UTF-8"))
    said = F.when(F.col("page_id") % 3 == 0, chunk(b"tEXt", title, F.when(F.col("page_id") % 7 == 0, 1).otherwise(0))).otherwise(F.lit(b""))
    end = F.when(F.col("page_id") % 5 == 0, F.lit(b"\x00\x00\x00\x00IEND\xae")).otherwise(chunk(b"IEND", F.lit(b"")))
    png = F.concat(F.lit(b"\x89PNG\r\n\x1a\n"), chunk(b"IHDR", F.lit(b"\x00\x00\x00\x01\x00\x00\x00\x01\x08\x00\x00\x00\x00")), said, end)
    content = F.when(F.col("page_id") % 4 == 0, F.encode("html", "UTF-8")).otherwise(png)
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), content.alias("content")).withColumn("length", F.octet_length("content").cast("long"))
    facts = evidence.file_facts(files)
    return facts.select(F.col("path").alias("page_id"), "media_type", F.size("parts").alias("n_parts"), F.col("has_text_chunk").alias("has_data"), "damaged", F.col("provenance_status").alias("status"))


@query("WITH t AS (SELECT 'manipulation' AS task, n_chars < 1000 AS f, toxic AS truth FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'identity', n_chars < 400, 1 - quality FROM documents JOIN labels USING (doc_id)) SELECT task, sum((f AND truth = 1)::INT)::BIGINT AS tp, sum((f AND truth = 0)::INT)::BIGINT AS fp, sum((NOT f AND truth = 0)::INT)::BIGINT AS tn, sum((NOT f AND truth = 1)::INT)::BIGINT AS fn FROM t GROUP BY task")
def manipulation_apart_from_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two tasks are measured apart; their errors never add up."""
    rows = labelled_outcomes(spark, sf_dir).filter("toxic is not null").select("n_chars", "toxic", "quality")
    flag = lambda limit: F.when(F.col("n_chars") < limit, "suspicious").otherwise("completed").alias("outcome")
    tasks = rows.select(F.lit("manipulation").alias("task"), flag(1000), F.col("toxic").alias("truth")).unionByName(rows.select(F.lit("identity").alias("task"), flag(400), (1 - F.col("quality")).alias("truth")))
    return evaluation.confusion(tasks, F.col("outcome"), F.col("truth"), ["task"]).select("task", "tp", "fp", "tn", "fn")


@query("SELECT vec_id, CASE WHEN n < 1.2 OR vec_id % 4 = 0 THEN 'inconclusive' ELSE 'completed' END AS status FROM (SELECT vec_id, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * (1 + vec_id % 3) AS n FROM embeddings)")
def capture_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poor captures are inconclusive, never suspicious."""
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (length * (1 + F.col("vec_id") % 3)).alias("sharpness"), F.when(F.col("vec_id") % 4 == 0, 100).otherwise(640).alias("width"), F.lit(480).alias("height"))
    return document_checks.quality_gate(rows, 1.2, 320).select("vec_id", F.col("quality_status").alias("status"))


@query("SELECT label, 'unavailable' AS outcome, count(*) AS n FROM embeddings GROUP BY label")
def media_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without weights every media check is unavailable; nothing is invented."""
    cases = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("case_id"), F.lit(None).cast("binary").alias("content"), (F.col("vec_id") % 2 == 0).alias("face_found"), "label")
    outcomes = status.case_outcomes(detect_media(cases))
    return outcomes.join(cases.select("case_id", "label"), "case_id").groupBy("label", "outcome").agg(F.count("*").alias("n"))


@query()
def svm_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear baseline, trained on texture, noise and frequency of tiles; its score is a margin."""
    tile = F.col("embedding")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", forensics.texture_variance(tile).alias("texture"), forensics.noise_residual(tile).alias("noise"), forensics.high_frequency_share(tile).alias("high"), (F.col("label") % 2).cast("double").alias("generated"))
    features = ["texture", "noise", "high"]
    return models.svm_scores(models.train_svm(rows, features, "generated"), rows, features).select("vec_id", "generated", "score")


@query("SELECT conv_id, count(*) AS n_turns, min(turn) AS first_turn, max(turn) AS last_turn, max(turn) - min(turn) + 1 = count(*) AND count(DISTINCT turn) = count(*) AS gapless FROM conversations GROUP BY conv_id")
def turn_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count_distinct("turn").alias("d"))
    return turns.select("conv_id", "n_turns", "first_turn", "last_turn", ((F.col("last_turn") - F.col("first_turn") + 1 == F.col("n_turns")) & (F.col("d") == F.col("n_turns"))).alias("gapless"))


_PACK = [
    ("chars_missing", "n_chars", "missing", None, "high"), ("few_chars", "n_chars", "below", "400", "low"), ("foreign", "lang", "none_of", "en, de", "low"),
    ("long_word", "text", "matches", "[a-z]{18}", "medium"), ("many_chars", "n_chars", "above", "10000", "medium"), ("no_source", "source", "missing", "", "high"), ("source_7", "source", "equals", "src7", "high"), ("very_long", "text", "longer", "12000", "high"),
]


@query("""WITH f AS (SELECT doc_id, unnest([CASE WHEN n_chars IS NULL THEN {'rule': 'chars_missing', 'g': 3} END, CASE WHEN n_chars < 400 THEN {'rule': 'few_chars', 'g': 1} END, CASE WHEN lang NOT IN ('en', 'de') THEN {'rule': 'foreign', 'g': 1} END,
 CASE WHEN regexp_matches(text, '[a-z]{18}') THEN {'rule': 'long_word', 'g': 2} END, CASE WHEN n_chars > 10000 THEN {'rule': 'many_chars', 'g': 2} END, CASE WHEN source IS NULL OR trim(source) = '' THEN {'rule': 'no_source', 'g': 3} END, CASE WHEN source = 'src7' THEN {'rule': 'source_7', 'g': 3} END, CASE WHEN length(text) > 12000 THEN {'rule': 'very_long', 'g': 3} END]) AS f FROM documents),
w AS (SELECT doc_id, f.rule AS rule, f.g AS g, max(f.g) OVER (PARTITION BY doc_id) AS most FROM f WHERE f IS NOT NULL)
SELECT doc_id, ['low', 'medium', 'high'][most] AS severity, string_agg(rule, ',' ORDER BY rule) AS rules FROM w WHERE g = most GROUP BY doc_id, most""")
def rule_pack_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack of eight rules over all documents: the gravest findings of each."""
    pack = spark.createDataFrame(_PACK, "rule string, field string, test string, operand string, severity string")
    found = rule_packs.pack_findings(table(spark, sf_dir, "documents"), pack, ["doc_id"])
    worst = rule_packs.case_severity(found, ["doc_id"], ("low", "medium", "high"))
    return worst.select("doc_id", "severity", F.array_join("rules", ",").alias("rules"))


@query(f"SELECT doc_id, 'tampering' AS check_name, {_STATUS} AS status, CASE WHEN toxic IS NOT NULL THEN CASE WHEN toxic = 1 THEN 1.0 WHEN quality = 0 THEN 0.5 ELSE 0.0 END END AS score FROM documents LEFT JOIN labels USING (doc_id)")
def expert_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third level of detail: every result with its score, as the checks gave it."""
    score = F.when(F.col("toxic").isNotNull(), F.when(F.col("toxic") == 1, 1.0).when(F.col("quality") == 0, 0.5).otherwise(0.0))
    results = labelled_outcomes(spark, sf_dir).select(F.col("doc_id").alias("case_id"), F.lit("document").alias("workflow"), F.lit("tampering").alias("check"), "status", F.lit(None).cast("string").alias("reason"), score.alias("score"))
    return status.disclosure(results)["expert"].select(F.col("case_id").alias("doc_id"), F.col("check").alias("check_name"), "status", "score")


_SAID = "CASE WHEN {s} >= 0.8 THEN '{n}: suspicious. The score is above the threshold.' WHEN {s} >= 0.4 THEN '{n}: inconclusive. The score lies between the thresholds.' END"


@query(f"""WITH s AS (SELECT vec_id, vec_id % 2 = 0 AS face, (vec_id % 256) / 255.0 AS g, 1 - (vec_id % 256) / 255.0 AS m FROM embeddings)
SELECT vec_id, concat_ws(chr(10), CASE WHEN NOT face THEN 'Deepfake / face manipulation: unavailable. No face was found.' ELSE {_SAID.format(s='m', n='Deepfake / face manipulation')} END, {_SAID.format(s='g', n='AI-generated image screening')}, 'Visual forensic signals: unavailable. The model for this check is not installed.') AS text FROM s""")
def media_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer reads of each image, in sentences."""
    return status.explanations(_media_results(spark, sf_dir)).select(F.col("case_id").alias("vec_id"), "text")


@query("""WITH s AS (SELECT vec_id, vec_id % 2 = 0 AS face, (vec_id % 256) / 255.0 AS g, 1 - (vec_id % 256) / 255.0 AS m FROM embeddings),
r AS (SELECT vec_id, face, CASE WHEN g >= 0.8 THEN 's' WHEN g >= 0.4 THEN 'i' ELSE 'c' END AS a, CASE WHEN NOT face THEN 'u' WHEN m >= 0.8 THEN 's' WHEN m >= 0.4 THEN 'i' ELSE 'c' END AS b FROM s)
SELECT vec_id, 1 AS ai, face::INT AS deepfake, 1 AS faces, 1 + face::INT AS confidences, (a = 'i')::INT + (b = 'i')::INT AS inconclusive, 1 + (NOT face)::INT AS unavailable, CASE WHEN 's' IN (a, b) THEN 'suspicious' WHEN 'i' IN (a, b) THEN 'inconclusive' ELSE 'checks_completed' END AS outcome FROM r""")
def evidence_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many results each image has under each kind of evidence, and the outcome that its action goes by."""
    view = status.evidence_view(_media_results(spark, sf_dir))
    kinds = status.EVIDENCE["media"]
    count = lambda k, name: F.count_if(F.col("kind") == kinds[k]).cast("int").alias(name)
    counted = view.groupBy(F.col("case_id").alias("vec_id")).agg(count(0, "ai"), count(1, "deepfake"), count(2, "faces"), count(4, "confidences"), count(5, "inconclusive"), count(6, "unavailable"), F.max(F.when(F.col("kind") == kinds[7], F.col("status"))).alias("outcome"))
    return counted


def _without_digits(content: bytes) -> str | None:
    """Stands for an OCR engine: it reads bytes of text, but no digits, and nothing of short ones."""
    text = "".join(c for c in content.decode() if not "0" <= c <= "9")
    return text if len(text) > 300 else None


@query("WITH t AS (SELECT doc_id, n_chars, regexp_replace(text, '[0-9]', '', 'g') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 300 THEN md5(t) END AS text_md5, CASE WHEN length(t) <= 300 THEN 'unavailable' WHEN n_chars < 800 THEN 'inconclusive' ELSE 'completed' END AS status FROM t")
def engine_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts from a pluggable engine: unavailable where it read none, inconclusive where the capture was poor."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.encode("text", "UTF-8").alias("content"), F.when(F.col("n_chars") < 800, "inconclusive").otherwise("completed").alias("quality"))
    read = evidence.with_text(docs, _without_digits).drop("content")
    found = document_checks.ocr_results(read.withColumn("case_id", F.struct("case_id", F.md5("text").alias("text_md5"))), "text", "quality")
    return found.select(F.col("case_id.case_id").alias("doc_id"), "case_id.text_md5", "status")
