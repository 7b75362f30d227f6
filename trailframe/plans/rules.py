"""More queries: paths, headers, lookups, joins of result tables, exact samples, measures. Importing this adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailframe.functions import arrays, exif, geometry, paths, times
from trailframe.operators import curation, detections, metrics, sampling, scores
from trailframe.plans.catalog import CONF, PARTS, PRED, PROBS, TOP, _images, _predicted, _probs, _t, _top, query

SHOT = "'X:\\' || 'A' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '\\' || c_mktsegment || '\\' || c_name || '.JPG'"


@query(f"""SELECT c_custkey, {SHOT} AS path, 'A' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS location, c_mktsegment AS folder_class, lower(c_mktsegment) AS listed_class, c_name AS stem, '.jpg' AS suffix,
'A' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS grandparent, 'A' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '-' || c_name || '.JPG' AS crop_name FROM customer""")
def labels_from_paths(spark, sf_dir):
    camera = F.concat(F.lit("A"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("\\", F.lit("X:"), camera, "c_mktsegment", F.concat("c_name", F.lit(".JPG"))).alias("path"))
    p = F.col("path")
    known = ["automobile", "building", "furniture", "household", "machinery"]
    location = paths.location_code(p)
    return rows.select("c_custkey", "path", location.alias("location"), paths.class_after_location(p).alias("folder_class"), paths.class_name(p, known).alias("listed_class"), paths.stem(p).alias("stem"),
                       paths.suffix(p).alias("suffix"), paths.parent_name(p, 2).alias("grandparent"), F.concat_ws("-", location, paths.base_name(p)).alias("crop_name"))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '   ' ELSE strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') END AS original,
CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE '2020:01:01 00:00:00' END AS changed, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN ' ' ELSE o_orderpriority END AS d FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'file_not_valid' WHEN o_orderkey % 7 = 0 THEN 'exif_not_found' ELSE coalesce(CASE WHEN trim(original) <> '' THEN original END, changed, 'dt_not_found') END AS date_time,
CASE WHEN o_orderkey % 11 = 0 THEN 'file_not_valid' WHEN o_orderkey % 7 = 0 THEN 'exif_not_found' WHEN d = ' ' THEN 'description_not_found' ELSE d END AS description FROM t""")
def exif_tags(spark, sf_dir):
    k = F.col("o_orderkey")
    original = F.when(k % 3 == 1, "   ").when(k % 3 == 2, F.date_format("o_orderdate", times.CAMERA))
    changed = F.when(k % 4 != 0, "2020:01:01 00:00:00")
    description = F.when(k % 5 == 0, "").when(k % 5 == 1, " ").otherwise(F.col("o_orderpriority"))
    tags = exif.date_and_description(changed, original, description, k % 7 != 0, k % 11 != 0)
    return _t(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(n) for n, c in tags.items()])


@query("SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier")
def union_by_name(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = _t(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(_t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")))


@query(f"{TOP} SELECT vec_id, label AS target, prediction, probability, confidence, round_even(probs[1], 4) AS c0 FROM top JOIN probs USING (vec_id)")
def assemble_results(spark, sf_dir):
    best = _top(spark, sf_dir)
    p = _probs(spark, sf_dir)
    tables = [p.select("vec_id", F.col("label").alias("target")), best.select("vec_id", "prediction", "probability"), best.select("vec_id", "confidence"), p.select("vec_id", F.bround(F.get("probs", F.lit(0)), 4).alias("c0"))]
    return scores.assembled(tables, "vec_id")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderkey) NOT IN (SELECT (o_custkey, o_orderkey) FROM orders WHERE o_orderstatus = 'F') ORDER BY o_orderdate, o_custkey, o_orderkey LIMIT 10")
def run_queue(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    waiting = detections.unseen(orders, orders.where("o_orderstatus = 'F'"), ["o_custkey", "o_orderkey"])
    return waiting.orderBy("o_orderdate", "o_custkey", "o_orderkey").limit(10).select("o_custkey", "o_orderkey")


HASHED = "WITH k AS (SELECT event_id, row_number() OVER (ORDER BY md5(concat_ws('|', event_id, '0')), event_id) AS n, count(*) OVER () AS a FROM events) "


@query(HASHED + "SELECT event_id FROM k WHERE n <= round_even(0.137 * a, 0)")
def fraction_sample(spark, sf_dir):
    return sampling.sample_exact(_t(spark, sf_dir, "events").select("event_id"), "event_id", 0.137)


@query(HASHED + "SELECT event_id FROM k WHERE (n - 1) % 20 = 0")
def stride_20(spark, sf_dir):
    return sampling.stride(_t(spark, sf_dir, "events").select("event_id"), "event_id", 20)


@query("""WITH k AS (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS w, md5(concat_ws('|', event_id, '0')) AS h FROM events),
l AS (SELECT event_id, CAST(sum(w) OVER (ORDER BY h, event_id ROWS UNBOUNDED PRECEDING) - w AS BIGINT) AS s FROM k WHERE w >= 1), a AS (SELECT CAST(sum(w) AS BIGINT) AS a FROM k WHERE w >= 1),
d AS (SELECT i AS draw, CAST(floor((CAST(('0x' || substr(md5(concat_ws('|', i, '1')), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE * a) AS BIGINT) AS s FROM range(0, 2000) t(i), a)
SELECT draw, event_id FROM d ASOF JOIN l ON d.s >= l.s""")
def weighted_draws(spark, sf_dir):
    return sampling.weighted_draws(_t(spark, sf_dir, "events"), "event_id", F.floor(F.col("value") * 100), 2000)


@query()
def group_cap_diverse(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("seconds", times.seconds_since(F.col("ts"))).select("event_id", "event_type", "user_id", "seconds", "value")
    return sampling.diverse_rows(rows, ["user_id", "event_type"], "event_id", ["seconds", "value"], 10, 40)


@query("""SELECT vec_id % 100 AS video, arg_min(label, vec_id) FILTER (label % 2 = 1) AS first_label, max(label) / 10.0 AS confidence FROM embeddings GROUP BY vec_id % 100""")
def video_metadata(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select((F.col("vec_id") % 100).alias("video"), "vec_id", F.when(F.col("label") % 2 == 1, F.col("label")).alias("first_label"), (F.col("label") / 10).alias("confidence"))
    return scores.video_metadata(rows, "video", "vec_id", ["first_label"], "confidence")


@query(f"SELECT coalesce({PARTS}[-2], '') AS folder, count(*) AS n FROM pages GROUP BY ALL")
def files_per_folder(spark, sf_dir):
    return curation.group_sizes(_t(spark, sf_dir, "pages").select(paths.parent_name(F.col("url")).alias("folder")), ["folder"])


@query(f"""{PRED}, c AS (SELECT t.label, count(*) FILTER (target = t.label AND prediction = t.label) AS tp, count(*) FILTER (target <> t.label AND prediction = t.label) AS fp,
count(*) FILTER (target = t.label AND prediction <> t.label) AS fn FROM pred, (SELECT DISTINCT target AS label FROM pred) t GROUP BY t.label)
SELECT round(avg(tp / (tp + fn)), 6) AS balanced_accuracy, round(avg(2 * tp / (2 * tp + fp + fn)), 6) AS macro_f1, count(*) AS n_classes FROM c""")
def balanced_accuracy(spark, sf_dir):
    rows = metrics.macro(_predicted(spark, sf_dir), "target", "prediction")
    return rows.select(F.round("balanced_accuracy", 6).alias("balanced_accuracy"), F.round("macro_f1", 6).alias("macro_f1"), "n_classes")


@query(f"WITH {PROBS} SELECT round(avg(-ln(probs[label + 1])), 6) AS cross_entropy, round(avg(pow(1 - probs[label + 1], 2) * -ln(probs[label + 1])), 6) AS focal FROM probs")
def mean_loss(spark, sf_dir):
    p, label = F.col("probs"), F.col("label")
    means = metrics.mean_loss(_probs(spark, sf_dir), {"cross_entropy": arrays.focal_loss(p, label, 0.0), "focal": arrays.focal_loss(p, label)})
    return means.select(*[F.round(c, 6).alias(c) for c in means.columns])


@query("""SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS low, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS middle,
quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS high FROM lineitem GROUP BY l_returnflag""")
def describe(spark, sf_dir):
    rows = metrics.described(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")
    return rows.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus, CASE o_orderpriority WHEN '1-URGENT' THEN 'first' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def replace_cells(spark, sf_dir):
    names = {"F": "done", "O": "open", "1-URGENT": "first"}
    return _t(spark, sf_dir, "orders").select("o_orderkey", *[curation.renamed(F.col(c), names).alias(c) for c in ("o_orderstatus", "o_orderpriority")])


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'third' WHEN 'view' THEN 'third' ELSE event_type END AS chained FROM events")
def renames_in_turn(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", curation.renamed_in_turn(F.col("event_type"), {"click": "view", "view": "third"}).alias("chained"))


@query("SELECT * FROM (SELECT p_partkey, p_type FROM part) WHERE p_type IN (SELECT p_type FROM part GROUP BY p_type HAVING count(*) >= 30)")
def without_rare_classes(spark, sf_dir):
    return curation.without_rare(_t(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", 30)


@query("""WITH b AS (SELECT o_orderkey, CAST(o_orderkey % 500 + 100 AS INT) AS w, CAST(o_orderkey % 311 + 50 AS INT) AS h FROM orders)
SELECT o_orderkey, CAST(floor((greatest(w, h, 480) - w) / 2) AS INT) AS pad_left, CAST(floor((greatest(w, h, 480) - h) / 2) AS INT) AS pad_top, CAST(floor((w - least(w, h)) / 2) AS INT) AS crop_left, CAST(floor((h - least(w, h)) / 2) AS INT) AS crop_top, least(w, h) AS side FROM b""")
def pad_and_centre(spark, sf_dir):
    w, h = F.col("w"), F.col("h")
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 500 + 100).cast("int").alias("w"), (F.col("o_orderkey") % 311 + 50).cast("int").alias("h"))
    full, cut = F.greatest(w, h, F.lit(480)), geometry.centre_square(w, h)
    return rows.select("o_orderkey", geometry.pad_offset(w, full).alias("pad_left"), geometry.pad_offset(h, full).alias("pad_top"), cut["left"].alias("crop_left"), cut["top"].alias("crop_top"), cut["side"].alias("side"))


@query("SELECT o_orderkey, strftime(o_orderdate + to_milliseconds((o_orderkey % 20) * 500), '%Y-%m-%d %H:%M:%S.%g') AS frame_time FROM orders")
def frame_times(spark, sf_dir):
    moved = times.add_milliseconds(F.col("o_orderdate"), F.col("o_orderkey") % 20 * 500)
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.date_format(moved, "yyyy-MM-dd HH:mm:ss.SSS").alias("frame_time"))


@query(f"""WITH b AS (SELECT conv_id AS file, arg_max(CAST(turn AS DOUBLE), ({CONF}, -turn)) AS x_min FROM conversations GROUP BY conv_id)
SELECT file, CASE quality WHEN 1 THEN 3 ELSE 0 END AS category, quality * 0.5::DOUBLE AS conf, x_min FROM b JOIN labels ON file = doc_id""")
def replaced_detections(spark, sf_dir):
    said = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("file"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("encounter"), (F.col("quality") * 0.5).alias("max_prob"))
    rows = detections.replaced(_images(spark, sf_dir), said, F.array(F.lit("q1"), F.lit("dog")))
    return rows.select("file", "category", "conf", F.get("bbox", F.lit(0)).alias("x_min"))
