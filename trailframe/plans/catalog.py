"""Queries over the library's own operators, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.functions import arrays, geometry, paths, schedules, times
from trailframe.operators import curation, detections, metrics, scores
from trailframe.operators.encounters import encounters as find_encounters

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Classes of the vectors: softmax of the first ten numbers, eight times each.
CLASSES = [f"c{i}" for i in range(10)]


def _probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    first = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 8)
    return e.select("vec_id", "label", arrays.softmax(first).alias("probs"))


PROBS = """
x AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda v: CAST(v AS DOUBLE) * 8) AS l FROM embeddings),
ex AS (SELECT vec_id, label, list_transform(l, lambda v: exp(v - list_max(l))) AS e FROM x),
probs AS (SELECT vec_id, label, list_transform(e, lambda v: v / list_sum(e)) AS probs FROM ex),
long AS (SELECT vec_id, label, i - 1 AS i, probs[i] AS p, round_even(probs[i], 4) AS r FROM probs, range(1, 11) t(i))"""

ENCOUNTERS = """
WITH src AS ({src}),
b AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts ASC NULLS LAST, event_id) AS prev FROM src),
o AS (SELECT *, CASE WHEN ts IS NOT NULL AND (prev IS NULL OR ts - prev > INTERVAL 6 HOUR) THEN ts END AS opened FROM b),
s AS (SELECT *, last_value(opened IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ASC NULLS LAST, event_id ROWS UNBOUNDED PRECEDING) AS start FROM o),
w AS (SELECT *, first_value(event_type) OVER g AS best, max(value) OVER (PARTITION BY user_id, start) AS most FROM s
      WINDOW g AS (PARTITION BY user_id, start ORDER BY value DESC NULLS LAST, ts ASC NULLS LAST, event_id))
SELECT event_id, user_id, start AS encounter_start, CASE WHEN ts IS NULL OR start IS NULL THEN event_type ELSE best END AS encounter,
       CASE WHEN ts IS NULL OR start IS NULL THEN value ELSE most END AS max_prob FROM w"""


@query(ENCOUNTERS.format(src="SELECT * FROM events"))
def encounters(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
    return find_encounters(e, "user_id", "ts", "value", "event_type", "event_id", 6 * 3600).select("event_id", "user_id", "encounter_start", "encounter", "max_prob")


@query(ENCOUNTERS.format(src="SELECT event_id, user_id, CASE WHEN event_id % 17 <> 0 THEN ts END AS ts, value, event_type FROM events"))
def encounters_undated(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("ts", F.when(F.col("event_id") % 17 != 0, F.col("ts")))
    return find_encounters(e, "user_id", "ts", "value", "event_type", "event_id", 6 * 3600).select("event_id", "user_id", "encounter_start", "encounter", "max_prob")


def _top(spark, sf_dir):
    classes = F.array(*[F.lit(c) for c in CLASSES])
    return scores.top_three(_probs(spark, sf_dir), "probs", classes).withColumn("confidence", F.col("label") / 10)


RANKED = f"WITH {PROBS}, k AS (SELECT vec_id, label, i, r, row_number() OVER (PARTITION BY vec_id ORDER BY r DESC, i) AS n FROM long), "
TOP = RANKED + "top AS (SELECT vec_id, any_value(label) / 10.0 AS confidence, " + ", ".join(f"max(CASE WHEN n = {n} THEN 'c' || i END) AS {a}, max(CASE WHEN n = {n} THEN r END) AS {b}" for n, a, b in ((1, "prediction", "probability"), (2, "second_pred", "second_prob"), (3, "third_pred", "third_prob"))) + " FROM k GROUP BY vec_id)"
SIX = "prediction, probability, second_pred, second_prob, third_pred, third_prob"


@query(f"{TOP} SELECT vec_id, {SIX} FROM top")
def top3_predictions(spark, sf_dir):
    return _top(spark, sf_dir).select("vec_id", *SIX.split(", "))


@query(f"{TOP} SELECT vec_id, " + ", ".join(f"CASE WHEN confidence < 0.15 THEN {'0.0' if 'prob' in c else chr(39) + 'empty' + chr(39)} ELSE {c} END AS {c}" for c in SIX.split(", ")) + " FROM top")
def relabel_empties(spark, sf_dir):
    return scores.relabel_empties(_top(spark, sf_dir), "confidence", 0.15).select("vec_id", *SIX.split(", "))


@query(f"{TOP} SELECT vec_id, 'above' AS side FROM top WHERE confidence > 0.5 UNION ALL SELECT vec_id, 'not_above' FROM top WHERE confidence <= 0.5")
def md_split(spark, sf_dir):
    above, below = scores.split_by_confidence(_top(spark, sf_dir), "confidence", 0.5)
    return above.select("vec_id", F.lit("above").alias("side")).unionByName(below.select("vec_id", F.lit("not_above").alias("side")))


@query(f"{TOP} SELECT vec_id, CASE WHEN confidence < 0.35 AND probability < 0.6 THEN 'empty' WHEN confidence = 0.9 THEN 'empty' ELSE prediction END AS encounter FROM top")
def empty_mask(spark, sf_dir):
    t = _top(spark, sf_dir).withColumn("encounter", F.when(F.col("confidence") == 0.9, scores.NO_BOX).otherwise(F.col("prediction")))
    return scores.empty_encounters(t, "confidence", 0.35, "probability", 0.6).select("vec_id", "encounter")


@query("SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'unprocessed') AS result FROM documents d LEFT JOIN labels l USING (doc_id)")
def unprocessed(spark, sf_dir):
    scored = _t(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("result"))
    known = detections.seen(scored, _t(spark, sf_dir, "documents"), ["doc_id"])
    return scores.with_unprocessed(_t(spark, sf_dir, "documents"), known, "doc_id", "result")


@query(f"""WITH {PROBS}, f AS (SELECT vec_id % 100 AS video, label / 10.0 AS c, i, p FROM long),
g AS (SELECT video, i, avg(p) FILTER (c > 0.7) AS sure, avg(p) AS everything, count(*) FILTER (c > 0.7) AS ns, count(*) AS n, max(c) FILTER (c > 0.7) AS cs, max(c) AS ca FROM f GROUP BY video, i),
v AS (SELECT video, i, coalesce(sure, everything) AS p, CASE WHEN ns > 0 THEN ns ELSE n END AS n, coalesce(cs, ca) AS c FROM g)
SELECT video, arg_max('c' || i, (round_even(p, 6), -i)) AS prediction, round_even(max(p), 6) AS probability, max(n) AS n_frames, max(c) AS confidence FROM v GROUP BY video""")
def video_collapse(spark, sf_dir):
    frames = _probs(spark, sf_dir).select((F.col("vec_id") % 100).alias("video"), F.col("vec_id").alias("frame"), (F.col("label") / 10).alias("confidence"), "probs")
    rows = scores.collapse_videos(frames, "video", "frame", "confidence", "probs")
    best = F.get(arrays.ranked(F.col("probs"), 6), F.lit(0))
    return rows.select("video", F.concat(F.lit("c"), best["index"].cast("string")).alias("prediction"), best["value"].alias("probability"), "n_frames", "confidence")


def _scored(spark, sf_dir):
    rows = _probs(spark, sf_dir).select("label", F.posexplode("probs").alias("class", "p"))
    return rows.select("class", F.bround("p", 6).alias("score"), (F.col("class") == F.col("label")).cast("int").alias("hit"))


AP = f"""WITH {PROBS}, t AS (SELECT i AS class, round_even(p, 6) AS score, CASE WHEN i = label THEN 1 ELSE 0 END AS hit FROM long),
u AS (SELECT class, score, sum(hit) AS tp, count(*) AS n FROM t GROUP BY class, score),
v AS (SELECT class, tp, sum(tp) OVER w AS tps, sum(n) OVER w AS ns, sum(tp) OVER (PARTITION BY class) AS support FROM u WINDOW w AS (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT class, CAST(max(support) AS BIGINT) AS support, sum(CAST(tp AS DOUBLE) / support * tps / ns) AS ap FROM v WHERE support > 0 GROUP BY class)"""


@query(f"{AP} SELECT class, support, round(ap, 6) AS ap FROM ap")
def average_precision(spark, sf_dir):
    return metrics.average_precision(_scored(spark, sf_dir), "class", "score", "hit").withColumn("ap", F.round("ap", 6))


@query(f"{AP} SELECT round(avg(ap), 6) AS macro_map, count(*) AS n_classes FROM ap")
def macro_map(spark, sf_dir):
    return metrics.average_precision(_scored(spark, sf_dir), "class", "score", "hit").agg(F.round(F.avg("ap"), 6).alias("macro_map"), F.count("*").alias("n_classes"))


PRED = RANKED + "pred AS (SELECT vec_id, label AS target, i AS prediction FROM k WHERE n = 1)"


def _predicted(spark, sf_dir):
    best = F.get(arrays.ranked(F.col("probs"), 4), F.lit(0))["index"]
    return _probs(spark, sf_dir).select("vec_id", F.col("label").alias("target"), best.alias("prediction"))


@query(f"{PRED} SELECT avg(CASE WHEN target = prediction THEN 1.0 ELSE 0.0 END) AS accuracy FROM pred")
def accuracy(spark, sf_dir):
    return metrics.accuracy(_predicted(spark, sf_dir), "target", "prediction")


@query(f"{PRED} SELECT target, prediction, count(*) AS n FROM pred GROUP BY target, prediction")
def confusion(spark, sf_dir):
    return metrics.confusion(_predicted(spark, sf_dir), "target", "prediction")


@query(f"""{PRED}, c AS (SELECT t.label, count(*) FILTER (target = t.label AND prediction = t.label) AS tp, count(*) FILTER (target <> t.label AND prediction = t.label) AS fp,
count(*) FILTER (target = t.label AND prediction <> t.label) AS fn FROM pred, (SELECT target AS label FROM pred UNION SELECT prediction FROM pred) t GROUP BY t.label)
SELECT label, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c""")
def precision_recall_f1(spark, sf_dir):
    rows = metrics.class_scores(_predicted(spark, sf_dir), "target", "prediction")
    return rows.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"""{TOP}, t AS (SELECT unnest([0.1, 0.25, 0.5, 0.75]) AS threshold),
z AS (SELECT CAST(threshold AS DOUBLE) AS threshold, confidence < threshold AND probability < threshold AS said, prediction IN ('c0', 'c1') AS fact FROM top, t),
c AS (SELECT threshold, count(*) FILTER (said AND fact) AS tp, count(*) FILTER (said AND NOT fact) AS fp, count(*) FILTER (NOT said AND NOT fact) AS tn,
  count(*) FILTER (NOT said AND fact) AS fn FROM z GROUP BY threshold)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall FROM c""")
def empty_threshold_sweep(spark, sf_dir):
    t = _top(spark, sf_dir).withColumn("fact", F.col("prediction").isin("c0", "c1"))
    rows = metrics.threshold_sweep(t, "confidence", "probability", "fact", [0.1, 0.25, 0.5, 0.75])
    return rows.withColumns({c: F.round(c, 9) for c in ("precision", "recall")})


KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, '0')), l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn,
count(*) OVER (PARTITION BY l_suppkey, l_returnflag) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM k WHERE rn <= 50 + least(greatest(floor((n - 50) / 2), 0), 200) AND rn <= 250""")
def group_cap_adaptive(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(*KEY, "l_returnflag")
    return curation.cap_groups_adaptive(rows, ["l_suppkey", "l_returnflag"], KEY, 50, 250).select(*KEY)


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY md5(concat_ws('|', event_id, '0')), event_id) AS rn FROM events)
SELECT event_id, user_id, event_type FROM k WHERE rn <= 12""")
def group_cap_random(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return curation.cap_groups(rows, ["user_id", "event_type"], ["event_id"], 12)


@query("""WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', doc_id, '0')), doc_id) AS rn, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN rn <= floor(0.1 * n) THEN 'test' WHEN rn <= floor(0.1 * n) + floor(0.1 * n) THEN 'val' ELSE 'train' END AS part FROM k""")
def split_80_10_10(spark, sf_dir):
    return curation.split(_t(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
SELECT event_type, n, round(avg(n) OVER () / n, 9) AS weight, round(avg(sqrt(n)) OVER () / sqrt(n), 9) AS root_weight,
round(1 / sqrt(n), 9) AS sampling_weight FROM c""")
def class_weights(spark, sf_dir):
    rows = curation.class_weights(_t(spark, sf_dir, "events"), "event_type")
    return rows.withColumns({c: F.round(c, 9) for c in ("weight", "root_weight", "sampling_weight")})


@query("""SELECT event_id FROM (SELECT event_id, -ln((CAST(('0x' || substr(md5(concat_ws('|', event_id, '0')), 1, 12)) AS BIGINT) + 0.5) / 281474976710656.0) / value AS e FROM events ORDER BY e, event_id LIMIT 500)""")
def weighted_sample(spark, sf_dir):
    return curation.weighted_sample(_t(spark, sf_dir, "events"), "event_id", F.col("value"), 500).select("event_id")


@query("SELECT event_id, CAST(event_type = 'click' AS INT) AS click, CAST(event_type = 'error' AS INT) AS error, CAST(event_type = 'purchase' AS INT) AS purchase, CAST(event_type = 'view' AS INT) AS \"view\" FROM events")
def one_hot(spark, sf_dir):
    names = ["click", "error", "purchase", "view"]
    hot = arrays.one_hot(names, F.col("event_type"))
    return _t(spark, sf_dir, "events").select("event_id", *[F.get(hot, F.lit(i)).alias(n) for i, n in enumerate(names)])


@query("""WITH p AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_brand END AS b FROM part)
SELECT p_partkey, CASE WHEN b IN ('Brand#11', 'Brand#12') THEN 'first' ELSE b END AS brand FROM p
WHERE (b IS NULL OR b NOT IN ('Brand#13', 'Brand#22')) AND (p_size >= 25 OR b IN ('Brand#11', 'Brand#21'))""")
def filters_renames(spark, sf_dir):
    part = _t(spark, sf_dir, "part").withColumn("p_brand", F.when(F.col("p_partkey") % 10 != 0, F.col("p_brand")))
    rows = curation.without(part, "p_brand", ["Brand#13", "Brand#22"])
    rows = curation.confident_or_rare(rows, "p_size", 25, "p_brand", ["Brand#11", "Brand#21"])
    merged = curation.inverted({"first": ["Brand#11", "Brand#12"]})
    return rows.select("p_partkey", curation.renamed(F.col("p_brand"), merged).alias("brand"))


PARTS = "regexp_split_to_array(url, '[\\\\/]')"


@query("""WITH f AS (SELECT page_id, list_filter(regexp_split_to_array(upper(url), '[\\\\/]'), lambda p: length(p) = 2 AND p <> lower(p)) AS c FROM pages)
SELECT page_id, CASE WHEN len(c) = 1 THEN c[1] ELSE 'unknown' END AS location FROM f""")
def location_from_path(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", paths.location_code(F.upper("url"), 2).alias("location"))


@query(f"WITH f AS (SELECT page_id, list_filter({PARTS}, lambda p: lower(p) IN ('en', 'de', 'fr')) AS c FROM pages) SELECT page_id, coalesce(lower(c[1]), 'unknown') AS class FROM f")
def class_from_path(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", paths.class_name(F.col("url"), ["en", "de", "fr"]).alias("class"))


@query("SELECT o_orderkey, replace(o_orderpriority, '-', '__') AS description, array_to_string(string_split(replace(o_orderpriority, '-', '__'), '__')[1:2], '-') AS camera FROM orders")
def camera_id(spark, sf_dir):
    text = F.replace(F.col("o_orderpriority"), F.lit("-"), F.lit("__"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", text.alias("description"), paths.camera_id(text).alias("camera"))


@query(f"""SELECT page_id, list_last({PARTS}) AS name, coalesce({PARTS}[-2], '') AS parent, '/data/' || url AS absolute, ltrim(replace(url, 'https://', ''), '/') AS relative FROM pages""")
def path_parts(spark, sf_dir):
    url = F.col("url")
    return _t(spark, sf_dir, "pages").select("page_id", paths.base_name(url).alias("name"), paths.parent_name(url).alias("parent"), paths.absolute(url, "/data").alias("absolute"), paths.relative(url, "https://").alias("relative"))


@query("SELECT o_orderkey, 'D:\\clips\\' || o_orderkey || '.mp4' AS path, 'D-_clips-_' || o_orderkey || '_mp4_' || lpad(CAST(o_orderkey % 20 AS VARCHAR), 4, '0') || '.jpg' AS frame FROM orders")
def encode_decode_video_path(spark, sf_dir):
    path = F.concat(F.lit("D:\\clips\\"), F.col("o_orderkey").cast("string"), F.lit(".mp4"))
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", paths.encode_frame(path, F.col("o_orderkey") % 20).alias("frame"))
    return rows.select("o_orderkey", paths.decode_frame(F.col("frame")).alias("path"), "frame")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


CONF = "CAST(('0x' || substr(md5(concat_ws('|', conv_id, turn, role, '0')), 1, 6)) AS BIGINT)"


def _images(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations")
    conf = F.conv(F.substr(curation.order_of(0, "conv_id", "turn", "role"), F.lit(1), F.lit(6)), 16, 10).cast("double")
    found = turns.select(F.col("conv_id").alias("file"), "turn", F.struct(F.col("role").alias("category"), conf.alias("conf"), F.array(F.col("turn").cast("double"), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("bbox")).alias("d"))
    return found.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "d"))), lambda x: x["d"]).alias("detections"))


@query(f"SELECT conv_id AS file, max({CONF}) AS conf, arg_max(CAST(turn AS DOUBLE), ({CONF}, -turn)) AS x_min FROM conversations GROUP BY conv_id")
def best_detection(spark, sf_dir):
    best = detections.best(F.col("detections"))
    return _images(spark, sf_dir).select("file", best["conf"].cast("long").alias("conf"), F.get(best["bbox"], F.lit(0)).alias("x_min"))


@query(f"SELECT conv_id AS file, CAST({CONF} AS DOUBLE) AS confidence, CAST(turn AS DOUBLE) AS x_min, 0.0::DOUBLE AS y_min, 1.0::DOUBLE AS width, 1.0::DOUBLE AS height FROM conversations")
def explode_detections(spark, sf_dir):
    return detections.flatten(_images(spark, sf_dir).withColumn("detections", F.transform("detections", lambda d: F.struct(F.lit("1").alias("category"), d["conf"].alias("conf"), d["bbox"].alias("bbox")))), best_only=False).drop("mega_class")


@query(f"SELECT conv_id AS file, role AS category, CAST({CONF} AS DOUBLE) AS conf, CAST(turn AS DOUBLE) AS x_min FROM conversations")
def export_json(spark, sf_dir):
    back = detections.export_json(_images(spark, sf_dir)).select("file", F.from_json("json", f"detections array<{detections.DETECTION}>").alias("j"))
    rows = back.select("file", F.explode("j.detections").alias("d"))
    return rows.select("file", "d.category", "d.conf", F.get("d.bbox", F.lit(0)).alias("x_min"))


@query("""SELECT o_orderkey, o.o_custkey AS file, c.Date_Time, c.Description FROM orders o
JOIN (SELECT c_custkey, c_mktsegment AS Date_Time, c_name AS Description FROM customer UNION ALL SELECT c_custkey, 'again', c_name FROM customer WHERE c_custkey % 5 = 0) c
ON o.o_custkey = c.c_custkey""")
def exif_join(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), F.col("c_mktsegment").alias("Date_Time"), F.col("c_name").alias("Description"))
    cache = c.unionByName(c.where("file % 5 = 0").withColumn("Date_Time", F.lit("again")))
    return detections.with_tags(_t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("file")), cache, "file").select("o_orderkey", "file", "Date_Time", "Description")


@query("SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_new(spark, sf_dir):
    return detections.unseen(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem WHERE (l_suppkey, l_returnflag) IN (SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_quantity > 45)")
def missing_dirs(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem")
    return detections.seen(rows.select("l_suppkey", "l_returnflag"), rows.where("l_quantity > 45"), ["l_suppkey", "l_returnflag"]).distinct()


@query("""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'dt_not_found' WHEN o_orderkey % 9 = 2 THEN strftime(o_orderdate, '%Y:%-m:%-d %-H:%-M:%-S') WHEN o_orderkey % 9 = 5 THEN strftime(o_orderdate, '%-d/%-m/%Y  %-H:%M:%S') WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%y:%m:%d %H:%M:%S')
  WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') WHEN o_orderkey % 4 = 2 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
  ELSE strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') END AS raw FROM orders),
t AS (SELECT o_orderkey, raw, CASE WHEN raw LIKE '____:%' THEN try_strptime(raw, '%Y:%m:%d %H:%M:%S') WHEN raw LIKE '__:%' THEN try_strptime(raw, '%y:%m:%d %H:%M:%S') WHEN raw LIKE '%/%' THEN try_strptime(replace(raw, '  ', ' '), '%d/%m/%Y %H:%M:%S') END AS ts FROM x),
m AS (SELECT make_timestamp(CAST(trunc(avg(CAST(epoch_us(ts) AS DOUBLE))) AS BIGINT)) AS mean FROM t)
SELECT o_orderkey, raw, strftime(coalesce(ts, mean), '%Y-%m-%d %H:%M') AS imputed, CAST(epoch(ts) AS BIGINT) - 1672531200 AS seconds,
strftime(ts, '%H:%M:%S') AS time_of_day, strftime(ts, '%d/%m/%Y %H:%M:%S') AS text, strftime(ts, '%y_%m_%d_%H') AS run FROM t, m""")
def dates(spark, sf_dir):
    k = F.col("o_orderkey")
    kinds = {0: "yy:MM:dd HH:mm:ss", 1: times.RESULT, 2: "yyyy-MM-dd HH:mm:ss", 3: times.CAMERA}
    raw = F.when(k % 7 == 0, F.lit("dt_not_found")).when(k % 9 == 2, F.date_format("o_orderdate", "yyyy:M:d H:m:s")).when(k % 9 == 5, F.date_format("o_orderdate", "d/M/yyyy  H:mm:ss"))
    for rest, form in kinds.items():
        raw = raw.when(k % 4 == rest, F.date_format("o_orderdate", form))
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).withColumn("own", times.first_format(F.col("raw"))).withColumn("ts", F.col("own"))
    own = F.col("own")
    return times.impute_mean(rows, "ts").select(
        "o_orderkey", "raw", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("imputed"), times.seconds_since(own).alias("seconds"),
        times.time_of_day(own).alias("time_of_day"), times.result_text(F.col("raw")).alias("text"), times.run_id(own).alias("run"),
    )


BOX = {"x": "l_discount", "y": "l_tax", "w": "l_quantity / 100", "h": "l_quantity / 200"}
#: Images of three sizes, one of them smaller than the crop; prime sides, so that no share ends in a 5.
SIDES = {"iw": "CASE l_linenumber % 3 WHEN 0 THEN 1999 WHEN 1 THEN 641 ELSE 211 END", "ih": "CASE l_linenumber % 3 WHEN 0 THEN 1081 WHEN 1 THEN 479 ELSE 199 END"}
KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
BOXES = f"b AS (SELECT {KEYS}, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in BOX.items())}, {', '.join(f'{v} AS {k}' for k, v in SIDES.items())} FROM lineitem)"


def _boxes(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select(*KEY, *[F.expr(v).cast("double").alias(k) for k, v in BOX.items()], *[F.expr(v).alias(k) for k, v in SIDES.items()])


def _ends(first: str, whole: str, inside: bool) -> tuple[str, str]:
    """SQL of a window's start and end: moved by what stands over an edge, unless both do."""
    moved = f"{first} - (CASE WHEN {first} < 0 THEN {first} ELSE 0 END) - (CASE WHEN {first} + 300 > {whole} THEN {first} + 300 - {whole} ELSE 0 END)"
    both = f"{first} < 0 AND {first} + 300 > {whole}"
    start, end = (f"greatest(0, {moved})", f"least({whole}, {moved} + 300)") if inside else (moved, f"{moved} + 300")
    return f"CASE WHEN {both} THEN 0 ELSE {start} END", f"CASE WHEN {both} THEN {whole if inside else 300} ELSE {end} END"


def _window(inside: bool) -> str:
    (left, right), (top, bottom) = _ends("l0", "iw", inside), _ends("t0", "ih", inside)
    return f"""WITH {BOXES}, p AS (SELECT *, CAST(trunc((x + w / 2) * iw - 150) AS INT) AS l0, CAST(trunc((y + h / 2) * ih - 150) AS INT) AS t0 FROM b),
c AS (SELECT {KEYS}, iw, ih, {left} AS "left", {top} AS top, {right} AS "right", {bottom} AS bottom FROM p)
SELECT {KEYS}, "left", top, "right", bottom, '[' || round_even("left" / iw, 4) || ', ' || round_even(top / ih, 4) || ', ' || round_even("right" / iw, 4) || ', ' || round_even(bottom / ih, 4) || ']' AS crop FROM c"""


def _windows(spark, sf_dir, inside):
    x, y, w, h, iw, ih = (F.col(c) for c in ("x", "y", "w", "h", "iw", "ih"))
    window = geometry.crop_window(x, y, w, h, iw, ih, 300, inside)
    return _boxes(spark, sf_dir).select(*KEY, *[c.alias(k) for k, c in window.items()], geometry.as_text(geometry.normalised(window, iw, ih)).alias("crop"))


@query(_window(False))
def crop_window(spark, sf_dir):
    return _windows(spark, sf_dir, False)


@query(_window(True))
def crop_window_inside(spark, sf_dir):
    return _windows(spark, sf_dir, True)


@query(f"""WITH {BOXES}, s AS (SELECT *, greatest((least(1, greatest(0, x + w + 0.05)) - least(1, greatest(0, x - 0.05))) * iw,
  (least(1, greatest(0, y + h + 0.05)) - least(1, greatest(0, y - 0.05))) * ih) AS longest FROM b)
SELECT {KEYS}, CASE WHEN longest > 300 THEN round(300 / longest, 9) END AS scale,
CASE WHEN longest > 300 THEN CAST(round_even(iw * (300 / longest), 0) AS INT) ELSE iw END AS new_width FROM s""")
def new_scale(spark, sf_dir):
    x, y, w, h, iw, ih = (F.col(c) for c in ("x", "y", "w", "h", "iw", "ih"))
    scale = geometry.new_scale(x, y, w, h, iw, ih, 0.05, 300)
    return _boxes(spark, sf_dir).select(*KEY, F.round(scale, 9).alias("scale"), geometry.scaled_side(iw, scale).alias("new_width"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(least(greatest(l_discount - 0.03, 0), 1) * 1000) AS INT) AS "left", CAST(floor(least(greatest(l_tax - 0.03, 0), 1) * 1000) AS INT) AS top,
CAST(floor(least(greatest(l_discount + l_quantity / 100 + 0.03, 0), 1) * 1000) AS INT) AS "right", CAST(floor(least(greatest(l_tax + l_quantity / 200 + 0.03, 0), 1) * 1000) AS INT) AS bottom FROM lineitem""")
def background_rect(spark, sf_dir):
    x, y, w, h = (F.expr(v) for v in BOX.values())
    box = geometry.background(x, y, w, h, F.lit(1000), F.lit(1000), F.lit(0.03))
    return _t(spark, sf_dir, "lineitem").select(*KEY, *[c.alias(k) for k, c in box.items()])


@query("""WITH b AS (SELECT *, l_quantity / 100 AS w, l_quantity / 200 AS h, 0.1 * least(l_quantity / 100, l_quantity / 200) AS m FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(least(greatest(l_discount - m, 0), 1) * 1000) AS INT) AS "left", CAST(floor(least(greatest(l_tax - m, 0), 1) * 1000) AS INT) AS top,
CAST(floor(least(greatest(l_discount + w + m, 0), 1) * 1000) AS INT) AS "right", CAST(floor(least(greatest(l_tax + h + m, 0), 1) * 1000) AS INT) AS bottom FROM b""")
def background_rect_of_box(spark, sf_dir):
    x, y, w, h = (F.expr(v) for v in BOX.values())
    box = geometry.background(x, y, w, h, F.lit(1000), F.lit(1000), F.lit(0.1), of_box=True)
    return _t(spark, sf_dir, "lineitem").select(*KEY, *[c.alias(k) for k, c in box.items()])


@query(f"WITH {PROBS} SELECT vec_id, round(pow(1 - probs[label + 1], 2) * -ln(probs[label + 1]), 6) AS loss FROM probs")
def focal_loss(spark, sf_dir):
    return _probs(spark, sf_dir).select("vec_id", F.round(arrays.focal_loss(F.col("probs"), F.col("label")), 6).alias("loss"))


@query("""WITH v AS (SELECT o_orderkey, CAST(floor(o_totalprice / 100) AS BIGINT) % 900 AS total, 1 + o_orderkey % 60 AS fps FROM orders),
i AS (SELECT *, CASE WHEN total < fps // 2 THEN total - 1 ELSE fps // 2 END AS plain FROM v), g AS (SELECT *, greatest(plain, 1) AS fit FROM i),
f AS (SELECT *, CASE WHEN total // fit > 20 THEN total // 20 ELSE fit END AS iv FROM g), x AS (SELECT o_orderkey, fps, iv, unnest(range(0, total, iv)) AS frame FROM f)
SELECT o_orderkey, frame // iv AS number, frame, round(frame / fps * 1000, 6) AS at_ms FROM x""")
def frame_schedule(spark, sf_dir):
    total = (F.floor(F.col("o_totalprice") / 100) % 900).cast("long")
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", total.alias("total"), (1 + F.col("o_orderkey") % 60).alias("fps"))
    step = schedules.frame_step(F.col("total"), F.col("fps"), 0.5, 20)
    frames = rows.select("o_orderkey", "fps", F.posexplode(schedules.frame_numbers(F.col("total"), step)).alias("number", "frame"))
    at = F.round(schedules.frame_offset_ms(F.col("frame"), F.col("fps")), 6)
    return frames.select("o_orderkey", F.col("number").cast("long").alias("number"), "frame", at.alias("at_ms"))


@query("SELECT l_suppkey, l_returnflag, count(*) AS n, count(*) FILTER (l_quantity > 25) AS n_large FROM lineitem GROUP BY l_suppkey, l_returnflag")
def group_sizes(spark, sf_dir):
    return curation.group_sizes(_t(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], n_large=F.col("l_quantity") > 25)


@query("SELECT count(DISTINCT c_mktsegment) FILTER (c_mktsegment <> 'BUILDING') AS n_known, count(*) FILTER (c_mktsegment = 'BUILDING') AS n_unknown, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ',') AS names FROM customer")
def known_classes(spark, sf_dir):
    return curation.known_classes(_t(spark, sf_dir, "customer"), "c_mktsegment", "BUILDING").withColumn("names", F.array_join("names", ","))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def newest_row(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", F.date_trunc("day", "ts").alias("day"))
    return detections.newest(rows, "user_id", "day", "event_id").select("user_id", "event_id")


@query("WITH n AS (SELECT DISTINCT event_type AS name FROM events UNION SELECT 'empty') SELECT name, row_number() OVER (ORDER BY name) AS id FROM n")
def class_ids(spark, sf_dir):
    names = _t(spark, sf_dir, "events").agg(F.collect_set("event_type").alias("names"))
    return names.select(F.explode(detections.class_ids(F.col("names"))).alias("name", "id")).select("name", F.col("id").cast("long").alias("id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def set_difference(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id").subtract(_t(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


@query("SELECT vec_id, label, CASE WHEN hi > lo THEN round((x - lo) / (hi - lo), 6) ELSE 0 END AS scaled FROM (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, min(CAST(embedding[1] AS DOUBLE)) OVER (PARTITION BY label) AS lo, max(CAST(embedding[1] AS DOUBLE)) OVER (PARTITION BY label) AS hi FROM embeddings)")
def min_max_scaled(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    return curation.min_max_scaled(rows, ["label"], "x", "scaled").select("vec_id", "label", F.round("scaled", 6).alias("scaled"))
