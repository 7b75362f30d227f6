"""Queries over training: heads, rates, checks, mixed examples. Importing this adds them to the catalog."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from trailframe.functions import schedules
from trailframe.operators import inference, mixup, stopping, training
from trailframe.plans.catalog import _t, query


def _examples(spark, sf_dir):
    return training.examples(_t(spark, sf_dir, "embeddings").where(F.size("embedding") == 64), "vec_id", "embedding", 10, label="label")


@query("""WITH e AS (SELECT label, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(i)), n AS (SELECT count(*) AS n FROM embeddings)
SELECT c.c AS class, i - 1 AS feature, round(sum(CASE WHEN label = c.c THEN x * (0.1 - 1) ELSE x * 0.1 END) / any_value(n), 9) + 0 AS gradient FROM e, n, range(0, 10) c(c) GROUP BY c.c, i""")
def head_gradient(spark, sf_dir):
    """The mean gradient of a head of one layer whose weights are 0."""
    head = training.Head([(np.zeros((64, 10)), np.zeros(10))])
    n, _, g = training.gradient(_examples(spark, sf_dir), head)
    cells = [(c, f, float(v)) for f, row in enumerate(g[:640].reshape(64, 10) / max(n, 1)) for c, v in enumerate(row)]
    return spark.createDataFrame(cells, "class long, feature long, gradient double").withColumn("gradient", F.round("gradient", 9) + 0)


@query()
def classifier_head(spark, sf_dir):
    """vec_id, label, predicted and probability by a head of two layers that was trained on all vectors."""
    rates = training.rates(spark, 30, rate=0.02, initial=0.005, least=0.001, warmup=3, cycle=30, decay=0.9)
    found = training.train(_examples(spark, sf_dir), training.Head.new(64, 10, two_layers=True), rates)
    rows = _t(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    said = inference.classify(rows, ["embedding"], found.load("embedding"))
    top = F.array_max("probs")
    return said.select("vec_id", "label", (F.array_position("probs", top) - 1).cast("int").alias("predicted"), F.round(top, 6).alias("probability"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 40 AS e FROM orders),
x AS (SELECT *, CASE WHEN e <= 3 THEN 0.1 + (1 - 0.1) / 3 * e ELSE 1 END AS warm, CASE WHEN e <= 3 THEN 1 ELSE pow(0.8, floor((e - 3) / 8)) END AS decay,
CASE WHEN e <= 3 THEN 1 ELSE 0.05 + 0.95 * (1 + cos(pi() * ((e - 3) % 8) / 8)) / 2 END AS cosine FROM o)
SELECT o_orderkey, e AS epoch, round(0.001 * warm * decay * cosine, 12) AS rate FROM x""")
def lr_schedule(spark, sf_dir):
    """Orders as steps of training, their number modulo 40 as the epoch."""
    rate = schedules.learning_rate(F.col("epoch"), rate=0.001, initial=0.0001, least=0.00005, warmup=3, cycle=8, decay=0.8)
    return _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 40).alias("epoch")).select("*", F.round(rate, 12).alias("rate"))


_CHECKS = """WITH e AS (SELECT user_id, event_id, event_id % 97 = 0 AS bad, CASE WHEN event_id % 97 = 0 THEN CAST('infinity' AS DOUBLE) ELSE floor(value / 20) END AS l FROM events),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
  l < coalesce(min(l) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST('infinity' AS DOUBLE)) AS improved FROM e),
b AS (SELECT *, n - coalesce(max(CASE WHEN improved THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS wait FROM a),
c AS (SELECT *, min(CASE WHEN wait >= 12 OR bad THEN n END) OVER (PARTITION BY user_id) AS stop FROM b),
d AS (SELECT * FROM c WHERE stop IS NULL OR n <= stop),
f AS (SELECT d.user_id, d.n, any_value(d.l) AS l, count(p.n) < 8 AS admitted FROM d LEFT JOIN d p ON p.user_id = d.user_id AND p.n < d.n AND p.l <= d.l GROUP BY d.user_id, d.n),
g AS (SELECT user_id, n, row_number() OVER (PARTITION BY user_id ORDER BY l, n DESC) <= 8 AS kept FROM f WHERE admitted),
k AS (SELECT d.*, coalesce(g.kept, false) AS kept, d.n = coalesce(d.stop, -1) AS stops FROM d LEFT JOIN g USING (user_id, n))"""


def _checks(spark, sf_dir):
    bad = F.col("event_id") % 97 == 0
    return _t(spark, sf_dir, "events").select("user_id", "event_id", F.when(~bad, F.floor(F.col("value") / 20).cast("double")).alias("loss"))


@query(f"{_CHECKS} SELECT user_id, event_id, n, improved, wait, stops, kept FROM k")
def training_checks(spark, sf_dir):
    """Users as runs of training, their events as its checks."""
    return stopping.checks(_checks(spark, sf_dir), "user_id", "event_id", "loss", patience=12).drop("loss")


@query(f"""{_CHECKS} SELECT user_id, count(*) AS checks, bool_or(stops) AS stopped, max(CASE WHEN improved THEN event_id END) AS best_at, max(event_id) AS last_at,
array_to_string(list_sort(list(event_id) FILTER (kept)), ',') AS kept_at FROM k GROUP BY user_id""")
def best_checks(spark, sf_dir):
    found = stopping.best_checks(_checks(spark, sf_dir), "user_id", "event_id", "loss", patience=12)
    return found.withColumn("kept_at", F.array_join("kept_at", ","))


def _number(text: str) -> str:
    return f"(CAST(('0x' || substr(md5({text}), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE"


@query(f"""WITH n AS (SELECT CAST(greatest(1, round_even(count(*) / 32, 0)) AS BIGINT) AS n FROM embeddings),
h AS (SELECT vec_id, label, embedding, md5(concat_ws('|', vec_id, '0')) AS h, CAST(('0x' || substr(md5(concat_ws('|', vec_id, '0')), 1, 12)) AS BIGINT) % n AS b FROM embeddings, n),
t AS (SELECT b.b, i, pow({_number("'0:' || b.b || 'x' || i")}, 2) AS x, pow({_number("'0:' || b.b || 'y' || i")}, 2) AS y FROM (SELECT DISTINCT b FROM h) b, range(1, 65) r(i)),
l AS (SELECT b, x / (x + y) AS lam FROM t WHERE x + y <= 1 QUALIFY row_number() OVER (PARTITION BY b ORDER BY i) = 1),
p AS (SELECT *, coalesce(lead(vec_id) OVER w, first_value(vec_id) OVER w) AS partner FROM h JOIN l USING (b) WINDOW w AS (PARTITION BY b ORDER BY h, vec_id))
SELECT p.vec_id, p.label, round(p.lam, 9) AS lam, p.partner, o.label AS other_label,
round(list_sum(list_transform(range(1, 65), lambda i: p.lam * CAST(p.embedding[i] AS DOUBLE) + (1 - p.lam) * CAST(o.embedding[i] AS DOUBLE))), 6) + 0 AS total FROM p JOIN embeddings o ON o.vec_id = p.partner""")
def mixup_pairs(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    found = mixup.mixed(rows, "vec_id", "embedding", "label")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, b: a + b)
    return found.select("vec_id", "label", F.round("lam", 9).alias("lam"), "partner", F.col("other_target").alias("other_label"), (F.round(total, 6) + 0).alias("total"))
