"""Mixing sources to target weights by balanced sampling with the cube method.

A source whose target is r times its size takes floor(r) whole copies of each document and one more of a sample in which each document
has the probability r - floor(r). The sample is drawn by the flight phase of the cube method: probabilities move along the null space
of the constraints (words and documents keep their totals) until one is 0 or 1, in chunks of CHUNK documents of one source; the two
or so that a chunk leaves open meet again in the next round, until each source has one chunk. There the flight stops where OPEN documents
are left, or all that a smaller source has, and the landing takes of all their subsets the one whose words come nearest to what is
still to be taken; equally near ones by the number of documents, then by hash. So no other choice of these would be nearer to the
target; the probabilities of these last documents are kept only up to that choice.

Chunks and draws follow hashes of id, text and source, so reruns agree. Documents without words take no words. A null source is a
source of its own, the last. Null ids and repeated rows are units like others. Other columns are not read. No rows, or only empty
ones: nothing to take.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailframe.llm import common as C

WEIGHTS, BUDGET, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
CHUNK, OPEN = 4096, 14
BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """source, source_size -> the same with target: shares by weight of budget * all words, never above most * source_size; what lies
    above goes to the others by weight. A source is open while budget left / weight left is below most * size / weight."""
    total = sizes.agg(F.sum("source_size").cast("double").alias("all_words"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    values = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("weight", F.get(values, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    weighed = weighed.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weighed = weighed.crossJoin(F.broadcast(total)).withColumn("level", (F.lit(budget) * F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    weighed = weighed.withColumn("open", F.col("level") <= F.col("ratio"))
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return weighed.withColumn("final", level).select("source", "source_size", F.when(F.col("final") <= F.col("ratio"), F.col("final") * F.col("weight")).otherwise(F.col("cap")).alias("target"))


def flight(sizes: np.ndarray, p: np.ndarray, rng, open_: int = 2) -> np.ndarray:
    """Probabilities after the flight phase: all but `open_` (two at least) are 0 or 1, words and documents have the totals they had, and
    each probability is kept in the mean."""
    p = p.copy()
    p[p < 1e-9], p[p > 1 - 1e-9] = 0.0, 1.0
    waiting = np.flatnonzero((p > 0) & (p < 1))[::-1].tolist()
    held: list[int] = []
    while len(held) + len(waiting) > max(2, open_):
        while len(held) < 3:
            held.append(waiting.pop())
        a, b, c = sizes[held]
        u = [1.0, -1.0, 0.0] if a == b else [1.0, 0.0, -1.0] if a == c else [b - c, c - a, a - b]
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(held, u, strict=True) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(held, u, strict=True) if x)
        step = up if rng.random() * (up + down) < down else -down
        for i, x in zip(held, u, strict=True):
            p[i] += step * x
            if p[i] < 1e-9:
                p[i] = 0.0
            elif p[i] > 1 - 1e-9:
                p[i] = 1.0
        held = [i for i in held if 0 < p[i] < 1]
    return p


def land(sizes: np.ndarray, p: np.ndarray, rng) -> np.ndarray:
    """0 or 1 for all: the flight, then the subset of the open ones that is nearest to their words."""
    p = flight(sizes, p, rng, OPEN)
    rest = np.flatnonzero((p > 0) & (p < 1))
    subsets = np.arange(1 << len(rest))[:, None] >> np.arange(len(rest)) & 1
    miss, documents = np.abs(subsets @ sizes[rest] - p[rest] @ sizes[rest]), np.abs(subsets.sum(1) - p[rest].sum())
    p[rest] = subsets[np.lexsort((documents.round(6), miss.round(6)))[0]]
    return p


def _fly(seed: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        key, size = table.column("key").to_numpy(), table.column("size").to_numpy()
        order = np.lexsort((size, key))
        rng = np.random.default_rng([seed, int(key[order[0]]) & (2**63 - 1), len(key)])
        sizes, p = size[order].astype(float), table.column("p").to_numpy()[order]
        p = land(sizes, p, rng) if last else flight(sizes, p, rng)
        out = np.empty_like(p)
        out[order] = p
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(out))

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, key (hash of id, text and source) for each row."""
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[source_col].cast("string").alias("source"))
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    units = C.checkpoint(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text", "source").alias("key")))
    sums = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sums = C.checkpoint(sums)
    n_sources, largest = sums.agg(F.count("*"), F.max("n")).first()
    targets = source_targets(sums.select("source", "source_size"), weights, budget, most)
    counts = sums.select(F.col("source").alias("s"), "n").join(targets.select(F.col("source").alias("t"), "source_size", "target"), F.expr("s <=> t")).drop("t")
    counts = F.broadcast(counts) if n_sources <= BROADCAST_SOURCES else counts
    units = units.join(counts, F.expr("source <=> s")).drop("s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.withColumn("whole", F.floor(ratio).cast("long")).withColumn("p", ratio - F.floor(ratio))
    schema = "doc_id long, source string, size long, key long, n long, source_size long, target double, whole long, p double, chunk long"
    units = units.select("doc_id", "source", "size", "key", "n", "source_size", "target", "whole", F.when(F.col("size") > 0, F.col("p")).otherwise(0.0).alias("p"))
    done, k = None, 0
    most_open, open_ = int(largest or 0), units
    while True:
        last = most_open <= CHUNK
        chunks = F.ceil(F.col("n") / F.lit(CHUNK) / F.lit((CHUNK // 4) ** k)).cast("long")
        chunk = F.lit(0).cast("long") if last else F.pmod(F.xxhash64("key", F.lit(seed + k)), F.greatest(chunks, F.lit(1)))
        flown = C.checkpoint(open_.withColumn("chunk", chunk).groupBy("source", "chunk").applyInArrow(_fly(seed + k, last), schema).drop("chunk"))
        settled = flown.where("p <= 0 or p >= 1")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        open_ = flown.where("p > 0 and p < 1")
        most_open = int(open_.groupBy("source").count().agg(F.max("count")).first()[0] or 0)
        k += 1
    return done.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * (F.col("whole") + F.round("p").cast("long"))).alias("taken"), "key")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(C.read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
