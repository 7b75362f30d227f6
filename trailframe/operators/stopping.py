"""When training stops, and which checkpoints are kept: over a table of checks by windows, over a stream by a state."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How many checks without a new best loss end a run, and how many checkpoints it keeps.
PATIENCE, KEPT = 2, 8


def checks(df: DataFrame, run: str, at: str, loss: str, patience: int = PATIENCE, kept: int = KEPT) -> DataFrame:
    """The checks of each run up to its end, with n (from 1), improved, wait (checks since the best), stops (this is the check that ends
    the run) and kept (its checkpoint is there at the end).

    A check improves if its loss is below all before it; `patience` checks that don't, or a loss that isn't a number, end the run. A
    checkpoint is saved while there are fewer than `kept`, or in place of the highest saved loss if its own is below that: of equal ones
    the oldest goes. So of those as high as the last kept loss, the latest saved ones stay. Losses that aren't finite count as infinite.
    Checks of one run and number are ordered by loss. A run is sorted in one task: it has as many rows as training had checks."""
    value = F.col(loss).cast("double")
    finite = F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))
    rows = df.withColumn("__loss", F.when(finite, value).otherwise(float("inf"))).withColumn("__finite", finite)
    order = Window.partitionBy(run).orderBy(at, "__loss")
    rows = rows.withColumn("n", F.row_number().over(order))
    before = F.min("__loss").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("improved", F.col("__loss") < F.coalesce(before, F.lit(float("inf"))))
    last = F.max(F.when(F.col("improved"), F.col("n"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("wait", F.col("n") - F.coalesce(last, F.lit(0)))
    ends = F.min(F.when((F.col("wait") >= patience) | ~F.col("__finite"), F.col("n"))).over(Window.partitionBy(run))
    rows = rows.withColumn("__end", ends).where("__end is null or n <= __end").withColumn("stops", F.coalesce(F.col("n") == F.col("__end"), F.lit(False)))
    low = F.row_number().over(Window.partitionBy(run).orderBy("__loss", "n"))
    every = Window.partitionBy(run)
    rows = rows.withColumn("__low", low).withColumn("__edge", F.coalesce(F.max(F.when(F.col("__low") == kept, F.col("__loss"))).over(every), F.max("__loss").over(every)))
    reached = F.coalesce(F.count_if(F.col("__loss") <= F.col("__edge")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    saved = (F.col("__loss") == F.col("__edge")) & (reached < kept)
    rows = rows.withColumn("__saved", saved).withColumn("__room", kept - F.count_if(F.col("__loss") < F.col("__edge")).over(every))
    later = F.count_if("__saved").over(order.rowsBetween(1, Window.unboundedFollowing))
    stays = (F.col("__loss") < F.col("__edge")) | (F.col("__saved") & (later < F.col("__room")))
    return rows.withColumn("kept", stays).drop("__loss", "__finite", "__end", "__low", "__edge", "__saved", "__room")


def best_checks(df: DataFrame, run: str, at: str, loss: str, patience: int = PATIENCE, kept: int = KEPT) -> DataFrame:
    """A row for each run: checks (that it had), stopped, best_at (of the lowest loss, the first of them), last_at and kept_at (of the
    checkpoints, in order)."""
    rows = checks(df, run, at, loss, patience, kept)
    best = F.max(F.when(F.col("improved"), F.struct("n", at)))[at]
    kept_at = F.array_sort(F.collect_list(F.when(F.col("kept"), F.col(at))))  # `kept` numbers at most
    return rows.groupBy(run).agg(F.count("*").alias("checks"), F.max("stops").alias("stopped"), best.alias("best_at"), F.max(at).alias("last_at"), kept_at.alias("kept_at"))


@dataclass
class Run:
    """A run so far."""

    n: int = 0
    best: float = math.inf
    wait: int = 0
    stopped: bool = False
    saved: list[tuple[float, int]] = field(default_factory=list)

    def check(self, at: int, loss: float | None, patience: int, kept: int) -> bool:
        """Takes a check in, unless the run has ended. Whether it improved."""
        if self.stopped:
            return False
        finite = loss is not None and math.isfinite(loss)
        value = loss if finite else math.inf
        self.n += 1
        improved = value < self.best
        self.best, self.wait = (value, 0) if improved else (self.best, self.wait + 1)
        self.stopped = self.wait >= patience or not finite
        if len(self.saved) < kept:
            self.saved.append((value, at))
        else:
            worst = max(self.saved, key=lambda s: s[0])  # the first of equal ones, which is the oldest
            if value < worst[0]:
                self.saved.remove(worst)
                self.saved.append((value, at))
        return improved


_STATE = "n long, best double, wait long, stopped boolean, losses array<double>, ats array<long>"


def stream_checks(df: DataFrame, run: str, at: str, loss: str, patience: int = PATIENCE, kept: int = KEPT) -> DataFrame:
    """run, at, improved, stopped, kept_at after each check of a stream (at long, loss double); checks of an ended run are ignored. A run's
    checks must come in order; those of one batch are put in order. What is held of a run is its best loss and `kept` checkpoints."""
    kind = dict(df.dtypes)[run]

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = Run()
        if state.exists:
            n, best, wait, stopped, losses, ats = state.get
            now = Run(n, best, wait, stopped, list(zip(losses, ats, strict=True)))
        rows = pd.concat(list(frames)).sort_values([at, loss], na_position="last")
        out = []
        for when, value in zip(rows[at], rows[loss], strict=True):
            if not now.stopped:
                improved = now.check(int(when), None if pd.isna(value) else float(value), patience, kept)
                out.append((key[0], int(when), improved, now.stopped, sorted(a for _, a in now.saved)))
        state.update((now.n, now.best, now.wait, now.stopped, [x for x, _ in now.saved], [a for _, a in now.saved]))
        yield pd.DataFrame(out, columns=[run, at, "improved", "stopped", "kept_at"])

    rows = df.select(run, F.col(at).cast("long").alias(at), F.col(loss).cast("double").alias(loss))
    schema = f"`{run}` {kind}, `{at}` long, improved boolean, stopped boolean, kept_at array<long>"
    return rows.groupBy(run).applyInPandasWithState(step, schema, _STATE, "append", GroupStateTimeout.NoTimeout)
