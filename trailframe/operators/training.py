"""Training of a classifier's head over a table of features: gradients in the tasks, steps of Adam on the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.functions import schedules
from trailframe.sources.shared import settled

#: Partial gradients that are added up in one task.
FAN = 16


@dataclass
class Head:
    """Weights and biases of one layer, or of two with a rectifier between and half as many units as features in the middle."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    dropout: float = 0.0

    @classmethod
    def new(cls, features: int, classes: int, two_layers: bool = False, dropout: float = 0.2, seed: int = 0) -> Head:
        """Uniform within one over the root of a layer's inputs."""
        sizes = [features, features // 2, classes] if two_layers else [features, classes]
        r = np.random.default_rng(seed)
        layers = [tuple(r.uniform(-1, 1, shape) / np.sqrt(a) for shape in ((a, b), (b,))) for a, b in zip(sizes, sizes[1:], strict=False)]
        return cls(layers, dropout if two_layers else 0.0)

    def logits(self, x: np.ndarray) -> np.ndarray:
        for w, b in self.layers[:-1]:
            x = np.maximum(x @ w + b, 0)
        w, b = self.layers[-1]
        return x @ w + b

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for layer in self.layers for p in layer])

    def with_flat(self, values: np.ndarray) -> Head:
        at, layers = 0, []
        for w, b in self.layers:
            layers.append((values[at : at + w.size].reshape(w.shape), values[at + w.size : at + w.size + b.size]))
            at += w.size + b.size
        return Head(layers, self.dropout)

    def gradient(self, x: np.ndarray, targets: np.ndarray, weights: np.ndarray, kept: np.ndarray | None = None) -> tuple[float, np.ndarray]:
        """The sum of the rows' weighted cross-entropies with targets (shares of the classes), and its gradient. `kept`: which units of the
        middle layer are not dropped, of each row."""
        scale = None
        hidden = x
        if len(self.layers) == 2:
            w, b = self.layers[0]
            raw = x @ w + b
            scale = (raw > 0) * (1.0 if kept is None else kept / (1 - self.dropout))
            hidden = raw * scale
        w, b = self.layers[-1]
        z = hidden @ w + b
        z = z - z.max(1, keepdims=True)
        logs = z - np.log(np.exp(z).sum(1, keepdims=True))
        loss = -(weights[:, None] * targets * logs).sum()
        dz = weights[:, None] * (np.exp(logs) * targets.sum(1, keepdims=True) - targets)
        parts = [hidden.T @ dz, dz.sum(0)]
        if scale is not None:
            dh = (dz @ w.T) * scale
            parts = [x.T @ dh, dh.sum(0), *parts]
        return float(loss), np.concatenate([p.ravel() for p in parts])


@dataclass
class Adam:
    """With the usual constants; decay is added to the gradient."""

    decay: float = 0.0
    steps: int = 0
    mean: np.ndarray | float = 0.0
    square: np.ndarray | float = 0.0

    def step(self, values: np.ndarray, gradient: np.ndarray, rate: float) -> np.ndarray:
        gradient = gradient + self.decay * values
        self.steps += 1
        self.mean = 0.9 * self.mean + 0.1 * gradient
        self.square = 0.999 * self.square + 0.001 * gradient**2
        return values - rate * self.mean / (1 - 0.9**self.steps) / (np.sqrt(self.square / (1 - 0.999**self.steps)) + 1e-8)


def _hashed(keys: np.ndarray, seed: int, n: int) -> np.ndarray:
    """Numbers in [0, 1), n for each key, the same wherever the row lies."""
    x = keys.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed * 2654435761 % (1 << 63))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) / 2.0**64


_PARTS = "part int, n double, loss double, gradient binary"


def _added(table: pa.Table) -> pa.Table:
    gradients = [np.frombuffer(x.as_py()) for x in table.column("gradient")]
    part, n, loss = (table.column(c).to_numpy() for c in ("part", "n", "loss"))
    ranked = np.argsort(part, kind="stable")  # the same order of additions in any run
    total = sum((gradients[i] for i in ranked), np.zeros(len(gradients[0])))
    return pa.Table.from_arrays([pa.array([part.min()], pa.int32()), pa.array([n[ranked].sum()]), pa.array([loss[ranked].sum()]), pa.array([total.tobytes()], pa.binary())], ["part", "n", "loss", "gradient"])


def gradient(rows: DataFrame, head: Head, seed: int = 0) -> tuple[float, float, np.ndarray]:
    """Sum of weights, of losses, and the gradient's sum over rows (key long, x array<float>, y array<double>, w double). A task sends one
    sum, FAN of them are added in one task, and so on, until FAN are left for the driver."""
    columns = ["key", "x", "y", "w"]
    width, classes = head.layers[0][0].shape[0], head.layers[-1][0].shape[1]

    def run(batches):
        n, loss, total = 0.0, 0.0, np.zeros(len(head.flat()))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                x = piece.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
                y = piece.column("y").flatten().to_numpy(zero_copy_only=False).reshape(-1, classes)
                w = piece.column("w").to_numpy()
                kept = None
                if head.dropout:
                    kept = _hashed(piece.column("key").to_numpy(), seed, head.layers[0][1].size) >= head.dropout
                part = head.gradient(x, y, w, kept)
                n, loss, total = n + w.sum(), loss + part[0], total + part[1]
        from pyspark import TaskContext

        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n]), pa.array([loss]), pa.array([total.tobytes()], pa.binary())], ["part", "n", "loss", "gradient"])

    parts = rows.select(*columns).mapInArrow(run, _PARTS)
    left, wide = rows.rdd.getNumPartitions(), 1
    while left > FAN:
        wide *= FAN
        parts = parts.groupBy((F.col("part") / wide).cast("int").alias("g")).applyInArrow(_added, _PARTS)
        left = -(-left // FAN)
    found = pa.Table.from_pylist([r.asDict() for r in parts.collect()], pa.schema([("part", pa.int32()), ("n", pa.float64()), ("loss", pa.float64()), ("gradient", pa.binary())]))
    whole = _added(found).to_pylist()[0]
    return whole["n"], whole["loss"], np.frombuffer(whole["gradient"])


def rates(spark: SparkSession, epochs: int, **schedule) -> list[float]:
    """The schedule's rate of each epoch."""
    rows = spark.range(epochs).select("id", schedules.learning_rate(F.col("id"), **schedule).alias("rate")).collect()
    return [r["rate"] for r in sorted(rows, key=lambda r: r["id"])]


@dataclass
class Trained:
    head: Head
    #: The mean loss before each step.
    losses: list[float] = field(default_factory=list)

    def load(self, features: str) -> Callable[[], Callable[[pa.RecordBatch], np.ndarray]]:
        """For `inference.classify`."""
        head = self.head

        def model(batch: pa.RecordBatch) -> np.ndarray:
            column = batch.column(features)
            return head.logits(column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64))

        return lambda: model


def examples(df: DataFrame, key: str, features: str, classes: int, label: str | None = None, targets: str | None = None, weights: list[float] | None = None) -> DataFrame:
    """key, x, y, w for training: y is 1 for the number in `label`, or the shares in `targets`; w is the label's weight. Rows with a null
    or a wrong length in any of them are left out."""
    if (label is None) == (targets is None):
        raise ValueError("either label or targets is needed")
    if targets is None:
        y = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == df[label]).cast("double"))
        known = df[label].between(0, classes - 1)
    else:
        y, known = F.transform(df[targets], lambda v: v.cast("double")), (F.size(df[targets]) == classes) & ~F.exists(df[targets], lambda v: v.isNull())
    w = F.lit(1.0) if weights is None else F.get(F.array(*[F.lit(float(v)) for v in weights]), df[label])
    x = F.transform(df[features], lambda v: v.cast("double"))
    return df.where(known & df[key].isNotNull() & df[features].isNotNull() & ~F.exists(df[features], lambda v: v.isNull())).select(df[key].cast("long").alias("key"), x.alias("x"), y.alias("y"), w.alias("w"))


def train(rows: DataFrame, head: Head, rates: list[float], decay: float = 0.0, seed: int = 0, batches: int = 1) -> Trained:
    """The head after an epoch for each rate. `rows`: from `examples`. An epoch takes `batches` steps, each over the rows of one share by
    hash of their keys, in the same shares in every epoch; a pass over the rows for each step, a gradient to the driver. The same table
    gives the same head; another partitioning, the same but for rounding. Vectors of another length than the first layer's are an error;
    no rows leave the head as it is."""
    width = head.layers[0][0].shape[0]
    wrong = rows.where(F.size("x") != width).limit(1).count()
    if wrong:
        raise ValueError(f"vectors need {width} components")
    rows = settled(rows)
    shares = [rows.where(F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(batches)) == i) for i in range(batches)] if batches > 1 else [rows]
    adam, out = Adam(decay), Trained(head)
    step = 0
    for rate in rates:
        for share in shares:
            step += 1
            n, loss, g = gradient(share, out.head, seed * 1_000_003 + step)
            if n:
                out.losses.append(loss / n)
                out.head = out.head.with_flat(adam.step(out.head.flat(), g / n, rate))
    return out
