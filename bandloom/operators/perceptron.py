"""Multi-layer perceptrons by mini-batch Adam (Kingma and Ba 2015).

Rows are dealt to mini-batches by a seeded digest of their content, packed as
matrices and written once, one folder per batch. A step is one job over one
folder: every task adds up the gradient of its rows, the sums meet in the driver,
which moves the weights and sends them along with the next step. What a step
collects is a vector of the network's size per final task, whatever the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandloom.functions.matrix import matrix
from bandloom.session import scratch_path

ACTIVATIONS = ("relu", "tanh", "logistic", "identity")
RATES = ("constant", "adaptive")
# Rows of a mini-batch unless asked for: at least SMALL_BATCH, at most STEPS of them in an epoch.
SMALL_BATCH = 200
STEPS = 4
# Bytes of bands a written file holds, about; a mini-batch is cut into that many files.
FILE_BYTES = 64_000_000
# Gradient vectors of more tasks than this are added by fewer tasks before the driver sees them.
FAN_IN = 32
# Epochs without progress before the fit ends or the rate falls, and the fall.
PATIENCE = 10
RATE_PATIENCE = 2
RATE_FALL = 5.0
LEAST_RATE = 1e-6
DECAY_1, DECAY_2, EPSILON = 0.9, 0.999, 1e-8


@dataclass(frozen=True)
class Network:
    """Weights (inputs x outputs) and biases per layer; the last layer feeds a softmax."""

    weights: tuple[np.ndarray, ...]
    biases: tuple[np.ndarray, ...]
    activation: str = "relu"

    @property
    def sizes(self) -> list[int]:
        return [len(self.weights[0]), *[len(b) for b in self.biases]]

    def flat(self) -> np.ndarray:
        return np.concatenate([part.ravel() for pair in zip(self.weights, self.biases) for part in pair])

    def moved(self, flat: np.ndarray) -> Network:
        """The network of the same shape that holds `flat`."""
        weights, biases, at = [], [], 0
        for w, b in zip(self.weights, self.biases):
            weights.append(flat[at:at + w.size].reshape(w.shape))
            at += w.size
            biases.append(flat[at:at + b.size])
            at += b.size
        return Network(tuple(weights), tuple(biases), self.activation)

    def layers(self, x: np.ndarray) -> list[np.ndarray]:
        """The input, every hidden layer and the margins."""
        out = [x]
        for i, (w, b) in enumerate(zip(self.weights, self.biases)):
            z = out[-1] @ w + b
            out.append(z if i == len(self.weights) - 1 else activate(z, self.activation))
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        margins = self.layers(x)[-1]
        e = np.exp(margins - margins.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Weighted sums over the rows: the gradient of the cross entropy, its value and the weight."""
        layers = self.layers(x)
        margins = layers[-1] - layers[-1].max(axis=1, keepdims=True)
        total = np.log(np.exp(margins).sum(axis=1))
        rows = np.arange(len(x))
        loss = float(weight @ (total - margins[rows, y]))
        delta = np.exp(margins - total[:, None])
        delta[rows, y] -= 1.0
        delta *= weight[:, None]
        parts = []
        for i in range(len(self.weights) - 1, -1, -1):
            parts[:0] = [(layers[i].T @ delta).ravel(), delta.sum(axis=0)]
            if i:
                delta = (delta @ self.weights[i].T) * slope(layers[i], self.activation)
        return np.concatenate([*parts, [loss, weight.sum()]])


def activate(z: np.ndarray, kind: str) -> np.ndarray:
    if kind == "relu":
        return np.maximum(z, 0.0)
    if kind == "tanh":
        return np.tanh(z)
    return 0.5 * (1.0 + np.tanh(z / 2)) if kind == "logistic" else z


def slope(a: np.ndarray, kind: str) -> np.ndarray:
    """Derivative of an activation, from its value."""
    if kind == "relu":
        return (a > 0).astype(float)
    if kind == "tanh":
        return 1.0 - a * a
    return a * (1.0 - a) if kind == "logistic" else np.ones_like(a)


def fresh_network(sizes: Sequence[int], activation: str, seed: int) -> Network:
    """Uniform weights within the bounds of Glorot and Bengio (2010)."""
    if activation not in ACTIVATIONS:
        raise ValueError(f"unknown activation {activation!r}, use one of {', '.join(ACTIVATIONS)}")
    rng = np.random.RandomState(seed)
    weights, biases = [], []
    for a, b in zip(sizes[:-1], sizes[1:]):
        bound = math.sqrt((2.0 if activation == "logistic" else 6.0) / (a + b))
        weights.append(rng.uniform(-bound, bound, (a, b)))
        biases.append(rng.uniform(-bound, bound, b))
    return Network(tuple(weights), tuple(biases), activation)


def packed_batches(df: DataFrame, code: Column, d: int, rows: int, batches: int, seed: int) -> DataFrame:
    """(batch, x, y, w): the labelled rows as matrices in row order, written by batch.

    Equal rows get one batch number by content and are spread over the files of the
    batch by the task they come from, so a row that is repeated often meets no single task.
    """
    weight = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
    wide = df.select("bands", code.cast("int").alias("code"), weight.alias("weight"))
    files = max(1, math.ceil(rows * d * 8 / FILE_BYTES / batches))
    if batches > 1:
        digest = F.xxhash64(F.lit(seed), "bands", "code")
        number = F.pmod(digest, F.lit(batches)).cast("int")
        wide = wide.withColumn("batch", number).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(files)))
        wide = wide.repartition(min(batches * files, 4096), "batch", "salt").drop("salt")
    else:
        wide = wide.withColumn("batch", F.lit(0))

    def pack(parts):
        for part in parts:
            if part.num_rows == 0:
                continue
            x = matrix(part, d)
            y, w, number = (part.column(c).to_numpy(zero_copy_only=False) for c in ("code", "weight", "batch"))
            groups = [(b, np.flatnonzero(number == b)) for b in np.unique(number)]
            yield pa.RecordBatch.from_arrays([
                pa.array([int(b) for b, _ in groups], pa.int32()), *(
                    pa.array([np.ascontiguousarray(a[at], dtype=kind).tobytes() for _, at in groups], pa.binary())
                    for a, kind in ((x, np.float64), (y, np.int32), (w, np.float64)))], names=["batch", "x", "y", "w"])

    path = scratch_path(df.sparkSession, "batches")
    wide.mapInArrow(pack, "batch int, x binary, y binary, w binary").write.partitionBy("batch").parquet(path)
    return df.sparkSession.read.schema("x binary, y binary, w binary, batch int").parquet(path)


def gradient_sum(blocks: DataFrame, network: Network, d: int, tasks: int) -> np.ndarray:
    """Gradient, loss and weight of all rows in `blocks`, which about `tasks` tasks read."""
    size = len(network.flat()) + 2

    def one_row(total):
        return pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["g"])

    def task(parts):
        total, seen = np.zeros(size), False
        for part in parts:
            for x, y, w in zip(*(part.column(c) for c in ("x", "y", "w"))):
                rows = np.frombuffer(x.as_buffer(), dtype=np.float64).reshape(-1, d)
                total += network.gradient(rows, np.frombuffer(y.as_buffer(), dtype=np.int32), np.frombuffer(w.as_buffer(), dtype=np.float64))
                seen = True
        if seen:
            yield one_row(total)

    def add(parts):
        total = np.zeros(size)
        for part in parts:
            if part.num_rows:
                total += matrix(part, size, "g").sum(axis=0)
        yield one_row(total)

    sums = blocks.select("x", "y", "w").mapInArrow(task, "g array<double>")
    if tasks > FAN_IN:
        sums = sums.repartition(math.ceil(math.sqrt(tasks))).mapInArrow(add, "g array<double>")
    rows = sums.collect()
    return np.sum([r["g"] for r in rows], axis=0) if rows else np.zeros(size)


def fit_perceptron(
    df: DataFrame, code: Column, d: int, outputs: int, hidden: Sequence[int] = (50,), activation: str = "relu",
    alpha: float = 1e-4, rate: float = 1e-3, schedule: str = "constant", epochs: int = 200, batch_size: int | None = None,
    tol: float = 1e-4, seed: int = 0, start: Network | None = None,
) -> tuple[Network, list[float]]:
    """The network and the loss of every epoch, taken before each of its steps.

    The loss is the mean cross entropy plus alpha / 2 times the squared weights per
    row of a batch. The fit ends after `epochs`, or once ten epochs in a row improved the
    least loss by less than `tol`; an `adaptive` rate is divided by five after two such
    epochs instead, until it is spent. Rows with weight 0 have no effect.
    """
    if schedule not in RATES:
        raise ValueError(f"unknown schedule {schedule!r}, use one of {', '.join(RATES)}")
    n = df.count()
    if n == 0:
        raise ValueError("no labelled samples to fit")
    size = int(batch_size) if batch_size else max(SMALL_BATCH, math.ceil(n / STEPS))
    batches = max(1, round(n / size))
    network = start or fresh_network([d, *hidden, outputs], activation, seed)
    if network.sizes[0] != d or network.sizes[-1] != outputs:
        raise ValueError(f"a start network of {network.sizes} units for {d} bands and {outputs} classes")
    table = packed_batches(df, code, d, n, batches, seed)
    tasks = table.filter(F.col("batch") == 0).rdd.getNumPartitions()
    parameters = network.flat()
    decayed = np.concatenate([np.full(p.size, float(k == 0)) for pair in zip(network.weights, network.biases) for k, p in enumerate(pair)])
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    steps, losses, least, stalled = 0, [], math.inf, 0
    for _ in range(int(epochs)):
        loss, mass = 0.0, 0.0
        for b in range(batches):
            sums = gradient_sum(table.filter(F.col("batch") == b), network.moved(parameters), d, tasks)
            weight = sums[-1]
            if weight == 0:
                continue
            gradient = (sums[:-2] + alpha * decayed * parameters) / weight
            loss += sums[-2] + alpha / 2 * float((decayed * parameters) @ parameters)
            mass += weight
            steps += 1
            first = DECAY_1 * first + (1 - DECAY_1) * gradient
            second = DECAY_2 * second + (1 - DECAY_2) * gradient**2
            pace = rate * math.sqrt(1 - DECAY_2**steps) / (1 - DECAY_1**steps)
            parameters = parameters - pace * first / (np.sqrt(second) + EPSILON)
        if mass == 0:
            raise ValueError("all samples have weight 0")
        losses.append(loss / mass)
        if not math.isfinite(losses[-1]):
            raise ValueError("the loss is not finite: bands hold NaN or infinite values, or the rate is too large")
        stalled = 0 if losses[-1] < least - tol else stalled + 1
        least = min(least, losses[-1])
        if schedule == "adaptive" and stalled >= RATE_PATIENCE:
            rate, stalled = rate / RATE_FALL, 0
            if rate < LEAST_RATE:
                break
        elif stalled >= PATIENCE:
            break
    return network.moved(parameters), losses
