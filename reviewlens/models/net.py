"""Single-task and multi-task networks trained data-parallel over Spark partitions.

The training rows are dealt once by a hash of row_id to ``workers``, a setting that depends neither on the rows nor on
the cluster. In each epoch every worker starts from the same weights, runs mini-batch AdamW over its own rows in a new
hash order, and returns its weights; Spark averages them by row count. Rows stream through a task one batch at a
time, and every row is trained: a worker's last batch may be smaller, and its step is scaled by its share of a full batch.
Only weights (of a checked size, independent of the data) pass through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from reviewlens.config import MULTI_TASK, SINGLE_TASK, Config
from reviewlens.functions import argmax, softmax_probability
from reviewlens.operators import metrics
from reviewlens.operators.sampling import order_hash
from reviewlens.operators.statistics import class_weight_map

RECOMMEND, SENTIMENT = "recommend", "sentiment"
CLASSES = {RECOMMEND: 2, SENTIMENT: 3}
CHUNK = 65_536
#: Weights that are updated at once.
STEP_BLOCK = 16_384
#: Bytes of the weights and both moments, which are broadcast in each epoch.
MAX_STATE_BYTES = 1 << 30

Weights = dict[str, np.ndarray]


# ---- the network: shared dense layer, then one head per task ----


@dataclass(frozen=True)
class NetSpec:
    """Layer sizes and losses. One task: a head on the shared layer. Several tasks: a branch of half
    the width with a head each."""

    inputs: int
    tasks: tuple[str, ...]
    task_weights: tuple[float, ...]
    hidden: int = 256
    dropout: float = 0.4

    def shapes(self) -> dict[str, tuple[int, int]]:
        layers = {"shared": (self.inputs, self.hidden)}
        width = self.hidden
        if len(self.tasks) > 1:
            width = self.hidden // 2
            layers |= {f"{t}.branch": (self.hidden, width) for t in self.tasks}
        return layers | {f"{t}.head": (width, CLASSES[t]) for t in self.tasks}

    def initial(self, seed: int) -> Weights:
        rng = np.random.default_rng(seed)
        out: Weights = {}
        for name, (rows, cols) in self.shapes().items():
            bound = 1 / math.sqrt(rows)
            out[f"{name}.w"] = rng.uniform(-bound, bound, (rows, cols)).astype("float32")
            out[f"{name}.b"] = rng.uniform(-bound, bound, cols).astype("float32")
        return out


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    """Normal distribution function by the rational approximation 26.2.17 of Abramowitz and Stegun
    (error below 1e-7), which needs only exp."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return np.where(x >= 0, 1 - upper, upper)


class _Dense:
    """x → gelu(x·w + b), with dropout while training."""

    def __init__(self, w: Weights, name: str, x: np.ndarray, dropout: float, rng):
        self.name, self.x, self.weight = name, x, w[f"{name}.w"]
        z = x @ self.weight + w[f"{name}.b"]
        cdf = _normal_cdf(z)
        self.slope = (cdf + z * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)).astype(x.dtype)
        self.out = (z * cdf).astype(x.dtype)
        if rng is not None and dropout > 0:
            keep = ((rng.random(z.shape) >= dropout) / (1 - dropout)).astype(x.dtype)
            self.out *= keep
            self.slope *= keep

    def backward(self, grad_out: np.ndarray, grads: Weights, inputs: bool = True):
        dz = grad_out * self.slope
        grads[f"{self.name}.w"] = self.x.T @ dz
        grads[f"{self.name}.b"] = dz.sum(axis=0)
        return dz @ self.weight.T if inputs else None


def forward(spec: NetSpec, w: Weights, x: np.ndarray, rng=None):
    """Logits per task, and the layers kept for the backward pass."""
    shared = _Dense(w, "shared", x, spec.dropout, rng)
    branches, logits = {}, {}
    for task in spec.tasks:
        hidden = shared.out
        if len(spec.tasks) > 1:
            branches[task] = _Dense(w, f"{task}.branch", hidden, spec.dropout, rng)
            hidden = branches[task].out
        logits[task] = hidden @ w[f"{task}.head.w"] + w[f"{task}.head.b"]
    return logits, shared, branches


def loss_and_gradients(
    spec: NetSpec, w: Weights, x: np.ndarray, targets: dict[str, np.ndarray], class_weights: np.ndarray, rng=None
) -> tuple[float, Weights]:
    """Weighted sum of the tasks' cross-entropies; the recommend loss also weights its classes."""
    logits, shared, branches = forward(spec, w, x, rng)
    grads: Weights = {}
    into_shared = np.zeros_like(shared.out)
    loss = 0.0
    rows = np.arange(len(x))
    for task, factor in zip(spec.tasks, spec.task_weights):
        y = targets[task]
        sample = class_weights[y] if task == RECOMMEND else np.ones(len(y))
        sample = sample / sample.sum()
        shifted = logits[task] - logits[task].max(axis=1, keepdims=True)
        p = np.exp(shifted) / np.exp(shifted).sum(axis=1, keepdims=True)
        loss += factor * float(-(sample * np.log(p[rows, y] + 1e-30)).sum())
        d = p.copy()
        d[rows, y] -= 1
        d = (d * (factor * sample)[:, None]).astype(x.dtype)
        hidden = branches[task].out if branches else shared.out
        grads[f"{task}.head.w"] = hidden.T @ d
        grads[f"{task}.head.b"] = d.sum(axis=0)
        back = d @ w[f"{task}.head.w"].T
        into_shared += branches[task].backward(back, grads) if branches else back
    shared.backward(into_shared, grads, inputs=False)
    return loss, grads


# ---- the optimiser ----


def learning_rate(step: int, total: int, warmup: int, peak: float) -> float:
    """Linear rise over the warm-up steps, then linear fall to zero."""
    if step < warmup:
        return peak * step / max(1, warmup)
    return peak * max(0.0, (total - step) / max(1, total - warmup))


@dataclass(frozen=True)
class Policy:
    epochs: int = 5
    batch_size: int = 128
    learning_rate: float = 1e-3
    weight_decay: float = 0.01
    warmup_ratio: float = 0.15
    clip_norm: float = 1.0

    @staticmethod
    def of(config: Config) -> Policy:
        return Policy(
            config.epochs, config.batch_size, config.learning_rate, config.weight_decay,
            config.warmup_ratio, config.clip_norm,
        )


def adamw_step(w: Weights, m: Weights, v: Weights, g: Weights, step: int, lr: float, policy: Policy) -> None:
    """One in-place update, with the gradient clipped by its global norm; ``step`` counts from 0. Tensors are updated a block at a
    time, which stays in the processor's cache."""
    norm = math.sqrt(sum(float((x * x).sum()) for x in g.values()))
    scale = min(1.0, policy.clip_norm / (norm + 1e-6))
    one, two = 1 - 0.9 ** (step + 1), 1 - 0.999 ** (step + 1)
    for name in w:
        whole = [x[name].reshape(-1) for x in (w, m, v, g)]
        for at in range(0, len(whole[0]), STEP_BLOCK):
            own, mean, square, grad = (x[at : at + STEP_BLOCK] for x in whole)
            grad = grad * scale
            part = grad - mean
            part *= 0.1
            mean += part
            np.multiply(grad, grad, out=part)
            part -= square
            part *= 0.001
            square += part
            np.divide(square, two, out=grad)
            np.sqrt(grad, out=grad)
            grad += 1e-8
            np.divide(mean, one, out=part)
            part *= lr
            part /= grad
            own *= 1 - lr * policy.weight_decay
            own -= part


# ---- rows to dense batches ----


def _dense(rows: pd.DataFrame, inputs: int) -> np.ndarray:
    x = np.zeros((len(rows), inputs), dtype="float32")
    lengths = rows["indices"].map(len).to_numpy()
    if lengths.sum():
        x[np.repeat(np.arange(len(rows)), lengths), np.concatenate(rows["indices"].to_list())] = (
            np.concatenate(rows["values"].to_list())
        )
    return x


def _batches(parts: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Cut the stream into full batches; the last one may be smaller."""
    held: pd.DataFrame | None = None
    for part in parts:
        held = part if held is None or held.empty else pd.concat([held, part], ignore_index=True)
        start = 0
        while start + size <= len(held):
            yield held.iloc[start : start + size]
            start += size
        held = held.iloc[start:]
    if held is not None and len(held):
        yield held


# ---- training ----


@dataclass
class NetModel:
    """The weights of the best epoch (none if no epoch scored over zero: then the last ones)."""

    spec: NetSpec
    weights: Weights
    best: int | None
    history: list[tuple[int, float, float]] = field(default_factory=list)

    def transform(self, df: DataFrame, shared: Broadcast | None = None) -> DataFrame:
        """Row ids, labels, logits per task, probability of class 1 and predicted classes. The weights are broadcast with the
        returned frame and go with it; a caller that is sooner done passes a broadcast of its own and destroys it."""
        spec, shared = self.spec, shared or df.sparkSession.sparkContext.broadcast(self.weights)

        def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for start in range(0, len(part), 256):
                    rows = part.iloc[start : start + 256]
                    logits, _, _ = forward(spec, shared.value, _dense(rows, spec.inputs))
                    out = {"row_id": rows["row_id"], "label": rows["label"]}
                    for task in spec.tasks:
                        out[f"{task}_logits"] = list(logits[task].astype("float64"))
                    yield pd.DataFrame(out)

        schema = ", ".join(["row_id long", "label int", *[f"{t}_logits array<double>" for t in spec.tasks]])
        scored = df.select("row_id", "label", "indices", "values").mapInPandas(score, schema)
        scored = scored.withColumn("probability", softmax_probability(F.col("recommend_logits"))).withColumn(
            "prediction", argmax(F.col("recommend_logits"))
        )
        if SENTIMENT in spec.tasks:
            scored = scored.withColumn("sentiment_prediction", argmax(F.col("sentiment_logits")))
        return scored

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the weights as a table of (tensor, chunk, values) rows, with the spec beside them."""
        rows = [(n, i, c.tolist()) for n, i, c in _chunks(self.weights)]
        spark.createDataFrame(rows, "tensor string, chunk int, values array<float>").write.mode(
            "overwrite"
        ).parquet(f"{path}/weights")
        s = self.spec
        spark.createDataFrame(
            [(s.inputs, list(s.tasks), list(s.task_weights), s.hidden, s.dropout, self.best)],
            "inputs int, tasks array<string>, task_weights array<double>, hidden int, dropout double, best int",
        ).write.mode("overwrite").parquet(f"{path}/spec")

    @staticmethod
    def load(spark: SparkSession, path: str) -> NetModel:
        s = spark.read.parquet(f"{path}/spec").first()
        spec = NetSpec(s["inputs"], tuple(s["tasks"]), tuple(s["task_weights"]), s["hidden"], s["dropout"])
        rows = _model_rows(spark.read.parquet(f"{path}/weights"))
        return NetModel(spec, _join_chunks(spec.initial(0), rows), s["best"])


def _chunks(tensors: Weights) -> Iterator[tuple[str, int, np.ndarray]]:
    for name, values in tensors.items():
        flat = values.ravel()
        for i in range(0, len(flat), CHUNK):
            yield name, i // CHUNK, flat[i : i + CHUNK]


def _model_rows(df: DataFrame) -> list[tuple[str, int, np.ndarray]]:
    """Fetch a table of weights, as Arrow: its size is that of the model, whatever the data."""
    table = df.select("tensor", "chunk", "values").toArrow()
    values = table["values"].combine_chunks()
    bounds = values.offsets.to_numpy()
    flat = values.values.to_numpy()
    names, chunks = table["tensor"].to_pylist(), table["chunk"].to_pylist()
    return [(n, c, flat[bounds[i] : bounds[i + 1]]) for i, (n, c) in enumerate(zip(names, chunks))]


def _join_chunks(like: Weights, rows: list[tuple[str, int, np.ndarray]]) -> Weights:
    parts: dict[str, list[tuple[int, np.ndarray]]] = {n: [] for n in like}
    for tensor, chunk, values in rows:
        parts[tensor].append((chunk, values))
    return {
        n: np.concatenate([v.astype("float32") for _, v in sorted(parts[n], key=lambda p: p[0])])
        .reshape(like[n].shape)
        for n in like
    }


def _run_epoch(train: DataFrame, state: Weights, spec: NetSpec, policy: Policy, class_weights: np.ndarray,
               seed: int, epoch: int, steps: dict[int, int]) -> tuple[Weights, float]:
    """One epoch of every worker and the row-weighted mean of what they return. ``state`` holds the weights and both
    moment estimates (keys ending in ``/m`` and ``/v``); ``steps`` has the batches of each worker in an epoch."""
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(state)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local = {n: x.copy() for n, x in shared.value.items()}
        w = {n: x for n, x in local.items() if "/" not in n}
        m, v = ({n: local[f"{n}/{s}"] for n in w} for s in "mv")
        done, trained, losses = 0, 0, 0.0
        for rows in _batches(parts, policy.batch_size):
            if not done:
                worker = int(rows["worker"].iloc[0])
                rng = np.random.default_rng([seed, epoch, worker])
                total = steps[worker] * policy.epochs
                warmup = int(policy.warmup_ratio * total)
            targets = {RECOMMEND: rows["label"].to_numpy(), SENTIMENT: rows["sentiment"].to_numpy()}
            x = _dense(rows, spec.inputs)
            loss, grads = loss_and_gradients(spec, w, x, targets, class_weights, rng)
            step = (epoch - 1) * steps[worker] + done
            rate = learning_rate(step, total, warmup, policy.learning_rate) * len(rows) / policy.batch_size
            adamw_step(w, m, v, grads, step, rate, policy)
            done, trained, losses = done + 1, trained + len(rows), losses + loss * len(rows)
        if done:
            out = [("/loss", 0, np.array([losses / trained])), *_chunks(local)]
            for start in range(0, len(out), 16):
                names, chunks, values = zip(*out[start : start + 16])
                packed = [x.tobytes() for x in values]
                yield pd.DataFrame({"worker": worker, "tensor": names, "chunk": chunks, "values": packed, "n": float(trained)})

    # the hash order is new in every epoch and local to the partition: no shuffle
    ordered = train.withColumn("_o", order_hash(f"epoch{epoch}", seed, "row_id")).sortWithinPartitions("_o", "row_id")
    returned = ordered.select("worker", "label", "sentiment", "indices", "values").mapInPandas(
        work, "worker int, tensor string, chunk int, values binary, n double"
    )
    means = returned.groupBy("tensor", "chunk").applyInArrow(_mean, "tensor string, chunk int, values binary").toArrow()
    shared.destroy()
    rows = [(r["tensor"], r["chunk"], np.frombuffer(r["values"], _kind(r["tensor"]))) for r in means.to_pylist()]
    loss = next(values[0] for tensor, _, values in rows if tensor == "/loss")
    return _join_chunks(state, [r for r in rows if r[0] != "/loss"]), float(loss)


def _kind(tensor: str) -> str:
    return "float64" if tensor == "/loss" else "float32"


def _mean(key: tuple, group: pa.Table) -> pa.Table:
    """The mean of a chunk over the workers, weighted by their rows, in double precision and the workers' order."""
    kind = _kind(key[0].as_py())
    total, rows = 0.0, 0.0
    for r in group.sort_by("worker").to_pylist():
        total = total + r["n"] * np.frombuffer(r["values"], kind).astype("float64")
        rows += r["n"]
    mean = (total / rows).astype(kind).tobytes()
    return pa.table({"tensor": pa.array([key[0].as_py()]), "chunk": pa.array([key[1].as_py()], pa.int32()), "values": pa.array([mean], pa.binary())})


def val_macro_f1(model: NetModel, val: DataFrame) -> float:
    shared = val.sparkSession.sparkContext.broadcast(model.weights)
    scored = model.transform(val, shared).withColumn("model", F.lit("net"))
    row = metrics.accuracy_f1(scored).first()
    shared.destroy()
    return float(row["macro_f1"]) if row else 0.0


def dealt_to_workers(train: DataFrame, workers: int) -> DataFrame:
    """The training rows with their ``worker``, one partition each; who gets a row follows from its row_id alone."""
    rows = train.select("row_id", "label", "sentiment", "indices", "values")
    return rows.withColumn("worker", F.pmod(F.xxhash64("row_id"), F.lit(workers)).cast("int")).repartitionById(
        workers, F.col("worker")
    )


def train_net(
    train: DataFrame,
    val: DataFrame,
    inputs: int,
    tasks: tuple[str, ...] = (RECOMMEND,),
    task_weights: tuple[float, ...] | None = None,
    seed: int = 42,
    policy: Policy = Policy(),
    hidden: int = 256,
    dropout: float = 0.4,
    workers: int = Config.workers,
    dealt: DataFrame | None = None,
) -> NetModel:
    """Train on feature rows (row_id, label, sentiment, indices, values) and keep the weights of the
    epoch with the best macro F1 of the recommend head on ``val``; the earliest wins ties. The model depends
    on the rows, the seed and the settings, ``workers`` among them, not on the number of cores. ``dealt`` are the rows as
    ``dealt_to_workers`` gives them, kept by a caller that trains several networks."""
    spec = NetSpec(inputs, tuple(tasks), tuple(task_weights or [1.0] * len(tasks)), hidden, dropout)
    weights_of = class_weight_map(train)
    class_weights = np.array([weights_of.get(c, 0.0) for c in range(CLASSES[RECOMMEND])])
    size = 12 * sum(math.prod(shape) for shape in spec.shapes().values())
    if size > MAX_STATE_BYTES:
        raise ValueError(f"weights and moments of {size} bytes: more than {MAX_STATE_BYTES} are not broadcast")
    own = dealt is None
    if own:
        dealt = dealt_to_workers(train, workers).persist(StorageLevel.MEMORY_AND_DISK)
    weights = spec.initial(seed)
    state = dict(weights)
    for s in "mv":
        state |= {f"{name}/{s}": np.zeros_like(x) for name, x in weights.items()}
    model, best_f1 = NetModel(spec, weights, None), 0.0
    history = []
    try:
        counts = dealt.groupBy("worker").count().collect()  # one row per worker
        if not counts:
            raise ValueError("no training rows")
        steps = {row["worker"]: math.ceil(row["count"] / policy.batch_size) for row in counts}
        for epoch in range(1, policy.epochs + 1):
            state, loss = _run_epoch(dealt, state, spec, policy, class_weights, seed, epoch, steps)
            now = NetModel(spec, {n_: x for n_, x in state.items() if "/" not in n_}, epoch)
            f1 = val_macro_f1(now, val)
            history.append((epoch, loss, f1))
            if f1 > best_f1:
                model, best_f1 = now, f1
            elif model.best is None:
                model = replace(now, best=None)
    finally:
        if own:
            dealt.unpersist()
    model.history = history
    return model


def train_single_task(train, val, inputs, seed, config: Config = Config(), dealt: DataFrame | None = None) -> NetModel:
    return train_net(
        train, val, inputs, (RECOMMEND,), (1.0,), seed, Policy.of(config), config.hidden_dim, config.dropout,
        config.workers, dealt,
    )


def train_multi_task(train, val, inputs, seed, config: Config = Config(), dealt: DataFrame | None = None) -> NetModel:
    return train_net(
        train, val, inputs, (SENTIMENT, RECOMMEND), (config.sentiment_weight, config.recommend_weight), seed,
        Policy.of(config), config.hidden_dim, config.dropout, config.workers, dealt,
    )


TRAINERS = {SINGLE_TASK: train_single_task, MULTI_TASK: train_multi_task}
