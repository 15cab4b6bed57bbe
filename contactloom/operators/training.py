"""Training of the scoring network on all labelled images, each task on its own part of them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.operators.scorer import Network, Tape, scaled, whole_images
from contactloom.session import cut

#: Decay of AdamW's two moments, the guard of its division, and the decay of weights.
BETA1, BETA2, EPSILON, DECAY = 0.9, 0.999, 1e-8, 0.01


def focal_slope(z: np.ndarray, y: np.ndarray, gamma: float, positive: float, negative: float) -> np.ndarray:
    """The slope of each image's focal loss -weight * (1 - p)^gamma * log(p) by its score; p is the label's probability."""
    sign = np.where(y == 1, 1.0, -1.0)
    p = 1 / (1 + np.exp(-np.clip(sign * z, -60, 60)))
    weight = np.where(y == 1, positive, negative)
    return sign * weight * (1 - p) ** gamma * (gamma * p * np.log(np.maximum(p, 1e-30)) - (1 - p))


def gradients(network: Network, x: np.ndarray, y: np.ndarray, kept: np.ndarray | None, gamma: float, positive: float, negative: float) -> dict[str, np.ndarray]:
    """The gradient of the mean focal loss by each weight."""
    tape = Tape()
    z = network.logits(x, tape, kept)
    slope = focal_slope(z[:, 0].astype(float), y, gamma, positive, negative) / len(y)
    found = tape.gradients(z, slope[:, None].astype(np.float32))
    return {name: found.get(id(w), np.zeros_like(w)) for name, w in network.weights.items()}


def packed(parts: list[dict[str, np.ndarray]]) -> np.ndarray:
    """Mappings of arrays in a row, by name."""
    return np.concatenate([part[name].ravel() for part in parts for name in sorted(part)])


def unpacked(values: np.ndarray, like: dict[str, np.ndarray], parts: int) -> list[dict[str, np.ndarray]]:
    """The opposite of packed."""
    at, found = 0, []
    for _ in range(parts):
        part = {}
        for name in sorted(like):
            size = like[name].size
            part[name] = values[at : at + size].reshape(like[name].shape).astype(np.float32)
            at += size
        found.append(part)
    return found


def trained(
    images: DataFrame,
    network: Network | None = None,
    epochs: int = 10,
    rows_per_task: int = 1024,
    most_tasks: int = 256,
    batch: int = 32,
    rate: float = 1e-3,
    gamma: float = 1.0,
    positive: float = 1.0,
    negative: float = 1.2,
    dropout: float = 0.5,
    side: int = 20,
    top: float = 31.0,
    freeze_encoder: bool = False,
    seed: int = 7,
) -> Network:
    """The network after `epochs` passes over all images of side x side cells with y 0 or 1.

    Parameter averaging: images are spread over tasks by a hash of their sample_id, about rows_per_task
    to each and more only where most_tasks are not enough. In each pass every task takes AdamW steps in small batches on its own part, beginning with the common weights; then
    weights and moments are averaged by rows. The sums are made on Spark, so only one vector of the
    network's own size comes to the driver, however many images and tasks there are. Images stream
    through a task by Arrow batches. The rate falls as a cosine; the loss is a focal one.

    Rows with another y, a null or incomplete x or cells that are null are left out; repeated rows count
    as often as they come. Without any row the network stays as it is. With the same seed and
    rows the result is the same up to the order of sums. freeze_encoder trains the head only.
    """
    start = (network or Network(seed=seed)).ready(side)
    names = [n for n in start.weights if n.startswith("head") or not freeze_encoder]
    zeros = {n: np.zeros_like(start.weights[n]) for n in names}
    state, steps = packed([{n: start.weights[n] for n in names}, zeros, zeros]), 0
    frozen, latent = {n: w for n, w in start.weights.items() if n not in names}, start.latent
    rows = whole_images(images.where(F.col("y").isin(0, 1)), side).select("sample_id", F.col("y").cast("int").alias("y"), "x")
    tasks = min(max(math.ceil(rows.count() / rows_per_task), 1), most_tasks)
    # in order within a task, so that a task that runs again takes the same steps
    order = F.xxhash64(F.lit(seed), "sample_id")
    rows = cut(rows.repartition(tasks, order).sortWithinPartitions(order, "sample_id", "y", "x"))
    for epoch in range(epochs):
        now = rate * (1 + math.cos(math.pi * epoch / epochs)) / 2

        def run(batches: Iterator[pd.DataFrame], state=state, steps=steps, epoch=epoch, now=now) -> Iterator[pd.DataFrame]:
            weights, first, second = unpacked(state, zeros, 3)
            own = Network({**frozen, **weights}, latent=latent)
            step, seen = steps, 0
            for part in batches:
                x, y = scaled(part["x"], side, top), part["y"].to_numpy()
                # another order in each pass and batch, the same when a task runs again
                random = np.random.default_rng([seed, epoch, seen])
                order = random.permutation(len(y))
                for at in range(0, len(order), batch):
                    some = order[at : at + batch]
                    kept = (random.random((len(some), 32)) >= dropout).astype(np.float32) / np.float32(1 - dropout)
                    slopes = gradients(own, x[some], y[some], kept, gamma, positive, negative)
                    step += 1
                    for name in names:
                        g, w = slopes[name], own.weights[name]
                        first[name] = BETA1 * first[name] + (1 - BETA1) * g
                        second[name] = BETA2 * second[name] + (1 - BETA2) * g * g
                        move = first[name] / (1 - BETA1**step) / (np.sqrt(second[name] / (1 - BETA2**step)) + EPSILON)
                        own.weights[name] = (w - now * (move + DECAY * w)).astype(np.float32)
                seen += len(y)
            if seen:
                done = packed([{n: own.weights[n] for n in names}, first, second])
                yield pd.DataFrame({"rows": [seen], "steps": [step - steps], "state": [done.astype(float)]})

        parts = cut(rows.mapInPandas(run, "rows long, steps long, state array<double>"))
        mean = parts.select("rows", F.posexplode("state").alias("at", "value")).groupBy("at").agg(
            (F.sum(F.col("value") * F.col("rows")) / F.sum("rows")).alias("value")
        ).toPandas()
        if not len(mean):
            break
        state = mean.sort_values("at")["value"].to_numpy()
        steps += parts.agg(F.max("steps")).first()[0]
    return Network({**frozen, **unpacked(state, zeros, 3)[0]}, latent=latent)


def weight_rows(spark: SparkSession, network: Network) -> DataFrame:
    """(name, shape, value): the weights of a network, one row each, to be written as a table."""
    rows = [(name, list(w.shape), w.ravel().astype(float).tolist()) for name, w in network.weights.items()]
    return spark.createDataFrame(rows, "name string, shape array<int>, value array<float>")


def network_of(rows: DataFrame, latent: int = 64) -> Network:
    """The network with the weights of weight_rows; their number is that of a network's layers."""
    return Network({r["name"]: np.array(r["value"], np.float32).reshape(r["shape"]) for r in rows.collect()}, latent=latent)
