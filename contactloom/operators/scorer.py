"""Scores of images: a plain score in SQL, and a small convolutional network that knows masked cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_score(x: Column, side: int = 20) -> Column:
    """Contacts between both halves of an image, relative to those within the halves, at most 1.

    The two blocks off the diagonal hold contacts across the middle. 0 for an image without contacts,
    null for a null one.
    """
    half = side // 2
    rows = F.sequence(F.lit(0), F.lit(side - 1))
    # of each row the half beyond the middle, or the other one
    far = lambda r: F.slice(x, r * side + F.when(r < half, half + 1).otherwise(1), half)
    near = lambda r: F.slice(x, r * side + F.when(r < half, 1).otherwise(half + 1), half)
    add = lambda total, v: total + F.greatest(F.coalesce(v, F.lit(0)), F.lit(0))
    cross, own = (F.aggregate(F.flatten(F.transform(rows, part)), F.lit(0).cast("long"), add) for part in (far, near))
    return F.when(x.isNotNull(), F.least(F.coalesce(F.try_divide(cross, own), F.lit(0.0)), F.lit(1.0)))


class Tape:
    """Remembers how arrays were made, so that gradients go back the same way."""

    def __init__(self) -> None:
        self._steps: list[tuple[np.ndarray, tuple]] = []

    def made(self, out: np.ndarray, *parts: tuple) -> np.ndarray:
        """Notes that out was made of parts: pairs of an array and of what turns out's gradient into the array's."""
        self._steps.append((out, parts))
        return out

    def gradients(self, out: np.ndarray, start: np.ndarray) -> dict[int, np.ndarray]:
        """The gradient of each array that was not made itself, by its id()."""
        found = {id(out): start}
        for made, parts in reversed(self._steps):
            gradient = found.pop(id(made), None)
            if gradient is not None:
                for source, back in parts:
                    part = back(gradient)
                    found[id(source)] = found[id(source)] + part if id(source) in found else part
        return found


def relu(x: np.ndarray, tape: Tape | None) -> np.ndarray:
    out = np.maximum(x, 0)
    return tape.made(out, (x, lambda g: g * (out > 0))) if tape else out


def linear(x: np.ndarray, weight: np.ndarray, bias: np.ndarray, tape: Tape | None) -> np.ndarray:
    out = x @ weight.T + bias
    return tape.made(out, (x, lambda g: g @ weight), (weight, lambda g: g.T @ x), (bias, lambda g: g.sum(0))) if tape else out


class Network:
    """A residual network with partial convolutions; weights come from a seed, a mapping or operators.training.

    A partial convolution sees valid cells only: its sums are scaled by the part of the kernel that is
    valid, and a cell stays valid if any cell under the kernel was.
    """

    WIDTHS = ((16, 2), (32, 1), (64, 1), (64, 2))
    PATHS = 4

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 7, latent: int = 64):
        self.weights, self.latent = dict(weights or {}), latent
        self._random = np.random.default_rng(seed)

    def _weight(self, name: str, *shape: int) -> np.ndarray:
        if name not in self.weights:
            fan = int(np.prod(shape[1:])) or 1
            self.weights[name] = (self._random.standard_normal(shape) * np.sqrt(2 / fan)).astype(np.float32)
        return self.weights[name]

    def _bias(self, name: str, size: int) -> np.ndarray:
        return self.weights.setdefault(name, np.zeros(size, np.float32))

    def ready(self, side: int = 20) -> Network:
        """The network with all its weights made."""
        self.predict(np.zeros((1, side, side), np.float32))
        return self

    @staticmethod
    def partial(
        x: np.ndarray, mask: np.ndarray, kernel: np.ndarray, stride: int = 1, tape: Tape | None = None, inner: bool = True
    ) -> tuple[np.ndarray, np.ndarray]:
        """Convolution of (n, in, h, w) with (out, in, k, k) under a mask (n, 1, h, w), padded by k // 2; x of an inner one gets a gradient."""
        k = kernel.shape[-1]
        pad = ((0, 0), (0, 0), (k // 2, k // 2), (k // 2, k // 2))
        see = lambda a: np.lib.stride_tricks.sliding_window_view(np.pad(a, pad), (k, k), (2, 3))[:, :, ::stride, ::stride]
        valid = see(mask).sum((1, 4, 5))[:, None]
        seen = see(x * mask)
        new = np.clip(valid, 0, 1)
        scale = k * k / (valid + 1e-8) * new
        out = (np.tensordot(seen, kernel, ([1, 4, 5], [1, 2, 3])).transpose(0, 3, 1, 2) * scale).astype(np.float32)
        if tape:

            def to_x(g: np.ndarray) -> np.ndarray:
                g = g * scale
                wide = np.zeros([n + 2 * (k // 2) if i > 1 else n for i, n in enumerate(x.shape)], np.float32)
                h, w = g.shape[2:]
                for i in range(k):
                    for j in range(k):
                        part = np.tensordot(g, kernel[:, :, i, j], ([1], [0])).transpose(0, 3, 1, 2)
                        wide[:, :, i : i + stride * (h - 1) + 1 : stride, j : j + stride * (w - 1) + 1 : stride] += part
                return wide[:, :, k // 2 : k // 2 + x.shape[2], k // 2 : k // 2 + x.shape[3]] * mask

            tape.made(out, *([(x, to_x)] if inner else []), (kernel, lambda g: np.tensordot(g * scale, seen, ([0, 2, 3], [0, 2, 3]))))
        return out, new.astype(np.float32)

    def _block(self, name: str, x: np.ndarray, mask: np.ndarray, out: int, stride: int, tape: Tape | None) -> tuple[np.ndarray, np.ndarray]:
        """Residual block: reduced, through parallel paths, restored, and added to its input."""
        width = max(out // (2 * self.PATHS), 1)
        small, small_mask = self.partial(x, mask, self._weight(f"{name}.reduce", width, x.shape[1], 1, 1), 1, tape)
        small = relu(small, tape)
        paths = [self.partial(small, small_mask, self._weight(f"{name}.path{i}", width, width, 3, 3), stride, tape) for i in range(self.PATHS)]
        joined, new = np.concatenate([p[0] for p in paths], 1), paths[0][1]
        if tape:
            tape.made(joined, *((p[0], lambda g, i=i: g[:, i * width : (i + 1) * width]) for i, p in enumerate(paths)))
        restored, _ = self.partial(relu(joined, tape), new, self._weight(f"{name}.restore", out, width * self.PATHS, 1, 1), 1, tape)
        if stride > 1 or x.shape[1] != out:
            x = self.partial(x, mask, self._weight(f"{name}.shortcut", out, x.shape[1], 1, 1), stride, tape)[0]
        added = (restored + x) * new
        if tape:
            tape.made(added, (restored, lambda g: g * new), (x, lambda g: g * new))
        return relu(added, tape), new

    def encode(self, images: np.ndarray, tape: Tape | None = None) -> np.ndarray:
        """(n, latent) of (n, side, side) images; negative cells are masked."""
        mask = (images >= 0).astype(np.float32)[:, None]
        x, mask = self.partial(np.maximum(images, 0).astype(np.float32)[:, None], mask, self._weight("first", 16, 1, 7, 7), 2, tape, inner=False)
        x = relu(x, tape)
        for i, (out, stride) in enumerate(self.WIDTHS[1:]):
            x, mask = self._block(f"block{i}", x, mask, out, stride, tape)
        cells = x.shape[2] * x.shape[3]
        pooled = x.reshape(*x.shape[:2], -1).mean(2)[:, : self.latent]
        if tape:
            tape.made(pooled, (x, lambda g: np.broadcast_to(g[:, :, None, None] / cells, x.shape)))
        return pooled

    def logits(self, images: np.ndarray, tape: Tape | None = None, kept: np.ndarray | None = None) -> np.ndarray:
        """(n, 1): the score of each image; kept are factors of the 32 hidden values (dropout)."""
        hidden = relu(linear(self.encode(images, tape), self._weight("head1", 32, self.latent), self._bias("head1.bias", 32), tape), tape)
        if kept is not None:
            full, hidden = hidden, hidden * kept
            if tape:
                tape.made(hidden, (full, lambda g: g * kept))
        return linear(hidden, self._weight("head2", 1, 32), self._bias("head2.bias", 1), tape)

    def predict(self, images: np.ndarray) -> np.ndarray:
        """Probability of each image."""
        return 1 / (1 + np.exp(-np.clip(self.logits(images)[:, 0], -60, 60)))


def scaled(x: pd.Series, side: int, top: float) -> np.ndarray:
    """(n, side, side) of a column of whole images, divided by `top` and clipped; -1 stays."""
    cells = np.stack(x.to_numpy()).astype(np.float32).reshape(-1, side, side) if len(x) else np.zeros((0, side, side), np.float32)
    return np.where(cells == -1, -1, np.clip(cells / top, 0, 1)).astype(np.float32)


def whole_images(images: DataFrame, side: int) -> DataFrame:
    """The rows with an image of side x side cells, none of them null."""
    return images.where((F.size("x") == side * side) & ~F.exists("x", lambda v: v.isNull()))


def network_scores(images: DataFrame, key: str = "sample_id", side: int = 20, top: float = 31.0, network: Network | None = None) -> DataFrame:
    """(key, prob) of each image of side x side cells, divided by `top` and clipped; others are left out."""
    network = (network or Network()).ready(side)
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "prob": network.predict(scaled(batch["x"], side, top)).astype(float)})

    return whole_images(images, side).select(key, "x").mapInPandas(run, f"`{key}` {kind}, prob double")
