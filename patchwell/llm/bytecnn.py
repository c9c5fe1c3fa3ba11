"""A byte convolutional network in numpy: embedding, filters of several widths, max pooling, softmax.

All filters lie in one bank as wide as the widest of them; narrower ones are zero beyond their width. A batch of
windows of equal length is then one matrix product. Max pooling sends the gradient to one place for each filter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

PAD = 0


def cut_windows(texts: Sequence[bytes], length: int, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, the last of each padded, and the text each belongs to. An empty text has none."""
    owner, out = [], []
    for i, t in enumerate(texts):
        if not t:
            continue
        n = 1 + max(0, -(-(len(t) - length) // hop))
        data = np.zeros((n - 1) * hop + length, np.uint8)
        data[:len(t)] = np.frombuffer(t, np.uint8)
        out.append(np.lib.stride_tricks.sliding_window_view(data, length)[::hop])
        owner.append(np.full(n, i))
    if not out:
        return np.zeros((0, length), np.uint8), np.zeros(0, int)
    return np.concatenate(out), np.concatenate(owner)


@dataclass
class ByteConvNet:
    classes: int
    widths: tuple[int, ...] = (2, 3, 4, 5)
    filters: int = 12
    dims: int = 8
    stride: int = 1
    seed: int = 1
    parts: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        rng, wide = np.random.default_rng(self.seed), max(self.widths)
        self.mask = np.zeros((wide, self.dims, self.filters * len(self.widths)), np.float32)
        for i, w in enumerate(self.widths):
            self.mask[:w, :, i * self.filters:(i + 1) * self.filters] = 1
        self.mask = self.mask.reshape(wide * self.dims, -1)
        if not self.parts:
            normal = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
            self.parts = {"bytes": normal(256, self.dims, by=0.5), "bank": normal(*self.mask.shape, by=0.3) * self.mask,
                          "bias": np.zeros(self.mask.shape[1], np.float32), "out": normal(self.mask.shape[1], self.classes, by=0.1),
                          "out_bias": np.zeros(self.classes, np.float32)}

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """(windows, places, width x dims): the embedded bytes under the bank at each place."""
        wide, n = max(self.widths), len(windows)
        x = self.parts["bytes"][windows].reshape(n, -1)
        places = (windows.shape[1] - wide) // self.stride + 1
        view = np.lib.stride_tricks.as_strided(x, (n, places, wide * self.dims), (x.strides[0], self.stride * self.dims * x.itemsize, x.itemsize), writeable=False)
        return np.ascontiguousarray(view)

    def pooled(self, windows: np.ndarray, where: bool = False):
        cols = self.columns(windows)
        act = (cols.reshape(-1, cols.shape[2]) @ self.parts["bank"]).reshape(len(windows), cols.shape[1], -1)
        if where:
            at = act.argmax(1)
            top = np.take_along_axis(act, at[:, None], 1)[:, 0] + self.parts["bias"]
            return np.maximum(top, 0), at, cols
        return np.maximum(act.max(1) + self.parts["bias"], 0)

    def logits(self, windows: np.ndarray, batch: int = 256) -> np.ndarray:
        out = [self.pooled(windows[i:i + batch]) @ self.parts["out"] + self.parts["out_bias"] for i in range(0, len(windows), batch)]
        return np.concatenate(out) if out else np.zeros((0, self.classes), np.float32)

    def fit(self, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray, steps: int = 1200, batch: int = 128, rate: float = 0.01) -> ByteConvNet:
        """Adam on weighted cross-entropy; the draws depend on the seed alone."""
        rng, wide = np.random.default_rng(self.seed), max(self.widths)
        first = {k: np.zeros_like(v) for k, v in self.parts.items()}
        second = {k: np.zeros_like(v) for k, v in self.parts.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(windows), batch)
            x, y, w = windows[pick], labels[pick], weights[pick]
            h, at, cols = self.pooled(x, where=True)
            p = softmax(h @ self.parts["out"] + self.parts["out_bias"])
            p[np.arange(batch), y] -= 1
            g = p * (w / w.sum())[:, None]
            dh = (g @ self.parts["out"].T) * (h > 0)
            seen = np.take_along_axis(cols, at[:, :, None], 1)  # (batch, filters, width x dims)
            dcol = (dh[:, :, None] * self.parts["bank"].T).reshape(batch, -1, wide, self.dims)
            touched = x[np.arange(batch)[:, None, None], at[:, :, None] * self.stride + np.arange(wide)]
            dbytes = np.stack([np.bincount(touched.ravel(), dcol[..., d].ravel(), 256) for d in range(self.dims)], 1)
            grads = {"out": h.T @ g, "out_bias": g.sum(0), "bias": dh.sum(0), "bank": np.einsum("nf,nfc->cf", dh, seen) * self.mask, "bytes": dbytes}
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, grad in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.99 * second[k] + 0.01 * grad * grad
                self.parts[k] -= (now * first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
        return self


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def mean_by(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Mean of the rows of each owner; zero where it has none."""
    count = np.bincount(owner, minlength=n)
    return np.stack([np.bincount(owner, values[:, c], n) for c in range(values.shape[1])], 1) / np.maximum(count, 1)[:, None]
