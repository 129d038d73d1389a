"""Reverse-mode differentiation over numpy arrays: as much as the small networks here need."""

from __future__ import annotations

import numpy as np


def _fit(g: np.ndarray, shape: tuple) -> np.ndarray:
    """A gradient summed over the axes that broadcasting added."""
    while g.ndim > len(shape):
        g = g.sum(0)
    for i, n in enumerate(shape):
        if n == 1 and g.shape[i] != 1:
            g = g.sum(i, keepdims=True)
    return g


class Tensor:
    """A value with the parents it came from and how its gradient goes back to each. Constants, and what is made of constants alone, get no gradient: none is computed for them."""

    __array_priority__ = 100

    def __init__(self, value, parents: tuple = (), constant: bool = False):
        self.value, self.grad = np.asarray(value, float), None
        self.parents = tuple([p for p in parents if not p[0].constant])
        self.constant = constant or bool(parents) and not self.parents

    @staticmethod
    def of(x) -> Tensor:
        return x if isinstance(x, Tensor) else Tensor(x, constant=True)

    @property
    def shape(self) -> tuple:
        return self.value.shape

    def __add__(self, other):
        a, b = self, Tensor.of(other)
        return Tensor(a.value + b.value, ((a, lambda g: g), (b, lambda g: g)))

    __radd__ = __add__

    def __mul__(self, other):
        a, b = self, Tensor.of(other)
        return Tensor(a.value * b.value, ((a, lambda g: g * b.value), (b, lambda g: g * a.value)))

    __rmul__ = __mul__

    def __neg__(self):
        return self * -1.0

    def __sub__(self, other):
        return self + -Tensor.of(other)

    def __rsub__(self, other):
        return Tensor.of(other) + -self

    def __truediv__(self, other):
        return self * Tensor.of(other).power(-1)

    def __matmul__(self, other):
        a, b = self, Tensor.of(other)
        return Tensor(a.value @ b.value, ((a, lambda g: g @ b.value.T), (b, lambda g: a.value.T @ g)))

    def __getitem__(self, key):
        def back(g):
            out = np.zeros(self.shape)
            if isinstance(key, np.ndarray) and key.ndim == 1 and len(key) and (key[1:] > key[:-1]).all() and key[0] >= 0:
                out[key] = g  # rising places: none is met twice
            else:
                np.add.at(out, key, g)
            return out

        return Tensor(self.value[key], ((self, back),))

    def apply(self, value, slope) -> Tensor:
        return Tensor(value, ((self, lambda g: g * slope),))

    def power(self, k: float):
        return self.apply(self.value**k, k * self.value ** (k - 1.0))

    def exp(self):
        e = np.exp(self.value)
        return self.apply(e, e)

    def log(self):
        return self.apply(np.log(self.value), 1 / self.value)

    def abs(self):
        return self.apply(np.abs(self.value), np.sign(self.value))

    def relu(self):
        return self.apply(np.maximum(self.value, 0), self.value > 0)

    def sigmoid(self):
        s = 1 / (1 + np.exp(-np.clip(self.value, -500, 500)))
        return self.apply(s, s * (1 - s))

    def softplus(self):
        return self.apply(np.logaddexp(0, self.value), 1 / (1 + np.exp(-np.clip(self.value, -500, 500))))

    def sum(self, axis=None, keepdims=False):
        def back(g):
            g = g if axis is None or keepdims else np.expand_dims(g, axis)
            return np.broadcast_to(g, self.shape)

        return Tensor(self.value.sum(axis=axis, keepdims=keepdims), ((self, back),))

    def mean(self, axis=None, keepdims=False):
        n = self.value.size if axis is None else self.shape[axis]
        return self.sum(axis, keepdims) * (1 / max(1, n))

    def stop(self) -> Tensor:
        """The value without its past."""
        return Tensor(self.value)

    def backward(self) -> None:
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            node, done = stack.pop()
            if done:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                stack.append((node, True))
                stack += [(p, False) for p, _ in node.parents]
        self.grad = np.ones(self.shape)
        for node in reversed(order):
            for parent, back in node.parents:
                g = np.asarray(back(node.grad), float)
                if g.shape != parent.shape:
                    g = _fit(g, parent.shape)
                parent.grad = g if parent.grad is None else parent.grad + g


def concat(parts: list[Tensor]) -> Tensor:
    """Along the last axis."""
    ends = np.cumsum([p.shape[-1] for p in parts])
    return Tensor(np.concatenate([p.value for p in parts], -1), tuple((p, lambda g, a=e - p.shape[-1], e=e: g[..., a:e]) for p, e in zip(parts, ends)))


def bce(logit: Tensor, y) -> Tensor:
    """Elementwise cross entropy of a logit."""
    return logit.softplus() - logit * y


def softmax_ce(logits: Tensor, label: np.ndarray) -> Tensor:
    top = logits - logits.value.max(-1, keepdims=True)
    return top.exp().sum(-1).log() - top[np.arange(len(label)), label]
