"""Reverse-mode differentiation over numpy arrays: what the learned embedders need, and no more."""

from __future__ import annotations

import numpy as np


def _fit(grad: np.ndarray, shape: tuple) -> np.ndarray:
    """Sums a gradient over the axes that broadcasting added."""
    while grad.ndim > len(shape):
        grad = grad.sum(0)
    for k, n in enumerate(shape):
        if n == 1 and grad.shape[k] != 1:
            grad = grad.sum(k, keepdims=True)
    return grad


class Tensor:
    """An array that remembers how it was made."""

    def __init__(self, data, parents=(), back=None):
        self.data, self.parents, self.back = np.asarray(data, np.float64), parents, back
        self.grad: np.ndarray | None = None

    @property
    def shape(self):
        return self.data.shape

    def _add(self, g):
        self.grad = g if self.grad is None else self.grad + g

    def __add__(self, other):
        o = other if isinstance(other, Tensor) else Tensor(other)
        return Tensor(self.data + o.data, (self, o), lambda g: (_fit(g, self.shape), _fit(g, o.shape)))

    __radd__ = __add__

    def __mul__(self, other):
        o = other if isinstance(other, Tensor) else Tensor(other)
        return Tensor(self.data * o.data, (self, o), lambda g: (_fit(g * o.data, self.shape), _fit(g * self.data, o.shape)))

    __rmul__ = __mul__

    def __sub__(self, other):
        return self + (other * -1.0 if isinstance(other, Tensor) else -np.asarray(other, float))

    def __matmul__(self, o):
        def back(g):
            a = g @ np.swapaxes(o.data, -1, -2)
            b = np.swapaxes(self.data, -1, -2) @ g
            return _fit(a, self.shape), _fit(b, o.shape)

        return Tensor(self.data @ o.data, (self, o), back)

    def map(self, value, slope):
        return Tensor(value, (self,), lambda g: (g * slope,))

    def relu(self):
        return self.map(np.maximum(self.data, 0), self.data > 0)

    def exp(self):
        v = np.exp(np.clip(self.data, -30, 30))
        return self.map(v, v)

    def log(self, tiny: float = 1e-10):
        v = np.maximum(self.data, tiny)
        return self.map(np.log(v), 1 / v)

    def sigmoid(self):
        v = 1 / (1 + np.exp(-np.clip(self.data, -30, 30)))
        return self.map(v, v * (1 - v))

    def softplus(self):
        x = np.clip(self.data, -30, 30)
        return self.map(np.log1p(np.exp(x)), 1 / (1 + np.exp(-x)))

    def power(self, k: float):
        return self.map(self.data**k, k * self.data ** (k - 1))

    def sum(self, axis=None, keepdims=False):
        def back(g):
            g = np.asarray(g)
            if axis is not None and not keepdims:
                g = np.expand_dims(g, axis)
            return (np.broadcast_to(g, self.shape),)

        return Tensor(self.data.sum(axis=axis, keepdims=keepdims), (self,), back)

    def mean(self, axis=None, keepdims=False):
        n = self.data.size if axis is None else self.data.shape[axis]
        return self.sum(axis, keepdims) * (1.0 / n)

    def reshape(self, *shape):
        return Tensor(self.data.reshape(shape), (self,), lambda g: (g.reshape(self.shape),))

    def transpose(self, *axes):
        return Tensor(self.data.transpose(axes), (self,), lambda g: (g.transpose(np.argsort(axes)),))

    def take(self, rows: np.ndarray, axis: int = 0):
        """Entries along an axis; -1 gives zeros."""
        gone = rows < 0
        at = np.where(gone, 0, rows)
        v = np.take(self.data, at, axis)
        mask = np.expand_dims(~gone, tuple(range(axis)) + tuple(range(axis + rows.ndim, v.ndim)))

        def back(g):
            out = np.zeros(self.shape)
            np.add.at(out, (*[slice(None)] * axis, at), g * mask)
            return (out,)

        return Tensor(v * mask, (self,), back)

    def softmax(self):
        e = np.exp(self.data - self.data.max(-1, keepdims=True))
        v = e / e.sum(-1, keepdims=True)
        return Tensor(v, (self,), lambda g: (v * (g - (g * v).sum(-1, keepdims=True)),))

    def norm(self):
        """Zero mean and unit variance over the last axis."""
        c = self - self.mean(-1, keepdims=True)
        return c * ((c * c).mean(-1, keepdims=True) + 1e-5).power(-0.5)

    def backward(self):
        order, seen = [], set()

        def visit(t):
            if id(t) not in seen:
                seen.add(id(t))
                for p in t.parents:
                    visit(p)
                order.append(t)

        visit(self)
        self.grad = np.ones(self.shape)
        for t in reversed(order):
            if t.back is not None and t.grad is not None:
                for p, g in zip(t.parents, t.back(t.grad), strict=True):
                    p._add(g)


class Adam:
    def __init__(self, params: list[Tensor], rate: float = 1e-3, decay: float = 0.0):
        self.params, self.rate, self.decay, self.t = params, rate, decay, 0
        self.m, self.v = [np.zeros(p.shape) for p in params], [np.zeros(p.shape) for p in params]

    def step(self):
        self.t += 1
        for p, m, v in zip(self.params, self.m, self.v, strict=True):
            if p.grad is None:
                continue
            m += 0.1 * (p.grad - m)
            v += 0.001 * (p.grad**2 - v)
            p.data = p.data * (1 - self.rate * self.decay) - self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
            p.grad = None


def xavier(rng: np.random.Generator, n_in: int, n_out: int) -> Tensor:
    bound = np.sqrt(6 / (n_in + n_out))
    return Tensor(rng.uniform(-bound, bound, (n_in, n_out)))
