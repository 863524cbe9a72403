"""Reverse-mode gradients of plain array code.

A Tensor stands in for an array: numpy's functions and operators applied to it
give Tensors that know how to pass a gradient back.  Only what the forward passes
of ``models`` and the losses of ``training`` use is there; anything else raises.
"""

from __future__ import annotations

import sys

import numpy as np
from numpy.lib.mixins import NDArrayOperatorsMixin
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _fit(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """g summed over the axes along which shape was broadcast."""
    g = g.sum(axis=tuple(range(g.ndim - len(shape))))
    return g.sum(axis=tuple(i for i, n in enumerate(shape) if n == 1 and g.shape[i] != 1), keepdims=True)


def value(x):
    return x.data if isinstance(x, Tensor) else np.asarray(x, float)


class Tensor(NDArrayOperatorsMixin):
    def __init__(self, data, parents=()):
        self.data, self.grad, self.parents = np.asarray(data, float), None, parents

    shape = property(lambda self: self.data.shape)
    T = property(lambda self: self.transpose(*reversed(range(self.data.ndim))))

    def __len__(self):
        return len(self.data)

    def __array_ufunc__(self, ufunc, method, *inputs, **kwargs):
        if method != "__call__" or kwargs or ufunc not in _UFUNCS:
            return NotImplemented
        values = [value(x) for x in inputs]
        out = ufunc(*values)
        backs = _UFUNCS[ufunc](out, *values)
        return Tensor(out, [(x, lambda g, b=b, s=v.shape: _fit(b(g), s)) for x, v, b in zip(inputs, values, backs, strict=True) if isinstance(x, Tensor)])

    def __array_function__(self, func, types, args, kwargs):
        return _FUNCTIONS[func](*args, **kwargs) if func in _FUNCTIONS else NotImplemented

    def __getitem__(self, at):
        def back(g):
            full = np.zeros_like(self.data)
            np.add.at(full, at, g)
            return full

        return Tensor(self.data[at], [(self, back)])

    def reshape(self, *shape):
        return Tensor(self.data.reshape(*shape), [(self, lambda g: g.reshape(self.shape))])

    def transpose(self, *axes):
        return Tensor(self.data.transpose(*axes), [(self, lambda g: g.transpose(*np.argsort(axes)))])

    def sum(self, axis=None, keepdims=False):
        def back(g):
            return np.broadcast_to(g if keepdims or axis is None else np.expand_dims(g, axis), self.shape)

        return Tensor(self.data.sum(axis=axis, keepdims=keepdims), [(self, back)])

    def mean(self, axis=None, keepdims=False):
        out = self.sum(axis, keepdims)
        return out * (out.data.size / self.data.size)

    def max(self, axis=None, keepdims=False):
        """A number to subtract, through which no gradient goes."""
        return self.data.max(axis=axis, keepdims=keepdims)

    def backward(self) -> None:
        """Gradients of this number with respect to all that it came from."""
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            node, done = stack.pop()
            if done:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                stack.append((node, True))
                stack += [(p, False) for p, _ in node.parents]
        self.grad = np.ones_like(self.data)
        for node in reversed(order):
            for parent, back in node.parents:
                g = back(node.grad)
                parent.grad = g if parent.grad is None else parent.grad + g


_swap = lambda x: np.swapaxes(x, -1, -2)
_UFUNCS = {
    np.add: lambda out, a, b: (lambda g: g, lambda g: g),
    np.subtract: lambda out, a, b: (lambda g: g, lambda g: -g),
    np.multiply: lambda out, a, b: (lambda g: g * b, lambda g: g * a),
    np.true_divide: lambda out, a, b: (lambda g: g / b, lambda g: -g * out / b),
    np.matmul: lambda out, a, b: (lambda g: g @ _swap(b), lambda g: _swap(a) @ g),
    np.negative: lambda out, a: (lambda g: -g,),
    np.exp: lambda out, a: (lambda g: g * out,),
    np.tanh: lambda out, a: (lambda g: g * (1 - out * out),),
    np.sqrt: lambda out, a: (lambda g: g / (2 * out),),
    np.absolute: lambda out, a: (lambda g: g * np.sign(a),),
    np.maximum: lambda out, a, b: (lambda g: g * (a > b), lambda g: g * (a <= b)),
}


def _where(condition, a, b):
    va, vb = value(a), value(b)
    pairs = ((a, va, lambda g: np.where(condition, g, 0.0)), (b, vb, lambda g: np.where(condition, 0.0, g)))
    return Tensor(np.where(condition, va, vb), [(x, lambda g, f=f, s=v.shape: _fit(f(g), s)) for x, v, f in pairs if isinstance(x, Tensor)])


def _split(x, n, axis=0):
    width = x.shape[axis] // n
    at = lambda k: tuple(slice(k * width, (k + 1) * width) if i == axis % len(x.shape) else slice(None) for i in range(len(x.shape)))
    return [x[at(k)] for k in range(n)]


def _stack(xs, axis=0):
    return Tensor(np.stack([value(x) for x in xs], axis), [(x, lambda g, i=i: np.take(g, i, axis)) for i, x in enumerate(xs) if isinstance(x, Tensor)])


def _concatenate(xs, axis=0):
    edges = np.cumsum([0, *(x.shape[axis] for x in xs)])
    return Tensor(np.concatenate([value(x) for x in xs], axis), [(x, lambda g, i=i: np.take(g, range(edges[i], edges[i + 1]), axis)) for i, x in enumerate(xs) if isinstance(x, Tensor)])


def _clip(x, low, high):
    return Tensor(np.clip(x.data, low, high), [(x, lambda g: g * ((x.data >= low) & (x.data <= high)))])


_FUNCTIONS = {np.where: _where, np.split: _split, np.stack: _stack, np.concatenate: _concatenate, np.clip: _clip}
