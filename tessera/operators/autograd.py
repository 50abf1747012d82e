"""Gradients.  Tensor: reverse-mode differentiation of small dense data on the driver.  Model: a loss over a table whose
parameters live on the driver; its gradients are derived as column expressions and one aggregate gives them all."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Tensor:
    def __init__(self, data, requires_grad: bool = False, _parents=(), _back=None):
        self.data = np.array(getattr(data, "to_numpy", lambda: data)(), float)
        self.requires_grad, self.grad, self._parents, self._back = requires_grad, None, _parents, _back

    from_array = classmethod(lambda cls, a, requires_grad=False: cls(a, requires_grad))
    zeros = classmethod(lambda cls, shape, requires_grad=False: cls(np.zeros(shape), requires_grad))
    ones = classmethod(lambda cls, shape, requires_grad=False: cls(np.ones(shape), requires_grad))
    randn = classmethod(lambda cls, shape, requires_grad=False, seed=None: cls(np.random.default_rng(seed).standard_normal(shape), requires_grad))
    shape, ndim, dtype = property(lambda s: list(s.data.shape)), property(lambda s: s.data.ndim), property(lambda s: str(s.data.dtype))

    @staticmethod
    def _of(o) -> Tensor:
        return o if isinstance(o, Tensor) else Tensor(o)

    def _make(self, data, parents, back) -> Tensor:
        return Tensor(data, any(p.requires_grad for p in parents), parents, back)

    def build_topo(self) -> list[Tensor]:
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            node, done = stack.pop()
            if done:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                stack.append((node, True))
                stack.extend((p, False) for p in node._parents)
        return order

    def backward(self) -> None:
        """Seeds 1 and accumulates into the gradients of everything that asks for one; broadcast inputs get summed ones."""
        if not self.requires_grad:
            return
        flow = {id(self): np.ones_like(self.data)}
        for node in reversed(self.build_topo()):
            g = flow.pop(id(node), None)
            if g is None or not node.requires_grad:
                continue
            node.grad = g if node.grad is None else node.grad + g
            if node._back:
                for p, d in zip(node._parents, node._back(g), strict=True):
                    d = _unbroadcast(np.broadcast_to(d, np.broadcast_shapes(np.shape(d), p.data.shape)), p.data.shape)
                    flow[id(p)] = d if id(p) not in flow else flow[id(p)] + d

    def set_grad(self, g) -> None:
        self.grad = None if g is None else np.array(g, float)

    def zero_grad(self) -> None:
        self.grad = None

    def requires_grad_(self, on: bool = True) -> Tensor:
        self.requires_grad = on
        return self

    def update_data(self, data) -> None:
        self.data = np.array(data, float)

    def __getitem__(self, key):
        return Tensor(self.data[key])

    def __add__(self, o):
        o = Tensor._of(o)
        return self._make(self.data + o.data, (self, o), lambda g: (g, g))

    def __sub__(self, o):
        o = Tensor._of(o)
        return self._make(self.data - o.data, (self, o), lambda g: (g, -g))

    def __rsub__(self, o):
        return Tensor._of(o) - self

    def __mul__(self, o):
        o = Tensor._of(o)
        return self._make(self.data * o.data, (self, o), lambda g: (g * o.data, g * self.data))

    def __truediv__(self, o):
        o = Tensor._of(o)
        return self._make(self.data / o.data, (self, o), lambda g: (g / o.data, -g * self.data / o.data**2))

    def __rtruediv__(self, o):
        return Tensor._of(o) / self

    def __matmul__(self, o):
        o = Tensor._of(o)
        return self._make(self.data @ o.data, (self, o), lambda g: (g @ o.data.T, self.data.T @ g))

    def __rmatmul__(self, o):
        return Tensor._of(o) @ self

    def __neg__(self):
        return self._make(-self.data, (self,), lambda g: (-g,))

    __radd__, __rmul__ = __add__, __mul__

    def _unary(self, data, slope) -> Tensor:
        return self._make(data, (self,), lambda g: (g * slope,))

    def sigmoid(self):
        s = 1 / (1 + np.exp(-self.data))
        return self._unary(s, s * (1 - s))

    def relu(self):
        return self._unary(np.maximum(self.data, 0), (self.data > 0).astype(float))

    def exp(self):
        return self._unary(np.exp(self.data), np.exp(self.data))

    def log(self):
        return self._unary(np.log(self.data), 1 / self.data)

    def tanh(self):
        return self._unary(np.tanh(self.data), 1 - np.tanh(self.data) ** 2)

    def abs(self):
        return self._unary(np.abs(self.data), np.sign(self.data))

    def sum(self):
        return self._make(self.data.sum().reshape(1), (self,), lambda g: (np.broadcast_to(g, self.data.shape),))

    def mean(self):
        return self._make(self.data.mean().reshape(1), (self,), lambda g: (np.broadcast_to(g / self.data.size, self.data.shape),))

    def reshape(self, *shape):
        return self._make(self.data.reshape(*shape), (self,), lambda g: (g.reshape(self.data.shape),))

    def transpose(self):
        return self._make(self.data.T, (self,), lambda g: (g.T,))

    t = transpose

    def __repr__(self) -> str:
        return f"Tensor(shape={self.shape}, requires_grad={self.requires_grad})"


def _unbroadcast(g: np.ndarray, shape) -> np.ndarray:
    while g.ndim > len(shape):
        g = g.sum(0)
    for k, n in enumerate(shape):
        if n == 1 != g.shape[k]:
            g = g.sum(k, keepdims=True)
    return g


class SGD:
    def __init__(self, params, lr: float, momentum: float = 0.0):
        self.params, self.lr, self.momentum, self._v = list(params), lr, momentum, [0.0] * len(params)

    def step(self) -> None:
        for k, p in enumerate(self.params):
            if p.grad is not None:
                self._v[k] = self.momentum * self._v[k] + self.lr * p.grad
                p.data = p.data - self._v[k]

    def zero_grad(self) -> None:
        for p in self.params:
            p.zero_grad()


class Adam(SGD):
    def __init__(self, params, lr: float = 0.001, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8):
        super().__init__(params, lr)
        self.betas, self.eps, self._m, self._t = (beta1, beta2), eps, [0.0] * len(self.params), 0

    def step(self) -> None:
        self._t += 1
        b1, b2 = self.betas
        rate = self.lr * np.sqrt(1 - b2**self._t) / (1 - b1**self._t)
        for k, p in enumerate(self.params):
            if p.grad is not None:
                self._m[k] = b1 * self._m[k] + (1 - b1) * p.grad
                self._v[k] = b2 * self._v[k] + (1 - b2) * p.grad**2
                p.data = p.data - rate * self._m[k] / (np.sqrt(self._v[k]) + self.eps)


class Node:
    """A differentiable column expression of data columns and named parameters."""

    def __init__(self, column, slopes: dict | None = None):
        self.column, self.slopes = column, slopes or {}

    @staticmethod
    def _of(o) -> Node:
        return o if isinstance(o, Node) else Node(o if hasattr(o, "_jc") else F.lit(float(o)))

    def _chain(self, column, *terms) -> Node:
        slopes: dict = {}
        for node, factor in terms:
            for name, s in node.slopes.items():
                slopes[name] = slopes[name] + s * factor if name in slopes else s * factor
        return Node(column, slopes)

    def __add__(self, o):
        o = Node._of(o)
        return self._chain(self.column + o.column, (self, F.lit(1.0)), (o, F.lit(1.0)))

    def __sub__(self, o):
        o = Node._of(o)
        return self._chain(self.column - o.column, (self, F.lit(1.0)), (o, F.lit(-1.0)))

    def __rsub__(self, o):
        return Node._of(o) - self

    def __mul__(self, o):
        o = Node._of(o)
        return self._chain(self.column * o.column, (self, o.column), (o, self.column))

    def __truediv__(self, o):
        o = Node._of(o)
        return self._chain(self.column / o.column, (self, 1 / o.column), (o, -self.column / (o.column * o.column)))

    def __neg__(self):
        return self * -1.0

    __radd__, __rmul__ = __add__, __mul__

    def exp(self):
        return self._chain(F.exp(self.column), (self, F.exp(self.column)))

    def log(self):
        return self._chain(F.ln(self.column), (self, 1 / self.column))

    def sigmoid(self):
        s = 1 / (1 + F.exp(-self.column))
        return self._chain(s, (self, s * (1 - s)))

    def tanh(self):
        t = F.tanh(self.column)
        return self._chain(t, (self, 1 - t * t))

    def relu(self):
        on = F.when(self.column > 0, 1.0).otherwise(0.0)
        return self._chain(self.column * on, (self, on))


def loss_and_gradients(df: DataFrame, loss, params: dict[str, float]) -> tuple[float, dict[str, float]]:
    """The mean over df of loss(parameters as nodes), and its gradient: one job, one row to the driver."""
    node = loss({k: Node(F.lit(float(v)), {k: F.lit(1.0)}) for k, v in params.items()})
    row = df.agg(F.avg(node.column).alias("_loss"), *[F.avg(s).alias(k) for k, s in node.slopes.items()]).first()
    return row["_loss"], {k: row[k] if k in node.slopes else 0.0 for k in params}


def fit(df: DataFrame, loss, params: dict[str, float], steps: int, lr: float) -> dict[str, float]:
    """Gradient descent: rows stay distributed, parameters are on the driver."""
    for _ in range(steps):
        _, g = loss_and_gradients(df, loss, params)
        params = {k: v - lr * g[k] for k, v in params.items()}
    return params
