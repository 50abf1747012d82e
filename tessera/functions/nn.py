"""Activations, their derivatives, and losses as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import ieee

#: Constants of the self-normalising unit and of the tanh form of the Gaussian unit (fixed values).
SELU_ALPHA, SELU_SCALE, GELU_CUBIC, GELU_SCALE = 1.6732632423543772, 1.0507009873554805, 0.044715, 0.7978845608028654


def relu(x) -> Column:
    return F.when(ieee.compare(x, "gt", 0.0), x).otherwise(F.lit(0.0))


def relu_deriv(x) -> Column:
    return F.when(ieee.compare(x, "gt", 0.0), 1.0).otherwise(0.0)


def leaky_relu(x, alpha: float = 0.01) -> Column:
    return F.when(x > 0, x).otherwise(x * alpha)


def leaky_relu_deriv(x, alpha: float = 0.01) -> Column:
    return F.when(ieee.compare(x, "gt", 0.0), 1.0).otherwise(alpha)


def elu(x, alpha: float = 1.0) -> Column:
    return F.when(x > 0, x).otherwise(alpha * F.expm1(x))


def selu(x) -> Column:
    return SELU_SCALE * elu(x, SELU_ALPHA)


def gelu(x) -> Column:
    return 0.5 * x * (1 + F.tanh(GELU_SCALE * (x + GELU_CUBIC * x * x * x)))


def swish(x) -> Column:
    return x * ieee.sigmoid(x)


def softplus(x) -> Column:
    return ieee.ln(1 + F.exp(x))


def mish(x) -> Column:
    return x * F.tanh(softplus(x))


def hardswish(x) -> Column:
    return x * ieee.clamp(x + 3, 0, 6) / 6


def sigmoid_deriv(x) -> Column:
    s = ieee.sigmoid(x)
    return s * (1 - s)


def huber(pred, target, delta: float = 1.0) -> Column:
    e = F.abs(pred - target)
    return F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))


def bce(pred, target) -> Column:
    p = ieee.clamp(pred, 1e-15, 1 - 1e-15)
    return -(target * F.ln(p) + (1 - target) * F.ln(1 - p))


#: Losses: row terms whose mean is the loss.
LOSSES = {"mse": lambda p, t: (p - t) * (p - t), "mae": lambda p, t: F.abs(p - t), "huber": huber, "binary_cross_entropy": bce}
ACTIVATIONS = {f.__name__: f for f in (relu, relu_deriv, leaky_relu, leaky_relu_deriv, elu, selu, gelu, swish, softplus, mish, hardswish, sigmoid_deriv)}


def row_softmax(v) -> Column:
    """Softmax of an array, shifted by its maximum."""
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def row_log_softmax(v) -> Column:
    top = F.array_max(v)
    total = F.ln(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return F.transform(v, lambda x: x - top - total)


def row_layer_norm(v, eps: float = 1e-5) -> Column:
    n = F.size(v)
    mu = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mu) * (x - mu)) / n
    return F.transform(v, lambda x: (x - mu) / F.sqrt(var + eps))
