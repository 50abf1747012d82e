"""Neural-network functions of arrays, and weight initialisers."""

from tessera.api import as_array
from tessera.operators.matrix import Array


def _of(name: str):
    method = getattr(Array, name)

    def call(a, *args):
        return method(as_array(a), *args)

    call.__name__ = name
    return call


for _n in ("relu", "sigmoid", "leaky_relu", "elu", "selu", "gelu", "swish", "mish", "softplus", "hardswish", "softmax", "log_softmax", "layer_norm", "batch_norm", "dropout", "mse_loss", "mae_loss", "huber_loss", "binary_cross_entropy", "cross_entropy_loss", "mse_grad", "softmax_ce_grad", "max_pool2d", "avg_pool2d", "pad"):
    globals()[_n] = _of(_n)


class initializers:
    """Random arrays scaled by fan-in and fan-out."""

    @staticmethod
    def glorot_uniform(shape, seed: int | None = None) -> Array:
        return Array.glorot(shape, True, seed)

    @staticmethod
    def glorot_normal(shape, seed: int | None = None) -> Array:
        return Array.glorot(shape, False, seed)

    @staticmethod
    def he_uniform(shape, seed: int | None = None) -> Array:
        return Array.he(shape, True, seed)

    @staticmethod
    def he_normal(shape, seed: int | None = None) -> Array:
        return Array.he(shape, False, seed)


glorot_uniform, glorot_normal, he_uniform, he_normal = initializers.glorot_uniform, initializers.glorot_normal, initializers.he_uniform, initializers.he_normal
