"""Linear algebra as functions of arrays."""

from tessera.api import as_array
from tessera.operators.matrix import Array


def _of(name: str):
    method = getattr(Array, name)

    def call(a, *args):
        return method(as_array(a), *args)

    call.__name__ = name
    return call


for _n in ("matmul", "transpose", "inv", "solve", "det", "trace", "rank", "qr", "svd", "eigh", "cholesky", "pseudo_inv", "gram_matrix", "covariance", "norm_frobenius", "is_symmetric", "is_positive_definite"):
    globals()[_n] = _of(_n)
