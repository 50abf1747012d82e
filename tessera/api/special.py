"""gamma, ln_gamma and erf of a number, list, Vector or Array."""

import math

from tessera.functions import special
from tessera.operators.matrix import Array
from tessera.operators.vector import Vector


def _of(number, column):
    safe = special._safe(number)

    def call(data):
        if isinstance(data, Array):
            return Array(data.into_vector()._map(column("x")).df.selectExpr("idx DIV {0} AS row_id".format(data.ncols), "idx", "x").groupBy("row_id").agg(_row()), data.shape)
        if isinstance(data, Vector):
            return data._map(column("x"))
        return [safe(float(x)) for x in data] if isinstance(data, (list, tuple)) else safe(float(data))

    return call


def _row():
    from pyspark.sql import functions as F

    return F.transform(F.array_sort(F.collect_list(F.struct("idx", "x"))), lambda s: s.x).alias("v")


gamma, ln_gamma, erf = _of(math.gamma, special.gamma), _of(math.lgamma, special.ln_gamma), _of(math.erf, special.erf)
