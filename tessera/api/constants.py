"""Mathematical and floating-point constants."""

import math

from tessera.functions.ieee import E, EPSILON_F32, EPSILON_F64, LN_2, LN_10, LOG2_E, LOG10_E, MAX_F32, MAX_F64, MIN_POSITIVE_F64, PHI, PI, SQRT_1_2, SQRT_2, SQRT_3, SQRT_5, TAU

INF, NEG_INF, NAN = math.inf, -math.inf, math.nan

__all__ = ["E", "EPSILON_F32", "EPSILON_F64", "INF", "LN_2", "LN_10", "LOG2_E", "LOG10_E", "MAX_F32", "MAX_F64", "MIN_POSITIVE_F64", "NAN", "NEG_INF", "PHI", "PI", "SQRT_1_2", "SQRT_2", "SQRT_3", "SQRT_5", "TAU"]
