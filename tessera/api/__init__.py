"""Module-level functions over Vector, Array, lists and numbers: one module for each area."""

from tessera.operators.matrix import Array
from tessera.operators.vector import Vector


def as_vector(data) -> Vector:
    """A Vector of a Vector, an Array (row-major) or an iterable of numbers."""
    return data if isinstance(data, Vector) else data.into_vector() if isinstance(data, Array) else Vector(data)


def as_array(data) -> Array:
    return data if isinstance(data, Array) else Array(data)
