"""A PySpark-native analytics engine for numeric columns, vectors and matrices."""


def _reduction(name: str):
    def call(data) -> float:
        from tessera.api import as_vector

        return getattr(as_vector(data), name)()

    call.__name__ = name
    call.__doc__ = f"Vector.{name} of a Vector, an Array or an iterable of numbers."
    return call


sum, mean, min, max = map(_reduction, ("sum", "mean", "min", "max"))
