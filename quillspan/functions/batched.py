"""Python functions over Arrow batches that work each distinct row of a batch out once."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def per_distinct(f: Callable, returns: T.DataType, once: bool = False):
    """A Spark function of as many columns as ``f`` has arguments.

    ``once``: to Spark it is not deterministic, so that no filter on what it
    returns is pushed below it and asks Python a second time.  Each use in a
    query is a call, so several uses need a column of their own.
    """
    kind = to_arrow_type(returns)

    def run(*columns: pa.Array) -> pa.Array:
        places: dict = {}
        which = [places.setdefault(row, len(places)) for row in zip(*(c.to_pylist() for c in columns))]
        return pa.array([f(*row) for row in places], kind).take(pa.array(which, pa.int64()))

    # Spark tells the kind of the function by its arguments, so their number must be known.
    one = lambda a: run(a)
    two = lambda a, b: run(a, b)
    three = lambda a, b, c: run(a, b, c)
    udf = F.arrow_udf((one, two, three)[f.__code__.co_argcount - 1], returns)
    return udf.asNondeterministic() if once else udf
