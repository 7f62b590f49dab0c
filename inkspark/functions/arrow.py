"""Arrow-batched functions that are made when first used, so that modules import without a session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def batched(kind: str) -> Callable:
    """``pandas_udf`` of the return type ``kind``, with type hints as it wants them."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def call(*columns) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        return call

    return wrap
