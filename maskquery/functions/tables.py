"""Table-valued functions for SQL: patch grids and parameter grids."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="y0 int, y1 int, x0 int, x1 int")
class PatchGrid:
    """Patches of one section, ``patch_grid(height, width, patch, stride)``, for lateral joins."""

    def eval(self, height: int, width: int, patch: int, stride: int):
        def starts(size: int) -> list[int]:
            last = max(size - patch, 0)
            return sorted({*range(0, last + 1, stride), last})

        for y in starts(height):
            for x in starts(width):
                yield y, min(y + patch, height), x, min(x + patch, width)


@udtf(returnType="grid_idx int, params map<string, string>")
class ParamGrid:
    """All combinations of parameter lists, ``param_grid('{"a": [1, 3], "b": [true]}')``, the last list varying fastest."""

    def eval(self, lists: str):
        given = json.loads(lists)
        for i, values in enumerate(itertools.product(*(v or [None] for v in given.values()))):
            yield i, {k: None if v is None else json.dumps(v) for k, v in zip(given, values)}


def register(spark: SparkSession) -> None:
    spark.udtf.register("patch_grid", PatchGrid)
    spark.udtf.register("param_grid", ParamGrid)
