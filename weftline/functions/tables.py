"""Table functions over source code, for lateral joins in SQL and with DataFrames."""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import pyast, pystate


def rewrites_table():
    """Table function (text): transform_id, message, after. It has the rewrites known when it is made."""
    changes = pystate.known_rewrites()

    class CodeRewrites:
        def eval(self, text: str | None) -> Iterator[tuple]:
            yield from pystate.rewritten(text, changes)

    return F.udtf(CodeRewrites, returnType="transform_id string, message string, after string")


def mutants_table():
    """Table function (text, count, seed): position, source, operator, description.

    All mutants for a null count, else at most count of them, chosen by the seed, in source order.
    """

    class CodeMutants:
        def eval(self, text: str | None, count: int | None, seed: int | None) -> Iterator[tuple]:
            pool = list(enumerate(pyast._mutants(text)))
            if count is not None and len(pool) > max(count, 0):
                pool = [pool[i] for i in sorted(random.Random(int(seed or 0)).sample(range(len(pool)), max(count, 0)))]
            for position, (source, operator, description) in pool:
                yield position, source, operator, description

    return F.udtf(CodeMutants, returnType="position int, source string, operator string, description string")


def register(spark: SparkSession) -> None:
    """``code_rewrites(text)`` and ``code_mutants(text, count, seed)`` for SQL: ``FROM t, LATERAL code_rewrites(t.text)``."""
    spark.udtf.register("code_rewrites", rewrites_table())
    spark.udtf.register("code_mutants", mutants_table())
