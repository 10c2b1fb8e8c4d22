"""Registry of named queries: a Spark builder plus its DuckDB oracle SQL.

Output normalisation lives here (wrappers only, never inside operators):
non-integer outputs are written ``round(x + 1.234567e-7, 4)`` (a bias with no short decimal form, so engine-specific half rounding never decides) on both sides and
integer outputs are cast to BIGINT, so the two engines hash equal.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    floats: tuple[str, ...] = ()
    ints: tuple[str, ...] = ()
    doc: str = ""
    bench: bool = False
    extra: dict = field(default_factory=dict)

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return normalise(self.build(spark, sf_dir), self.floats, self.ints)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        reps = [f'round("{c}" + 1.234567e-7, 4) AS "{c}"' for c in self.floats]
        reps += [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in self.ints]
        if not reps:
            return self.sql
        return f"SELECT * REPLACE ({', '.join(reps)}) FROM (\n{self.sql}\n) AS q"


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, floats=(), ints=(), bench: bool = False):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, tuple(floats), tuple(ints), fn.__doc__ or "", bench)
        return fn

    return deco


def normalise(df: DataFrame, floats=(), ints=()) -> DataFrame:
    fl, it = set(floats), set(ints)
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in fl:
            c = F.round(c.cast("double") + F.lit(1.234567e-7), 4)
        elif f.name in it or isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)
