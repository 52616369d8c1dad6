"""Registration of queries with the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.session import spread

Query = Callable[[SparkSession, str], DataFrame]


class Plans:
    """Queries by name, in the order in which they were registered."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its name; without ``sql`` it has no equivalent there."""

        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts, whose rows take long, over all cores even if they come in one file."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


# Pieces of SQL.


def norm(x: str, bar: str = "", lower: bool = True) -> str:
    out = f"trim(regexp_replace(regexp_replace(replace({x}, '|', '{bar}'), '[[:punct:]]', ' ', 'g'), ' {{2,}}', ' ', 'g'))"
    return f"lower({out})" if lower else out


def toks(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda t: t <> '')"


def grams(words: str, n: int = 2) -> str:
    joined = " || '_' || ".join(f"{words}[i + {k}]" if k else f"{words}[i]" for k in range(n))
    return f"CASE WHEN len({words}) >= {n} THEN list_distinct(list_transform(range(1, len({words}) - {n - 2}), lambda i: {joined})) ELSE [] END"
