"""Registration of queries, and access to tables and views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickbars.functions import ntz
from tickbars.plans.views import ORACLE_CTES, VIEWS
from tickbars.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = configure(spark)
        self.dir = sf_dir.rstrip("/")
        self._known: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}.parquet"

    def stream_path(self, name: str) -> str:
        """The table as a pattern: a stream takes a folder or a pattern, and a table may be one file."""
        return f"{self.dir}/{name}.parque[t]"

    def table(self, name: str) -> DataFrame:
        if name not in self._known:
            self._known[name] = self.spark.read.parquet(self.path(name))
        return self._known[name]

    def view(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.table(name)
        if name not in self._known:
            self._known[name] = self._view(name)
        return self._known[name]

    def _view(self, name: str) -> DataFrame:
        needs, text = VIEWS[name]
        rows = self.spark.sql(text, **{n: self.view(n) for n in needs})
        zoned = [c for c, kind in rows.dtypes if kind == "timestamp"]
        return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else rows

    def as_of(self, name: str = "trades", column: str = "Timestamp") -> Column:
        """Newest time of a view, which stands for the clock: one value, so that bounds are literals and reach the scan."""
        return ntz(self.view(name).agg(F.max(column)).first()[0])


def oracle(needs: str, body: str) -> str:
    """SQL over the named views: their texts come first, each after those it is made from.

    A body that begins with a comma goes on with named texts of its own.
    """
    ctes: dict[str, str] = {}

    def add(name: str) -> None:
        if name in ctes:
            return
        source = VIEWS.get(name) or ORACLE_CTES.get(name)
        if source is None:
            return
        for n in source[0]:
            add(n)
        ctes[name] = source[1].format(**{n: n for n in source[0]})

    for name in needs.split():
        add(name)
    body = body.strip()
    if not ctes:
        return body
    return "WITH " + ",\n".join(f"{name} AS (\n{text.strip()}\n)" for name, text in ctes.items()) + ("" if body.startswith(",") else "\n") + body


def query(name: str, needs: str = "", sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a function over ``Tables`` as a query, with its SQL if it has one."""
    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(needs, sql)
        return build
    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round sums of fractions, whose last digits depend on the order of addition."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
