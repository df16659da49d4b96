"""The registered queries: each operator on the shared test tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# The modules that register queries.
FAMILIES = (
    "marts", "relational", "quality", "history", "profiling", "texts", "governance", "io", "streams",
)


class Tables:
    """The test tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        # Kept, so that a plan with many branches lists the files and reads the footer once.
        self.__dict__[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.__dict__[name]

    def view(self, sql: str) -> DataFrame:
        """A derived input: SQL over the test tables that reads the same in both engines."""
        used = {n: getattr(self, n) for n in TABLES if f"{{{n}}}" in sql}
        return self.spark.sql(sql, **used)

    def scratch(self, purpose: str) -> str:
        return scratch_path(self.spark, purpose)

    @cached_property
    def model(self) -> Mapping[str, DataFrame]:
        """The security model; a table is derived when it is first asked for."""
        from .model import SecurityModel

        return SecurityModel(self)


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None
    headline: bool


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None, *, headline: bool = False):
    """Register ``fn(tables) -> DataFrame`` under its own name."""

    def register(fn):
        if fn.__name__ in REGISTRY:
            raise ValueError(f"query registered twice: {fn.__name__}")
        REGISTRY[fn.__name__] = Query(fn.__name__, fn, sql, headline)
        return fn

    return register


def load() -> dict[str, Query]:
    for name in FAMILIES:
        import_module(f"{__name__}.{name}")
    return REGISTRY
