"""A paginated source as a table: one Spark partition per page."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def dig(document, response_path: str):
    """Follow a dotted path such as ``data.items``."""
    for part in response_path.split(".") if response_path else ():
        document = (document or {}).get(part)
    return document or []


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


def paged_source(
    name: str,
    fetch: Callable[[int, int], str],
    schema: T.StructType,
    *,
    pages: int,
    page_size: int,
    response_path: str = "",
) -> type[DataSource]:
    """A data source class that asks ``fetch(page, page_size)`` for each page's JSON text.

    ``fetch`` runs in the executors.  A page past the end may be empty; if the last one
    allowed is full, the read fails, for rows beyond ``pages`` would be lost.
    """
    names = schema.names

    class Reader(DataSourceReader):
        def partitions(self):
            return [Page(i) for i in range(pages)]

        def read(self, partition) -> Iterator[tuple]:
            items = dig(json.loads(fetch(partition.number, page_size) or "{}"), response_path)
            if partition.number == pages - 1 and len(items) >= page_size:
                raise ValueError(f"{name}: page {pages} of at most {pages} is full; allow more pages")
            return (tuple(item.get(n) for n in names) for item in items)

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    return Paged


def read_paged(spark: SparkSession, source: type[DataSource]) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load()
