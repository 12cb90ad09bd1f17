"""A paged service as a data source: partitions are pages, found from the service's total."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, offset: int, limit: int):
        self.offset, self.limit = offset, limit


class PagedReader(DataSourceReader):
    def __init__(self, fetch, total: int, limit: int):
        self.fetch, self.total, self.limit = fetch, total, limit

    def partitions(self):
        return [Page(o, self.limit) for o in range(0, self.total, self.limit)] or [Page(0, self.limit)]

    def read(self, partition):
        yield from self.fetch(partition.offset, partition.limit)


def paged_source(name: str, schema: str, fetch, total, limit: int = 100) -> type[DataSource]:
    """A DataSource class over fetch(offset, limit) -> rows and total() -> number of rows; register it with spark.dataSource.register."""

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return PagedReader(fetch, total(), limit)

    return Paged
