"""Custom collectors: functions of the user's as a Spark source, a task each."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "collector string, metric_name string, value double"


class _Named(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


def source(collectors: dict[str, Callable[[], Iterable[tuple[str, float]]]], name: str = "collectors") -> type[DataSource]:
    """A source of that name whose rows are what the collectors give: (metric name, value) pairs, nulls allowed."""
    held = dict(collectors)

    class Reader(DataSourceReader):
        def __init__(self, wanted: list[str]):
            self.wanted = wanted

        def partitions(self):
            return [_Named(x) for x in self.wanted]

        def read(self, partition):
            if partition is not None:  # a source without partitions is read once, with none
                for metric, value in held[partition.name]():
                    yield partition.name, metric, None if value is None else float(value)

    class Collectors(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            only = self.options.get("only")
            wanted = sorted(held) if only is None else [x for x in sorted(held) if x == only]
            return Reader(wanted)

    return Collectors


def collect(spark: SparkSession, collectors: dict[str, Callable[[], Iterable[tuple[str, float]]]]) -> DataFrame:
    """(collector, metric_name, value): each collector runs in a task of its own, at every read; none gives no rows."""
    if not collectors:
        return spark.createDataFrame([], SCHEMA)
    made = source(collectors)
    spark.dataSource.register(made)
    return spark.read.format(made.name()).load()
