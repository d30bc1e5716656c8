"""Searches of one's own as a Spark data source: a function that yields results, run once per location on the executors.

    spark.dataSource.register(SearchSource)
    spark.read.format("gleaner_search").option("search", "mymodule:find").option("category", "hotel").option("locations", "Berlin;Bonn").load()

find(category, location, limit) yields mappings with fields of a search result; missing ones are ''. A location is a
partition, so a search that fails is tried again by Spark alone. A filter on ordinal, of which each location has a range of its own, leaves out
locations that it excludes, if the option pushdown and Spark's spark.sql.python.filterPushdown.enabled are true.

As a stream, the offset is how many of the locations have been searched: a stream that starts again from its checkpoint, with more
locations behind those it had, searches the new ones only.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from gleaner.schema import RESULT_FIELDS, SEARCH_RESULT


class _Location(InputPartition):
    def __init__(self, rank: int, name: str):
        self.rank, self.name = rank, name


#: Ordinals of a location.
EACH = 1_000_000


class _Search:
    """What the batch and the stream share."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def locations(self) -> list[_Location]:
        names = [x.strip() for x in self.options.get("locations", "").split(";")]
        return [_Location(i, n) for i, n in enumerate(names)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if isinstance(partition, _Nothing):
            return
        module, _, name = self.options["search"].partition(":")
        find = getattr(importlib.import_module(module), name)
        limit = int(self.options.get("limit", 50))
        for i, row in enumerate(find(self.options.get("category", ""), partition.name, limit)):
            if i >= limit:
                return
            yield (*(str(row.get(f) or "") for f in RESULT_FIELDS), int(self.options.get("source_rank", 0)), partition.rank * EACH + i)


class _Reader(_Search, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.least, self.most = 0, float("inf")

    def partitions(self) -> list[_Location]:
        own = [x for x in self.locations() if x.rank * EACH <= self.most and (x.rank + 1) * EACH > self.least]
        return own or [_Nothing(None)]


class _NarrowedReader(_Reader):
    """Spark refuses a reader that takes filters unless their push-down is set, so this one is asked for by an option."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of ordinal narrow the locations; Spark still looks at each row, so all filters go back."""
        for f in filters:
            yield f
            if getattr(f, "attribute", None) != ("ordinal",):
                continue
            if isinstance(f, EqualTo):
                low = high = f.value
            elif isinstance(f, In):
                low, high = min(f.value, default=0), max(f.value, default=0)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                low, high = f.value + isinstance(f, GreaterThan), self.most
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                low, high = self.least, f.value - isinstance(f, LessThan)
            else:
                continue
            self.least, self.most = max(self.least, low), min(self.most, high)


class _Nothing(InputPartition):
    """Stands for no location: Spark wants a partition."""


class _StreamReader(_Search, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"locations": 0}

    def latestOffset(self) -> dict:
        return {"locations": len(self.locations())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.locations()[start["locations"] : end["locations"]]

    def commit(self, end: dict) -> None:
        """Nothing is held for what has been searched."""


class SearchSource(DataSource):
    """Format gleaner_search; options search, category, locations (split at ;), limit, source_rank, pushdown."""

    @classmethod
    def name(cls) -> str:
        return "gleaner_search"

    def schema(self) -> StructType:
        return SEARCH_RESULT

    def reader(self, schema: StructType) -> DataSourceReader:
        if ":" not in self.options.get("search", ""):
            raise ValueError("option search: module:function")
        return (_NarrowedReader if self.options.get("pushdown") == "true" else _Reader)(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        if ":" not in self.options.get("search", ""):
            raise ValueError("option search: module:function")
        return _StreamReader(self.options)
