"""A Python data source for paged registries: `spark.read.format("registry_search")`."""

from __future__ import annotations

import importlib
import json

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "page int, code string, title string, kind string"


class _Page(InputPartition):
    def __init__(self, number: int, items: list | None = None):
        self.number, self.items = number, items


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        """A partition per page. Pages of a JSON file (option `path`) are read here, where the query is planned, and go with it."""
        numbers = range(1, int(self.options.get("pages", 1)) + 1)
        if "client" in self.options:
            return [_Page(n) for n in numbers]
        with open(self.options["path"]) as file:
            items = json.load(file)
        size = int(self.options.get("page_size", 500))
        return [_Page(n, items[(n - 1) * size : n * size]) for n in numbers]

    def read(self, partition):
        """Items of the page, asked of the client that option `client` names ('module:function') where it isn't held."""
        items = partition.items
        if items is None:
            module, name = self.options["client"].split(":")
            items = getattr(importlib.import_module(module), name)(partition.number)
        wanted = [p for p in self.options.get("prefixes", "").split(",") if p]
        for item in items or ():
            code = item.get("code") or item.get("Code") or ""
            if code and (not wanted or any(code.startswith(p) for p in wanted)):
                yield partition.number, code, item.get("title") or item.get("Title") or "", item.get("type") or item.get("Type") or ""


class RegistrySearch(DataSource):
    """Search results of a registry, a partition per page; option `prefixes` keeps codes that begin with one of them."""

    @classmethod
    def name(cls):
        return "registry_search"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RegistrySearch)
