"""A Python data source for JSON lines behind URLs: ``spark.read.format("jsonl_urls").option("urls", "a,b")``.

One partition a URL; any scheme of urllib is read, so ``file:`` URLs serve offline.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class JsonLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_urls"

    def schema(self) -> str:
        return "url string, text string, body string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader([u.strip() for u in self.options.get("urls", "").split(",") if u.strip()])


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str]):
        self.urls = urls

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with urlopen(partition.value) as answer:  # noqa: S310 - the caller names the URLs
            for line in answer:
                line = line.decode("utf-8", "replace").strip()
                if line:
                    try:
                        record = json.loads(line)
                    except ValueError:
                        continue
                    text = record.get("text") or record.get("prompt") or record.get("description") if isinstance(record, dict) else None
                    yield partition.value, text, line
