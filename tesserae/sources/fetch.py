"""Sources behind a protocol, as Python data sources: chunk look-ups with retries, and log scans by adaptive ranges.

A back end is an importable function "module:name", so that these sources hold no network code:
tests give them fakes, a deployment its client.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def backend(name: str) -> Callable:
    module, _, f = name.partition(":")
    return getattr(importlib.import_module(module), f)


def attempts(call: Callable, tries: int, wait_ms: Callable[[int], int]) -> object:
    """The result of call, tried again after a pause where it raises."""
    for k in range(tries):
        try:
            return call()
        except Exception:
            if k + 1 == tries:
                raise
            time.sleep(wait_ms(k) / 1000)
    raise ValueError("no tries")


class ChunkSource(DataSource):
    """Chunks by address; options: backend, addresses (comma-separated), partitions, base_wait_ms."""

    @classmethod
    def name(cls) -> str:
        return "chunk_fetch"

    def schema(self) -> str:
        return "address string, data binary, tries int"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _ChunkReader(dict(self.options))


class _ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        wanted = [a for a in self.options.get("addresses", "").split(",") if a]
        n = max(1, min(len(wanted), int(self.options.get("partitions", 4))))
        return [InputPartition(wanted[k::n]) for k in range(n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fetch, wait = backend(self.options["backend"]), int(self.options.get("base_wait_ms", 500))
        for address in partition.value:
            tried = 0

            def call(address: str = address) -> bytes:
                nonlocal tried
                tried += 1
                return fetch(address)

            yield address, attempts(call, 3, lambda k: wait << k), tried


class LogSource(DataSource):
    """Log entries by block range; options: backend, first, last, partitions, window, least_window, most_window.

    A range that fails is halved, down to the least window, and then tried again with growing pauses;
    after twenty calls that went well the window is doubled.
    """

    @classmethod
    def name(cls) -> str:
        return "block_log"

    def schema(self) -> str:
        return "block long, log_index int, data string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _LogReader(dict(self.options))


class _LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        first, last, n = (int(self.options[k]) for k in ("first", "last", "partitions"))
        step = -(-(last - first + 1) // max(1, n))
        return [InputPartition((a, min(last, a + step - 1))) for a in range(first, last + 1, max(1, step))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        scan = backend(self.options["backend"])
        number = lambda k, d: int(self.options.get(k, d))
        window, least, most, wait = number("window", 400_000), number("least_window", 10_000), number("most_window", 400_000), number("base_wait_ms", 1000)
        at, last = partition.value
        good = 0
        while at <= last:
            to = min(last, at + window - 1)
            try:
                rows = scan(at, to) if window > least else attempts(lambda a=at, b=to: scan(a, b), 6, lambda k: wait * (k + 1))
            except Exception:
                if window <= least:
                    raise
                window, good = max(least, window // 2), 0
                continue
            yield from rows
            at, good = to + 1, good + 1
            if good % 20 == 0:
                window = min(most, window * 2)
