"""Where the registered queries and their reference SQL come together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(covers: str, sql: str | None = None):
    """Register a function under its own name; ``covers`` lists the operators it shows."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if fn.__name__ in ENTRIES:
            raise ValueError(f"{fn.__name__} is registered twice")
        ENTRIES[fn.__name__] = Entry(fn.__name__, covers, fn, sql)
        return fn

    return register
