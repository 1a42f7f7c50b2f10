"""Registry of the named queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    build: Builder
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def register(build: Builder) -> Builder:
        if name in CATALOG:
            raise ValueError(f"query {name!r} is registered twice")
        CATALOG[name] = Entry(build, sql)
        return build

    return register


def load_all() -> dict[str, Entry]:
    from poseweave.plans import (queries_estimation, queries_grid, queries_pose, queries_relations,  # noqa: F401
                                 queries_text)

    return CATALOG
