"""A remote store's snapshot as a data source of pages, each of which names the next.

``<path>/<token>.json`` heads a page: {"next": token, "has_more": bool}; ``<path>/<token>.jsonl`` has its rows. The first token is ``start``.
The planner follows the heads, which are small, and tasks read the pages' rows, each page a partition. A page that has more
must name another that wasn't met; else the source raises, rather than reading in circles. As a stream, the offset is the last page's token, and
a batch takes the pages that have come since.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from mnemospark.plans.sync import may_advance, pull_plan
from mnemospark.sources.bundle_files import located

FORMAT, FIRST = "mnemospark_pages", "start"
COLUMNS = ["gateway_memory_id", "server_revision", "content", "content_hash", "project", "tombstone"]
SCHEMA = "gateway_memory_id string, server_revision bigint, content string, content_hash string, project string, tombstone boolean"


@dataclass
class Page(InputPartition):
    token: str


class Pages:
    """The pages under a path."""

    def __init__(self, path: str) -> None:
        self.path = path

    def text(self, name: str) -> str:
        system, place = located(self.path)
        with system.open_input_stream(f"{place}/{name}") as f:
            return f.read().decode()

    def follow(self, token: str, most: int | None = None, seen: set[str] | None = None) -> Iterator[tuple[str, str | None]]:
        """(token, next) from ``token`` on; next is None on the last page."""
        seen = set() if seen is None else seen
        n = 0
        while most is None or n < most:
            head = json.loads(self.text(f"{token}.json"))
            seen.add(token)
            following = head.get("next") if head.get("has_more") else None
            if head.get("has_more"):
                if following is None or following == token:
                    raise ValueError(f"page {token} has more but does not advance")
                if following in seen:
                    raise ValueError(f"page {token} goes back to {following}")
            yield token, following
            if following is None:
                return
            token, n = following, n + 1

    def rows(self, token: str) -> Iterator[tuple]:
        for line in self.text(f"{token}.jsonl").splitlines():
            if line.strip():
                row = json.loads(line)
                yield tuple(row.get(c) for c in COLUMNS)


class PagesReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.pages = Pages(path)

    def partitions(self) -> list[Page]:
        return [Page(token) for token, _ in self.pages.follow(FIRST)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.pages.rows(partition.token)


class PagesStream(DataSourceStreamReader):
    """Offsets are {"token": the last page read, "pages": how many}; a last page that gets a successor later goes on from there."""

    def __init__(self, path: str) -> None:
        self.pages = Pages(path)
        self.at, self.seen = self.initialOffset(), set()

    def initialOffset(self) -> dict:
        return {"token": "", "pages": 0}

    def after(self, token: str) -> str | None:
        """The page behind ``token``, if there is one by now."""
        return next(self.pages.follow(token, 1))[1] if token else FIRST

    def latestOffset(self) -> dict:
        begin = self.after(self.at["token"])
        if begin is not None:
            n = self.at["pages"]
            for token, _ in self.pages.follow(begin, None, self.seen):
                n += 1
                self.at = {"token": token, "pages": n}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Page]:
        n = end["pages"] - start["pages"]
        return [Page(token) for token, _ in self.pages.follow(self.after(start["token"]), n)] if n else []

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.pages.rows(partition.token)

    def commit(self, end: dict) -> None:
        pass


class PagesSource(DataSource):
    """``spark.read.format(FORMAT).load(path)`` or ``spark.readStream...``, after ``spark.dataSource.register(PagesSource)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options["path"])

    def streamReader(self, schema) -> PagesStream:
        return PagesStream(self.options["path"])


def pull(remote: DataFrame, mapping: DataFrame, local: DataFrame, state: DataFrame, project: str, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plan, mappings, pull state) of one page or snapshot of a project: the cursor goes to the greatest revision seen, but only without conflicts.

    remote: the source's columns. Imports and updates are the caller's to apply to the memories; a link's and an update's mapping is told here.
    """
    plan = pull_plan(remote, mapping.where(F.col("project") == project), local)
    advance = may_advance(plan).first()["advance"]
    told = plan.where(F.col("action").isin("link", "update", "tombstone")).join(remote.select("gateway_memory_id", F.col("server_revision").alias("rev"), F.col("content_hash").alias("hash")), "gateway_memory_id")
    old = mapping.join(told.select(F.col("local_memory_id").alias("told_id"), "action", "rev", "hash", F.col("gateway_memory_id").alias("gid")), F.col("local_memory_id") == F.col("told_id"), "left")
    hit = F.col("told_id").isNotNull()
    change = {"last_seen_server_revision": F.greatest("last_seen_server_revision", "rev"), "last_pulled_content_hash": F.coalesce("hash", "last_pulled_content_hash"), "tombstone_deleted": F.col("action") == "tombstone", "updated_at": now}
    kept = old.select(*(F.when(hit, change[c]).otherwise(F.col(c)).cast(mapping.schema[c].dataType).alias(c) if c in change else F.col(c) for c in mapping.columns))
    fresh = told.where("action = 'link'").join(mapping.select("local_memory_id"), "local_memory_id", "left_anti")
    values = {"local_memory_id": F.col("local_memory_id"), "project": F.lit(project), "gateway_memory_id": F.col("gateway_memory_id"), "last_seen_server_revision": F.col("rev"), "last_pulled_content_hash": F.col("hash"), "sync_state": F.lit("synced"), "tombstone_deleted": F.lit(False), "created_at": now, "updated_at": now}
    mappings = kept.unionByName(fresh.select(*(values.get(c, F.lit(None)).cast(mapping.schema[c].dataType).alias(c) for c in mapping.columns)))
    moved = remote.agg(F.max("server_revision").alias("top")).where(F.col("top").isNotNull() & F.lit(advance)).select(F.lit(project).alias("project"), "top")
    j = state.join(moved, "project", "full_outer")
    values = {"last_pull_server_revision": F.greatest("last_pull_server_revision", "top"), "updated_at": F.when(F.col("top").isNotNull(), now).otherwise(F.col("updated_at"))}
    return plan, mappings, j.select(*(values[c].cast(state.schema[c].dataType).alias(c) if c in values else F.col(c) for c in state.columns))
