"""Streaming extensions: log ingestion, and working contexts kept as keyed state."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIMIT = 65_536


def append_text(content: str, text: str) -> str:
    """``content`` with ``text`` under the next numbered heading."""
    numbers = [int(n) for n in re.findall(r"(?m)^## Ammendment\s+(\d{1,18})\s*$", content)]
    gap = "" if not content or content.endswith("\n\n") else "\n" if content.endswith("\n") else "\n\n"
    return f"{content}{gap}## Ammendment {max(numbers, default=0) + 1}\n{text}"


def working_contexts(appends: DataFrame) -> DataFrame:
    """A stream of (project, seq, text) as a stream of (project, content, version): each project's latest context.

    An append beyond the size limit leaves the context as it is.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        content, version = state.get if state.exists else ("", 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        for text in rows["text"].fillna(""):
            longer = append_text(content, text)
            if len(longer) <= LIMIT:
                content, version = longer, version + 1
        state.update((content, version))
        yield pd.DataFrame({"project": [key[0]], "content": [content], "version": [version]})

    return appends.groupBy("project").applyInPandasWithState(fold, "project string, content string, version long", "content string, version long", "update", GroupStateTimeout.NoTimeout)


def ingest_log(events: DataFrame, path: str, checkpoint: str):
    """Appends a stream of log events to a Parquet dataset, each event once."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
