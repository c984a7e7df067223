"""Working contexts under batches of set, append and clear.

A context is one text of at most ``CONTEXT_LIMIT`` characters a project. A batch's operations are brought to their project in
order and read as a sorted stream: a task holds one context and the highest amendment number in it, so an append costs its own
length, not the text's. What a project's operations leave is one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.revisions import CONTEXT_LIMIT
from mnemospark.plans import lineage
from mnemospark.schemas import GLOBAL

NUMBERED = re.compile(r"^## Ammendment (.*)$", re.M)
FOLDED = "project string, seq bigint, outcome string, version bigint, content string, last boolean"


def highest_number(text: str) -> int:
    """The highest number of an amendment's heading; 0 without one."""
    numbers = [m.strip() for m in NUMBERED.findall(text)]
    return max((int(n) for n in numbers if re.fullmatch(r"\+?[0-9]+", n)), default=0)


def appended(content: str, number: int, text: str) -> str:
    """``content`` with a numbered amendment behind a blank line."""
    gap = "" if not content or content.endswith("\n\n") else "\n" if content.endswith("\n") else "\n\n"
    return f"{content}{gap}## Ammendment {number}\n{text}"


def fold(rows: DataFrame) -> DataFrame:
    """(project, seq, outcome, version, content, last) of rows (project, seq, op, text, version), what is held first; ``last`` rows tell what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, content, version, number = None, None, 0, 0

        def end() -> list[dict]:
            return [{"project": now, "seq": None, "outcome": None, "version": version, "content": content, "last": True}] if content is not None else []

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["project"] != now:
                    out += end()
                    now, content, version, number = r["project"], None, 0, 0
                op, text = r["op"], r["text"] or ""
                if op == "held":
                    content, version, number = text, r["version"], highest_number(text)
                    continue
                outcome, new = op, None
                if not (now or "").strip() or now == GLOBAL:
                    outcome = "no_project"
                elif op == "clear":
                    outcome = "absent" if content is None else "cleared"
                    content, version, number = None, 0, 0
                elif op in ("set", "append"):
                    new = text if op == "set" else appended(content or "", number + 1, text)
                    outcome = "too_long" if len(new) > CONTEXT_LIMIT else op
                else:
                    outcome = "unknown"
                if outcome in ("set", "append"):
                    # an appended text may hold headings of its own
                    number = highest_number(text) if op == "set" else max(number + 1, highest_number(text))
                    content, version = new, version + 1
                out.append({"project": now, "seq": r["seq"], "outcome": outcome, "version": version if content is not None else None, "content": None, "last": False})
            yield pa.RecordBatch.from_pylist(out, SCHEMA)
        yield pa.RecordBatch.from_pylist(end(), SCHEMA)

    return rows.repartition("project").sortWithinPartitions("project", "seq").mapInArrow(run, FOLDED)


SCHEMA = pa.schema([("project", pa.string()), ("seq", pa.int64()), ("outcome", pa.string()), ("version", pa.int64()), ("content", pa.string()), ("last", pa.bool_())])


def change_contexts(contexts: DataFrame, operations: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(results (project, seq, outcome, version), contexts) of operations (project, seq, op, text), in the order of seq.

    op: set, append or clear. Outcomes: set, append, cleared, absent (nothing to clear), too_long (left as it was), no_project (none named, or the global scope), unknown. Contexts
    that no operation names stay; a cleared one that is set again starts at version 1.
    """
    touched = operations.select("project").distinct()
    held = contexts.join(touched, "project", "left_semi").select("project", F.lit(-1).cast("bigint").alias("seq"), F.lit("held").alias("op"), F.col("content").alias("text"), "version")
    rows = operations.select("project", F.col("seq").cast("bigint"), "op", "text", F.lit(None).cast("bigint").alias("version")).unionByName(held)
    done = lineage.cut(fold(rows))
    changed = done.where("NOT last AND outcome IN ('set', 'append')").select("project").distinct().withColumn("changed", F.lit(True))
    left = done.where("last").join(changed, "project", "left").join(contexts.select("project", F.col("updated_at").alias("before")), "project", "left")
    new = left.select("project", "content", "version", F.when(F.col("changed"), now).otherwise(F.col("before")).alias("updated_at"))
    return done.where("NOT last").select("project", "seq", "outcome", "version"), contexts.join(touched, "project", "left_anti").unionByName(new.select(*contexts.columns))


def context_of(contexts: DataFrame, project: str) -> DataFrame:
    """The context of a project, if it has one; the predicate reaches the scan."""
    return contexts.where(F.col("project") == project)
