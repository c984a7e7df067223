"""A document's meaning as canonical JSON: its hash, and what differs between two.

Objects have sorted keys at every level (a variant keeps them so), so neither the order of keys nor white space counts; the
order of lists does. All columns; a document's 19 fields are put together without parsing its body.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields that make a document's meaning, and the column and kind of each.
SEMANTIC_FIELDS = {
    "attester": ("attester", "json"),
    "body": ("content", "text"),
    "computation": ("computation", "json"),
    "description": ("description", "text"),
    "executor": ("executor", "json"),
    "extensions": ("extensions", "map"),
    "generated": ("generated", "json"),
    "parameters": ("parameters", "list"),
    "resource": ("resource", "text"),
    "runtime": ("runtime", "json"),
    "sources": ("sources", "list"),
    "stale_after": ("stale_after", "text"),
    "status": ("status", "text"),
    "tags": ("tags", "list"),
    "title": ("title", "text"),
    "type": ("concept_type", "text"),
    "usage_window": ("usage_window", "json"),
    "verified": ("verified", "list"),
    "x-agent-memory": ("agent_memory", "map"),
}
#: What an absent value of a kind counts as.
ABSENT = {"text": "null", "json": "null", "list": "[]", "map": "{}"}


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def canonical(json: Column) -> Column:
    """JSON with sorted keys and without white space; a text that isn't JSON (or repeats a key) as a JSON string; null for null."""
    return F.coalesce(F.to_json(F.try_parse_json(json)), F.when(json.isNotNull(), quoted(json)))


def semantic_parts(columns: dict[str, str]) -> Column:
    """array<string>: the canonical JSON of each of ``SEMANTIC_FIELDS``, in their order.

    ``columns`` is (name, type) of the table's columns: absent ones count as null; JSON columns are text or typed values.
    """
    parts = []
    for column, kind in SEMANTIC_FIELDS.values():
        if column not in columns:
            parts.append(F.lit(ABSENT[kind]))
            continue
        value = F.col(column)
        if kind == "text":
            part = F.when(value.isNotNull(), quoted(value))
        else:
            part = canonical(value if columns[column] == "string" else F.to_json(value, {"ignoreNullFields": "false"}))
        parts.append(F.coalesce(part, F.lit(ABSENT[kind])))
    return F.array(*parts)


def semantic_json(parts: Column) -> Column:
    """The canonical JSON object of ``semantic_parts``."""
    fields = [F.concat(F.lit(f'"{name}":'), F.get(parts, F.lit(k))) for k, name in enumerate(SEMANTIC_FIELDS)]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def semantic_hash(parts: Column) -> Column:
    return F.sha2(semantic_json(parts), 256)


def semantic_diff(before: Column, after: Column) -> Column:
    """array<struct<field, before, after>> of the fields whose canonical JSON differs; ``before`` null: of a document that has nothing yet."""
    empty = F.array(*(F.lit(ABSENT[kind]) for _, kind in SEMANTIC_FIELDS.values()))
    old = F.coalesce(before, empty)
    rows = F.transform(F.array(*map(F.lit, SEMANTIC_FIELDS)), lambda name, k: F.struct(name.alias("field"), F.get(old, k).alias("before"), F.get(after, k).alias("after")))
    return F.filter(rows, lambda r: r["before"] != r["after"])
