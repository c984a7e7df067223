"""Markdown documents with YAML frontmatter: parse, render, import, export."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.functions.predicates import has_secret

MAX_DOCUMENT, MAX_FRONTMATTER, MAX_DEPTH, MAX_ITEMS, MAX_TAGS, MAX_ALIASES = 1 << 20, 128 << 10, 32, 10_000, 256, 64
KNOWN = ["id", "type", "title", "description", "resource", "tags", "status", "project", "scope", "memory_type", "stale_after", "sources", "verified", "generated", "edges", "revision", "metadata"]
_FIELDS = ["id", "type", "title", "description", "resource", "tags", "status", "project", "memory_type", "stale_after", "sources", "verified", "generated", "edges", "revision", "scope", "extensions", "body", "error"]
PARSED = T.StructType([T.StructField(n, T.ArrayType(T.StringType()) if n == "tags" else T.StringType()) for n in _FIELDS])


def _measure(value, depth: int = 0) -> int:
    if depth > MAX_DEPTH:
        raise ValueError("frontmatter is nested too deep")
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return 1 + sum(_measure(v, depth + 1) for v in inner)


def _text(v) -> str | None:
    return None if v is None else v if isinstance(v, str) else json.dumps(v, default=str, ensure_ascii=False, sort_keys=True)


def parse_document(document: str | None) -> dict:
    """The parts of a document; ``error`` says what is wrong with it, and then nothing else is set."""
    out: dict = dict.fromkeys(PARSED.fieldNames())
    try:
        if document is None:
            raise ValueError("no document")
        if len(document.encode("utf-8", "replace")) > MAX_DOCUMENT:
            raise ValueError("the document is too large")
        if not document.startswith("---\n"):
            raise ValueError("the document has no frontmatter")
        head, mark, body = document[4:].partition("\n---\n")
        if not mark:
            raise ValueError("the frontmatter does not end")
        if len(head.encode("utf-8", "replace")) > MAX_FRONTMATTER:
            raise ValueError("the frontmatter is too large")
        if sum(isinstance(t, yaml.AliasToken) for t in yaml.scan(head)) > MAX_ALIASES:
            raise ValueError("the frontmatter has too many aliases")
        meta = yaml.safe_load(head)
        if not isinstance(meta, dict):
            raise ValueError("the frontmatter is no mapping")
        if _measure(meta) > MAX_ITEMS:
            raise ValueError("the frontmatter has too many items")
        if not isinstance(meta.get("type"), str) or not meta["type"].strip():
            raise ValueError("the frontmatter has no type")
        tags = meta.get("tags") or []
        if not isinstance(tags, list) or len(tags) > MAX_TAGS:
            raise ValueError("tags are no list, or too many")
        for k in ("id", "type", "title", "description", "resource", "status", "project", "memory_type", "stale_after", "sources", "verified", "generated", "edges", "revision", "scope"):
            out[k] = _text(meta.get(k))
        out["tags"] = [str(t) for t in tags]
        out["extensions"] = json.dumps({k: v for k, v in meta.items() if k not in KNOWN}, default=str, ensure_ascii=False, sort_keys=True)
        out["body"] = body
    except (ValueError, yaml.YAMLError, RecursionError) as e:
        out["error"] = str(e).split("\n")[0]
    return out


def render_document(row: dict) -> str:
    """The document of a row: frontmatter keys in a fixed order, absent ones left out."""
    meta = {k: row[k] for k in KNOWN if row.get(k) not in (None, [], "")}
    for k in ("sources", "verified", "generated", "edges", "revision"):
        if isinstance(meta.get(k), str):
            meta[k] = json.loads(meta[k])
    extra = json.loads(row.get("extensions") or "{}")
    text = yaml.safe_dump(meta | {k: extra[k] for k in sorted(extra) if k not in meta}, sort_keys=False, allow_unicode=True, width=10_000)
    return f"---\n{text}---\n{row.get('body') or ''}"


@F.pandas_udf(PARSED)
def parsed(documents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_document(d) for d in documents], columns=PARSED.fieldNames())


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(path, document parts) of ``path``/memories/*.md, or of the file ``path``, through Spark's reader."""
    texts = spark.read.text(path if path.endswith(".md") else f"{path}/memories/*.md", wholetext=True).select(F.input_file_name().alias("path"), "value")
    return texts.select("path", parsed("value").alias("d")).select("path", "d.*")


def import_plan(documents: DataFrame, current: DataFrame) -> DataFrame:
    """(id, outcome): created, updated, unchanged, rejected, or blocked by a secret marker."""
    cur = current.select(F.col("id").alias("have_id"), F.col("content").alias("have_body"))
    j = documents.join(cur, documents["id"] == cur["have_id"], "left")
    outcome = F.when(F.col("error").isNotNull(), "rejected").when(has_secret(F.col("body")), "blocked").when(F.col("have_id").isNull(), "created").when(F.col("have_body") == F.col("body"), "unchanged").otherwise("updated")
    return j.select("id", outcome.alias("outcome"))


def render(rows: DataFrame) -> DataFrame:
    """(path, document) of rows that have the columns of parsed documents."""
    names = [c for c in PARSED.fieldNames() if c in rows.columns and c != "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [{k: (list(v) if hasattr(v, "tolist") else v) for k, v in r.items()} for r in f.to_dict("records")]
            yield pd.DataFrame({"path": [f"memories/{r['id']}.md" for r in found], "document": [render_document(r) for r in found]})

    return rows.select(*names).mapInPandas(run, "path string, document string")


def export(rows: DataFrame, root: str) -> None:
    """Writes rendered documents as a table of (path, document); refuses a place that exists."""
    rendered = render(rows)
    if rows.where(has_secret(F.col("body"))).limit(1).count():
        raise ValueError("a document holds a secret marker")
    rendered.write.mode("errorifexists").parquet(root)
