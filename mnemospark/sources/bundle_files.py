"""Bundles as files: ``memories/<id>.md``, ``index.md`` and ``log.md``, all of them or none.

Export is a data source writer: tasks write their rows' files into a hidden folder beside the target, and the commit moves
that folder to its name, so a reader sees no bundle or a whole one; a failed job leaves nothing. Files are written
through Arrow's file systems, so the target may be any place that all executors reach. A repeated task writes the same files again.

Import reads the files through Spark and puts them as one batch; a document's own revision is the one it expects.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from mnemospark.functions.predicates import has_secret, live
from mnemospark.operators.bundle import event_log, index_document, index_rows
from mnemospark.operators.put import DOCUMENT, Put, conformed, put, stored_documents
from mnemospark.sources.documents import read_bundle, render

FORMAT, LOG_EVENTS = "mnemospark_bundle", 200
#: What a file's name may be.
NAME = r"^(?:memories/)?[^/.\x00-\x1f][^/\x00-\x1f]*\.md$"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path.rstrip("/")
    system, place = fs.FileSystem.from_uri(path)
    return system, place.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    files: int


class BundleWriter(DataSourceWriter):
    """Writes rows (path, document) as files."""

    def __init__(self, path: str) -> None:
        self.path = path
        system, place = located(path)
        if system.get_file_info(place).type != fs.FileType.NotFound:
            raise ValueError(f"{path} exists already")
        parent, _, name = place.rpartition("/")
        self.place, self.staging = place, f"{parent}/.{name}-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        system, _ = located(self.path)
        made, n = set(), 0
        for row in rows:
            where = f"{self.staging}/{row.path}"
            folder = where.rpartition("/")[0]
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            with system.open_output_stream(where) as out:
                out.write(row.document.encode())
            n += 1
        return Written(n)

    def commit(self, messages: list) -> None:
        system, _ = located(self.path)
        system.create_dir(self.staging, recursive=True)
        system.move(self.staging, self.place)

    def abort(self, messages: list) -> None:
        system, _ = located(self.path)
        if system.get_file_info(self.staging).type != fs.FileType.NotFound:
            system.delete_dir(self.staging)


class BundleSource(DataSource):
    """``df.write.format(FORMAT).save(path)`` for rows (path, document)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, document string"

    def writer(self, schema, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options["path"])


def rendered_documents(tables: dict[str, DataFrame], ids: DataFrame | None = None) -> DataFrame:
    """(path, document) of the live memories, or of those of ``ids`` (id)."""
    m = tables["memories"].where(live())
    if ids is not None:
        m = m.join(ids.select("id").distinct(), "id", "left_semi")
    rows = stored_documents(m, tables["concepts"], tables["sources"], tables["verifications"], tables["relationships"])
    more = m.select(F.col("id").alias("memory_id"), "project").join(tables["concepts"].select("memory_id", F.col("current_revision").alias("revision")), "memory_id")
    text = {"id": F.col("memory_id"), "type": F.col("concept_type"), "body": F.col("content"), "revision": F.col("revision").cast("string")}
    lists = {c: F.when(F.size(c) > 0, F.to_json(F.col(c))) for c in ("sources", "verified", "edges")}
    made = {"generated": F.when(F.col("generated_by").isNotNull(), F.to_json(F.struct(F.col("generated_by").alias("by"), F.col("generated_at").alias("at"))))}
    return render(rows.join(more, "memory_id").withColumns(text | lists | made))


def export_bundle(tables: dict[str, DataFrame], path: str, today: Column, ids: DataFrame | None = None, dry_run: bool = False) -> int:
    """Writes the live memories (or ``ids``) with their index and the newest ``LOG_EVENTS`` events of their log; returns the number of documents.

    Refused, before anything is written: a path that exists, a document with a secret marker, an id that is no file name, or twice.
    """
    spark = tables["memories"].sparkSession
    system, place = located(path)
    if system.get_file_info(place).type != fs.FileType.NotFound:
        raise ValueError(f"{path} exists already")
    m = tables["memories"].where(live()) if ids is None else tables["memories"].where(live()).join(ids.select("id").distinct(), "id", "left_semi")
    names = m.select(F.concat(F.lit("memories/"), "id", F.lit(".md")).alias("path"), has_secret(F.col("content")).alias("secret"))
    told = names.groupBy("path").agg(F.count("*").alias("n"), F.max("secret").alias("secret")).agg(F.count("*").alias("files"), F.count_if(F.col("n") > 1).alias("twice"), F.count_if("secret").alias("secret"), F.count_if(~F.col("path").rlike(NAME)).alias("odd")).first()
    if told["secret"]:
        raise ValueError("a document holds a secret marker")
    if told["odd"] or told["twice"]:
        raise ValueError("an id is no file name, or there twice")
    if dry_run:
        return told["files"]
    # a type's list is one text, and so is the log of its last events
    index = index_document(index_rows(m, tables["concepts"], today)).select(F.concat(F.lit("## "), "concept_type", F.lit("\n\n"), "body").alias("part"), F.col("concept_type").alias("at"))
    newest = event_log(*(tables[t].join(m.select(F.col("id").alias("memory_id")), "memory_id", "left_semi") for t in ("revisions",)), tables["tombstones"]).orderBy(F.desc("at"), F.desc("memory_id"), F.desc("revision")).limit(LOG_EVENTS)
    line = F.concat(F.lit("- "), F.date_format("at", "yyyy-MM-dd"), F.lit(" "), "operation", F.lit(" "), "memory_id", F.lit(" r"), F.coalesce(F.col("revision").cast("string"), F.lit("-")))

    def document(rows: DataFrame, title: str, name: str, reverse: bool) -> DataFrame:
        parts = F.sort_array(F.collect_list(F.struct("at", "part")), not reverse)
        return rows.agg(F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform(parts, lambda p: p["part"]), "\n"), F.lit("\n")).alias("document")).select(F.lit(name).alias("path"), "document")

    events = newest.select(line.alias("part"), F.struct("at", "memory_id", "revision").alias("at"))
    rows = rendered_documents(tables, ids).unionByName(document(index, "Index", "index.md", False)).unionByName(document(events, "Log", "log.md", True))
    spark.dataSource.register(BundleSource)
    rows.select("path", "document").write.format(FORMAT).mode("append").save(path)
    return told["files"]


def bundle_documents(spark: SparkSession, path: str) -> DataFrame:
    """A bundle's files, or one file's, as documents to be put: the columns of ``put``, ``error`` and ``secret``; in the order of their names."""
    d = read_bundle(spark, path)
    name = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    listed = {c: F.from_json(c, DOCUMENT[c]) for c in ("sources", "verified", "edges")}
    put_as = {"target": F.concat(F.lit("/memories/"), name, F.lit(".md")), "content": F.col("body"), "concept_type": F.col("type"), "expected": F.expr("try_cast(revision as bigint)"), "generated_by": F.get_json_object("generated", "$.by"), "generated_at": F.get_json_object("generated", "$.at"), "extensions": F.nullif(F.col("extensions"), F.lit("{}"))}
    rows = d.withColumn("secret", F.coalesce(has_secret(F.col("body")), F.lit(False))).withColumns(listed | put_as)
    # a file's place in the batch is its name's hash: no two files share a name, and only a memory's own proposals are ordered
    return rows.withColumn("seq", F.xxhash64("path"))


def import_bundle(tables: dict[str, DataFrame], path: str, project: str | None, now: Column, dry_run: bool = False) -> tuple[Put, DataFrame]:
    """(the put, (path, outcome) of every file): documents that can't be read are rejected, those with a secret marker blocked.

    A document that names its revision is put only onto that revision; one that is new is created whatever revision it names.
    """
    d = bundle_documents(tables["memories"].sparkSession, path)
    known = tables["memories"].select(F.col("id").alias("known_id"))
    ok = d.where("error IS NULL AND NOT secret").withColumn("dry_run", F.lit(dry_run))
    ok = ok.join(known, F.coalesce("id", F.regexp_extract("path", r"([^/]+)\.md$", 1)) == F.col("known_id"), "left").withColumn("expected", F.when(F.col("known_id").isNotNull(), F.col("expected")))
    done = put(tables, conformed(ok), project, now, "import")
    told = d.select("path", "seq", F.when(F.col("error").isNotNull(), "rejected").when(F.col("secret"), "blocked").alias("early")).join(done.results.select("seq", F.col("outcome").alias("late")), "seq", "left")
    return done, told.select("path", F.coalesce("early", "late").alias("outcome"))
