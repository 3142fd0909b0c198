"""Where results go: documents as lines of JSON, logs by use case and disposition; a streaming sink that writes a batch once."""

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from weblens import plugins


class Sink:
    """What a deployment registers to deliver results: documents (value, ...), insights (any rows) and dead letters."""

    def emit_alerts(self, docs: DataFrame) -> None:
        raise NotImplementedError

    def emit_insights(self, rows: DataFrame) -> None:
        raise NotImplementedError

    def emit_dead_letters(self, rows: DataFrame) -> None:
        raise NotImplementedError


@plugins.register("sink", "files")
class FileSink(Sink):
    """Lines of JSON below one folder."""

    def __init__(self, folder: str):
        self.folder = folder

    def emit_alerts(self, docs: DataFrame) -> None:
        write_documents(docs, f"{self.folder}/alerts")

    def emit_insights(self, rows: DataFrame) -> None:
        write_insights(rows, f"{self.folder}/insights")

    def emit_dead_letters(self, rows: DataFrame) -> None:
        write_dead_letters(rows, f"{self.folder}/dead_letters")


def write_documents(docs: DataFrame, folder: str) -> None:
    """Append documents (value, ...) as lines of JSON."""
    docs.select("value").write.mode("append").text(folder)


def write_insights(rows: DataFrame, folder: str) -> None:
    """Append any rows as lines of JSON, a document each."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(folder)


def write_dead_letters(rows: DataFrame, folder: str) -> None:
    """Append what could not be read: source, reason and the raw line."""
    rows.select(F.to_json(F.struct("source", "reason", "raw")).alias("value")).write.mode("append").text(folder)


def write_log(log: DataFrame, folder: str) -> None:
    """Append the audit log, partitioned so that one use case or disposition is read alone."""
    log.write.mode("append").partitionBy("usecase", "disposition").parquet(folder)


@dataclass
class Staged(WriterCommitMessage):
    """A file that a task has written aside, and its number of lines."""

    path: str
    lines: int


class OnceWriter(DataSourceStreamWriter):
    """Tasks write aside; a commit lists a batch's files in one manifest, which appears at once and names the batch.

    Files that no manifest lists are not part of the sink: those of failed or repeated tasks. A batch that is committed
    again finds its manifest and drops what it wrote. The folder is one that driver and executors share.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator) -> Staged:
        os.makedirs(f"{self.folder}/data", exist_ok=True)
        path, n = f"{self.folder}/data/{uuid.uuid4().hex}.json", 0
        with open(path, "w", encoding="utf-8") as f:
            for row in iterator:
                f.write(row.value.replace("\n", " ") + "\n")
                n += 1
        return Staged(path, n)

    def commit(self, messages: list, batchId: int) -> None:
        os.makedirs(f"{self.folder}/batches", exist_ok=True)
        manifest = f"{self.folder}/batches/{batchId:012d}.json"
        if os.path.exists(manifest):
            return self.abort(messages, batchId)
        files = [os.path.basename(m.path) for m in messages if m is not None and m.lines]
        with open(f"{manifest}.tmp", "w", encoding="utf-8") as f:
            json.dump({"batch": batchId, "files": files, "lines": sum(m.lines for m in messages if m is not None)}, f)
        os.replace(f"{manifest}.tmp", manifest)

    def abort(self, messages: list, batchId: int) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class OnceSink(DataSource):
    """``writeStream.format("weblens_once")`` of a column ``value``, to the folder in the option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "weblens_once"

    def streamWriter(self, schema, overwrite: bool) -> OnceWriter:
        return OnceWriter(self.options["path"])


def delivered(spark: SparkSession, folder: str) -> DataFrame:
    """(value) of all committed batches: the files that manifests list, whatever else lies there."""
    listed = spark.read.text(f"{folder}/batches/*.json").select(F.from_json("value", "batch long, files array<string>, lines long").alias("m"))
    files = listed.select(F.explode("m.files").alias("file"))
    rows = spark.read.text(f"{folder}/data").select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    return rows.join(files, "file", "left_semi").select("value")
