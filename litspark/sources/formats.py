"""Spark formats of the library's own: ``jats`` reads papers' XML files, ``report`` writes evaluation reports.

Both open files in Python, so their folders must be file paths that driver and
executors share (``file:`` or none as scheme). For object stores use
:func:`litspark.sources.jats.read_xml_files`.
"""

from __future__ import annotations

import datetime
import json
import os
import shutil
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage)
from pyspark.sql.types import StructType

#: Bytes of files that one partition of the ``jats`` format reads, unless a single file is larger.
PARTITION_BYTES = 64 << 20


def register(spark: SparkSession) -> None:
    """Make ``jats`` and ``report`` known to the session."""
    spark.dataSource.register(JatsSource)
    spark.dataSource.register(ReportSource)


def local_path(path: str) -> str:
    """A plain path of a shared folder; other schemes raise."""
    scheme = urlparse(path).scheme
    if scheme == "file":
        return unquote(urlparse(path).path)
    if scheme:
        raise ValueError(f"{path}: only shared file paths can be opened from Python")
    return path


def xml_files(path: str) -> list[tuple[str, int]]:
    """Every ``.xml`` file below a folder with its size, by path; hidden and temporary names are left out."""
    found = []
    for folder, below, names in os.walk(path):
        below[:] = [b for b in below if not b.startswith((".", "_"))]
        for name in names:
            if name.endswith(".xml") and not name.startswith((".", "_")):
                at = os.path.join(folder, name)
                found.append((at, os.path.getsize(at)))
    return sorted(found)


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    paths: tuple[str, ...]


def packed(files: Iterable[tuple[str, int]], limit: int) -> list[Files]:
    """Files in order, put together until the next would pass ``limit`` bytes."""
    parts: list[Files] = []
    paths: list[str] = []
    size = 0
    for path, n in files:
        if paths and size + n > limit:
            parts.append(Files(tuple(paths)))
            paths, size = [], 0
        paths.append(path)
        size += n
    return [*parts, Files(tuple(paths))] if paths else parts


def _documents(part: Files) -> Iterator[tuple[str, str]]:
    for path in part.paths:
        with open(path, encoding="utf-8", errors="replace", newline="") as file:
            yield path, file.read()


def write_xml_files(documents: DataFrame, path: str) -> None:
    """One file per row of ``(doc_key, xml)``, spread over 256 folders by a hash; a repeated task writes the same files again."""
    root = local_path(path)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for frame in frames:
            for key, xml, folder in zip(frame["doc_key"], frame["xml"], frame["folder"]):
                at = os.path.join(root, f"{folder:02x}")
                os.makedirs(at, exist_ok=True)
                draft = os.path.join(at, f".{key}.{uuid.uuid4().hex}")
                with open(draft, "w", encoding="utf-8", newline="") as file:
                    file.write(xml)
                os.replace(draft, os.path.join(at, f"{key}.xml"))
                n += 1
        yield pd.DataFrame({"n": [n]})

    documents.where("doc_key is not null and xml is not null").select(
        "doc_key", "xml", F.pmod(F.hash("doc_key"), F.lit(256)).alias("folder")).mapInPandas(
        write, "n bigint").write.format("noop").mode("overwrite").save()


class JatsSource(DataSource):
    """``spark.read.format("jats").load(folder)``: one row ``(doc_key, xml)`` per file, for ``jats.parse_papers``.

    Option ``partitionBytes`` sets what a task reads. As a stream, option
    ``ledger`` names a folder in which every step lists the files it adds, so a
    file is read once whatever its name or time; put whole files in place by
    renaming, and use one ledger per query.
    """

    @classmethod
    def name(cls) -> str:
        return "jats"

    def schema(self) -> str:
        return "doc_key string, xml string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self._path = local_path(options["path"])
        self._limit = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[Files]:
        return packed(xml_files(self._path), self._limit) or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple[str, str]]:
        return _documents(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are numbers of ledger entries; an entry, once written, never changes."""

    def __init__(self, options: dict) -> None:
        if "ledger" not in options:
            raise ValueError("a jats stream needs the option ledger")
        self._path, self._ledger = local_path(options["path"]), local_path(options["ledger"])
        self._limit = int(options.get("partitionBytes", PARTITION_BYTES))
        self._known: set[str] = set()
        self._steps = 0

    def _entry(self, step: int) -> str:
        return os.path.join(self._ledger, f"{step:09d}.json")

    def _files(self, step: int) -> list[tuple[str, int]]:
        with open(self._entry(step), encoding="utf-8") as file:
            return [tuple(row) for row in json.load(file)]

    def initialOffset(self) -> dict:
        return {"step": 0}

    def latestOffset(self) -> dict:
        os.makedirs(self._ledger, exist_ok=True)
        while os.path.exists(self._entry(self._steps)):
            self._known.update(path for path, _ in self._files(self._steps))
            self._steps += 1
        new = [f for f in xml_files(self._path) if f[0] not in self._known]
        if new:
            draft = f"{self._entry(self._steps)}.{uuid.uuid4().hex}"
            with open(draft, "w", encoding="utf-8") as file:
                json.dump(new, file)
            os.replace(draft, self._entry(self._steps))
            self._known.update(path for path, _ in new)
            self._steps += 1
        return {"step": self._steps}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        files = [f for step in range(start["step"], end["step"]) for f in self._files(step)]
        return packed(files, self._limit) or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple[str, str]]:
        return _documents(partition)


@dataclass
class Written(WriterCommitMessage):
    """One task's file and its rows."""

    name: str
    rows: int


class ReportSource(DataSource):
    """``df.write.format("report").option("run", id).mode("overwrite").save(folder)``: a report's rows as JSON lines.

    Tasks write into a folder of the job's own. A commit drops what failed
    attempts left there, adds ``_report.json`` (run, files, rows) and puts the
    folder in place as ``<folder>/<run>`` by renaming; ``<folder>/latest.json``
    comes last. A failed job leaves nothing, an earlier report stands. Mode
    ``append`` refuses a run that exists.
    """

    @classmethod
    def name(cls) -> str:
        return "report"

    def schema(self) -> str:
        raise ValueError("read reports with spark.read.json")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema, overwrite)


def _plain(value: object) -> object:
    """Rows as objects, times and dates as text."""
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        run = options.get("run", "")
        if not run or run != os.path.basename(run) or run.startswith((".", "_")):
            raise ValueError(f"option run must be a folder name, not {run!r}")
        self._run, self._names = run, schema.names
        self._path = local_path(options["path"])
        self._target = os.path.join(self._path, run)
        if not overwrite and os.path.exists(self._target):
            raise ValueError(f"report {run} exists")
        self._staged = os.path.join(self._path, f"_staged-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        os.makedirs(self._staged, exist_ok=True)
        name, rows = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.json", 0
        with open(os.path.join(self._staged, name), "w", encoding="utf-8") as file:
            for row in iterator:
                file.write(json.dumps(dict(zip(self._names, map(_plain, row))), ensure_ascii=False) + "\n")
                rows += 1
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        done = sorted((m for m in messages if m is not None), key=lambda m: m.name)
        os.makedirs(self._staged, exist_ok=True)
        for stray in set(os.listdir(self._staged)) - {m.name for m in done}:
            os.remove(os.path.join(self._staged, stray))
        about = {"run": self._run, "files": [m.name for m in done], "rows": sum(m.rows for m in done)}
        with open(os.path.join(self._staged, "_report.json"), "w", encoding="utf-8") as file:
            json.dump(about, file)
        if os.path.exists(self._target):
            old = f"{self._staged}-old"
            os.replace(self._target, old)
            os.replace(self._staged, self._target)
            shutil.rmtree(old)
        else:
            os.replace(self._staged, self._target)
        draft = os.path.join(self._path, f"_latest-{uuid.uuid4().hex}")
        with open(draft, "w", encoding="utf-8") as file:
            json.dump(about, file)
        os.replace(draft, os.path.join(self._path, "latest.json"))

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self._staged, ignore_errors=True)


def write_report(rows: DataFrame, path: str, run: str) -> None:
    """Write one report whole or not at all; a run written again is replaced."""
    register(rows.sparkSession)
    rows.write.format("report").option("run", run).mode("overwrite").save(path)
