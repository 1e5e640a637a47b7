"""Data source ``dated_files``: delimited session files, plain or zipped, whose names carry the date.

Reading looks at names first.  The files of the wanted days, and the newest of them, are chosen before any is opened;
small files are packed into one task and each is streamed in chunks.  Of an archive the first member with a known
suffix is read.  Only the wanted columns are taken, by the first alias that the header holds (ignoring case and
punctuation), as text.  The days are options and not filters pushed down by a query: Spark 4.1 keeps what was pushed
to a Python source in the relation, where the next query on the same DataFrame would find it.

Writing gives one file per session.  A task writes under temporary names; only when all tasks are done are the
files given their names, so a task that is run again leaves nothing twice.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime

import pandas as pd
import pyarrow as pa
import pyarrow.csv
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage)
from pyspark.sql.types import StructType

from ratewell import columns as H

#: Rows of a file that are parsed at a time; bytes of files that one task reads.
CHUNK_ROWS, TASK_BYTES = 50_000, 64 << 20
_FORMATS = {"yyyyMMdd": "%Y%m%d", "ddMMyyyy": "%d%m%Y", "ddMMMyyyy": "%d%b%Y", "yyyy-MM-dd": "%Y-%m-%d"}


def session_of(name: str, kind: str) -> date | None:
    """Date in a file name, by the patterns of the file kind; None when none fits."""
    for pattern, form in H.DATED_FILE_PATTERNS[kind]:
        if found := re.search(pattern, name):
            try:
                return datetime.strptime(found[1], _FORMATS[form]).date()
            except ValueError:
                continue
    return None


def plain(header: str) -> str:
    return "".join(ch for ch in header.lower() if ch.isalnum())


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, str, date]]):
        super().__init__(files)
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: Mapping[str, str]):
        self.path, self.kind = options["path"], options["kind"]
        self.columns: dict[str, list[str]] = json.loads(options["columns"])
        self.required: list[str] = json.loads(options.get("required", "[]"))
        self.suffixes = tuple(options.get("suffixes", ".csv,.dat,.txt").split(","))
        self.newest = int(options["newest"]) if "newest" in options else None
        self.since, self.until = (date.fromisoformat(options[k]) if k in options else None for k in ("since", "until"))

    def partitions(self) -> Sequence[InputPartition]:
        system, folder = fs.FileSystem.from_uri(self.path)
        dated = []
        for info in system.get_file_info(fs.FileSelector(folder)):
            named = info.base_name.lower().endswith((*self.suffixes, ".zip"))
            session = session_of(info.base_name, self.kind) if info.type == fs.FileType.File and named else None
            if session is not None and (self.until is None or session <= self.until) and (self.since is None or session >= self.since):
                dated.append((session, info.base_name, info.path, info.size))
        dated.sort()
        if self.newest is not None:
            dated = dated[max(0, len(dated) - self.newest):]
        packs, size = [[]], 0
        for session, name, path, length in dated:
            if packs[-1] and size + length > TASK_BYTES or len(packs[-1]) >= 64:
                packs.append([])
                size = 0
            packs[-1].append((path, name, session))
            size += length
        return [_Files(p) for p in packs]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        for path, name, session in partition.files:
            with system.open_input_file(path) as raw:
                if not name.lower().endswith(".zip"):
                    yield from self._rows(raw, name, session)
                    continue
                with zipfile.ZipFile(raw) as archive:
                    members = [m for m in archive.namelist() if m.lower().endswith(self.suffixes)]
                    if members:
                        with archive.open(members[0]) as handle:
                            yield from self._rows(handle, name, session)

    def _rows(self, handle, name: str, session: date) -> Iterator[pa.RecordBatch]:
        text = io.TextIOWrapper(handle, encoding="utf-8-sig", errors="replace", newline="")
        header = text.readline().rstrip("\r\n")
        separator = max(",|\t", key=header.count)
        names = [h.strip().strip('"') for h in header.split(separator)]
        at = {plain(h): i for i, h in reversed(list(enumerate(names)))}
        places = {c: next((at[plain(a)] for a in aliases if plain(a) in at), None) for c, aliases in self.columns.items()}
        if any(places[c] is None for c in self.required):
            return
        used = sorted({i for i in places.values() if i is not None})
        seen = 0
        if not used:
            return
        for chunk in pd.read_csv(text, sep=separator, header=None, names=range(len(names)), usecols=used, dtype=str,
                                 keep_default_na=False, chunksize=CHUNK_ROWS, index_col=False):
            cells = {i: pa.array(chunk[i].to_numpy(object), pa.string()) for i in used}
            empty = pa.nulls(len(chunk), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(chunk), pa.string()), pa.array([session] * len(chunk), pa.date32()),
                 pa.array(range(seen, seen + len(chunk)), pa.int64()), *(empty if i is None else cells[i] for i in places.values())],
                ["file_name", "session", "row_number", *places])
            seen += len(chunk)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: Mapping[str, str]):
        self.path, self.name, self.separator = options["path"], options["name"], options.get("separator", ",")

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, folder = fs.FileSystem.from_uri(self.path)
        system.create_dir(folder)
        files, session, out, closers = [], None, None, []

        def close() -> None:
            while closers:
                closers.pop().close()

        for batch in batches:
            days = batch.column("session").to_pylist()
            rows, start = batch.drop_columns(["session"]), 0
            while start < len(days):
                end = next((i for i in range(start, len(days)) if days[i] != days[start]), len(days))
                if days[start] != session:
                    close()
                    session = days[start]
                    final = session.strftime(self.name)
                    temporary = f"{folder}/.{final}.{uuid.uuid4().hex}"
                    files.append((temporary, f"{folder}/{final}"))
                    closers.append(sink := system.open_output_stream(temporary))
                    if final.endswith(".zip"):
                        closers.append(archive := zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED))
                        closers.append(sink := archive.open(final.removesuffix(".zip"), "w"))
                    out = sink
                    out.write((self.separator.join(rows.schema.names) + "\n").encode())
                text = io.BytesIO()
                pyarrow.csv.write_csv(rows.slice(start, end - start), text, pyarrow.csv.WriteOptions(
                    include_header=False, delimiter=self.separator, quoting_style="needed"))
                out.write(text.getvalue())
                start = end
        close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        system, _ = fs.FileSystem.from_uri(self.path)
        for message in messages:
            for temporary, final in message.files if message else ():
                system.move(temporary, final)

    def abort(self, messages: list[_Written | None]) -> None:
        system, _ = fs.FileSystem.from_uri(self.path)
        for message in messages:
            for temporary, _ in message.files if message else ():
                system.delete_file(temporary)


class DatedFiles(DataSource):
    """Options to read: ``path``, ``kind`` (of names), ``columns`` (JSON: column -> header aliases), and if wanted ``required``
    (columns without which a file is passed over), ``suffixes``, ``newest`` (files), ``since`` and ``until`` (days).  To write: ``path``,
    ``name`` (strftime pattern, zipped if it ends in .zip) and ``separator``; the rows have a ``session`` date."""

    @classmethod
    def name(cls) -> str:
        return "dated_files"

    def schema(self) -> str:
        return "file_name string, session date, row_number long, " + ", ".join(f"`{c}` string" for c in json.loads(self.options["columns"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


def read_dated(spark: SparkSession, path: str, kind: str, columns: Mapping[str, Sequence[str]], required: Sequence[str] = (),
               suffixes: str = ".csv,.dat,.txt", newest: int | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows of the newest session files between two days: file_name, session, row_number and the wanted columns as text."""
    spark.dataSource.register(DatedFiles)
    limits = {k: str(v) for k, v in (("newest", newest), ("since", since), ("until", until)) if v is not None}
    return spark.read.format("dated_files").options(
        path=path, kind=kind, columns=json.dumps(columns), required=json.dumps(list(required)), suffixes=suffixes, **limits).load()


def write_dated(rows: DataFrame, path: str, name: str, separator: str = ",") -> None:
    """One file per ``session``; null sessions have no file name and are refused."""
    spark = rows.sparkSession
    spark.dataSource.register(DatedFiles)
    checked = rows.withColumn("session", F.coalesce("session", F.raise_error(F.lit("a row has no session")).cast("date")))
    checked.repartition("session").sortWithinPartitions("session").write.format("dated_files").mode("append").options(
        path=path, name=name, separator=separator).save()
