"""Stacked CSV blocks as a data source: ``efd_csv`` writes lines in order and reads coefficients back.

Every task writes a file of its own for each attempt; the commit keeps one
attempt of each, named in the order of the tasks, and removes the others, so
that the files in the order of their names are the whole text. Paths are what
the file systems of Arrow reach (local, HDFS, object stores).
"""

from __future__ import annotations

import csv
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

COEFFICIENTS = "specimen_name string, harmonic int, a double, b double, c double, d double"
HEADER = "harmonic,a,b,c,d"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path)


@dataclass
class Written(WriterCommitMessage):
    part: int
    file: str
    lines: int


class BlockWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path = path
        where, folder = _open(path)
        there = where.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        if there and not overwrite:
            raise ValueError(f"{path} has files already")
        where.create_dir(folder)
        if overwrite:
            where.delete_dir_contents(folder)

    def write(self, rows: Iterator[Row]) -> Written:
        where, folder = _open(self.path)
        part, lines = TaskContext.get().partitionId(), 0
        file = f"_attempt-{part:05d}-{uuid.uuid4().hex}"
        with where.open_output_stream(f"{folder}/{file}") as out:
            for row in rows:
                out.write(f"{row.line}\n".encode())
                lines += 1
        return Written(part, file, lines)

    def commit(self, messages: list[Written | None]) -> None:
        where, folder = _open(self.path)
        for m in sorted((m for m in messages if m and m.lines), key=lambda m: m.part):
            where.move(f"{folder}/{m.file}", f"{folder}/part-{m.part:05d}.csv")
        self._clear(where, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_open(self.path))

    @staticmethod
    def _clear(where: fs.FileSystem, folder: str) -> None:
        for f in where.get_file_info(fs.FileSelector(folder)):
            if f.base_name.startswith("_attempt-"):
                where.delete_file(f.path)


@dataclass
class Part(InputPartition):
    file: str


class BlockReader(DataSourceReader):
    """Every file holds whole blocks, and is one partition."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        where, folder = _open(self.path)
        found = where.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return [Part(f.path) for f in sorted(found, key=lambda f: f.base_name) if f.base_name.startswith("part-")] or [Part("")]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.file:
            return
        where, _ = _open(self.path)
        with where.open_input_stream(partition.file) as stream:
            name = None
            for fields in csv.reader(_lines(stream)):
                if not fields or fields == [""]:
                    name = None
                elif name is None:
                    name = fields[0]
                elif fields != HEADER.split(","):
                    yield (name, int(fields[0]), *map(float, fields[1:]))


def _lines(stream) -> Iterator[str]:
    """Lines with their ends, a few at a time."""
    rest = b""
    while piece := stream.read(1 << 20):
        *whole, rest = (rest + piece).split(b"\n")
        yield from (f"{line.decode()}\n" for line in whole)
    if rest:
        yield rest.decode()


class EfdCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "efd_csv"

    def schema(self) -> str:
        return COEFFICIENTS

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        return BlockWriter(self.options["path"], overwrite)
