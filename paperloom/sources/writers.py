"""Files written by executors: whole files, and reports put together from ordered parts.

A task writes under a name of its own and moves the file to its place when it is whole, so readers never see a
part of one; a task that is repeated or runs twice moves the same bytes there again, and one that fails removes what
it began. Only names and counts come back to the driver. Folders may be on any file system that pyarrow knows
by the folder's URI; driver and executors must share it.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes moved at once where files are put together.
CHUNK = 4 << 20


def filesystem(folder: str):
    """(file system, path) of a folder given as URI or local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + os.path.abspath(folder))


def put(fs, place: str, chunks: Iterable[bytes]) -> int:
    """Write ``chunks`` to ``place``, which appears when it is whole; the number of bytes."""
    fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
    own, size, done = f"{place}.{uuid.uuid4().hex}.tmp", 0, False
    try:
        with fs.open_output_stream(own) as out:
            for chunk in chunks:
                out.write(chunk)
                size += len(chunk)
        fs.move(own, place)
        done = True
    finally:
        if not done and fs.get_file_info(own).type.name != "NotFound":
            fs.delete_file(own)
    return size


def chunks_of(fs, places: Iterable[str], between: bytes = b"") -> Iterable[bytes]:
    """The bytes of files one after another, ``between`` after each."""
    for place in places:
        with fs.open_input_stream(place) as file:
            while chunk := file.read(CHUNK):
                yield bytes(chunk)
        if between:
            yield between


def write_files(files: DataFrame, folder: str, made: Callable[[dict], Iterable[tuple[str, bytes]]]) -> DataFrame:
    """Write what ``made`` gives for each row (as a dict): (place below the folder, bytes). Runs at once; the
    manifest (place, size) is a stored table."""
    from ..operators.shared import stored

    def run(batches):
        fs, root = filesystem(folder)
        for b in batches:
            rows = [(place, put(fs, f"{root}/{place}", [raw])) for row in b.to_pylist() for place, raw in made(row)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["place", "size"])

    return stored(files.mapInArrow(run, "place string, size long"))


def merge_files(manifest: DataFrame, folder: str, name: str, between: bytes = b"\n") -> int:
    """Put the files of a manifest together in order of their places, in one task that streams them; bytes written."""

    def run(batches):
        fs, root = filesystem(folder)
        places = (f"{root}/{p}" for b in batches for p in b.column("place").to_pylist())
        size = put(fs, f"{root}/{name}", chunks_of(fs, places, between))
        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64())], names=["size"])

    return manifest.select("place").repartition(1).sortWithinPartitions("place").mapInArrow(run, "size long").first()["size"]


class Report:
    """A text file made of pieces in order: lines of the driver's, and tables of texts that executors write.

    ``rows`` writes a table's column ``text`` in the order of its other columns, each partition a part file, between
    lines that stand there only if it has rows. ``close`` puts all parts together in one task that streams them.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str):
        self.spark, self.folder, self.name = spark, folder, name
        self.fs, self.root = filesystem(folder)
        self.parts = f".{name}-{uuid.uuid4().hex}"
        self.places: list[str] = []

    def lines(self, *lines: str) -> None:
        if lines:
            place = f"{self.root}/{self.parts}/{len(self.places):06d}"
            put(self.fs, place, ["".join(f"{x}\n" for x in lines).encode()])
            self.places.append(place)

    def rows(self, table: DataFrame, before: Iterable[str] = (), after: Iterable[str] = ()) -> int:
        """Write the table; the number of its rows."""
        order = [c for c in table.columns if c != "text"]
        folder, piece = f"{self.parts}/rows-{len(self.places):06d}", self.folder

        def run(batches):
            from pyspark import TaskContext

            fs, root = filesystem(piece)
            rows = 0

            def chunks():
                nonlocal rows
                for b in batches:
                    rows += b.num_rows
                    yield "".join(f"{x}\n" for x in b.column("text").to_pylist() if x is not None).encode()

            first = next(batches, None)
            if first is None:
                return
            batches = _with(first, batches)
            place = f"{root}/{folder}/{TaskContext.get().partitionId():08d}"
            put(fs, place, chunks())
            yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([rows], pa.int64())], names=["place", "rows"])

        dealt = table.repartitionByRange(*order).sortWithinPartitions(*order)
        done = sorted(tuple(r) for r in dealt.mapInArrow(run, "place string, rows long").collect())  # one row a partition
        total = sum(n for _, n in done)
        if total:
            self.lines(*before)
            self.places += [place for place, _ in done]
            self.lines(*after)
        return total

    def close(self) -> str:
        """Put the report together and remove its parts; its place."""
        places, folder, name = self.places, self.folder, self.name

        def run(batches):
            fs, root = filesystem(folder)
            for _ in batches:
                size = put(fs, f"{root}/{name}", chunks_of(fs, places))
                yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64())], names=["size"])

        try:
            self.spark.range(0, 1, 1, 1).mapInArrow(run, "size long").collect()
        finally:
            self.drop()
        return f"{self.root}/{name}"

    def drop(self) -> None:
        """Remove the parts, as after a failure."""
        place = f"{self.root}/{self.parts}"
        if self.fs.get_file_info(place).type.name == "Directory":
            self.fs.delete_dir(place)


def _with(first, rest):
    yield first
    yield from rest
