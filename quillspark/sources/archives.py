"""What archives hold, without unpacking them: a table of members from the headers alone.

A zip lists its members at its end, and a tar has a header before each; both are read by byte ranges, so an archive of
hundreds of gigabytes costs some reads a member and no memory. Each archive is one row, read where it lies; an archive that
can't be read gives a row that says why, and doesn't stop the others. What a member would be unpacked as, and which names
may not be, are expressions and aggregates over that table.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endings of archives, by kind.
ENDINGS = {"zip": (".zip",), "tar": (".tar.gz", ".tar.bz2", ".tar.xz", ".tgz", ".tbz2", ".txz", ".tar")}
MEMBERS = "archive string, kind string, pos int, name string, size long, error string"
#: Bytes of one read. Headers that stand close together come with one.
RANGE = 1 << 16
_FAILURES = (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, ValueError, NotImplementedError)


def kind_of(path: Column) -> Column:
    """"zip" or "tar" by the ending; null for what isn't an archive."""
    name, out = F.lower(path), F.lit(None).cast("string")
    for kind, endings in ENDINGS.items():
        for ending in endings:
            out = F.when(F.endswith(name, F.lit(ending)), kind).otherwise(out)
    return out


class Ranges(io.RawIOBase):
    """A file of which only the ranges that are asked for are read."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int) -> None:
        self.read_at, self.size, self.at, self.start, self.held, self.fetched = read_at, size, 0, 0, b"", 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = max(0, offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence])
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = max(0, min(self.size - self.at, n if n >= 0 else self.size))
        if not (self.start <= self.at and self.at + n <= self.start + len(self.held)):
            self.start, self.held = self.at, self.read_at(self.at, min(max(n, RANGE), self.size - self.at))
            self.fetched += len(self.held)
        out = self.held[self.at - self.start : self.at - self.start + n]
        self.at += len(out)
        return out

    def readinto(self, into: bytearray) -> int:
        out = self.read(len(into))
        into[: len(out)] = out
        return len(out)


def listed(kind: str, file: io.RawIOBase) -> Iterator[tuple[int, str, int]]:
    """(position, name, size) of the files of an archive; folders, links and devices aren't files."""
    if kind == "zip":
        with zipfile.ZipFile(file) as z:
            for k, x in enumerate(z.infolist()):
                if not x.is_dir():
                    yield k, x.filename, x.file_size
    else:
        with tarfile.open(fileobj=file) as t:
            for k, x in enumerate(t):
                t.members = []  # it would remember all
                if x.isfile():
                    yield k, x.name, x.size


def checked(kind: str, file: io.RawIOBase) -> None:
    """Reads every member to its end. A zip has a checksum for each; a tar shows no more than that it is whole."""
    if kind == "zip":
        with zipfile.ZipFile(file) as z:
            if (bad := z.testzip()) is not None:
                raise zipfile.BadZipFile(f"checksum of {bad}")
    else:
        with tarfile.open(fileobj=file) as t:
            for member in t:
                t.members = []
                handle = t.extractfile(member) if member.isfile() else None
                while handle is not None and handle.read(1 << 20):
                    pass
            # The block after the last member marks the end; a file cut between two members has none.
            t.fileobj.seek(t.offset)
            if t.fileobj.read(tarfile.BLOCKSIZE) != bytes(tarfile.BLOCKSIZE):
                raise tarfile.ReadError("unexpected end of data")


def _rows(archive: str, kind: str | None, file: io.RawIOBase, verify: bool) -> Iterator[tuple]:
    """Rows of one archive; its error, if any, comes last, without a member."""
    if kind is None:
        yield archive, kind, None, None, None, "not an archive: its name has none of the known endings"
        return
    try:
        if verify:
            checked(kind, file)
            file.seek(0)
        for row in listed(kind, file):
            yield (archive, kind, *row, None)
    except _FAILURES as e:
        yield archive, kind, None, None, None, f"{type(e).__name__}: {e}"[:500]


def _table(rows: DataFrame, opened: Callable[[tuple], io.RawIOBase], verify: bool) -> DataFrame:
    names = [x.split()[0] for x in MEMBERS.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda held: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                try:
                    file = opened(row)
                except _FAILURES as e:
                    held.append((row[0], row[1], None, None, None, f"{type(e).__name__}: {e}"[:500]))
                    continue
                for x in _rows(row[0], row[1], file, verify):
                    held.append(x)
                    if len(held) >= 10_000:
                        yield out(held)
                        held = []
        if held:
            yield out(held)

    return rows.mapInArrow(run, MEMBERS)


def members(archives: DataFrame, verify: bool = False) -> DataFrame:
    """(archive, kind, pos, name, size, error) of archives (path, content) that are at hand as bytes."""
    rows = archives.select(F.col("path").alias("archive"), kind_of(F.col("path")).alias("kind"), "content")
    return _table(rows, lambda row: io.BytesIO(row[2] if row[2] is not None else b""), verify)


def scan(spark: SparkSession, pattern: str, verify: bool = False) -> DataFrame:
    """The same of archives in a store, read by ranges; one task for each archive, as a header says where the next one is."""
    files = spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("archive"), kind_of(F.col("path")).alias("kind"), "length")

    def opened(row: tuple) -> io.RawIOBase:
        from pyarrow import fs

        whole = row[0] if "://" in row[0] else "file://" + row[0].removeprefix("file:")
        store, path = fs.FileSystem.from_uri(quote(whole, safe=":/@"))
        file = store.open_input_file(path)

        def read_at(offset: int, size: int) -> bytes:
            return file.read_at(size, offset)

        return Ranges(read_at, row[2])

    return _table(files.repartition("archive"), opened, verify)


def landing(name: Column, flat: bool = False) -> Column:
    """The relative path that a member is unpacked to; null for one that may not be: an absolute path, or one with "..".

    ``flat``: by its last part alone, in which case folders don't matter."""
    parts = F.filter(F.split(name, "/"), lambda p: (p != "") & (p != "."))
    if flat:
        last = F.try_element_at(parts, F.lit(-1))
        return F.when(last != "..", last)
    whole = F.when(F.size(parts) == 0, ".").otherwise(F.array_join(parts, "/"))
    return F.when(~F.startswith(name, F.lit("/")) & ~F.array_contains(parts, ".."), whole)


def landed(table: DataFrame, flat: bool = False) -> DataFrame:
    """Members with ``landing``; an archive's error has none."""
    return table.withColumn("landing", F.when(F.col("error").isNull(), landing(F.col("name"), flat)))


def refused(table: DataFrame, flat: bool = False) -> DataFrame:
    """Members that would leave the folder they are unpacked to."""
    return landed(table, flat).where("error is null and landing is null").drop("landing")


def clashes(table: DataFrame, by: list[str], flat: bool = False) -> DataFrame:
    """(by, landing, n, archives): paths that several members of the archives of one group would be unpacked to, of which
    each would replace the one before. Must be none."""
    found = landed(table, flat).where("landing is not null").groupBy(*by, "landing").agg(F.count("*").alias("n"), F.count_distinct("archive").alias("archives"))
    return found.where("n > 1")


def require_safe(table: DataFrame, by: list[str], flat: bool = False) -> None:
    """Refuses archives that can't be read and names that two members share. Members that may not be unpacked are left out."""
    broken = table.where("error is not null").orderBy("archive").take(3)
    if broken:
        raise ValueError(f"unreadable archives: {[(r.archive, r.error) for r in broken]}")
    shared = clashes(table, by, flat).orderBy("landing").take(3)
    if shared:
        raise ValueError(f"several members are unpacked to one path: {[tuple(r) for r in shared]}")
