"""ZIP archives as a source: a row per member, members dealt to tasks by their packed bytes and read by range.

The central directory at an archive's end gives each member's place and packed size. Reading it takes a few seeks, a task
an archive; members then go to tasks in runs of about task_bytes, so one archive of many gigabytes is read by many tasks
and a task reads its own range alone. A single member is one task, as deflated bytes can't be entered in the middle; it
is unpacked in parts, so its size doesn't matter.

Edge cases: folders are no members; members of one name are separate rows; a member that is encrypted, packed by other
methods than store and deflate, cut short, or that differs from the directory in size or CRC is not `intact` and has no
digest; an empty archive has no rows; a file that is no archive fails the read.
"""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from hashlib import sha256
from itertools import islice

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.tables import stored
from .files import CHUNK, opened

DIRECTORY = "archive string, member string, bytes long, packed long, method int, encrypted boolean, crc long, header_at long, safe boolean"
MEMBERS = "archive string, member string, bytes long, header_at long, safe boolean, intact boolean, found string"
EXTRACTED = "name string, archive string, member string, bytes long, state string"
#: Fixed by the format: a local header is 30 bytes, with the lengths of name and extra field in its last four.
LOCAL_HEADER, LOCAL_BYTES = b"PK\x03\x04", 30


class Damaged(Exception):
    """A member that can't be read as the directory says."""


class Seekable(io.RawIOBase):
    """A stream of Arrow's as Python's own: seeking before the start is an OSError, by which zipfile knows short files."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        return self.stream.readinto(buffer)

    def tell(self) -> int:
        return self.stream.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            return self.stream.seek(offset, whence)
        except ValueError as e:
            raise OSError(str(e)) from e


def directory(files: DataFrame) -> DataFrame:
    """A row per member of the archives of an inventory, from central directories alone.

    A member is not safe if its path is absolute, names a drive or leads upwards.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with opened(path) as f, zipfile.ZipFile(Seekable(f)) as z:
                    rows = []
                    for m in z.infolist():
                        inside = m.filename.replace("\\", "/")
                        safe = not inside.startswith("/") and ".." not in inside.split("/") and ":" not in inside
                        if not m.is_dir():
                            rows.append((path, inside, m.file_size, m.compress_size, m.compress_type, bool(m.flag_bits & 1), m.CRC, m.header_offset, safe))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in DIRECTORY.split(", ")])

    return files.select("path").mapInPandas(run, DIRECTORY)


def dealt(listing: DataFrame, task_bytes: int) -> DataFrame:
    """The listing with members of one archive in runs of about task_bytes, a run to a task, in the archive's order."""
    along = Window.partitionBy("archive").orderBy("header_at").rowsBetween(Window.unboundedPreceding, -1)
    # A seek counts as 64 kB, so that very many tiny members are dealt as well.
    cost = F.col("packed") + 65_536
    rows = stored(listing.withColumn("run", F.floor(F.coalesce(F.sum(cost).over(along), F.lit(0)) / task_bytes)), "directory")
    runs = rows.select("archive", "run").distinct()
    number = runs.groupBy("archive").agg(F.max("run").alias("last"))
    # One row per archive.
    before = Window.orderBy("archive").rowsBetween(Window.unboundedPreceding, -1)
    base = number.select("archive", F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("base"))
    tasks = number.agg(F.sum(F.col("last") + 1)).first()[0] or 1
    numbered = rows.join(base, "archive").withColumn("task", (F.col("base") + F.col("run")).cast("int"))
    return numbered.repartitionById(int(tasks), "task").sortWithinPartitions("archive", "header_at").drop("run", "base", "task")


def parts_of(stream, m) -> Iterator[bytes]:
    """The unpacked bytes of a member of the directory, in parts of at most CHUNK, checked against the directory."""
    if m.encrypted or m.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise Damaged(f"{m.member} is encrypted or packed by method {m.method}")
    stream.seek(m.header_at)
    head = stream.read(LOCAL_BYTES)
    if len(head) < LOCAL_BYTES or not head.startswith(LOCAL_HEADER):
        raise Damaged(f"{m.member} has no header at {m.header_at}")
    stream.seek(m.header_at + LOCAL_BYTES + sum(struct.unpack("<HH", head[-4:])))
    inflate = zlib.decompressobj(-15) if m.method == zipfile.ZIP_DEFLATED else None
    left, size, crc = m.packed, 0, 0
    while left:
        packed = stream.read(min(CHUNK, left))
        if not packed:
            raise Damaged(f"{m.member} is cut short")
        left -= len(packed)
        while packed:
            try:
                part = inflate.decompress(packed, CHUNK) if inflate else packed
            except zlib.error as e:
                raise Damaged(f"{m.member}: {e}") from e
            packed = inflate.unconsumed_tail if inflate else b""
            size, crc = size + len(part), zlib.crc32(part, crc)
            if size > m.bytes:
                raise Damaged(f"{m.member} is longer than the directory says")
            if part:
                yield part
    if inflate and (part := inflate.flush()):
        size, crc = size + len(part), zlib.crc32(part, crc)
        yield part
    if (size, crc) != (m.bytes, m.crc):
        raise Damaged(f"{m.member} differs from the directory in size or CRC")


def streams(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(stream of the archive, member) of each row; an archive stays open over the rows that follow each other."""
    path, stream = None, None
    try:
        for batch in batches:
            for m in batch.itertuples(index=False):
                if m.archive != path:
                    if stream is not None:
                        stream.close()
                    path, stream = m.archive, opened(m.archive)
                yield stream, m
    finally:
        if stream is not None:
            stream.close()


def framed(rows: Iterator[tuple], schema: str, size: int = 1000) -> Iterator[pd.DataFrame]:
    """Rows as tables of at most `size` of them; a table costs far more than a row."""
    names = [c.split()[0] for c in schema.split(", ")]
    while part := list(islice(rows, size)):
        yield pd.DataFrame(part, columns=names)


def archive_members(files: DataFrame, task_bytes: int = 64 << 20) -> DataFrame:
    """archive (its path), member, bytes, header_at, safe, intact and found (SHA-256) of every member of the archives of
    an inventory."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for stream, m in streams(batches):
            digest, intact = sha256(), True
            try:
                for part in parts_of(stream, m):
                    digest.update(part)
            except Damaged:
                intact = False
            yield m.archive, m.member, m.bytes, m.header_at, m.safe, intact, digest.hexdigest() if intact else None

    return dealt(directory(files), task_bytes).mapInPandas(lambda batches: framed(read(batches), MEMBERS), MEMBERS)


def archive_lines(files: DataFrame, member: str, task_bytes: int = 64 << 20, rows: int = 10_000) -> DataFrame:
    """archive, member, line_no (from 0) and line of the safe members whose path matches the pattern `member`, UTF-8 text.

    Lines end by LF or CRLF; an end after the last line adds none. A damaged member fails the read. The result goes to
    from_csv or any text function, so a CSV in an archive is read without unpacking it to disk.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for stream, m in streams(batches):
            rest, at, lines = [], 0, []

            def table(lines: list[bytes], at: int, m=m) -> pd.DataFrame:
                text = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines]
                return pd.DataFrame({"archive": m.archive, "member": m.member, "line_no": range(at, at + len(lines)), "line": text})

            for part in parts_of(stream, m):
                for offset in range(0, len(part), 1 << 20):
                    *whole, last = part[offset : offset + (1 << 20)].split(b"\n")
                    if whole:
                        lines += [b"".join([*rest, whole[0]]), *whole[1:]]
                        rest = []
                    rest.append(last)
                    while len(lines) >= rows:
                        yield table(lines[:rows], at)
                        lines, at = lines[rows:], at + rows
            if any(rest):
                lines.append(b"".join(rest))
            if lines:
                yield table(lines, at)

    listing = directory(files).where(F.col("safe") & F.col("member").rlike(member))
    return dealt(listing, task_bytes).mapInPandas(run, "archive string, member string, line_no long, line string")


def match_members(members: DataFrame, manifest: DataFrame, ignored: str = "SHA256SUMS.txt") -> DataFrame:
    """name, archive, member, state of every name of the manifest and every member without one.

    A safe member matches the one name that is its path or its path without the first folder; with both in the manifest
    it matches neither. Names: ok, differs, broken (not intact), listed (of `directory`, which has no digests), missing,
    ambiguous (several members) or invalid (in the manifest). Members without a name: unlisted or unsafe; files called
    `ignored` are left out.
    """
    read = "found" in members.columns
    m = members.select("archive", "member", "header_at", "safe", *(("found", "intact") if read else (F.lit(None).cast("string").alias("found"), F.lit(True).alias("intact"))))
    names = F.array_distinct(F.array(F.col("member"), F.regexp_replace("member", "^[^/]+/", "")))
    hits = m.where("safe").withColumn("name", F.explode(names)).join(manifest.select("name", "digest"), "name")
    of_one = hits.groupBy("archive", "header_at").agg(F.count("*").alias("names"), *(F.any_value(c).alias(c) for c in ("name", "member", "digest", "found", "intact"))).where("names = 1")
    of_one = stored(of_one, "matches")
    same = F.when(~F.col("intact"), "broken").when(F.col("found") == F.col("digest"), "ok").when(F.col("found").isNull(), "listed").otherwise("differs")
    per_name = of_one.groupBy("name").agg(F.count("*").alias("members"), F.min(F.struct("archive", "header_at", "member", same.alias("same"))).alias("m"))
    state = F.when(~F.col("valid"), "invalid").when(F.col("members").isNull(), "missing").when(F.col("members") > 1, "ambiguous").otherwise(F.col("m.same"))
    rows = manifest.select("name", "valid").join(per_name, "name", "left").select("name", "m.archive", "m.member", state.alias("state"))
    other = m.join(of_one.select("archive", "header_at"), ["archive", "header_at"], "left_anti").where(F.regexp_extract("member", r"([^/]*)$", 1) != ignored)
    rest = other.select(F.lit(None).cast("string").alias("name"), "archive", "member", F.when(F.col("safe"), "unlisted").otherwise("unsafe").alias("state"))
    return rows.unionByName(rest)


def extract_verified(files: DataFrame, manifest: DataFrame, folder: str, task_bytes: int = 64 << 20) -> DataFrame:
    """Writes the manifest's files below folder and returns name, archive, member, bytes, state (ok, differs, broken).

    Nothing is written unless every name has one member and every member a name: else a ValueError tells counts by state.
    A member is hashed as it is unpacked into a file of another name, which takes its own name if the digest is right
    and goes if not; so a lost task leaves no half file under a right name, and its next attempt replaces what is there.
    """
    listing = stored(directory(files), "listing")
    matched = stored(match_members(listing, manifest), "matched")
    odd = {r["state"]: r["count"] for r in matched.where("state <> 'listed'").groupBy("state").count().collect()}
    if odd:
        raise ValueError(f"archives and manifest differ: {odd}")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        system, top = pyarrow.fs.FileSystem.from_uri(folder)
        for stream, m in streams(batches):
            path = f"{top.rstrip('/')}/{m.name}"
            partial = f"{path}.{uuid.uuid4().hex}.partial"
            system.create_dir(path.rpartition("/")[0], recursive=True)
            digest, state = sha256(), None
            with system.open_output_stream(partial) as out:
                try:
                    for part in parts_of(stream, m):
                        digest.update(part)
                        out.write(part)
                except Damaged:
                    state = "broken"
            state = state or ("ok" if digest.hexdigest() == m.digest else "differs")
            if state == "ok":
                system.move(partial, path)
            else:
                system.delete_file(partial)
            yield m.name, m.archive, m.member, m.bytes, state

    wanted = listing.join(matched.select("name", "archive", "member"), ["archive", "member"]).join(manifest.select("name", "digest"), "name")
    return stored(dealt(wanted, task_bytes).mapInPandas(lambda batches: framed(write(batches), EXTRACTED), EXTRACTED), "extracted")
