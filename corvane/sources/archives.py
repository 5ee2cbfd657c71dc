"""Members of zip archives as input partitions: each is found in the archive's directory, read by one task, and held against its digest.

The directory at an archive's end says where members lie, so planning reads that alone; a member is unpacked as it is read, a block at a time. Up to ``TASKS`` members
have a task each; of more, neighbours in an archive share one, by size, so that tasks and readings of the directory don't grow with the number of members.
Its CRC is checked always, its SHA-256 where the manifest gives one; what doesn't match is an error that names archive and member, before the
member's last block leaves the task. A manifest may be a table of any size: it lies sorted in the shared folder, and each task reads its own members' digests from it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import dataset, fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .growing import open_folder
from .shared import shared_folder, written

FORMAT = "corvane_archive"
BLOCK = 1 << 20
#: Tasks that members are dealt over, about, and the most bytes of members that share one.
TASKS = 256
SHARED = 64 << 20
DIGESTS = pa.schema([(c, pa.string()) for c in ("archive", "member", "sha256")])


def named(archive: str) -> str:
    """What a manifest calls an archive: its file's name without ``.zip``."""
    return archive.rsplit("/", 1)[-1].removesuffix(".zip")


@dataclass
class Member:
    name: str
    size: int
    sha256: str | None


@dataclass
class Members(InputPartition):
    """Members of one archive that a task reads one after the other."""

    archive: str
    members: list[Member]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("archives need a path")
        self.uri, self.pattern, self.lines = options["path"], options.get("members", "*"), options.get("content", "lines") == "lines"
        self.manifest, self.told = json.loads(options.get("manifest", "{}")), options.get("digests")

    def digests(self) -> dataset.Dataset:
        """The table of the manifest."""
        store, path = open_folder(self.told)
        return dataset.dataset(path, DIGESTS, "parquet", store)

    def archives(self) -> list[str]:
        store, path = open_folder(self.uri)
        (info,) = store.get_file_info([path])
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no archive at {self.uri}")
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(".zip"))

    def partitions(self) -> list[Members]:
        store, _ = open_folder(self.uri)
        found, missing, there = {}, set(self.manifest), {}
        for a in self.archives():
            with store.open_input_file(a) as f:
                try:
                    members = zipfile.ZipFile(f).infolist()
                except zipfile.BadZipFile as e:
                    raise ValueError(f"{a} is no whole archive: {e}") from e
            names = {m.filename for m in members}
            missing -= names
            if self.told:
                there[named(a)] = there.get(named(a), set()) | names
            found[a] = [Member(m.filename, m.file_size, self.manifest.get(m.filename)) for m in members if not m.is_dir() and fnmatch(m.filename, self.pattern)]
        if self.told:
            for b in self.digests().to_batches(columns=["archive", "member"]):
                missing |= {m for a, m in zip(*(c.to_pylist() for c in b.columns), strict=True) if m not in there.get(a, ())}
                if missing:
                    break
        if missing:
            raise ValueError(f"no archive has the member {min(missing)} of the manifest")
        alone = sum(map(len, found.values())) <= TASKS
        # A member counts a kilobyte beside its bytes: many empty ones are work as well.
        most = min(SHARED, sum(m.size + 1024 for ms in found.values() for m in ms) // TASKS)
        out = []
        for a, members in found.items():
            room = 0
            for m in members:
                if alone or room <= 0:
                    out.append(Members(a, []))
                    room = most
                out[-1].members.append(m)
                room -= m.size + 1024
        return out

    def blocks(self, z: zipfile.ZipFile, archive: str, p: Member) -> Iterator[bytes]:
        """A member's bytes; the last of them only after its digests were right."""
        digest, held = hashlib.sha256(), b""
        try:
            with z.open(p.name) as m:
                while block := m.read(BLOCK):  # checks the CRC at the end
                    digest.update(block)
                    if held:
                        yield held
                    held = block
        except (zipfile.BadZipFile, EOFError, OSError, zlib.error) as e:
            raise ValueError(f"{archive}: member {p.name} is damaged: {e}") from e
        if p.sha256 and digest.hexdigest() != p.sha256.lower():
            raise ValueError(f"{archive}: member {p.name} has the digest {digest.hexdigest()}, not {p.sha256}")
        yield held

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        store, _ = open_folder(self.uri)
        if self.told:
            names, member = [m.name for m in partition.members], dataset.field("member")
            own = (dataset.field("archive") == named(partition.archive)) & (member >= min(names)) & (member <= max(names))
            told = dict(zip(*(c.to_pylist() for c in self.digests().to_table(["member", "sha256"], filter=own).columns), strict=True))
            for m in partition.members:
                m.sha256 = told.get(m.name)
        with store.open_input_file(partition.archive) as f, zipfile.ZipFile(f) as z:
            for m in partition.members:
                yield from self.rows(partition.archive, m, self.blocks(z, partition.archive, m))

    def rows(self, archive: str, member: Member, blocks: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        names = ["archive", "member", "place", "content"]
        row = lambda at, values: pa.RecordBatch.from_arrays([pa.array([archive] * len(values)), pa.array([member.name] * len(values)), pa.array(range(at, at + len(values)), pa.int64()), pa.array(values, pa.binary())], names)
        if not self.lines:
            yield row(0, [b"".join(blocks)])
            return
        rest, at = b"", 0
        for block in blocks:
            *whole, rest = (rest + block).split(b"\n")
            if whole:
                yield row(at, whole)
                at += len(whole)
        if rest:
            yield row(at, [rest])


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "archive string, member string, place long, content binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, members: str = "*", lines: bool = True, manifest: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """(archive, member, place, content) of the members whose names fit: a row a line, or one a member. ``manifest``: SHA-256 by member, or a table
    (archive, member, sha256) that names archives by their files without ``.zip``; all it names must be there."""
    spark.dataSource.register(Archives)
    reader = spark.read.format(FORMAT).option("members", members).option("content", "lines" if lines else "whole")
    if isinstance(manifest, DataFrame):
        at = f"{shared_folder(spark).rstrip('/')}/manifest-{uuid.uuid4().hex}"
        manifest.select(*DIGESTS.names).repartitionByRange("archive", "member").sortWithinPartitions("archive", "member").write.parquet(at)
        return reader.option("digests", at).load(path)
    return reader.option("manifest", json.dumps(manifest or {})).load(path)


def write_archives(members: DataFrame, path: str) -> DataFrame:
    """Writes (archive, member, content) as one zip file an archive into a folder, each by the task that has its members; returns (archive, member, sha256).

    An archive's members stream in order of their names and are written under another name first, so a task that is run again leaves no half archive.
    """
    rows = members.select("archive", "member", "content").repartition("archive").sortWithinPartitions("archive", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_folder(path)
        store.create_dir(folder, recursive=True)
        task, z, out, at = TaskContext.get().taskAttemptId(), None, None, None

        def close() -> None:
            z.close()
            out.close()
            store.move(f"{folder}/.{task}-{at}", f"{folder}/{at}.zip")

        for b in batches:
            names, digests = [[], []], []
            for archive, member, content in zip(*(b.column(c).to_pylist() for c in ("archive", "member", "content")), strict=True):
                if archive != at:
                    if z:
                        close()
                    at, out = archive, store.open_output_stream(f"{folder}/.{task}-{archive}")
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                z.writestr(zipfile.ZipInfo(member), content, zipfile.ZIP_DEFLATED)
                names[0].append(archive)
                names[1].append(member)
                digests.append(hashlib.sha256(content).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(names[0], pa.string()), pa.array(names[1], pa.string()), pa.array(digests, pa.string())], ["archive", "member", "sha256"])
        if z:
            close()

    return written(rows.mapInArrow(run, "archive string, member string, sha256 string"), "archived")  # read again, archives would be written again
