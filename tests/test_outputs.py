"""Streams to several tables through failures, and archives with damaged members."""

from __future__ import annotations

import hashlib
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.plans import QUERIES
from corvane.sources import archives, recordings
from corvane.streaming import fanout

# --- one stream, several outputs -------------------------------------------------------------------------------------

OUTPUTS = {"all": lambda b: b.select("id"), "even": lambda b: b.where("id % 2 = 0").select("id"), "sums": lambda b: b.groupBy((F.col("id") % 3).alias("id")).count()}


def stream_of(spark, folder, rows):
    os.makedirs(folder, exist_ok=True)
    for k, r in enumerate(rows):
        spark.range(*r).coalesce(1).write.mode("ignore").parquet(f"{folder}/part={k}")
    return spark.readStream.schema("id long, part int").option("maxFilesPerTrigger", 1).parquet(folder)


def table(spark, root, name):
    return sorted((r.batch_id, r.id) for r in fanout.read_output(spark, root, name, "id long").collect())


def test_a_batch_is_in_every_table_once_through_failures(spark, tmp_path):
    """A write that fails between two tables, and a stop between the last table and the commit: the batch comes again and replaces what it left."""
    root, check, source = (str(tmp_path / n) for n in ("out", "check", "in"))
    rows = [(0, 10), (10, 25), (25, 31)]
    stream = stream_of(spark, source, rows)
    failing = OUTPUTS | {"even": lambda b: b.where("id % 2 = 0").select(F.when(F.col("id") == 12, F.raise_error(F.lit("no disk"))).otherwise(F.col("id")).cast("long").alias("id"))}
    with pytest.raises(Exception, match="no disk"):
        fanout.fan_out(stream, root, check, failing).awaitTermination()
    assert fanout.committed(spark, root) == [0]
    assert {b for b, _ in table(spark, root, "all")} == {0}  # the second batch's first table was written, and isn't read
    # Stop after the last table of batch 1, before its commit: write its tables as a try that died would leave them, with other rows.
    for name in OUTPUTS:
        spark.range(1000, 1003).write.mode("overwrite").parquet(f"{root}/{name}/batch_id=1")
    for _ in range(2):  # and once more, with nothing new
        fanout.fan_out(stream_of(spark, source, rows), root, check, OUTPUTS).awaitTermination()
        assert fanout.committed(spark, root) == [0, 1, 2]
        assert [i for _, i in table(spark, root, "all")] == list(range(31)) and [i for _, i in table(spark, root, "even")] == list(range(0, 31, 2))
        assert len(table(spark, root, "sums")) == 9
    # A replay of a committed batch leaves every table as it is.
    before = {n: table(spark, root, n) for n in OUTPUTS}
    fanout.write_batch(spark.range(500, 600), 1, root, OUTPUTS)
    assert before == {n: table(spark, root, n) for n in OUTPUTS}
    assert fanout.read_output(spark, str(tmp_path / "none"), "all", "id long").count() == 0
    with pytest.raises(ValueError, match="no name"):
        fanout.fan_out(stream, root, check, {"_commits": lambda b: b})


# --- archives --------------------------------------------------------------------------------------------------------


@pytest.fixture
def zips(tmp_path):
    """Two archives: text with and without a last line end, an empty member, a folder, bytes; one member of several blocks."""
    members = {"a/one.txt": b"first\nsecond\n\nlast", "a/two.txt": b"only\n", "empty.txt": b"", "raw.bin": bytes(range(256)) * 9000}
    for k, names in enumerate((["a/one.txt", "raw.bin"], ["a/two.txt", "empty.txt"])):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.mkdir("folder")
            for n in names:
                z.writestr(n, members[n])
    return str(tmp_path), members


def test_members_are_partitions_and_lines_are_whole(spark, zips):
    path, members = zips
    got = archives.read_archives(spark, path, "*.txt")
    lines = {(r.member, r.place): bytes(r.content) for r in got.collect()}
    assert lines == {("a/one.txt", 0): b"first", ("a/one.txt", 1): b"second", ("a/one.txt", 2): b"", ("a/one.txt", 3): b"last", ("a/two.txt", 0): b"only"}
    digests = {n: hashlib.sha256(c).hexdigest() for n, c in members.items()}
    whole = archives.read_archives(spark, path, lines=False, manifest=digests)
    assert whole.rdd.getNumPartitions() == 4 and {r.member: bytes(r.content) for r in whole.collect()} == members
    assert archives.read_archives(spark, f"{path}/0.zip", "raw.bin", lines=False).count() == 1


def test_damaged_members_are_errors_that_name_them(spark, zips, tmp_path):
    path, members = zips
    wrong = {"a/one.txt": "0" * 64}
    with pytest.raises(Exception, match="a/one.txt has the digest"):
        archives.read_archives(spark, path, "a/*", manifest=wrong).collect()
    with pytest.raises(Exception, match="member none of the manifest"):
        archives.read_archives(spark, path, manifest={"none": "0"}).collect()
    blob = bytearray(open(f"{path}/0.zip", "rb").read())
    with zipfile.ZipFile(f"{path}/0.zip") as z:
        info = z.getinfo("raw.bin")
    blob[info.header_offset + 30 + len("raw.bin") + info.compress_size // 2] ^= 0xFF
    open(f"{path}/0.zip", "wb").write(bytes(blob))
    with pytest.raises(Exception, match="member raw.bin is damaged"):
        archives.read_archives(spark, path, "*.bin", lines=False).collect()
    assert archives.read_archives(spark, path, "a/*").count() == 5  # members beside it are read
    open(f"{path}/0.zip", "wb").write(bytes(blob[: len(blob) // 2]))
    with pytest.raises(Exception, match="no whole archive"):
        archives.read_archives(spark, path).collect()


def test_written_archives_are_read_back(spark, tmp_path):
    at = str(tmp_path / "made")
    rows = [(f"z{i % 3}", f"m{i}", os.urandom(i * 100)) for i in range(20)]
    told = archives.write_archives(spark.createDataFrame(rows, "archive string, member string, content binary"), at)
    digests = {r.member: r.sha256 for r in told.collect()}
    back = archives.read_archives(spark, at, lines=False, manifest=digests)
    assert {(os.path.basename(r.archive)[:-4], r.member, bytes(r.content)) for r in back.collect()} == set(rows)
    assert sorted(os.listdir(at)) == ["z0.zip", "z1.zip", "z2.zip"]


def test_a_table_of_digests_is_held_against_every_member(spark, tmp_path):
    """Members of one name in two archives have their own digests; what isn't as told, or isn't there, is an error that names it."""
    at = str(tmp_path / "made")
    rows = [(f"z{i % 3}", f"m{i // 3}", os.urandom(i * 100)) for i in range(20)]
    told = archives.write_archives(spark.createDataFrame(rows, "archive string, member string, content binary"), at)
    back = archives.read_archives(spark, at, lines=False, manifest=told)
    assert {(os.path.basename(r.archive)[:-4], r.member, bytes(r.content)) for r in back.collect()} == set(rows)
    assert archives.read_archives(spark, at, lines=False, manifest=told.where("member = 'm1'")).count() == 20
    assert archives.read_archives(spark, at, lines=False, manifest=told.limit(0)).count() == 20
    wrong = told.withColumn("sha256", F.when(F.expr("archive = 'z1' and member = 'm2'"), "0" * 64).otherwise(F.col("sha256")))
    with pytest.raises(Exception, match="z1.zip: member m2 has the digest"):
        archives.read_archives(spark, at, manifest=wrong).collect()
    with pytest.raises(Exception, match="member m6 of the manifest"):
        archives.read_archives(spark, at, manifest=told.withColumn("archive", F.lit("z2"))).collect()


def test_archived_results_are_held_against_their_digests(spark, sf, monkeypatch):
    """A member that was written anew since, whole and with a right CRC, isn't what its digest tells."""

    def tampered(members, path):
        told = write(members, path)
        name = sorted(os.listdir(path))[0]
        with zipfile.ZipFile(f"{path}/{name}") as z:
            content = {n: z.read(n) for n in z.namelist()}
        changed = min(content)
        content[changed] = content[changed].replace(b'"value":', b'"value":1')
        with zipfile.ZipFile(f"{path}/{name}", "w", zipfile.ZIP_DEFLATED) as z:
            for n, c in content.items():
                z.writestr(n, c)
        return told

    write = archives.write_archives
    monkeypatch.setattr(archives, "write_archives", tampered)
    with pytest.raises(Exception, match="has the digest"):
        QUERIES["archived_results"](spark, sf).collect()


# --- recordings by segment -------------------------------------------------------------------------------------------


def test_parts_of_recordings_are_read_from_their_folders_alone(spark, tmp_path):
    at = str(tmp_path / "rec")
    rows = [(b, s, b * 1000 + s * 10 + k, s * 10 + k, 0.5) for b in (1, 2, 3) for s in (-1, 0, 1, 2, 5) for k in range(4)]
    recordings.write_recordings(spark.createDataFrame(rows, "bag long, segment long, frame long, ns long, value double"), at)
    recordings.disable(spark.createDataFrame([(3,)], "bag long"), at)
    wanted = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (1, 5), (2, -1), (3, 0), (9, 0)], "bag long, segment long")
    schema = "frame long, ns long, value double"
    got = recordings.read_segments(spark, at, wanted, schema)
    assert sorted({(r.bag, r.segment, r.stretch) for r in got.collect()}) == [(1, 0, 0), (1, 1, 0), (1, 5, 5), (2, -1, -1)] and got.count() == 16
    assert {r.bag for r in recordings.read_segments(spark, at, wanted, schema, with_disabled=True).collect()} == {1, 2, 3}
    assert "dynamicpruning" in got._jdf.queryExecution().toString().lower() and recordings.read_segments(spark, at, wanted.limit(0), schema).count() == 0
    got = {r.bag: (r.segments, r.first, r.last, r.disabled) for r in recordings.catalogue(spark, at).collect()}
    assert got == {"1": (5, -1, 5, False), "2": (5, -1, 5, False), "3": (5, -1, 5, True)}
    with pytest.raises(Exception, match="already exists"):
        recordings.write_recordings(spark.createDataFrame(rows, "bag long, segment long, frame long, ns long, value double"), at)
