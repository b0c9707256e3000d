"""Archives of many tasks, opened by zipfile; the writer of files under failing tasks; running sums."""

import hashlib
import os
import random
import subprocess
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from imgspark.operators.scan import prefix_sums
from imgspark.sources import archives, byte_files

SCHEMA = "image_id long, job_id long, name string, seq long, content binary"


def rows(jobs, each, seed=3):
    r = random.Random(seed)
    out = [(1000 * j + i, j, f"é{r.randrange(each)}.png", 1000 * j + i, r.randbytes(r.randrange(400)) * r.choice([1, 3])) for j in range(jobs) for i in range(each)]
    return [*out, (7, 0, "empty", 10**6, b""), (8, 0, "null", 10**6, None), (9, 0, None, 1, b"x"), (10, None, "n", 1, b"x"), (11, 0, "", 1, b"x")]


def last(table):
    kept = {}
    for _, job, name, seq, content in table:
        if job is not None and name and (job not in kept or name not in kept[job] or kept[job][name][0] < seq):
            kept.setdefault(job, {})[name] = (seq, content or b"")
    return {j: [(n, c) for n, (s, c) in sorted(x.items(), key=lambda x: (x[1][0], x[0]))] for j, x in kept.items()}


@pytest.mark.parametrize("deflate,limit", [(True, archives.LIMIT), (False, archives.LIMIT), (True, 900), (True, 0)])
def test_archives_open_and_hold_the_last_of_equal_names(spark, tmp_path, deflate, limit):
    table = rows(3, 40)
    archives.write_archives(spark.createDataFrame(table, SCHEMA).repartition(5), str(tmp_path), "pics", "2026-01-02", deflate, limit)
    want = last(table)
    assert sorted(os.listdir(tmp_path)) == ["0", "1", "2"]
    for job, entries in want.items():
        with zipfile.ZipFile(tmp_path / str(job) / "pics-export-2026-01-02.zip") as z:
            assert z.testzip() is None
            assert [(i.filename, z.read(i)) for i in z.infolist()] == entries
            assert all(i.date_time[:3] == (2026, 1, 2) for i in z.infolist())
            assert {i.compress_type for i in z.infolist() if i.file_size} == {8 if deflate else 0}


def test_read_entries_meet_their_places(spark):
    table = rows(2, 30)
    laid, _ = archives.laid_out(spark.createDataFrame(table, SCHEMA), "2026-01-02")
    found = archives.read_entries(laid).collect()
    by = {k: {(r.job_id, r.name): (r["at"], r.crc, r["size"]) for r in found if r.kind == k} for k in ("local", "directory")}
    assert by["local"] == by["directory"] and len(by["local"]) == sum(map(len, last(table).values()))
    assert {(r.job_id, r.name): r.sha256 for r in found if r.kind == "local"} == {(j, n): hashlib.sha256(c).hexdigest() for j, x in last(table).items() for n, c in x}
    damaged = laid.filter("substring(content, 1, 4) = X'504B0304'").withColumn("content", F.expr("concat(substring(content, 1, length(content) - 1), X'00')")).limit(40)
    with pytest.raises(Exception, match="damaged|zlib|decompress"):
        archives.read_entries(damaged).collect()


def test_no_rows_no_archives(spark, tmp_path):
    archives.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path), "pics", "2026-01-02")
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []


def test_files_of_several_rows_and_modes(spark, tmp_path):
    at = str(tmp_path / "out")
    df = spark.createDataFrame([("a/x", b"1"), ("a/x", b"23"), ("b", None)], "path string, content binary").coalesce(1)
    byte_files.save(df, at)
    byte_files.save(df.filter("path = 'b'").withColumn("content", F.lit(b"new")), "file:" + at)
    read = lambda: {str(p.relative_to(at)): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert read() == {"a/x": b"123", "b": b"new"}
    byte_files.save(df.filter("path = 'b'"), at, "overwrite")
    assert read() == {"b": b""}
    for bad in ("../x", "/x", "a//b", "", None, "."):
        with pytest.raises(Exception, match="not a file below"):
            byte_files.save(spark.createDataFrame([("fine", b"1"), (bad, b"1")], "path string, content binary").coalesce(1), at)
    assert read() == {"b": b""} and not [p for p in os.listdir(at) if p.startswith("_staging")]


RETRY = """
import sys
sys.path.insert(0, {root!r})
from pyspark import TaskContext
from pyspark.sql import SparkSession
from imgspark.sources import byte_files
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()
def flaky(batches):
    for k, b in enumerate(batches):
        yield b
        if TaskContext.get().attemptNumber() < {fails} and TaskContext.get().partitionId() == 1:
            raise RuntimeError("lost on purpose")
rows = spark.range(0, 3000, 1, 3).selectExpr("concat('d', id % 7, '/f', id) AS path", "cast(cast(id AS string) AS binary) AS content")
spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
try:
    byte_files.save(rows.mapInArrow(flaky, rows.schema), {at!r})
    print("saved")
except Exception as e:
    print("failed")
"""


@pytest.mark.parametrize("fails,says", [(1, "saved"), (9, "failed")])
def test_tasks_that_fail_leave_each_file_once_or_nothing(tmp_path, fails, says):
    at, root = str(tmp_path / "out"), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", RETRY.format(root=root, at=at, fails=fails)], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": root})
    assert done.stdout.split()[-1:] == [says], done.stderr[-2000:]
    files = {str(p.relative_to(at)): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert files == ({f"d{i % 7}/f{i}": str(i) for i in range(3000)} if says == "saved" else {})
    assert not os.path.exists(at) or not [p for p in os.listdir(at) if p.startswith("_staging")]


def test_prefix_sums_split_a_hot_group(spark):
    r = random.Random(1)
    table = [(None if g < 0 else g, i, r.randrange(-5, 100)) for i, g in enumerate([1] * 700 + [2] * 30 + [3] + [-1] * 40)]
    r.shuffle(table)
    got = prefix_sums(spark.createDataFrame(table, "g long, i long, n long").repartition(4), "g", ["i"], {"before": "n", "place": "i"}).collect()
    assert len(got) == len(table)
    sums = {}
    for g, i, n in sorted(table, key=lambda x: x[1]):
        sums[g, i] = sum(sums.get((g, "n"), [])), sum(sums.get((g, "i"), []))
        sums.setdefault((g, "n"), []).append(n)
        sums.setdefault((g, "i"), []).append(i)
    assert all((x.before, x.place) == sums[x.g, x.i] for x in got)


def test_a_new_folder_goes_into_place_in_one_move(tmp_path, monkeypatch):
    import pyarrow as pa

    moved = []

    class Counted:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def move(self, source, target):
            moved.append(target)
            self.fs.move(source, target)

    opened = byte_files.opened
    monkeypatch.setattr(byte_files, "opened", lambda folder: (Counted(opened(folder)[0]), opened(folder)[1]))
    rows = lambda names: iter([pa.record_batch([pa.array(names), pa.array([n.encode() for n in names], pa.binary())], names=["path", "content"])])
    writer = byte_files.ByteFilesWriter(str(tmp_path), False)
    writer.commit([writer.write(rows([f"a/b/{i}" for i in range(50)])), writer.write(rows(["a/b/x", "c/y", "z"]))])
    assert len(moved) == 4
    assert sorted(p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*") if p.is_file()) == sorted([*(f"a/b/{i}" for i in range(50)), "a/b/x", "c/y", "z"])
