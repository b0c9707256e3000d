"""Embedded pictures by ranges of any size against one walk through the whole file."""

import random

import pytest

from imgspark.functions import kernels as K
from imgspark.operators import pictures
from imgspark.sources import byte_ranges


def picture(r, deep=0):
    """A picture with random segments, fill bytes and a scan; perhaps with another one in a segment."""
    out = b"\xff\xd8" + (b"\xff\xe0\x00\x04ab" if r.random() < 0.8 else b"\xff\x01")
    for _ in range(r.randrange(4)):
        inner = picture(r, deep + 1) if deep < 2 and r.random() < 0.5 else r.randbytes(r.randrange(30))
        out += b"\xff" * r.randrange(1, 3) + b"\xe1" + (len(inner) + 2).to_bytes(2) + inner
    if r.random() < 0.9:
        out += b"\xff\xc0\x00\x0b\x08" + r.randrange(1, 999).to_bytes(2) + r.randrange(1, 999).to_bytes(2) + b"\x01\0\0\0"
    if r.random() < 0.8:
        out += b"\xff\xda\x00\x04xy" + bytes(r.choice([0, 1, 0x5A]) for _ in range(r.randrange(60)))
    return out + b"\xff\xd9" * (r.random() < 0.8)


def blob(r):
    parts = [r.choice([picture(r), picture(r), r.randbytes(r.randrange(40)), b"\xff\xd8\xff", b"\xff\xd9", b"\xff" * r.randrange(5)]) for _ in range(r.randrange(8))]
    out = b"".join(parts)
    return out[: r.randrange(len(out) + 1)] if out and r.random() < 0.2 else out


def blobs(n, seed):
    r = random.Random(seed)
    out = {f"f{i:03d}": blob(r) for i in range(n)}
    wide = b"\xff\xd8\xff\xe1\xff\xff" + b"z" * 65533 + b"\xff\xc0\x00\x0b\x08\x00\x07\x00\x09\x01\0\0\0\xff\xda\x00\x04xy" + b"q" * 700 + b"\xff\xd9"
    return out | {"wide": b"\0\0" + wide + wide, "empty": b"", "end": b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x07\x00\x09\x01\0\0\0\xff\xd9"}


def walked(files):
    return sorted((k, *x) for k, v in files.items() for x in K.embedded_jpegs(v))


def found(spark, ranges, size):
    return sorted((r.path.rpartition("/")[2], r.start, r.end, r.width, r.height) for r in pictures.embedded_pictures(ranges, size).collect())


@pytest.mark.parametrize("size", [13, 64, 5000, 1 << 20])
def test_same_pictures_at_any_size_of_range(spark, size):
    files = blobs(150, 1)
    if size < 64:
        del files["wide"]  # thousands of ranges in one header
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()] + [("null", None)], "path string, content binary")
    want = walked(files)
    assert len(want) > 60
    assert found(spark, byte_ranges.ranges_of(df, size), size) == want


def test_files_are_read_in_ranges(spark, tmp_path):
    files = blobs(40, 2)
    for k, v in files.items():
        (tmp_path / k[:1]).mkdir(exist_ok=True)
        (tmp_path / k[:1] / k).write_bytes(v)
    ranges = byte_ranges.read_ranges(spark, str(tmp_path), 100)
    whole = {}
    for r in sorted(ranges.collect(), key=lambda r: (r.path, r.k)):
        name = r.path.rpartition("/")[2]
        assert r.start == r.k * 100 == len(whole.get(name, b"")) and r.length == len(files[name]) and len(r.content) == min(r.own + 9, r.length - r.start)
        whole[name] = whole.get(name, b"") + bytes(r.content[: r.own])
    assert whole == {k: v for k, v in files.items() if v}
    assert found(spark, ranges, 100) == walked(files)


def test_partitions_weigh_alike(tmp_path):
    for k, n in enumerate([10, 5000, 1, 0, 2500, 30, 30, 30]):
        (tmp_path / f"f{k}").write_bytes(b"x" * n)
    parts = byte_ranges.ByteRangesReader(str(tmp_path), 100, 1000).partitions()
    sizes = [sum(n for _, _, n, _ in p.pieces) for p in parts]
    assert max(sizes) == 10 and all(s == 10 for s in sizes[:-1]) and sum(sizes) == 80
    assert byte_ranges.ByteRangesReader(str(tmp_path / "none"), 100, 1000).folder
