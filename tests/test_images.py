import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import rasters
from tessera.sources import images, readers, sinks


def decoded(data):
    """The array of an 8-bit RGB PNG without filters."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, body, size = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + part)
        size = struct.unpack(">II", part[:8]) if kind == b"IHDR" else size
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(size[1], -1)  # checks the sum of all
    assert (raw[:, 0] == 0).all()
    return raw[:, 1:].reshape(size[1], size[0], 3)


def from_tiff(data):
    """The array of a strip-wise deflated TIFF, classic or large."""
    big = struct.unpack("<H", data[2:4])[0] == 43
    at, n, w = (struct.unpack("<Q", data[8:16])[0], "Q", 20) if big else (struct.unpack("<I", data[4:8])[0], "H", 12)
    many = struct.unpack_from("<" + n, data, at)[0]
    tags, at = {}, at + struct.calcsize(n)
    for i in range(many):
        tag, kind = struct.unpack_from("<HH", data, at + w * i)
        count = struct.unpack_from("<Q" if big else "<I", data, at + w * i + 4)[0]
        f, where = {3: "H", 4: "I", 16: "Q"}[kind], at + w * i + (12 if big else 8)
        if struct.calcsize(f"<{count}{f}") > (8 if big else 4):
            where = struct.unpack_from("<Q" if big else "<I", data, where)[0]
        tags[tag] = struct.unpack_from(f"<{count}{f}", data, where)
    raw = b"".join(zlib.decompress(data[a : a + b]) for a, b in zip(tags[273], tags[279]))
    assert tags[259] == (8,) and tags[258] == (8, 8, 8)
    return np.frombuffer(raw, np.uint8).reshape(tags[257][0], tags[256][0], 3)


@pytest.fixture(scope="module")
def cells(spark):
    df = spark.range(900).select((F.col("id") * 7 % 61 - 9).alias("px"), (F.col("id") * 11 % 37 + 4).alias("py"), *((F.col("id") % n / float(n)).alias(c) for n, c in ((7, "r"), (5, "g"), (3, "b"))))
    return df.dropDuplicates(["px", "py"]).filter("px < 10 OR px > 30").persist()


@pytest.mark.parametrize("at_once", [1, 90, 1 << 20])
@pytest.mark.parametrize(("origin", "transpose"), [("upper", False), ("lower", False), ("upper", True)])
def test_strips_are_the_image(spark, cells, tmp_path, at_once, origin, transpose):
    """Strips of any height, also such without cells, in both formats: what the driver would paint."""
    want = rasters.oriented(rasters.image(cells, (0.2, 0.4, 0.6), origin=origin), transpose)
    for name, read in (("a.png", decoded), ("a.tif", from_tiff)):
        images.write(cells, str(tmp_path / name), (0.2, 0.4, 0.6), origin, transpose, at_once)
        assert (read((tmp_path / name).read_bytes()) == want).all()


def test_large_offsets_and_no_cells(spark, cells, tmp_path, monkeypatch):
    monkeypatch.setattr(images, "SHORT", 100)
    images.write(cells, str(tmp_path / "b.tiff"), cells_at_once=200)
    assert (from_tiff((tmp_path / "b.tiff").read_bytes()) == rasters.image(cells)).all()
    images.write(cells.limit(0), str(tmp_path / "none.png"))
    assert decoded((tmp_path / "none.png").read_bytes()).shape == (1, 1, 3)


def test_an_image_that_the_driver_could_not_hold(spark, tmp_path):
    """Above the area that an array on the driver was refused at."""
    far = spark.createDataFrame([(0, 0, 1.0, 0.0, 0.0), (8191, 8999, 0.0, 1.0, 0.0)], "px long, py long, r double, g double, b double")
    with pytest.raises(ValueError):
        rasters.image(far)
    images.write(far, str(tmp_path / "far.png"), cells_at_once=1 << 22)
    data = (tmp_path / "far.png").read_bytes()
    assert struct.unpack(">II", data[16:24]) == (9000, 8192) and len(data) < 1 << 20


def test_checksum_of_joined_texts():
    a, b = b"spatial" * 999, bytes(range(256)) * 40
    assert images.joined_checksum(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)
    assert images.joined_checksum(1, zlib.adler32(a), len(a)) == zlib.adler32(a)


def test_extent_of_a_written_image(spark, cells, tmp_path):
    images.write(cells, str(tmp_path / "c.tif"))
    h, w, _ = rasters.image(cells).shape
    assert tuple(readers.image_box(spark, str(tmp_path / "c.tif")).first()) == (0.0, w, 0.0, h)


def test_rings_are_nested():
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    rings = [square(4, 4, 2), square(0, 0, 10), square(2, 2, 6), square(20, 0, 5), square(20, 0, 2)]
    got = readers.polygons(sinks.geojson(rings, 3.5))
    assert sorted(len(p) for p in got) == [1, 2, 2] and readers.buffer_of(sinks.geojson(rings, 3.5)) == 3.5
    assert {(p[0][2], len(p)) for p in got} == {((10, 10), 2), ((6, 6), 1), ((25, 5), 2)}
    assert readers.buffer_of(sinks.geojson(rings)) == 0 and sinks.nested([]) == []
