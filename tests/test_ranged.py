"""The FITS data source: what it reads of a file, how it cuts one, which filters reach it."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual
from test_files import card, fits_bytes, header

from nightframes.sources import fits, ranged


class Counting:
    """A file that counts the bytes read from it."""

    def __init__(self, path):
        self.file, self.bytes = open(path, "rb"), 0

    def seek(self, at):
        self.file.seek(at)

    def read(self, n):
        found = self.file.read(n)
        self.bytes += len(found)
        return found


def cube_file(path, planes=3, height=20, width=50):
    data = np.arange(planes * height * width, dtype="i4").reshape(planes, height, width)
    path.write_bytes(fits_bytes(data, [card("OBJECT", "M 31")]))
    return data


@pytest.fixture
def giant(tmp_path):
    """A file of 6 GB that takes no room on the disk: three planes of 2 GB, mostly zeros, and a second unit."""
    width, height = 20_000, 25_000
    head = header(
        [card("SIMPLE", True), card("BITPIX", 32), card("NAXIS", 3), card("NAXIS1", width), card("NAXIS2", height)]
        + [card("NAXIS3", 3), card("OBJECT", "big")]
    )
    size = 3 * width * height * 4
    path = str(tmp_path / "giant.fits")
    with open(path, "wb") as f:
        f.write(head)
        f.seek(len(head) + (height + 7) * width * 4)  # plane 1, line 7
        f.write(np.arange(width, dtype=">i4").tobytes())
        f.seek(len(head) + -(-size // 2880) * 2880)
        f.write(fits_bytes(np.ones((2, 2), dtype="i2"), first="XTENSION"))
    return path


def test_headers_are_all_that_a_catalog_reads(giant):
    length = os.path.getsize(giant)
    assert length > 6e9
    file = Counting(giant)
    units = [u for b in ranged.unit_batches(giant, file, length) for u in b.to_pylist()]
    assert [(u["hdu"], u["axes"], u["complete"]) for u in units] == [(0, [20_000, 25_000, 3], True), (1, [2, 2], True)]
    assert file.bytes <= 2 * ranged.HEADER_BLOCKS * ranged.BLOCK
    file = Counting(giant)
    cards = [c for b in ranged.card_batches(giant, file, length) for c in b.column("card").to_pylist()]
    assert len(cards) == 7 and cards[-1].startswith("OBJECT")
    assert file.bytes <= ranged.HEADER_BLOCKS * ranged.BLOCK


def test_one_line_of_a_giant_file(spark, giant):
    lines = fits.decoded_lines(spark, [giant])
    assert lines.filter("plane = 1 and y = 7").rdd.getNumPartitions() > 80
    found = lines.filter("plane = 1 and y = 7").collect()
    assert len(found) == 1 and found[0]["samples"] == list(range(20_000))
    catalog = fits.frames(spark, [giant]).first()
    assert (catalog["width"], catalog["height"], catalog["planes"], catalog["object"]) == (20_000, 25_000, 3, "big")


def test_a_plane_is_one_stretch_of_the_file(tmp_path):
    path = tmp_path / "cube.fits"
    data = cube_file(path)
    length = path.stat().st_size
    for bounds, lines in (({"plane": (1, 1)}, 20), ({"plane": (2, 2), "y": (3, 4)}, 2), ({"y": (0, 0)}, 3), ({}, 60)):
        file = Counting(str(path))
        rows = [r for b in ranged.line_batches("p", file, length, 0, length, bounds) for r in b.to_pylist()]
        assert len(rows) == lines
        assert all(r["samples"] == data[r["plane"], r["y"]].tolist() for r in rows)
        header_bytes = ranged.HEADER_BLOCKS * ranged.BLOCK
        assert file.bytes <= header_bytes + lines * 50 * 4


@pytest.mark.parametrize("split", [100, 2880, 5000, 1 << 20])
def test_splits_hold_every_line_once(spark, tmp_path, split):
    data = cube_file(tmp_path / "cube.fits", height=9, width=31)
    (tmp_path / "empty.fits").write_bytes(b"")
    (tmp_path / "cut.fits").write_bytes(fits_bytes(np.zeros((100, 100), dtype="f8"))[:9000])
    lines = fits.decoded_lines(spark, [str(tmp_path)], split_bytes=split)
    if split < 5000:
        assert lines.rdd.getNumPartitions() > 2
    rows = lines.collect()
    whole = sorted((r["plane"], r["y"], r["samples"]) for r in rows if r["error"] is None)
    assert whole == [(p, y, data[p, y].tolist()) for p in range(3) for y in range(9)]
    errors = sorted((r["path"].rsplit("/", 1)[-1], r["error"][:12]) for r in rows if r["error"])
    assert [e[0] for e in errors] == ["cut.fits", "empty.fits"]


def test_filters_reach_the_files(spark, tmp_path):
    data = cube_file(tmp_path / "a.fits")
    cube_file(tmp_path / "b.fits", planes=1, height=3, width=4)
    lines = fits.decoded_lines(spark, [str(tmp_path)])
    got = lines.filter("plane = 2 and y >= 18")
    assert sorted((r["y"], r["samples"]) for r in got.collect()) == [(y, data[2, y].tolist()) for y in (18, 19)]
    assert lines.filter("plane > 0 and plane < 2 and y <= 1 and y > 0").count() == 1
    assert lines.filter("plane is null").count() == 0
    assert lines.filter("plane = 1 or y = 0").count() == 23
    path = lines.filter("path like '%b.fits'").first()["path"]
    assert lines.filter(F.col("path") == path).count() == 3
    assert lines.filter(F.col("path").isin(path, "other")).count() == 3


def test_filters_that_stay_with_spark():
    reader = ranged.FitsReader("lines", [], 1)
    taken = [EqualTo(("plane",), 2), GreaterThan(("y",), 4), LessThanOrEqual(("y",), 9), In(("path",), ("a", "b"))]
    left = [IsNotNull(("plane",)), EqualTo(("error",), "x"), In(("y",), (1, 2))]
    assert list(reader.pushFilters([*taken, *left])) == left
    assert reader.bounds == {"plane": (2, 2), "y": (5, 9)} and reader.names == {"a", "b"}


def test_names_patterns_and_missing_paths(spark, tmp_path):
    cube_file(tmp_path / "a.fits")
    cube_file(tmp_path / "b.fit")
    (tmp_path / "_hidden.fits").write_bytes(b"x")
    whole = [p.rsplit("/", 1)[-1] for p, _ in ranged.listed([str(tmp_path), f"file:{tmp_path}/a.fits"])]
    assert whole == ["a.fits", "b.fit"]
    assert [p for p, _ in ranged.listed([f"{tmp_path}/*.fit"])] == [f"file:{tmp_path}/b.fit"]
    with pytest.raises(FileNotFoundError):
        ranged.listed([f"{tmp_path}/gone.fits"])
    # the same names as the listing through Spark
    listing = {r["path"] for r in fits.scan_directory(spark, str(tmp_path)).collect()}
    assert {p for p, _ in ranged.listed([str(tmp_path)])} <= listing
