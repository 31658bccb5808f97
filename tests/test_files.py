"""Real files written here with numpy: listing, cards, scanlines, analysis, streams."""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightframes.operators import incremental as N
from nightframes.operators import planes as P
from nightframes.operators import stats as A
from nightframes.sources import fits, ranged, tables
from nightframes.streaming import continuous as G

BITPIX = {"u1": 8, "i2": 16, "i4": 32, "i8": 64, "f4": -32, "f8": -64}


def card(name, value=None, comment=None):
    if value is None:
        return f"{name:<8}{comment or ''}".ljust(80)
    text = f"'{value:<8}'" if isinstance(value, str) else ("T" if value is True else str(value)).rjust(20)
    return (f"{name:<8}= {text}" + (f" / {comment}" if comment else "")).ljust(80)


def header(cards):
    text = "".join([*cards, "END".ljust(80)])
    return text.ljust(-(-len(text) // 2880) * 2880).encode("ascii")


def fits_bytes(data, extra=(), first="SIMPLE"):
    data = np.asarray(data)
    kind = data.dtype.str[1:]
    head = [card("SIMPLE", True) if first == "SIMPLE" else card("XTENSION", "IMAGE")]
    head += [card("BITPIX", BITPIX[kind]), card("NAXIS", data.ndim)]
    head += [card(f"NAXIS{i + 1}", n) for i, n in enumerate(reversed(data.shape))]
    body = data.astype(">" + kind).tobytes()
    return header([*head, *extra]) + body.ljust(-(-len(body) // 2880) * 2880, b"\0")


@pytest.fixture
def folder(tmp_path):
    ramp = np.arange(12, dtype="i2").reshape(3, 4)
    cube = np.arange(24, dtype="f4").reshape(3, 2, 4)
    night = [card("DATE-OBS", "2026-06-22T00:00:00"), card("OBJECT", "M 31 / it''s", "target"), card("HISTORY", comment="made here")]
    files = {
        "ramp.fit": fits_bytes(ramp, [*night, card("BZERO", 32768.0), card("BAYERPAT", "RGGB")]),
        "cube.FITS": fits_bytes(cube, [card("GAIN", 1.5)]),
        "second.fts": header([card("SIMPLE", True), card("BITPIX", 8), card("NAXIS", 0)]) + fits_bytes(ramp, first="XTENSION"),
        "tiled.fz": header([card("SIMPLE", True), card("BITPIX", 8), card("NAXIS", 0)])
        + header([card("XTENSION", "BINTABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", 8), card("NAXIS2", 1), card("PCOUNT", 0), card("GCOUNT", 1), card("ZIMAGE", True)])
        + bytes(2880),
        "cut.fits": fits_bytes(np.zeros((100, 100), dtype="f8"))[:9000],
        "notes.txt": b"not an image",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    os.mkdir(tmp_path / "deeper")
    (tmp_path / "deeper" / "hidden.fit").write_bytes(files["ramp.fit"])
    return str(tmp_path)


def names(df, column="path"):
    return sorted(r[column].rsplit("/", 1)[-1] for r in df.collect())


def test_directory_scan(spark, folder, capsys):
    found = fits.scan_directory(spark, folder)
    assert names(found) == ["cube.FITS", "cut.fits", "ramp.fit", "second.fts", "tiled.fz"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    assert fits.scan_directory(spark, folder + "/missing").count() == 0
    stamp = fits.file_stamps(found).filter("path like '%ramp.fit'").first()
    assert stamp["length"] == os.path.getsize(f"{folder}/ramp.fit") and stamp["stamp"] is not None


def test_input_expansion(spark, folder):
    got = fits.expand_inputs(spark, [folder], [f"{folder}/notes.txt", f"{folder}/gone.fit"])
    assert "notes.txt" in names(got) and len(names(got)) == 6
    assert fits.expand_inputs(spark, [], []).count() == 0


def test_units_and_cards(spark, folder):
    units = fits.image_units(spark, [f"{folder}/second.fts"]).orderBy("hdu").collect()
    assert [(u["hdu"], u["is_image"], u["axes"]) for u in units] == [(0, False, []), (1, True, [4, 3])]
    raw = [r["card"] for r in fits.raw_cards(spark, [f"{folder}/ramp.fit"]).orderBy("ord").collect()]
    assert raw[0] == "SIMPLE  =                    T" and raw[-1].startswith("BAYERPAT= 'RGGB")
    parsed = {r["name"]: r for r in fits.cards(spark, [f"{folder}/ramp.fit"]).collect()}
    assert (parsed["OBJECT"]["value"], parsed["OBJECT"]["comment"], parsed["OBJECT"]["vtype"]) == ("M 31 / it's", "target", "string")
    assert (parsed["BZERO"]["value"], parsed["BZERO"]["vtype"]) == ("32768.0", "number")
    assert (parsed["HISTORY"]["value"], parsed["HISTORY"]["comment"]) == (None, "made here")


def test_file_hash(spark, folder):
    got = fits.file_hash(spark, [f"{folder}/notes.txt"]).first()["sha256"]
    assert got == hashlib.sha256(b"not an image").hexdigest()


def ingested(spark, folder):
    paths = [f"{folder}/{n}" for n in ("ramp.fit", "cube.FITS", "second.fts", "tiled.fz", "cut.fits")]
    lines, frames = fits.decoded_lines(spark, paths), fits.frames(spark, paths)
    return lines, frames, fits.scanlines(lines, frames)


def test_samples_and_errors(spark, folder, monkeypatch):
    monkeypatch.setattr(ranged, "BATCH_SAMPLES", 8)
    lines, frames, scanlines = ingested(spark, folder)
    errors = {r["path"].rsplit("/", 1)[-1]: r["error"] for r in fits.read_errors(lines).collect()}
    assert set(errors) == {"tiled.fz", "cut.fits"} and "ends before" in errors["cut.fits"]
    cube = scanlines.filter("frame_id like '%cube.FITS'").orderBy("plane", "y").collect()
    assert [r["samples"] for r in cube] == np.arange(24.0).reshape(6, 4).tolist()
    assert {(r["planes"], r["sample_type"], r["axes"]) for r in cube} == {(3, "F32", 3)}
    ramp = P.physical_pixels(scanlines.filter("frame_id like '%ramp.fit'"))
    assert ramp.agg(F.min("v"), F.max("v")).first()[:] == (32768.0, 32779.0)
    stats = A.pixel_stats(P.explode_samples(scanlines.filter("frame_id like '%second.fts'"))).first()
    assert (stats["min"], stats["max"], stats["count"]) == (0, 11, 12)


@pytest.mark.parametrize("kind", sorted(BITPIX))
def test_sample_types_round_trip(spark, tmp_path, kind):
    values = np.array([[1, 2, 3], [100, 7, 0]], dtype=kind)
    (tmp_path / "a.fits").write_bytes(fits_bytes(values))
    lines = fits.decoded_lines(spark, [str(tmp_path / "a.fits")]).orderBy("y").collect()
    assert [r["samples"] for r in lines] == values.astype(float).tolist()


def test_analysis_of_files(spark, folder):
    lines, frames, scanlines = ingested(spark, folder)
    described = frames.withColumn("session_id", F.lit(1))
    out = N.analyze_frames(scanlines, described, read_errors=fits.read_errors(lines))
    status = {r["path"].rsplit("/", 1)[-1]: r["status"] for r in out.collect()}
    assert status["ramp.fit"] == "analyzed" and status["cube.FITS"] == status["second.fts"] == "skipped_no_date"
    assert status["tiled.fz"] == "error"
    # The cut file's header can be read; its data cannot, and that decides.
    assert status["cut.fits"] == "error"
    assert tuple(N.outcome_counts(out).first()) == (5, 1, 2, 2)


def test_tables_round_trip_and_refuse_to_overwrite(spark, folder, tmp_path):
    _, frames, scanlines = ingested(spark, folder)
    out = str(tmp_path / "lake")
    cards = fits.cards(spark, [f"{folder}/ramp.fit"]).withColumnRenamed("path", "frame_id")
    tables.write_frames(out, frames, cards, scanlines)
    back = tables.read_table(spark, out, "scanlines")
    assert back.count() == scanlines.count()
    with pytest.raises(Exception):
        tables.write_frames(out, frames, cards, scanlines)
    tables.write_frames(out, frames, cards, scanlines, overwrite=True)
    back = tables.read_table(spark, out, "scanlines")
    rgb = P.load_rgb(back.filter("sample_type = 'I16' and bayerpat is not null"))
    cube = str(tmp_path / "cube")
    tables.write_rgb16(cube, rgb, cards, history="debayered")
    stored = tables.read_table(spark, cube, "scanlines")
    assert stored.select("plane").distinct().count() == 3
    again = P.load_rgb(stored)
    assert again.first()["notice"] == "AlreadyDebayeredRgbCube"
    key = ["frame_id", "y", "x", "r", "g", "b"]
    assert sorted(map(str, again.select(key).collect())) == sorted(map(str, rgb.select(key).collect()))
    kept = {r["name"] for r in tables.read_table(spark, cube, "cards").collect()}
    assert "BAYERPAT" not in kept and {"OBJECT", "BZERO", "HISTORY"} <= kept


def test_arriving_files_are_analysed_once(spark, tmp_path):
    incoming, cache, progress = (str(tmp_path / n) for n in ("in", "cache", "progress"))
    os.mkdir(incoming)
    seen = []

    def analyze(targets):
        paths = [r["path"] for r in targets.select("path").collect()]
        seen.extend(paths)
        lines, frames = fits.decoded_lines(spark, paths), fits.frames(spark, paths)
        described = frames.withColumn("session_id", F.lit(1))
        out = N.analyze_frames(fits.scanlines(lines, frames), described, read_errors=fits.read_errors(lines))
        kept = out.select("path", "status", "stars_measured", "mean", "max")
        return targets.join(kept, "path")

    def run():
        G.keep_metrics_current(G.watch_folder(spark, incoming), cache, progress, analyze).awaitTermination()

    night = [card("DATE-OBS", "2026-06-22T00:00:00")]
    whole = fits_bytes(np.full((10, 10), 7, dtype="i2"), night)
    with open(f"{incoming}/a.fits", "wb") as f:
        f.write(whole)
    with open(f"{incoming}/half.fits", "wb") as f:
        f.write(fits_bytes(np.zeros((100, 100), dtype="f8"), night)[:5000])
    run()
    stored = G.read_cache(spark, cache).collect()
    assert [(r["path"].rsplit("/", 1)[-1], r["mean"]) for r in stored] == [("a.fits", 7.0)]
    with open(f"{incoming}/b.fits", "wb") as f:
        f.write(whole)
    run()
    assert names(G.read_cache(spark, cache)) == ["a.fits", "b.fits"]
    assert sorted(p.rsplit("/", 1)[-1] for p in seen) == ["a.fits", "b.fits", "half.fits"]
