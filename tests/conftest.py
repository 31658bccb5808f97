from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from nightframes.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    return build_session("tests", cores="8", **{"spark.checkpoint.dir": folder, "spark.sql.shuffle.partitions": "4"})


@pytest.fixture
def frame(spark):
    """Build the scanlines of one frame from a nested list or array of planes or rows."""

    def build(data, sample_type="I16", bscale=1.0, bzero=0.0, bayerpat=None, frame_id=1):
        planes = data if hasattr(data[0][0], "__len__") else [data]
        axes = 2 if planes is not data else 3
        height, width = len(planes[0]), len(planes[0][0])
        rows = [
            (frame_id, p, y, [float(v) for v in row], width, height, axes, len(planes), sample_type, bscale, bzero, bayerpat)
            for p, plane in enumerate(planes)
            for y, row in enumerate(plane)
        ]
        return spark.createDataFrame(
            rows,
            "frame_id bigint, plane int, y int, samples array<double>, width int, height int, axes int,"
            " planes int, sample_type string, bscale double, bzero double, bayerpat string",
        )

    return build


@pytest.fixture
def value(spark):
    """Evaluate a Column built from literals."""

    def evaluate(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return evaluate
