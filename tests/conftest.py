import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from gridrun.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "gridrun-tests", 4)


def runs_of(mask, raster_id=1):
    """Dense class mask -> run tuples (raster_id, row, c0, c1, class_id)."""
    out = []
    for r, line in enumerate(mask):
        c = 0
        while c < len(line):
            k, s = line[c], c
            while c < len(line) and line[c] == k:
                c += 1
            if k:
                out.append((raster_id, r, s, c - 1, int(k)))
    return out


@pytest.fixture(scope="session")
def make(spark):
    schema = "raster_id long, row int, c0 int, c1 int, class_id int"

    def of(mask, raster_id=1):
        return spark.createDataFrame(runs_of(np.asarray(mask), raster_id), schema)
    return of


@pytest.fixture(scope="session")
def dense():
    def of(df, shape, value=None):
        out = np.zeros(shape, int)
        for r in df.collect():
            out[r["row"], r["c0"]:r["c1"] + 1] = r[value] if value else 1
        return out
    return of
