"""Large components of burned boxes, strip by strip, against labelled runs."""

import numpy as np
import pytest

from gridrun.operators import components as C
from gridrun.operators.burn import box_layer, burn_boxes


@pytest.mark.parametrize("strip,connectivity", [(16, 8), (16, 4), (64, 8)])
def test_large_of_boxes(spark, strip, connectivity):
    rng = np.random.default_rng(strip + connectivity)
    rows = [(int(rng.integers(1, 4)), int(rng.integers(0, 6)), *(int(v) for v in (*rng.integers(-3, 60, 2), *rng.integers(1, 14, 2)))) for _ in range(150)]
    rows += [(1, 2, 5, 0, 1, 64), (2, 1, 7, 14, 3, 4), (2, 1, 30, 15, 4, 1), (None, 1, 5, 5, 30, 30)]      # over all strips; large and small over one border
    features = spark.createDataFrame(rows, "raster_id long, class_id int, c0 int, r0 int, w int, h int")
    of = lambda df: sorted(map(tuple, df.select("raster_id", "row", "c0", "c1", "class_id").collect()))
    labelled = C.label_components(burn_boxes(features, 64, 64), (64, 64), connectivity=connectivity, tile=16)
    for least in (0, 12, 60, 10000):
        got = C.large_of_boxes(box_layer(features, 64, 64), (64, 64), least, connectivity=connectivity, strip=strip)
        assert of(got) == of(C.mask_of(C.keep_components(labelled, least)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert C.large_of_boxes(box_layer(features.limit(0), 64, 64), (64, 64), 5, strip=strip).count() == 0
