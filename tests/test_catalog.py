"""Each query with SQL against another engine, on the smallest tables."""

import duckdb
import numpy as np
import pytest

from rasterfold.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "labels", "lineitem", "part", "pages", "events")
#: One query of each family; the driver compares all of them.
NAMES = (
    "grayscale", "filter_sepia", "tone_map_aces", "color_lab", "region_invert", "rotate_90", "pad", "resize_nearest", "resize_lanczos3", "blend_soft_light", "compose_xor", "edges_sobel", "edges_kirsch", "blur_gaussian", "median_blur", "top_hat",
    "threshold_otsu", "threshold_wolf_jolion", "integral_image", "dither_bayer_4x4", "percentiles", "equalize_tiles", "ssim_blocks", "perceptual_hash", "ink_runs", "box_overlap", "frame_move", "softmax", "character_errors", "corpus_coverage", "telemetry_daily", "request_canonical",
)


def plain(v):
    if v is None or (isinstance(v, float) and np.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, (int, float, np.number, bool, np.bool_)) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.execute(catalog.oracle_sql()[name]).df(), catalog.queries()[name](spark, SF).toPandas()
    columns = sorted(want)
    assert columns == sorted(got)
    rows = lambda x: sorted((tuple(map(plain, r)) for r in x[columns].itertuples(index=False, name=None)), key=repr)
    assert rows(want) == rows(got) and len(want)


def test_every_sql_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
