import pytest

import __spark_entry__ as driver
from oracle import compare, connection

SF = "/root/testdata/sf0.001"
QUICK = ["voxel_barycentre", "voxel_spheres", "map_first_hit", "radius_join_grouped", "nearest_label_transfer", "asof_bracket",
         "horizon_windows", "metric_threshold_sweep", "evidence_counts", "raster_future_occupancy", "pca_local", "sample_batches"]


def test_every_sql_has_its_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_flagship(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    assert compare(driver.queries()[name](spark, SF), connection(SF), driver.oracle_sql()[name]) is None
