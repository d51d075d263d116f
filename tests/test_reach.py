import numpy as np
import pytest
from pyspark.sql import functions as F

from tiepoint.functions import geo
from tiepoint.operators import candidates


def layer(spark, rows):
    return spark.createDataFrame(rows, "OBJECTID long, GlobalID string, lon double, lat double")


@pytest.mark.parametrize("threshold", [10.67, 1200.0])
@pytest.mark.parametrize("crowded", [16, 4096])
def test_reach_equals_the_listed_pairs(spark, threshold, crowded):
    """Copies on few places, points on either side of cells, one without a place and one that reaches nothing."""
    step = threshold / 400_000
    cap = layer(spark, [(k, None, 5.0 + (k % 7) * step, 40.0 + (k % 5) * step) for k in range(60)] + [(90, None, None, 1.0), (91, None, 80.0, 0.0)])
    auth = layer(spark, [(k, f"a{k}", 5.0 - (k % 6) * step, 40.0 + (k % 4) * step) for k in range(200)])
    pairs = candidates.pairs_within(cap, auth, threshold)
    listed = pairs.groupBy("cap_oid").agg(F.count("*").alias("n"), F.round(F.min("distance_m"), 5), F.round(F.max("distance_m"), 5)).collect()
    found = candidates.reach(cap, auth, threshold, crowded).select("cap_oid", "n", F.round("nearest_m", 5), F.round("farthest_m", 5)).collect()
    assert listed and sorted(map(tuple, found)) == sorted(map(tuple, listed))


def test_curved_equals_the_geodesic():
    rng = np.random.default_rng(3)
    lon, lat, far, to = rng.uniform(-180, 180, 5000), rng.uniform(-85, 85, 5000), rng.uniform(0, 19_000, 5000), rng.uniform(0, 6.3, 5000)
    lat2 = lat + np.degrees(far * np.cos(to) / 6.4e6)
    lon2 = lon + np.degrees(far * np.sin(to) / 6.4e6 / np.cos(np.radians(lat)))

    def place(lon, lat):
        lam, phi = np.radians(lon), np.radians(lat)
        n = geo.WGS84_A / np.sqrt(1 - geo.WGS84_E2 * np.sin(phi) ** 2)
        return np.stack([n * np.cos(phi) * np.cos(lam), n * np.cos(phi) * np.sin(lam), n * (1 - geo.WGS84_E2) * np.sin(phi)])

    assert np.abs(geo.curved(place(lon, lat), place(lon2, lat2)) - geo.vincenty(lon, lat, lon2, lat2)).max() < 2e-7
    assert geo.curved(place(lon, lat), place(lon, lat)).max() == 0.0
