"""Components of all roads, against union-find."""

from collections import Counter
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from trailspark.plans import registry

TABLES = "/root/testdata/sf0.001"


def sizes_by_force(parts: list[int]) -> Counter:
    """Nodes of each component by its smallest node, by the adapter's rule: a road on, and one far away."""
    n, of = max(parts), {}

    def top(x):
        of.setdefault(x, x)
        while of[x] != x:
            x = of[x]
        return x

    for k in parts:
        for dst in [k % n + 1] * (k % 7 != 0) + [k * 31 % n + 1] * (k % 5 == 0):
            if dst != k:
                a, b = top(k), top(dst)
                of[max(a, b)] = min(a, b)
    return Counter(top(x) for x in of)


@pytest.mark.parametrize("kind", ["table", "gaps"])
def test_road_components_equal_union_find(spark, tmp_path, kind):
    folder = TABLES
    if kind == "gaps":  # parts that are missing leave several components
        folder = str(tmp_path)
        keys = [k for k in range(1, 1500) if k * 7919 % 11 > 4]
        pq.write_table(pa.table({"p_partkey": keys, "p_size": pa.array([1] * len(keys), pa.int32())}), f"{folder}/part.parquet")
    parts = pq.read_table(Path(folder) / "part.parquet")["p_partkey"].to_pylist()
    want = sizes_by_force(parts)
    got = {r["label"]: r["nodes"] for r in registry.QUERIES["road_components"](spark, folder).collect()}
    assert got == want
    largest = registry.QUERIES["largest_road_component"](spark, folder).first()
    assert (largest["label"], largest["nodes"]) == min(want.items(), key=lambda x: (-x[1], x[0]))
    assert {r["label"]: r["nodes"] for r in registry.QUERIES["components"](spark, folder).collect()} == want
