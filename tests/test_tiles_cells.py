"""Strides choose positions before anything is exploded."""

import pytest

from freshet.sources.tiles import _cells


@pytest.mark.parametrize("stride, kept", [(1, 35), (2, 12), (3, 6), (9, 1)])
def test_only_kept_cells_are_exploded(spark, stride, kept):
    values = [float(i) for i in range(35)]
    df = spark.createDataFrame([("a", 5, 7, values, [v + 100 for v in values])], "path string, height int, width int, p array<double>, q array<double>")
    cells = _cells(df, ["p", "q"], stride, ["path"])
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "Filter" not in plan.split("Generate")[0]
    rows = cells.collect()
    assert len(rows) == kept
    nx = -(-7 // stride)
    for r in rows:
        assert r.p == r.y_idx * stride * 7 + r.x_idx * stride and r.q == r.p + 100 and r.pixel_id == r.y_idx * nx + r.x_idx


def test_stored_patches_and_their_index(spark, tmp_path):
    from freshet.operators.patches import write_patches

    rows = [(f"2022-01-{d:02d} 00:00:00", y, x, [float(100 * d + 10 * y + x)]) for d in range(1, 9) for y in range(4) for x in range(3)]
    patches = spark.createDataFrame(rows, "time string, cy int, cx int, patch array<double>").selectExpr("cast(time as timestamp_ntz) as time", "cy", "cx", "patch")
    data, index = write_patches(patches.repartition(7), str(tmp_path))
    stored, named = spark.read.parquet(data), spark.read.parquet(index).orderBy("sample").collect()
    assert stored.columns == ["sample", "patch"] and [r.sample for r in named] == list(range(96))
    assert [(r.time.day, r.cy, r.cx) for r in named] == sorted((d, y, x) for d in range(1, 9) for y in range(4) for x in range(3))
    values = {r.sample: r.patch[0] for r in stored.collect()}
    assert all(values[r.sample] == 100 * r.time.day + 10 * r.cy + r.cx for r in named)
