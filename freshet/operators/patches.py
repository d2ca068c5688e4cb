"""Spatio-temporal patches around interior cells.

A patch holds P time steps of a (2·hw+1)² neighbourhood with all bands, oldest step first,
flattened row-major as (step, dy, dx, band).

The grid is cut into square blocks. A block holds its own cells and a halo of ``hw`` cells, so at
hw = 5 and blocks of 32 a cell is copied 1.7 times on average, not 121 times. One shuffle gathers
the plane of each (block, time); P consecutive planes meet in a window over a dense time index; the
patches of all centres of a block are then cut out of the planes as array slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.operators.ordering import ordered_view, with_running_total
from freshet.runtime import pin, temporary
from freshet.sources.sinks import save_table

#: Side of a block in cells.
BLOCK = 32


def dense_time_index(cube: DataFrame, time: str = "time") -> DataFrame:
    """``(time, t_idx)`` over all distinct times, 0-based."""
    times = cube.select(time).dropna().distinct().withColumn("_one", F.lit(1))
    ranked = with_running_total(times, [], time, {"t_idx": "_one"})
    return ranked.select(time, (F.col("t_idx") - 1).cast("long").alias("t_idx"))


def _blocks_of(at: Column, hw: int, block: int, size: int) -> Column:
    """Blocks whose cells or halo hold the coordinate."""
    low = F.greatest(F.floor((at - hw) / block), F.lit(0)).cast("int")
    high = F.least(F.floor((at + hw) / block), F.lit((size - 1) // block)).cast("int")
    return F.sequence(low, high)


def build_patches(
    cube: DataFrame,
    P: int,
    hw: int,
    bands: Sequence[str],
    height: int,
    width: int,
    times: DataFrame | None = None,
    time_index: DataFrame | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """``(time, cy, cx, patch)`` for every interior centre with P full steps.

    ``cube`` has one row per (time, cell); a band value may be NULL and stays NULL inside the
    patch, while a cell without a row takes all its centres away. ``times`` restricts the reference
    times, after the steps have been taken over all. ``time_index`` gives (time, t_idx) where it is
    known from the sources, which saves a pass over the cube.
    """
    bands = list(bands)
    values = F.array(*[F.col(b).cast("float") for b in bands])
    spread = (
        cube.filter(F.col("y_idx").between(0, height - 1) & F.col("x_idx").between(0, width - 1))
        .select("time", "y_idx", "x_idx", values.alias("v"), F.explode(_blocks_of(F.col("y_idx"), hw, block, height)).alias("by"))
        .select("*", F.explode(_blocks_of(F.col("x_idx"), hw, block, width)).alias("bx"))
    )
    y0, x0 = F.greatest(F.col("by") * block - hw, F.lit(0)), F.greatest(F.col("bx") * block - hw, F.lit(0))
    y1 = F.least(F.col("by") * block + block - 1 + hw, F.lit(height - 1))
    x1 = F.least(F.col("bx") * block + block - 1 + hw, F.lit(width - 1))
    w = x1 - x0 + 1
    place = ((F.col("y_idx") - y0) * w + F.col("x_idx") - x0).cast("int")
    gathered = spread.groupBy("by", "bx", "time").agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), "v"))).alias("cells"))
    planes = gathered.select("by", "bx", "time", _dense(F.col("cells"), ((y1 - y0 + 1) * w).cast("int")).alias("plane"))

    # Written once: the slice plan, the time index and the window all read it.
    planes = pin(planes)
    indexed = planes.join(dense_time_index(planes) if time_index is None else time_index, "time")
    view = ordered_view(indexed, ["by", "bx"], ["t_idx"], before=P - 1)
    last = view.window().rowsBetween(-(P - 1), 0)
    stacked = view.df.withColumns(
        {"steps": F.collect_list("plane").over(last), "first_idx": F.min("t_idx").over(last)}
    )
    full = view.finish(stacked).filter(
        (F.size("steps") == P) & (F.col("t_idx") - F.col("first_idx") == P - 1)
    )
    if times is not None:
        full = full.join(times, "time", "left_semi")

    side = 2 * hw + 1
    steps = F.col("steps")

    def cut(cy: Column, cx: Column) -> Column:
        """Row slices of every plane; a missing cell makes the whole patch NULL."""
        first = (cy - y0) * w + cx - x0 - hw
        rows = lambda plane: F.flatten(
            F.transform(F.sequence(F.lit(-hw), F.lit(hw)), lambda dy: F.slice(plane, (first + dy * w + 1).cast("int"), F.lit(side)))
        )
        return F.flatten(F.flatten(F.transform(steps, rows)))

    def centres(number: Column, size: int) -> Column:
        low, high = F.greatest(number * block, F.lit(hw)), F.least(number * block + block - 1, F.lit(size - 1 - hw))
        return F.when(low <= high, F.sequence(low, high))

    patches = F.flatten(
        F.transform(centres(F.col("by"), height), lambda cy: F.transform(
            centres(F.col("bx"), width), lambda cx: F.struct(cy.alias("cy"), cx.alias("cx"), cut(cy, cx).alias("patch"))
        ))
    )
    return full.select("time", F.explode(patches).alias("p")).select("time", "p.cy", "p.cx", "p.patch").filter(F.col("patch").isNotNull())


def number_patches(patches: DataFrame) -> DataFrame:
    """The same patches with ``sample``, a dense number from 0 in the order of (time, cy, cx).

    Rows are dealt to ranges of that order; counts of the ranges give each its first number.
    """
    at = F.struct("time", "cy", "cx")
    numbered = with_running_total(patches.select("*", at.alias("_at"), F.lit(1).alias("_one")), [], "_at", {"_n": "_one"})
    return numbered.select((F.col("_n") - 1).cast("long").alias("sample"), *patches.columns)


def write_patches(patches: DataFrame, folder: str) -> tuple[str, str]:
    """Store numbered patches and, beside them, the index of what each number stands for; returns both paths.

    The patch table is laid out by ``sample``, so a range of numbers reads few files; the index is small and has no
    patch in it.
    """
    with temporary(patches.sparkSession):
        numbered = number_patches(patches)
        data = save_table(numbered.repartitionByRange("sample").sortWithinPartitions("sample").drop("time", "cy", "cx"), f"{folder}/patches")
        index = save_table(numbered.drop("patch"), f"{folder}/patch_index")
    return data, index


def _dense(cells: Column, expected: Column) -> Column:
    """Values by position; positions without a cell are NULL. Whole planes, the usual case, need no filling."""
    kind = "array<array<float>>"
    gap = lambda n: F.array_repeat(F.lit(None).cast("array<float>"), n)
    filled = F.aggregate(
        cells, F.array().cast(kind), lambda out, c: F.concat(out, gap(c["at"] - F.size(out)), F.array(c["v"])).cast(kind),
    )
    filled = F.concat(filled, gap(expected - F.size(filled)))
    return F.when(F.size(cells) == expected, F.transform(cells, lambda c: c["v"])).otherwise(filled)
