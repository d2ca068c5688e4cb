"""Ordered work (lags, leads, rolling frames, ranks) that survives one huge group.

``Window.partitionBy(entity).orderBy(time)`` sorts each entity in a single task. That is the
right plan while entities are of ordinary size. When one holds a large share of the table it
is cut into consecutive *slices* of its own order column:

1. ``plan_slices`` counts rows per group and, for the few groups above the limit, takes
   cut points from a mergeable quantile sketch. At most ``total / task_rows`` groups can be
   above the limit, so the table of cut points has a proven size bound and may be
   broadcast.
2. Rows get the number of their slice; slices become part of the window's partition key.
3. Frames that reach over a slice edge see copies of the neighbouring rows (a halo), which
   are filtered out again afterwards. Only the edge rows are copied.

Results are those of the plain window, row for row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from freshet.runtime import Limits, pin

SLICE = "_slice"
COPY = "_copy"
_ALL = "_all"
_GROUP_ROWS = "_group_rows"
_SKETCH_CUTS = 4096


def bucket_of(x: Column, cuts: Column, n_cuts: int) -> Column:
    """How many of the ascending ``cuts`` lie strictly below ``x`` (binary search)."""
    steps = [1 << p for p in range(max(n_cuts, 1).bit_length() - 1, -1, -1)]
    size = F.size(cuts)
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda found, step: F.when(
            (found + step <= size) & (F.get(cuts, found + step - 1) < x), found + step
        ).otherwise(found),
    )


@dataclass
class SlicePlan:
    """Cut points of the oversized groups; empty when every group fits one task.

    ``rows`` holds one ``(key..., cuts, counts)`` tuple per oversized group.
    """

    keys: list[str]
    order: str
    order_type: T.DataType
    rows: list[tuple] = field(default_factory=list)
    key_types: list[T.DataType] = field(default_factory=list)

    @property
    def needed(self) -> bool:
        return bool(self.rows)

    @property
    def most_cuts(self) -> int:
        return max((len(r[-2]) for r in self.rows), default=0)

    def table(self, spark) -> DataFrame:
        """``(keys, _cuts, _starts, _total)``: starts = rows of the group before each slice."""
        schema = T.StructType(
            [T.StructField(k, t) for k, t in zip(self.keys, self.key_types)]
            + [
                T.StructField("_cuts", T.ArrayType(self.order_type)),
                T.StructField("_starts", T.ArrayType(T.LongType())),
                T.StructField("_total", T.LongType()),
            ]
        )
        data = []
        for *key, cuts, counts in self.rows:
            starts = [sum(counts[:i]) for i in range(len(counts))]
            data.append((*key, list(cuts), starts, sum(counts)))
        return spark.createDataFrame(data, schema)

    def tag(self, df: DataFrame) -> DataFrame:
        """Add ``_slice`` with ``_starts``/``_total`` (NULL outside oversized groups)."""
        return (
            df.join(F.broadcast(self.table(df.sparkSession)), self.keys, "left")
            .withColumn(
                SLICE,
                # NULL sorts last, so it belongs to the last slice.
                F.coalesce(
                    F.when(F.col(self.order).isNull(), F.size("_cuts")).otherwise(
                        bucket_of(F.col(self.order), F.col("_cuts"), self.most_cuts)
                    ),
                    F.lit(0),
                ),
            )
            .drop("_cuts")
        )

    def spread(self, dim: DataFrame) -> DataFrame:
        """Repeat a per-group table once per slice, to join it on (keys, slice)."""
        if not self.needed:
            return dim
        table = F.broadcast(self.table(dim.sparkSession)).select(
            *self.keys, F.size("_cuts").alias("_n")
        )
        return (
            dim.join(table, self.keys, "left")
            .withColumn(SLICE, F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(0)))))
            .drop("_n")
        )


def _merge_thin(cuts: list, counts: list[int], least: int) -> tuple[list, list[int]]:
    """Join neighbouring slices until each holds at least ``least`` rows."""
    kept_cuts: list = []
    kept: list[int] = []
    run = 0
    for i, n in enumerate(counts):
        run += n
        if run >= least and i < len(cuts):
            kept_cuts.append(cuts[i])
            kept.append(run)
            run = 0
    if run < least and kept:
        kept_cuts.pop()
        kept[-1] += run
    else:
        kept.append(run)
    return kept_cuts, kept


def plan_slices(df: DataFrame, keys: Sequence[str], order: str, reach: int = 1, least_slices: int = 1) -> SlicePlan:
    """Find the groups of ``keys`` too large for one task and cut them along ``order``.

    ``least_slices`` above one cuts the largest groups into about so many slices at any size.

    ``reach`` is the longest distance, in rows, that a frame looks over a slice edge; slices
    never get shorter than that.
    """
    limits = Limits.of(df.sparkSession)
    keys = list(keys)
    fields = {f.name: f.dataType for f in df.schema.fields}
    plan = SlicePlan(keys, order, fields[order], [], [fields[k] for k in keys])
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(_GROUP_ROWS))
    stats = sizes.agg(F.sum(_GROUP_ROWS).alias("total"), F.max(_GROUP_ROWS).alias("largest")).first()
    total, largest = stats["total"] or 0, stats["largest"] or 0
    task_rows = max(limits.task_rows, -(-total // limits.max_slices))
    if least_slices > 1:
        task_rows = max(1, min(task_rows, -(-total // least_slices)))
    if largest <= task_rows:
        return plan

    # At most total / task_rows <= max_slices groups pass this filter.
    hot = sizes.filter(F.col(_GROUP_ROWS) > task_rows)
    n_cuts = int(min(_SKETCH_CUTS, -(-largest // task_rows))) - 1
    grid = [(i + 1) / (n_cuts + 1) for i in range(n_cuts)]
    wanted = F.least(F.ceil(F.col(_GROUP_ROWS) / F.lit(task_rows)) - 1, F.lit(n_cuts)).cast("int")
    sketch = (
        df.join(F.broadcast(hot), keys)
        .groupBy(*keys)
        .agg(
            F.percentile_approx(order, F.array(*map(F.lit, grid)), max(10_000, 20 * n_cuts)).alias("_q"),
            F.max(_GROUP_ROWS).alias(_GROUP_ROWS),
        )
        .select(
            *keys,
            # Thin the grid to the number of slices this group needs.
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(1), F.greatest(wanted, F.lit(1))),
                    lambda i: F.element_at(
                        "_q", F.greatest(F.round(i * F.lit(float(n_cuts + 1)) / (wanted + 1)).cast("int"), F.lit(1))
                    ),
                )
            ).alias("_cuts"),
        )
    )
    draft = [(*[r[k] for k in keys], list(r["_cuts"]), [1] * (len(r["_cuts"]) + 1)) for r in sketch.collect()]
    first = SlicePlan(keys, order, plan.order_type, draft, plan.key_types)
    counted = first.tag(df).filter(F.col("_total").isNotNull()).groupBy(*keys, SLICE)
    counted = counted.agg(
        F.count(F.lit(1)).alias(_GROUP_ROWS)
    )
    per_slice = {(*[r[k] for k in keys], r[SLICE]): r[_GROUP_ROWS] for r in counted.collect()}
    for *key, cuts, _ in draft:
        counts = [per_slice.get((*key, i), 0) for i in range(len(cuts) + 1)]
        plan.rows.append((*key, *_merge_thin(cuts, counts, max(reach, 1))))
    return plan


@dataclass
class OrderedView:
    """A frame prepared for ordered windows, and how to get back from it."""

    df: DataFrame
    partition: list[str]
    order: list[str]
    plan: SlicePlan

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.partition).orderBy(*[F.asc_nulls_last(c) for c in self.order])

    def join_groups(self, df: DataFrame, dim: DataFrame, how: str = "left") -> DataFrame:
        """Join a per-group table without bringing a split group together again."""
        return df.join(self.plan.spread(dim), self.partition, how)

    def finish(self, df: DataFrame) -> DataFrame:
        """Drop halo copies and helper columns."""
        if not self.plan.needed:
            return df
        return df.filter(~F.col(COPY)).drop(SLICE, COPY)


def ordered_view(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    before: int = 0,
    after: int = 0,
    least_slices: int = 1,
) -> OrderedView:
    """Prepare ``df`` for windows over ``keys`` ordered by ``order``.

    ``before``/``after``: how many preceding/following rows the caller's frames touch. ``least_slices``:
    groups above that share of all rows are cut, however few rows there are.
    Rows with a NULL key are dropped, as grouping does in the batch semantics followed here. Rows
    without a time stay and come last in their group.
    """
    keys, order = list(keys), list(order)
    df = df.dropna(subset=keys)
    plan = plan_slices(df, keys, order[0], max(before, after), least_slices)
    if not plan.needed:
        return OrderedView(df, keys, order, plan)

    tagged = plan.tag(df)
    last_slice = F.size("_starts") - 1
    pieces = [tagged.withColumn(COPY, F.lit(False))]
    hot = tagged.filter(F.col("_total").isNotNull())
    w = Window.partitionBy(*keys, SLICE)
    if before:
        late = w.orderBy(*[F.desc_nulls_first(c) for c in order])
        pieces.append(
            hot.filter(F.col(SLICE) < last_slice)
            .withColumn("_r", F.row_number().over(late))
            .filter(F.col("_r") <= before)
            .drop("_r")
            .withColumn(SLICE, F.col(SLICE) + 1)
            .withColumn(COPY, F.lit(True))
        )
    if after:
        early = w.orderBy(*[F.asc_nulls_last(c) for c in order])
        pieces.append(
            hot.filter(F.col(SLICE) > 0)
            .withColumn("_r", F.row_number().over(early))
            .filter(F.col("_r") <= after)
            .drop("_r")
            .withColumn(SLICE, F.col(SLICE) - 1)
            .withColumn(COPY, F.lit(True))
        )
    whole = pieces[0]
    for piece in pieces[1:]:
        whole = whole.unionByName(piece)
    return OrderedView(whole.drop("_starts", "_total"), [*keys, SLICE], order, plan)


def with_running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: dict[str, str],
    spread: bool = False,
) -> DataFrame:
    """Inclusive running totals per group in ascending ``order``, sliced where needed.

    A table without keys is one group and is always cut by ranges, as is any with ``spread``: one plan at all
    sizes, whose ranges are pinned. ``sums`` maps output names to numeric columns. Ties in ``order`` must be
    aggregated away beforehand. Slice totals are prefix-summed as a table of a row per slice.
    """
    keys = list(keys)
    if not keys or spread:
        return _ranged_total(df, keys, order, sums)
    plan = plan_slices(df, keys, order)
    if not plan.needed:
        w = Window.partitionBy(*keys).orderBy(order)
        return df.select("*", *[F.sum(c).over(w).alias(n) for n, c in sums.items()])
    tagged = plan.tag(df).drop("_starts", "_total")
    return _total_over_slices(tagged, keys, order, sums)


def _ranged_total(df: DataFrame, keys: list[str], order: str, sums: dict[str, str]) -> DataFrame:
    """Running totals of a table that is one group, or few: cut by ranges of (keys, order), whatever its size.

    The dealt rows are written with the number of their range, so numbers hold in every later reading. Ranges
    that turn out larger than one task should sort are dealt once more, by the size now known.
    """
    limit = Limits.of(df.sparkSession).task_rows
    dealt = pin(df.repartitionByRange(*keys, order).withColumn(SLICE, F.spark_partition_id()))
    sizes = dealt.groupBy(SLICE).count().agg(F.max("count").alias("largest"), F.sum("count").alias("total")).first()
    if (sizes["largest"] or 0) > limit:
        ranges = -(-2 * sizes["total"] // limit)
        dealt = pin(dealt.drop(SLICE).repartitionByRange(ranges, *keys, order).withColumn(SLICE, F.spark_partition_id()))
    return _total_over_slices(dealt, keys, order, sums)


def _total_over_slices(tagged: DataFrame, keys: list[str], order: str, sums: dict[str, str]) -> DataFrame:
    """Running totals inside slices plus what the group's earlier slices hold."""
    per_slice = tagged.groupBy(*keys, SLICE).agg(*[F.sum(c).alias(n) for n, c in sums.items()]).withColumn(_ALL, F.lit(0))
    # A row per slice of a group: few, whatever the table's size.
    w_slice = Window.partitionBy(_ALL, *keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    base = per_slice.select(
        *keys, SLICE, *[F.coalesce(F.sum(n).over(w_slice), F.lit(0)).alias(f"_b_{n}") for n in sums]
    )
    w = Window.partitionBy(*keys, SLICE).orderBy(order)
    out = tagged.select("*", *[F.sum(c).over(w).alias(n) for n, c in sums.items()]).join(base, [*keys, SLICE])
    for n in sums:
        out = out.withColumn(n, F.col(n) + F.col(f"_b_{n}")).drop(f"_b_{n}")
    return out.drop(SLICE)
