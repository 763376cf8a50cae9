"""Row positions in a sorted order, without sorting all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import materialize, quoted, same_keys

_IN_PARTITION = (1 << 33) - 1     # monotonically_increasing_id keeps the place in the partition in its low 33 bits


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "position") -> DataFrame:
    """Adds the place (from 0) of every row among the rows of its group, in the given order; a null group is a group.

    Rows are dealt by ranges of (group, order), sorted inside them and written once; the ranges, one row each per
    group, are summed up, so rows carry all their columns along and are joined with nothing but range sizes. Rows equal in
    group and order are dealt to one task, so the order should tell rows apart. `df` is read twice, once for the range cuts;
    write it before where it is expensive.
    """
    keys = [*[F.col(c).asc_nulls_first() for c in group], *order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns(
        {"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))})
    dealt = materialize(dealt)
    ranges = dealt.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    over = f"(partition by {', '.join(map(quoted, group)) or 'true'} order by _range)"
    ranges = ranges.withColumn("_start", F.expr(f"sum(_n) over {over} - _n - _first")).drop("_n", "_first")
    placed = same_keys(dealt, ranges, ["_range", *group])
    return placed.withColumn(name, F.col("_start") + F.col("_at")).drop("_range", "_at", "_start")


def with_position(df: DataFrame, key: str, name: str = "position") -> DataFrame:
    """Add the row's position from 0 in the order of a unique key."""
    return numbered(df, [], [F.col(key).asc_nulls_first()], name)


def in_blocks(df: DataFrame, position: str, block: int, halo: int) -> DataFrame:
    """Cut rows into blocks by position; rows near an edge are also copied into every block
    that `halo` reaches.

    Adds __block and __own (false for a copy), so that a window of `halo` rows to either side can be
    computed block by block.
    """
    p = quoted(position)
    blocks = f"sequence(CAST(floor(({p} - {halo}) / {block}) AS BIGINT), CAST(floor(({p} + {halo}) / {block}) AS BIGINT))"
    out = df.selectExpr("*", f"explode({blocks}) AS __block").filter("__block >= 0")
    return out.withColumn("__own", F.expr(f"__block = floor({p} / {block})"))
