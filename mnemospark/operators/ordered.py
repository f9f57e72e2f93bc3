"""Work that needs order: numbers over a whole table, and folds over the rows of a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def row_numbers(df: DataFrame, order: list[str | Column], name: str = "n") -> DataFrame:
    """Numbers all rows from 1 in the given order, without gathering them in one task.

    Rows are dealt by ranges and numbered within each; a range's first number is the sum of the
    sizes of those before it, which are as few as partitions.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    named = df.select("*", *[k.alias(f"__o{i}") for i, k in enumerate(keys)])
    flat = [f"__o{i}" for i in range(len(keys))]
    dealt = written(named.repartitionByRange(*flat).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select("__range", before.alias("__first"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*flat))
    return dealt.join(F.broadcast(first), "__range").withColumn(name, (own + F.col("__first")).cast("long")).drop("__range", "__first", *flat)


def fold(df: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable[[tuple], object], step: Callable[[object, object, list], None], end: Callable[[object, list], None]) -> DataFrame:
    """Folds the rows of each key in order. ``start`` makes a key's state, ``step`` takes a row and may give rows, ``end`` closes the key.

    Rows are dealt by key, sorted, and folded as they stream by: a task holds one state, never a key's rows.
    """
    names = [c.strip().split()[0] for c in schema.split(", ")]

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, out = None, None, []
        for frame in frames:
            for row in frame.itertuples(index=False):
                now = tuple(getattr(row, k) for k in keys)
                if now != key:
                    if key is not None:
                        end(state, out)
                    key, state = now, start(now)
                step(state, row, out)
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        if key is not None:
            end(state, out)
            if out:
                yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(task, schema)
