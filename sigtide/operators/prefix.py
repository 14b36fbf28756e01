"""Running aggregates over groups of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_before(df: DataFrame, keys: list[str], block: Column, order: list[str],
                   columns: dict[str, tuple[Callable[[Column], Column], Column]]) -> DataFrame:
    """Add per-row aggregates (sum or max) over all earlier rows of the key.

    ``block`` cuts a key into consecutive ranges of ``order``. Rows run inside their own block, the
    blocks run over their totals, and both add up, so a key with a third of all rows is many window
    partitions instead of one. Null where nothing comes before.
    """
    b = df.withColumn("_block", block).withColumns({f"_v_{n}": c for n, (_, c) in columns.items()})
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = b.groupBy(*keys, "_block").agg(*[fn(F.col(f"_v_{n}")).alias(f"_t_{n}") for n, (fn, _) in columns.items()])
    carried = totals.select(*keys, "_block", *[fn(F.col(f"_t_{n}")).over(blocks).alias(f"_b_{n}") for n, (fn, _) in columns.items()])
    rows = b.withColumns({f"_i_{n}": fn(F.col(f"_v_{n}")).over(inside) for n, (fn, _) in columns.items()})
    out = {}
    for n, (fn, _) in columns.items():
        both = F.array_compact(F.array(f"_b_{n}", f"_i_{n}"))
        add = F.aggregate(F.slice(both, 2, 1), F.get(both, 0), lambda acc, v: acc + v) if fn is F.sum else F.array_max(both)
        out[n] = add
    drop = [f"_{p}_{n}" for n in columns for p in "vbi"]
    return rows.join(carried, [*keys, "_block"]).withColumns(out).drop("_block", *drop)
