"""Places of rows in one order over a whole table, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewell.functions.exprs import free_name
from framewell.operators.stages import kept

#: Bits of a row's number inside its partition, in monotonically_increasing_id.
INSIDE = 33


def placed(rows: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """rows plus `name`, their place from 0.

    Rows are dealt to ranges of the whole order, so that only rows equal in all of it must share one, sorted there,
    numbered and written once; a range starts where the counts before it end. Rows that are equal in the order are
    placed one after the other; nulls stand where the order puts them; an empty table gives an empty result.
    """
    at, part, before = (free_name(rows.columns, n) for n in ("_at", "_part", "_before"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    ranged = kept(ranged, "placed").withColumn(part, F.shiftright(F.col(at), INSIDE))
    # a row for each range
    starts = ranged.groupBy(part).agg(F.count("*").alias(before))
    starts = starts.select(part, (F.sum(before).over(Window.orderBy(part)) - F.col(before)).alias(before))
    inside = F.col(at).bitwiseAND((1 << INSIDE) - 1)
    return ranged.join(F.broadcast(starts), part).select(*rows.columns, (F.col(before) + inside).alias(name))
