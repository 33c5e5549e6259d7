"""What ranked searches share: the first rows of each group, and broadcasts of checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def top(rows: DataFrame, order: WindowSpec, k: int) -> DataFrame:
    """The first k rows of each group with `rank` from 0. The filter is on the bare row
    number, so that Spark keeps k rows of a group in each task before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("rank", (F.col("rank") - 1).cast("long"))


#: Batches of questions of up to so many bytes are sent to all tasks; larger ones are joined by shuffle.
BROADCAST_BYTES = 8 << 20


def is_small(rows: DataFrame) -> bool:
    """Whether rows, of strings and numbers, are few bytes. Only for what comes from
    questions: their sizes are summed by a job."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) if t == "string" else F.lit(8) for c, t in rows.dtypes), F.lit(16))
    return (rows.agg(F.sum(width.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES


def small(rows: DataFrame) -> DataFrame:
    """rows to be broadcast, if they are."""
    return F.broadcast(rows) if is_small(rows) else rows


#: Up to so many questions are put into the plan itself, one pass over what is searched.
DIRECT = 32


def direct(rows: DataFrame) -> Column | None:
    """rows as an array of structs in the plan, if they are at most DIRECT; else None."""
    some = rows.limit(DIRECT + 1).collect()
    if len(some) > DIRECT:
        return None
    kind = rows.schema
    lits = [F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in kind]) for r in some]
    return F.array(*lits).cast(ArrayType(kind))
