"""Joins of many rows with one row for each key, where some keys have many of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.runtime import unused

#: A key is split if it has over this many rows and over one in ``HEAVY`` of all: ``2 * HEAVY`` keys at most, a bounded list.
LEAST, HEAVY = 256, 128


def heavy_parts(counts: DataFrame, key: str, total: int) -> dict:
    """Of ``counts`` (key, n; ``total`` at most 2 times the rows): into how many parts each heavy key is split."""
    limit = max(LEAST, total // HEAVY)
    return {r[key]: -(-r["n"] // limit) for r in counts.where(F.col("n") > limit).select(key, "n").collect()}


def spread_join(many: DataFrame, one: DataFrame, key: str, parts: dict, by: Column) -> DataFrame:
    """``many`` joined with ``one``, which has each ``key`` once. The rows of a heavy key are dealt to its parts by a hash of ``by``.

    The key's row in ``one`` goes to all its parts, so each row meets it once and no task gets all of them.
    """
    if not parts:
        return many.join(one, key)
    part = unused("v_part", [*many.columns, *one.columns])
    kind = one.schema[key].dataType
    split = F.create_map(*[x for k, n in parts.items() for x in (F.lit(k).cast(kind), F.lit(n))])
    width = F.coalesce(split[F.col(key)], F.lit(1))
    dealt = many.withColumn(part, F.pmod(F.xxhash64(by), width).cast("int"))
    copied = one.withColumn(part, F.explode(F.sequence(F.lit(0), width - 1)))
    return dealt.join(copied, [key, part]).drop(part)
