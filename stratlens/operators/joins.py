"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "_salt"


def salts_for(df: DataFrame) -> int:
    """As many sub-keys as a shuffle has partitions, so that one hot key can use all of them."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def salt_of(df: DataFrame, keys: Sequence[str], salts: int | None = None) -> Column:
    """A sub-key that depends on the row's contents alone.

    A task run again after a lost executor must deal its rows as before, so neither row numbers
    nor sums of floating-point numbers, which may come out in another order, take part.
    """
    others = [name for name in df.columns if name not in keys]
    stable = [name for name, kind in df.dtypes if name in others and kind not in ("double", "float")]
    return F.pmod(F.xxhash64(*(stable or others or keys)), F.lit(salts or salts_for(df))).cast("int")


def salted_join(
    rows: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "inner", salts: int | None = None
) -> DataFrame:
    """Attach the few ``facts`` of each key to its many ``rows`` without one task per key.

    Each key's rows are dealt over ``salts`` sub-keys (see ``salts_for``) and its facts are repeated once for each.
    ``rows`` may bring its own ``_salt``. Whether the small side is broadcast instead is left to
    its measured size at run time.
    """
    salts = salts or salts_for(rows)
    dealt = rows if SALT in rows.columns else rows.withColumn(SALT, salt_of(rows, keys, salts))
    copies = facts.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*keys, SALT], how).drop(SALT)
