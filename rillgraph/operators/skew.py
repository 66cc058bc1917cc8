"""Joins whose keys may be very unequal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of all rows is split; so there are at most as many such keys.
SHARES = 4096


def split_join(many: DataFrame, few: DataFrame, on: str | list[str], by: list[str], total: int) -> DataFrame:
    """``many`` joined with ``few`` on the columns ``on``, which are unique in ``few``; ``few`` counts the key's rows in ``many`` as ``n``.

    A key with more than one in ``SHARES`` of the ``total`` rows is dealt by the hash of the columns ``by`` to parts of about that
    size, and its row of ``few`` goes to each part. The list of such keys is broadcast: ``SHARES`` rows of a few numbers at
    most, and ``few`` grows by twice as many rows at most, whatever the input. Null keys join with nothing.
    """
    on = [on] if isinstance(on, str) else on
    limit = max(1, total // SHARES)
    parts = F.when(F.col("n") > limit, F.ceil(F.col("n") / limit)).otherwise(1).cast("int")
    hot = few.where(F.col("n") > limit).select(*on, parts.alias("__parts"))
    dealt = many.join(F.broadcast(hot), on, "left").withColumn("__part", F.pmod(F.xxhash64(*by), F.coalesce("__parts", F.lit(1))).cast("int"))
    each = few.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return dealt.drop("__parts").join(each, [*on, "__part"]).drop("__part")
