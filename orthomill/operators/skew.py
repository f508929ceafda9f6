"""Joins that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthomill.session import cut_lineage, spread

#: Rows of one key that one task is meant to hold; every key gets as many salts as its own count asks for.
ROWS_PER_SALT = 1_000_000
#: Pairs of one key that one salt is meant to make.
PAIRS_PER_SALT = 5_000_000


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], rows_per_salt: int = ROWS_PER_SALT,
                pairs_per_salt: int = PAIRS_PER_SALT) -> DataFrame:
    """Inner equi-join in which every key is spread by its own row counts on both sides.

    A key has at least one salt for every ``rows_per_salt`` of its rows on a side, and so many on both that a pair of salts makes
    ``pairs_per_salt`` pairs at most; the side with more rows gets more of them. Its rows are dealt over their
    own side's salts and repeated once per salt of the other side, so two rows meet under exactly one pair of salts. The
    counts combine before the shuffle and are materialised once; both sides read the same table, and keys whose
    salts are 1 on both sides, nearly all, are left out of it and cost nothing. The work follows the pairs, not the
    bytes, so both sides are dealt over all tasks.
    """
    keys = list(keys)
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r")), keys)

    def needed(own: str, other: str) -> Column:
        side, across = F.col(own).cast("double"), F.col(other).cast("double")
        pieces = F.ceil(side * across / pairs_per_salt)
        # With one salt on the smaller side, the larger has them all.
        shared = F.when(pieces * across < side, pieces).when(pieces * side < across, 1).otherwise(F.ceil(F.sqrt(pieces * side / across)))
        return F.greatest(F.ceil(side / rows_per_salt), shared).cast("int").alias(own)

    salts = cut_lineage(counts.select(*keys, needed("_l", "_r"), needed("_r", "_l")).filter("_l > 1 or _r > 1"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        known = df.join(salts, keys, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_l", "_r")})
        mine = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c not in keys] or [F.lit(0)]), F.col(own))
        salted = known.withColumn(f"_s{own}", mine.cast("int")).withColumn(
            f"_s{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_l", "_r")
        return spread(salted, *keys, "_s_l", "_s_r")

    return dealt(left, "_l", "_r").join(dealt(right, "_r", "_l"), [*keys, "_s_l", "_s_r"]).drop("_s_l", "_s_r")
