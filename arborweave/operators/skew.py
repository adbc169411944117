"""Aggregation and joins that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a partial result of each aggregate is merged.
MERGE = {"count": "sum", "sum": "sum", "min": "min", "max": "max"}
#: Most keys that are ever treated as heavy; bounds every broadcast made here.
MAX_HEAVY = 256


def heavy_keys(df: DataFrame, key: str, share: float = 0.005, tracked: int = 8192) -> DataFrame:
    """Keys that hold more than about `share` of the rows, found with a sketch.

    One pass over df with a mergeable frequent-items sketch of fixed size:
    each task keeps `tracked` counters, the driver at most MAX_HEAVY keys.
    The sketch may miss or add keys near the share; callers must stay right
    whichever keys it names. Null is no key. Result: one column, `key`.
    """
    spark = df.sparkSession
    row = df.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {MAX_HEAVY}, {tracked})").alias("top"), F.count("*").alias("n")).first()
    names = [x["item"] for x in row["top"] or [] if x["count"] > share * row["n"]]
    return spark.createDataFrame([(x,) for x in names], df.select(key).schema)


def aggregate_skewed(
    df: DataFrame,
    key: str,
    aggs: Sequence[tuple[str, str, str]],
    share: float = 0.005,
    salts: int = 64,
) -> DataFrame:
    """One row per value of `key`, balanced however skewed the key is.

    aggs: (result name, one of count/sum/min/max, source column). Heavy keys
    come from a sketch. Their rows meet the short list by a broadcast join
    (at most MAX_HEAVY rows) and are aggregated per key and salt, then per
    key, so that no task holds one key alone; all other rows go through an
    ordinary shuffle on the key; the two results are united.

    Rows with a null key form no group. Null source values are ignored, as
    in SQL; a group of only nulls gives null. Empty input gives no rows.
    Other columns of df are dropped before the shuffle.
    """
    used = list(dict.fromkeys([key, *(c for _, _, c in aggs if c != "*")]))
    # a salt from the row's content, so that a task that runs again gives the same
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")
    rows = df.where(F.col(key).isNotNull()).select(*used, salt.alias("__salt"))
    hot = F.broadcast(heavy_keys(rows, key, share))

    def agg(names: Sequence[tuple[str, Column]]) -> list[Column]:
        return [c.alias(n) for n, c in names]

    first = agg([(n, getattr(F, f)(F.lit(1) if c == "*" else F.col(c))) for n, f, c in aggs])
    merged = agg([(n, getattr(F, MERGE[f])(n)) for n, f, _ in aggs])
    heavy = rows.join(hot, key, "left_semi").groupBy(key, "__salt").agg(*first).groupBy(key).agg(*merged)
    light = rows.join(hot, key, "left_anti").groupBy(key).agg(*first)
    return heavy.unionByName(light)


def join_skewed(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: float = 0.005) -> DataFrame:
    """left join right on `key`, where left may be skewed and right has each key at most once.

    The rows of right that belong to heavy keys of left number at most
    MAX_HEAVY and are broadcast, so a heavy key is never shuffled to one
    task; the rest is an ordinary shuffled join. how: inner, left_semi,
    left_anti or left. Null keys match nothing (left and left_anti keep
    their rows). Columns of right other than the key must not clash with
    those of left.
    """
    if how not in ("inner", "left_semi", "left_anti", "left"):
        raise ValueError(f"unsupported join type {how}")
    hot = heavy_keys(left, key, share)
    names = [r[0] for r in hot.collect()]  # at most MAX_HEAVY
    if not names:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(names), F.lit(False))
    heavy = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    return heavy.unionByName(left.where(~is_hot).join(right.where(~is_hot), key, how))


def heavy_limit(total: int, least: int = 1000, most: int = 4096) -> int:
    """Rows above which a group counts as heavy: at most `most` groups can be that large."""
    return max(least, -(-total // most))


def join_counted(left: DataFrame, right: DataFrame, key: Sequence[str], n: str, total: int, how: str = "inner", least: int = 1000) -> DataFrame:
    """left join right on `key`, where right has each key once with the exact number n of its rows in left.

    Keys of more than heavy_limit(total) rows are at most 4,096 whatever the
    data, so their rows of right are broadcast and the rows of left stay
    where they are; all others are joined by a shuffle in which no key is
    heavy. how: inner, left_semi or left. Null keys match nothing. n is dropped.
    """
    key = list(key)
    limit = heavy_limit(total, least)
    hot = right.where(F.col(n) > limit)
    names = hot.select(*key).collect()  # at most 4,096
    if not names:
        return left.join(right.drop(n), key, how)
    spark = left.sparkSession
    listed = F.broadcast(spark.createDataFrame(names, right.select(*key).schema))
    heavy = left.join(F.broadcast(hot.drop(n)), key, "inner" if how == "left" else how)
    light = left.join(listed, key, "left_anti").join(right.where(F.col(n) <= limit).drop(n), key, how)
    return heavy.unionByName(light)


def flags(numbers: DataFrame, column: str, size: int) -> np.ndarray:
    """size booleans: which of the remainders 0..size-1 (a power of two) the numbers of a column have.

    A filter of fixed size for a later pass: the bits are set in partial
    aggregates, and size / 8 bytes reach the driver whatever the table holds.
    Nulls set none.
    """
    at = F.col(column).bitwiseAND(F.lit(size - 1)) + 1  # the functions below count from 1
    rows = numbers.where(F.col(column).isNotNull()).groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(size, bool)
    width = 1 << 15
    for r in rows.toLocalIterator():
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little").astype(bool)
        begin = (r["k"] - 1) * width
        out[begin : begin + width] = bits[: max(0, size - begin)]
    return out
