"""Counts of records per tag and per placement node (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborweave.operators.skew import aggregate_skewed
from arborweave.session import materialise

#: Parts the field from the key in the combined grouping key; occurs in neither.
PART = "\u0001"


def one_per_pos(records: DataFrame, order: str = "loaded_at") -> DataFrame:
    """One row for each pos: of repeated deliveries the first by `order`.

    Deliveries of equal time keep either (they are equal rows). Rows with a
    null pos can't be identified with one another and all stay. Every column
    of records travels, so callers pass only those they need.
    """
    rest = [c for c in records.columns if c != "pos"]
    first = F.min_by(F.struct(*rest), F.struct(F.col(order).isNull(), F.col(order)))
    alone = F.when(F.col("pos").isNull(), F.monotonically_increasing_id())
    return records.withColumn("__alone", alone).groupBy("pos", "__alone").agg(first.alias("r")).select("pos", "r.*")


def keyed_records(records: DataFrame) -> DataFrame:
    """(pos, key, num_duplicates, read_at): one row for each key a record names.

    key is field, PART, value. A tid counts without surrounding blanks;
    node_to_align is divided at runs of blanks and each different node counts
    once. Null, empty and blank values give no rows.
    """
    tid = F.regexp_replace(F.coalesce("tid", F.lit("")), r"^[ \t]+|[ \t]+$", "")
    nodes = F.array_distinct(F.split(F.coalesce("node_to_align", F.lit("")), r"\s+"))
    keys = F.concat(
        F.when(tid != "", F.array(F.concat(F.lit("tid" + PART), tid))).otherwise(F.array().cast("array<string>")),
        F.transform(F.filter(nodes, lambda x: x != ""), lambda x: F.concat(F.lit("node_to_align" + PART), x)),
    )
    return records.select("pos", F.explode(keys).alias("key"), "num_duplicates", "read_at")


def per_key(records: DataFrame, share: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """((field, heavy_key, n_records, sum_duplicates, last_read_at) for every key, all records).

    Each record (pos) counts once. sum_duplicates takes null as 0;
    last_read_at is null if no record of the key has a time.
    """
    once = materialise(one_per_pos(records.select("pos", "tid", "node_to_align", "num_duplicates", "read_at", "loaded_at")).drop("loaded_at"), "records")
    result = aggregate_skewed(keyed_records(once), "key", [("n_records", "count", "*"), ("sum_duplicates", "sum", "num_duplicates"), ("last_read_at", "max", "read_at")], share)
    return (
        result.select(
            F.substring_index("key", PART, 1).alias("field"),
            F.expr(f"substring(key, instr(key, '{PART}') + 1)").alias("heavy_key"),
            "n_records",
            F.coalesce("sum_duplicates", F.lit(0)).alias("sum_duplicates"),
            "last_read_at",
        ),
        once,
    )


def found(records: DataFrame, share: float = 0.04) -> DataFrame:
    """(field, heavy_key): keys that at least `share` of all records name."""
    keys, once = per_key(records)
    total = once.count()  # from the footers of the written table
    return keys.where(F.col("n_records") >= share * total).select("field", "heavy_key")
