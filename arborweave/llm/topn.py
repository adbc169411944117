"""The N best items of every group (problem 3).

Hot-cold split: exact group counts send heavy groups to a range sort that
spreads one group over many tasks, and light groups to an ordinary window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborweave.operators.skew import heavy_limit
from arborweave.session import materialise


def _first_of_runs(group: str, n: int):
    """Keeps the first n rows of each run of equal `group` in sorted batches of one partition."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, had = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(batch.schema.get_field_index(group)).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            values = batch.column(batch.schema.get_field_index(group))
            new = np.ones(len(codes), bool)
            new[1:] = codes[1:] != codes[:-1]
            start = np.maximum.accumulate(np.where(new, np.arange(len(codes)), 0))
            rank = np.arange(len(codes)) - start
            if values[0].as_py() == last:
                rank[start == 0] += had
            last, had = values[-1].as_py(), int(rank[-1]) + 1
            yield batch.filter(pa.array(rank < n))

    return keep


def top_per_group(hits: DataFrame, group: str, item: str, score: str, n: int = 3, least_heavy: int = 1000) -> DataFrame:
    """(group, item, score, rank): the n items of highest score of each group.

    Each item counts once in its group, with its best score. Ties go to the
    item that is smaller in byte order. Rows with a null in group, item or
    score don't count; repeated rows count once; groups of fewer than n
    items give fewer rows; other columns are dropped. A NaN score ranks above
    all others, as in Spark's ordering.

    A group is heavy if it has more items than heavy_limit(all items), which
    at most 4,096 groups can; only their names are broadcast.
    """
    spark = hits.sparkSession
    rows = hits.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).alias("s")).dropna()
    best = materialise(rows.groupBy("g", "i").agg(F.max("s").alias("s")), "best")
    limit = heavy_limit(best.count(), least_heavy)
    names = best.groupBy("g").count().where(F.col("count") > limit).select("g").collect()  # at most 4,096
    order = [F.col("s").desc(), F.col("i")]
    cold, parts = best, []
    if names:
        hot = F.broadcast(spark.createDataFrame(names, best.select("g").schema))
        cold = best.join(hot, "g", "left_anti")
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spread = best.join(hot, "g", "left_semi").repartitionByRange(tasks, F.col("g"), *order).sortWithinPartitions("g", *order)
        parts = [spread.mapInArrow(_first_of_runs("g", n), best.schema)]
    ranked = Window.partitionBy("g").orderBy(*order)
    out = None
    for part in (cold, *parts):
        top = part.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= n)
        out = top if out is None else out.unionByName(top)
    return out.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")


def found(hits: DataFrame) -> DataFrame:
    """(query, node): the three best nodes of each query."""
    return top_per_group(hits, "query", "node", "score", 3).select("query", "node")
