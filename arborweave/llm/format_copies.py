"""Records that are equal but for how they are written (problem 5).

Progressive partition refinement: classes by cheap invariants (length and
letter histogram), then inside classes of several members by a content hash,
then by content and comment tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborweave.operators.record_keys import one_per_pos
from arborweave.operators.skew import join_counted
from arborweave.session import materialise


def letters(sequence: Column) -> Column:
    """The letters A to Z of a sequence in upper case, in order; '' for null."""
    return F.upper(F.regexp_replace(F.coalesce(sequence, F.lit("")), "[^A-Za-z]", ""))


def tokens(comment: Column) -> Column:
    """The set of comment tokens in one spelling: lower case, sorted, without NumDuplicates."""
    parts = F.split(F.lower(F.coalesce(comment, F.lit(""))), r"[\s,;]+")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda x: (x != "") & ~x.rlike(r"^numduplicates(=|$)")))), " ")


def invariants(text: Column) -> Column:
    """One number from the length and the counts of the commonest letters of a stripped text."""
    size = F.length(text)
    return F.xxhash64(size, *(size - F.length(F.replace(text, F.lit(x), F.lit(""))) for x in "ACGT"))


def refine(rows: DataFrame, key: str, total: int) -> DataFrame:
    """The rows whose class by `key` has at least two different pos.

    The classes are found by a partial aggregate (no class is gathered), and
    heavy ones are joined by broadcast.
    """
    classes = rows.groupBy(key).agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.count("*").alias("n")).where(F.col("a") < F.col("b"))
    return join_counted(rows, classes.select(key, "n"), [key], "n", total, "left_semi")


def members(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((keep_pos, pos) for each record that has copies, all records in narrow form).

    Two records are copies if the letters A to Z of their sequences are equal
    in upper case and in order and their comments hold the same tokens
    (whatever order, case and separators, without NumDuplicates). keep_pos is
    the smallest pos of the group. Repeated deliveries of a pos are one
    record, rows without pos are none. A null or empty sequence has no
    letters, so that such records are copies if their tokens agree; a null
    comment has no tokens.
    """
    read = records.where(F.col("pos").isNotNull()).select("pos", "comment", "num_duplicates", "loaded_at", letters(F.col("sequence")).alias("__text"))
    read = read.withColumn("k0", invariants(F.col("__text")))
    narrow = materialise(one_per_pos(read).drop("loaded_at"), "narrow")
    total = narrow.count()
    rows = refine(narrow.select("pos", "comment", "__text", "k0"), "k0", total)
    # the content is hashed only in classes of several members
    content = F.unhex(F.md5("__text"))
    rows = refine(materialise(rows.select("pos", "comment", content.alias("k1")), "contents"), "k1", total)
    # and the comment is taken apart only where the contents agree
    rows = materialise(rows.select("pos", F.unhex(F.md5(F.concat(F.col("k1"), tokens(F.col("comment")).cast("binary")))).alias("k2")), "classes")
    groups = rows.groupBy("k2").agg(F.min("pos").alias("keep_pos"), F.count("*").alias("n")).where(F.col("n") > 1)
    return join_counted(rows, groups, ["k2"], "n", total).select("keep_pos", "pos"), narrow


def found(records: DataFrame) -> DataFrame:
    """(keep_pos, copy_pos): each record that is a copy, with the one that is kept."""
    return members(records)[0].where("pos <> keep_pos").select("keep_pos", F.col("pos").alias("copy_pos"))


def collapsed(records: DataFrame) -> DataFrame:
    """(keep_pos, n_copies, sum_duplicates): one row per group of copies, single records included.

    A missing or 0 num_duplicates counts as 1.
    """
    grouped, narrow = members(records)
    rows = narrow.select("pos", F.when(F.col("num_duplicates") != 0, F.col("num_duplicates")).otherwise(1).alias("d")).join(grouped, "pos", "left")
    return rows.groupBy(F.coalesce("keep_pos", "pos").alias("keep_pos")).agg(F.count("*").alias("n_copies"), F.sum("d").alias("sum_duplicates"))
