"""Operators on sequence records: names, pairs, runs, reading frames, checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborweave.functions import codons, packed
from arborweave.functions import sequences as S


def number_names(records: DataFrame, mark: str = ".", first_too: bool = False) -> DataFrame:
    """records with repeated names made unique: the n-th copy of x becomes x.n.

    Copies are numbered in the order of pos (rows of equal pos in any order).
    The first copy keeps its name unless first_too (as writers want), in which
    case all copies of a repeated name are numbered from 1. Null names stay.
    """
    # null names, which may be many, are no group
    by = Window.partitionBy("name", F.when(F.col("name").isNull(), F.col("pos")))
    rank = F.row_number().over(by.orderBy("pos"))
    if first_too:
        n = F.count("*").over(by)
        suffix = F.when(n > 1, F.concat(F.lit(mark), rank.cast("string"))).otherwise("")
    else:
        suffix = F.when(rank > 1, F.concat(F.lit(mark), (rank - 1).cast("string"))).otherwise("")
    return records.withColumn("name", F.when(F.col("name").isNotNull(), F.concat("name", suffix)))


def checked_dna(records: DataFrame, gaps: bool = False) -> DataFrame:
    """(pos, sequence, n_acgt, ok): sequences in the DNA alphabet; ok tells that nothing was dropped."""
    kept = S.dna_letters(F.col("sequence"), gaps)
    return records.select("pos", kept.alias("sequence"), S.count_of(kept, "ACGT").alias("n_acgt"), (F.length(kept) == F.length("sequence")).alias("ok"))


def checked_protein(records: DataFrame, gaps: bool = False) -> DataFrame:
    """(pos, sequence, ok): sequences in the protein alphabet; ok tells that nothing was dropped."""
    kept = S.protein_letters(F.col("sequence"), gaps)
    return records.select("pos", kept.alias("sequence"), (F.length(kept) == F.length("sequence")).alias("ok"))


def data_type(records: DataFrame, least: float = 0.9) -> DataFrame:
    """(n_dna, n_amino, is_dna) over all records: DNA if more than `least` of the amino letters are ACGTUN."""
    up = F.upper("sequence")
    sums = records.agg(F.coalesce(F.sum(S.count_of(up, "ACGTUN")), F.lit(0)).alias("n_dna"), F.coalesce(F.sum(S.count_of(up, S.AMINO)), F.lit(0)).alias("n_amino"))
    return sums.select("n_dna", "n_amino", F.when(F.col("n_amino") > 0, F.col("n_dna") / F.col("n_amino") > least).otherwise(False).alias("is_dna"))


def base_frequencies(records: DataFrame) -> DataFrame:
    """(base, n, share) of A, C, G and T over all records, as the model's equilibrium frequencies."""
    kept = S.dna_letters(F.col("sequence"))
    one = records.select(*(S.count_of(kept, b).alias(b) for b in "ACGT")).agg(*(F.coalesce(F.sum(b), F.lit(0)).alias(b) for b in "ACGT"))
    total = F.col("A") + F.col("C") + F.col("G") + F.col("T")
    rows = F.array(*(F.struct(F.lit(b).alias("base"), F.col(b).alias("n"), F.when(total > 0, F.col(b) / total).alias("share")) for b in "ACGT"))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def homopolymers(records: DataFrame, least: int = 2) -> DataFrame:
    """(pos, base, start, length): runs of at least `least` equal letters; starts count from 0."""
    runs = F.regexp_extract_all(F.upper("sequence"), F.lit(r"(?s)((.)\2*)"), F.lit(1))
    # the running start is the sum of the lengths before
    acc = F.aggregate(
        runs,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,base:string,length:int>>").alias("out")),
        lambda a, r: F.struct(
            (a["at"] + F.length(r)).alias("at"),
            F.when(F.length(r) >= least, F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), F.substring(r, 1, 1).alias("base"), F.length(r).alias("length"))))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    return records.select("pos", F.explode(acc).alias("r")).select("pos", "r.base", "r.start", "r.length")


def _open_stretches(least: int, least_share: float, code: str):
    amino = np.frombuffer((code + "X").encode(), np.uint8)
    digit = np.full(256, 4, np.uint8)
    digit[np.frombuffer(codons.BASES.encode(), np.uint8)] = np.arange(4)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(pos, dna) -> the stretches of the six frames of each row, for a whole batch at once."""
        for batch in batches:
            letters, offsets = packed.letters_of(batch.column(1))
            forward = digit[letters].astype(np.int64)
            # bases stand in the order TCAG, so the complement of a digit is two further
            backward = np.where(forward < 4, forward ^ 2, 4)[::-1]
            n_rows, size = len(offsets) - 1, np.diff(offsets)
            for sign, digits, begin, width, of in ((1, forward, offsets[:-1], size, np.arange(n_rows)), (-1, backward, len(letters) - offsets[:0:-1], size[::-1], np.arange(n_rows)[::-1])):
                for f in range(3):
                    n = np.maximum(width - f, 0) // 3
                    row = np.repeat(np.arange(n_rows), n)
                    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    at = begin[row] + f + 3 * nth
                    if not len(at):
                        continue
                    a, b, c = digits[at], digits[at + 1], digits[at + 2]
                    protein = amino[np.where((a < 4) & (b < 4) & (c < 4), 16 * a + 4 * b + c, 64)]
                    open_ = protein != ord("X")
                    first, last = open_.copy(), open_.copy()
                    first[1:] &= ~(open_[:-1] & (row[1:] == row[:-1]))
                    last[:-1] &= ~(open_[1:] & (row[1:] == row[:-1]))
                    first, last = np.flatnonzero(first), np.flatnonzero(last)
                    length = last - first + 1
                    keep = (length >= least) & (length >= least_share * n[row[first]])
                    first, length = first[keep], length[keep]
                    begins = f + 1 + 3 * nth[first]
                    ends = begins + 3 * length - 1
                    total = width[row[first]]
                    start, stop = (begins, ends) if sign > 0 else (total - ends + 1, total - begins + 1)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(of[row[first]])), pa.array(np.full(len(first), sign * (f + 1), np.int32)), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), packed.strings(protein, first, length)],
                        ["pos", "frame", "orf_start", "orf_end", "translation"],
                    )

    return find


def frames(records: DataFrame, least: int = 50, least_share: float = 0.0, mitochondrial: bool = False) -> DataFrame:
    """(pos, frame, orf_start, orf_end, translation): open stretches of the six frames.

    Frames 1 to 3 read forwards from that base, -1 to -3 the reverse
    complement; a stretch lies between stops and unknown codons and has at
    least `least` amino acids (1 if that is less) and that share of the
    frame's codons. Coordinates count from 1 on the forward strand, ends
    included. Sequences are read upper-case, without gaps, U as T; null and
    empty ones give no rows. A long sequence is read once, whatever it holds.
    """
    rows = records.where(F.col("sequence").isNotNull()).select("pos", S.dna_letters(F.col("sequence")).alias("dna"))
    schema = f"pos {dict(rows.dtypes)['pos']}, frame int, orf_start int, orf_end int, translation string"
    return rows.mapInArrow(_open_stretches(max(1, least), least_share, codons.code(mitochondrial)), schema)


def paired(records: DataFrame) -> DataFrame:
    """(name, pos_1, pos_2, sequence): x/1 joined with x/2 as x/p12, the sequences around the break mark 0.

    Each first read meets each second read of its stem that comes later (by
    pos). Null names and sequences pair with nothing.
    """
    stem = F.regexp_extract("name", r"^(.*)/[12]$", 1)
    read = F.regexp_extract("name", r"/([12])$", 1)
    rows = records.where("name IS NOT NULL AND sequence IS NOT NULL").select(stem.alias("stem"), read.alias("read"), "pos", "sequence").where("stem <> ''")
    a = rows.where("read = '1'").select("stem", F.col("pos").alias("pos_1"), F.col("sequence").alias("s1"))
    b = rows.where("read = '2'").select("stem", F.col("pos").alias("pos_2"), F.col("sequence").alias("s2"))
    return a.join(b, "stem").where("pos_1 < pos_2").select(F.concat("stem", F.lit("/p12")).alias("name"), "pos_1", "pos_2", F.concat("s1", F.lit("0"), "s2").alias("sequence"))


def read_order(records: DataFrame, by: str) -> DataFrame:
    """(pos, place): the stable order of reads by score, length or copies, descending; pos decides ties.

    Nulls come last. One global order, by range partitioning and per-partition offsets; no single task sees all rows.
    """
    key = {"score": F.coalesce("node_score", F.lit(float("-inf"))), "length": F.coalesce(F.length("sequence"), F.lit(-1)), "copies": F.coalesce("num_duplicates", F.lit(-1))}[by]
    return global_rank(records.select("pos", key.alias("key")), [F.col("key").desc(), F.col("pos")]).select("pos", "place")


def global_rank(rows: DataFrame, order: list) -> DataFrame:
    """rows plus place, their position from 1 in a total order.

    Rows are range-partitioned and sorted, counted per partition, and
    numbered from the partition's offset; the order must leave no ties.
    """
    from arborweave.session import materialise

    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__n", F.monotonically_increasing_id())
    placed = materialise(placed.select("*", F.shiftright("__n", 33).cast("int").alias("__p")), "ranked")
    counts = {r["__p"]: r["n"] for r in placed.groupBy("__p").agg(F.count("*").alias("n")).collect()}  # one number per partition
    offset, pairs = 0, []
    for p in sorted(counts):
        pairs.append((p, offset))
        offset += counts[p]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(pairs, "__p int, __o long"))
    local = F.col("__n") - F.shiftleft(F.col("__p").cast("long"), 33) + 1
    return placed.join(offsets, "__p").withColumn("place", local + F.col("__o")).drop("__n", "__p", "__o")


def reconcile(names: DataFrame, leaves: DataFrame) -> DataFrame:
    """(n_matched, n_leaves_without, n_names_without): how the names of records and of leaves agree; null names count nowhere."""
    a = names.select("name").dropna().distinct().withColumn("in_records", F.lit(1))
    b = leaves.select("name").dropna().distinct().withColumn("in_tree", F.lit(1))
    both = a.join(b, "name", "full")
    n = lambda c: F.count(F.when(c, 1))
    return both.agg(
        n(F.col("in_records").isNotNull() & F.col("in_tree").isNotNull()).alias("n_matched"), n(F.col("in_records").isNull()).alias("n_leaves_without"), n(F.col("in_tree").isNull()).alias("n_names_without")
    )
