"""Operators on alignments in long form: one row (group, row_id, col, symbol) per cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborweave.functions import packed

# Base sets as bit masks, A=1 C=2 G=4 T=8, in the order of the public one-letter codes. Fixed values.
IUPAC = {"A": 1, "C": 2, "G": 4, "T": 8, "R": 5, "Y": 10, "M": 3, "K": 12, "W": 9, "S": 6, "B": 14, "D": 13, "H": 11, "V": 7, "N": 15}
LETTER = {mask: letter for letter, mask in IUPAC.items()}


def mask_of(symbol: Column) -> Column:
    """The base set of a symbol; 0 for a gap or an unknown one."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in IUPAC.items() for x in kv)), F.upper(symbol)), F.lit(0))


def letter_of(mask: Column) -> Column:
    """The symbol of a base set; - for the empty one."""
    return F.substring(F.lit("-" + "".join(LETTER[m] for m in range(1, 16))), mask + 1, F.lit(1))


def cells(rows: DataFrame, text: str = "sequence", shift: str | None = None) -> DataFrame:
    """One row per symbol of `text`, with col from 0 (or from the value of shift); other columns stay. Null and empty texts give none."""
    n = F.length(text)
    out = rows.where(n > 0).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("col")).withColumn("symbol", F.expr(f"substring({text}, col + 1, 1)"))
    return (out.withColumn("col", F.col("col") + F.col(shift)) if shift else out).drop(text)


def column_counts(long: DataFrame, group: str = "group", weight: Column | None = None) -> DataFrame:
    """(group, col, a, c, g, t, n): weighted base counts of each column; an ambiguity code adds to each of its bases.

    Partial sums are formed before the shuffle, so a column of very many rows is no hot spot.
    """
    m = mask_of(F.col("symbol"))
    w = weight if weight is not None else F.lit(1)
    sums = [F.sum(F.when(m.bitwiseAND(F.lit(1 << i)) != 0, w).otherwise(0)).alias(b) for i, b in enumerate("acgt")]
    return long.groupBy(group, "col").agg(*sums, F.sum(F.when(F.col("symbol") != "-", w).otherwise(0)).alias("n"))


_MASKS = np.zeros(256, np.uint8)
for _letter, _mask in IUPAC.items():
    _MASKS[ord(_letter)] = _mask


def _count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, weight, shift, text) -> partial counts per group and column of parts of a batch, which are bounded by letters."""
    for batch in (part for whole in batches for part in packed.parts(whole, 3)):
        letters, offsets = packed.letters_of(batch.column(3))
        size = np.diff(offsets)
        names = batch.column(0).dictionary_encode()
        of, weight, shift = names.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
        cell = np.repeat(of.astype(np.int64) << 40, size) | (np.arange(len(letters)) - np.repeat(offsets[:-1] - shift, size))
        w = np.repeat(weight, size)
        keys, at = np.unique(cell, return_inverse=True)
        mask = _MASKS[letters]

        def total(on: np.ndarray, keys: np.ndarray = keys, at: np.ndarray = at, w: np.ndarray = w) -> pa.Array:
            out = np.zeros(len(keys), np.int64)
            np.add.at(out, at[on], w[on])
            return pa.array(out)

        sums = [total(mask & (1 << i) != 0) for i in range(4)]
        yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(keys >> 40)), pa.array((keys & ((1 << 40) - 1)).astype(np.int32)), *sums, total(letters != ord("-"))], ["group", "col", "a", "c", "g", "t", "n"])


def row_counts(rows: DataFrame, text: str = "sequence", weight: Column | None = None, shift: str | None = None) -> DataFrame:
    """column_counts() of whole rows (group, text), without a row per letter.

    Each batch of rows is counted by numpy, and one row per group and column
    of the batch is shuffled, summed before by Spark's partial aggregate. Null
    and empty texts count nowhere; weights are whole numbers.
    """
    w = (weight if weight is not None else F.lit(1)).cast("long")
    at = F.col(shift).cast("long") if shift else F.lit(0).cast("long")
    given = rows.where(F.length(text) > 0).select(F.col("group").cast("string").alias("group"), w.alias("w"), at.alias("at"), _ascii(F.col(text)).alias("text")).dropna()
    partial = given.mapInArrow(_count_letters, "group string, col int, a long, c long, g long, t long, n long")
    return partial.groupBy("group", "col").agg(*(F.sum(c).alias(c) for c in ("a", "c", "g", "t", "n")))


def consensus(counted: DataFrame, least: Column | int = 1) -> DataFrame:
    """counted plus symbol: the base of the highest count, or the code of all bases that tie for it; - below `least`."""
    top = F.greatest("a", "c", "g", "t")
    mask = sum((F.when(F.col(b) == top, 1 << i).otherwise(0) for i, b in enumerate("acgt")), F.lit(0))
    return counted.withColumn("symbol", F.when((top <= 0) | (F.col("n") < (least if isinstance(least, Column) else F.lit(least))), "-").otherwise(letter_of(mask)))


def consensus_minimum(weighted_rows: Column, least: int = 5, share: float = 0.5) -> Column:
    """The count a column needs to be called: the larger of least and the whole part of share of the rows."""
    return F.greatest(F.lit(least), F.floor(weighted_rows * share).cast("int"))


def to_rows(long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sequence): the cells of each row put together in the order of col; rows are bounded by the alignment's length."""
    return long.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "symbol"))), lambda x: x["symbol"]), "").alias("sequence"))


def without_gap_columns(long: DataFrame, group: str = "group") -> DataFrame:
    """long without the columns in which every row has a gap; columns keep their numbers."""
    live = long.groupBy(group, "col").agg(F.max((F.col("symbol") != "-").cast("int")).alias("live")).where("live = 1").drop("live")
    return long.join(live, [group, "col"], "left_semi")


def span_of(long: DataFrame, group: str = "group", margin: int = 15) -> DataFrame:
    """(group, first, last): the columns around the non-gap cells, widened by margin on both sides (not below 0)."""
    return long.where("symbol <> '-'").groupBy(group).agg(F.greatest(F.lit(0), F.min("col") - margin).alias("first"), (F.max("col") + margin).alias("last"))


def overlap_identity(pairs: DataFrame, a: str = "a", b: str = "b", key: str = "id") -> DataFrame:
    """(key, overlap, identity): of two aligned rows, aligned sites over the length of a, and equal ones over the aligned.

    Symbols compare in upper case. 0 where nothing is aligned; null texts give no rows.
    """
    x, y = (F.split(F.upper(c), "") for c in (a, b))
    both = F.zip_with(x, y, lambda p, q: F.when(~p.isin("-", "") & ~q.isin("-", ""), F.when(p == q, 2).otherwise(1)).otherwise(0))
    size = F.length(F.replace(F.col(a), F.lit("-"), F.lit("")))
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(key, size.alias("size"), both.alias("both"))
    aligned = F.size(F.filter("both", lambda v: v > 0))
    equal = F.size(F.filter("both", lambda v: v == 2))
    return rows.select(key, F.when(F.col("size") > 0, aligned / F.col("size")).otherwise(0.0).alias("overlap"), F.when(aligned > 0, equal / aligned).otherwise(0.0).alias("identity"))


def _ascii(text: Column) -> Column:
    """Upper case, with one ? for each character outside of ASCII, so that letters are bytes."""
    return F.regexp_replace(F.upper(text), r"[^\x00-\x7F]", "?")


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, parent, child) -> the events of each pair, by numpy over the letters of a whole batch."""
    for batch in batches:
        p, p_at = packed.letters_of(batch.column(1))
        c, c_at = packed.letters_of(batch.column(2))
        size = np.minimum(np.diff(p_at), np.diff(c_at))
        x, y = p[packed.spread(p_at[:-1], size)], c[packed.spread(c_at[:-1], size)]
        row = np.repeat(np.arange(len(size)), size)
        col = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + 1
        gap = np.uint8(ord("-"))
        live = (x != gap) | (y != gap)  # columns in which both have gaps neither count nor break a run
        x, y, row, col = x[live], y[live], row[live], col[live]
        kind = np.where(x == gap, 1, np.where(y == gap, 2, np.where(x != y, 3, 0)))
        change = np.ones(len(kind), bool)
        change[1:] = (kind[1:] != kind[:-1]) | (row[1:] != row[:-1]) | (kind[1:] == 3)
        first = np.flatnonzero(change)
        last = np.append(first[1:], len(kind)) - 1
        keep = kind[first] > 0
        first, last = first[keep], last[keep]
        what, none = kind[first], kind[first] != 3
        names = pa.array(["same", "insertion", "deletion", "substitution"])
        one = np.ones(len(first), np.int64)
        states = [pa.array(packed.strings(v, first, one).to_numpy(zero_copy_only=False), pa.string(), mask=none) for v in (x, y)]
        columns = [batch.column(0).take(pa.array(row[first])), names.take(pa.array(what)), pa.array(col[first], pa.int32()), pa.array(col[last], pa.int32()), *states]
        yield pa.RecordBatch.from_arrays(columns, ["k", "kind", "start", "end", "from_state", "to_state"])


def branch_events(pairs: DataFrame, key: str = "branch") -> DataFrame:
    """(branch, kind, start, end, from_state, to_state) between aligned rows parent and child of one branch.

    substitution: both have different residues in a column; insertion and
    deletion: maximal runs where only the child or only the parent has one
    (columns where both have gaps neither count nor break a run). Columns
    count from 1, the longer row's surplus doesn't count. A run that lasts to
    the end is reported as well. Null texts give no rows. Each pair is read
    where it lies: nothing is shuffled.
    """
    rows = pairs.where("parent IS NOT NULL AND child IS NOT NULL").select(F.col(key).alias("k"), _ascii(F.col("parent")).alias("p"), _ascii(F.col("child")).alias("c"))
    kind = dict(rows.dtypes)["k"]
    return rows.mapInArrow(_events, f"k {kind}, kind string, start int, end int, from_state string, to_state string").withColumnRenamed("k", key)


def shifts(events: DataFrame) -> DataFrame:
    """(branch, column_, shift): for each insertion of a branch, by how many columns what follows has moved in the parent.

    A window over the insertions of one branch, which are bounded by the row's length.
    """
    rows = events.where("kind = 'insertion'").select("branch", "start", (F.col("end") - F.col("start") + 1).alias("n"))
    return rows.select("branch", F.col("start").alias("column_"), F.sum("n").over(Window.partitionBy("branch").orderBy("start")).alias("shift"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p, p_at = packed.letters_of(batch.column(1))
        c, c_at = packed.letters_of(batch.column(2))
        size = np.minimum(np.diff(p_at), np.diff(c_at))
        first = np.cumsum(size) - size
        sides = [v[packed.spread(at[:-1], size)] != ord("-") for v, at in ((p, p_at), (c, c_at))]
        row = np.repeat(np.arange(len(size)), size)
        totals = [np.concatenate([[0], np.cumsum(x)]) for x in sides]
        at = np.flatnonzero(sides[0] != sides[1])
        numbers = [pa.array(t[at + 1] - t[first[row[at]]], pa.int32()) for t in totals]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[at])), pa.array(at - first[row[at]] + 1, pa.int32()), *numbers], ["k", "col", "left_site", "right_site"])


def running_sites(pairs: DataFrame, key: str = "branch") -> DataFrame:
    """(branch, col, left_site, right_site): the last site of the parent and of the child up to each column in which only one has a residue.

    Columns and sites count from 1, 0 before the first. Null texts give no rows.
    """
    rows = pairs.where("parent IS NOT NULL AND child IS NOT NULL").select(F.col(key).alias("k"), _ascii(F.col("parent")).alias("p"), _ascii(F.col("child")).alias("c"))
    return rows.mapInArrow(_running, f"k {dict(rows.dtypes)['k']}, col int, left_site int, right_site int").withColumnRenamed("k", key)


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p, p_at = packed.letters_of(batch.column(1))
        c, c_at = packed.letters_of(batch.column(2))
        size = np.minimum(np.diff(p_at), np.diff(c_at))
        x, y = p[packed.spread(p_at[:-1], size)], c[packed.spread(c_at[:-1], size)]
        mark = np.where((x == ord("-")) | (y == ord("-")), np.uint8(ord("-")), np.where(x == y, np.uint8(ord("1")), np.uint8(ord("0"))))
        yield pa.RecordBatch.from_arrays([batch.column(0), packed.strings(mark, np.cumsum(size) - size, size)], ["k", "identity"])


def identity_vectors(pairs: DataFrame, a: str = "a", b: str = "b", key: str = "id") -> DataFrame:
    """(key, identity): a sign for each column of two aligned rows, 1 where they agree (case apart), 0 where not, - where either has a gap."""
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(key).alias("k"), _ascii(F.col(a)).alias("a"), _ascii(F.col(b)).alias("b"))
    return rows.mapInArrow(_agreement, f"k {dict(rows.dtypes)['k']}, identity string").withColumnRenamed("k", key)


def pair_distances(triples: DataFrame, key: str = "id") -> DataFrame:
    """(key, d_ps, d_pq, d_sq): shares of differing columns between the aligned rows parent, sister and query, over columns all three have."""
    x, y, z = (F.split(F.upper(c), "") for c in ("parent", "sister", "query"))
    cols = F.filter(F.arrays_zip(x.alias("p"), y.alias("s"), z.alias("q")), lambda v: ~v["p"].isin("-", "") & ~v["s"].isin("-", "") & ~v["q"].isin("-", ""))
    rows = triples.dropna(subset=["parent", "sister", "query"]).select(key, cols.alias("v"))
    n = F.size("v")

    def differ(a: str, b: str) -> Column:
        return F.when(n > 0, F.size(F.filter("v", lambda c: c[a] != c[b])) / n).otherwise(0.0)

    return rows.select(key, differ("p", "s").alias("d_ps"), differ("p", "q").alias("d_pq"), differ("s", "q").alias("d_sq"))


def three_point(distances: DataFrame, old: Column) -> DataFrame:
    """distances plus to_parent, to_sister, to_query: branch lengths from the inner point, the first two rescaled to add up to `old`."""
    p = F.greatest(F.lit(0.0), (F.col("d_ps") + F.col("d_pq") - F.col("d_sq")) / 2)
    s = F.greatest(F.lit(0.0), (F.col("d_ps") + F.col("d_sq") - F.col("d_pq")) / 2)
    q = F.greatest(F.lit(0.0), (F.col("d_pq") + F.col("d_sq") - F.col("d_ps")) / 2)
    total = p + s
    return distances.withColumns({"to_parent": F.when(total > 0, p / total * old).otherwise(old / 2), "to_sister": F.when(total > 0, s / total * old).otherwise(old / 2), "to_query": q})
