"""Operators on local hits: parsing, merging, ranking, seeds and anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborweave.functions import packed
from arborweave.operators.skew import flags, heavy_keys, join_skewed
from arborweave.session import materialise

#: Places of the filter of k-mers; where it fills up it only lets more pass.
FILTER = 1 << 24
#: query q_start q_end q_strand target t_start t_end t_strand score
SUGAR = r"^(?:sugar|vulgar):\s+(\S+)\s+(\d+)\s+(\d+)\s+([-+.])\s+(\S+)\s+(\d+)\s+(\d+)\s+([-+.])\s+(-?\d+)"


def parse_hits(lines: DataFrame, line: str = "value") -> DataFrame:
    """Hits of sugar or vulgar lines; lines of other forms and nulls give no rows."""
    g = [F.regexp_extract(line, SUGAR, i) for i in range(1, 10)]
    return lines.where(F.col(line).rlike(SUGAR)).select(
        g[0].alias("query"), g[4].alias("target"), g[8].cast("int").alias("score"), g[1].cast("int").alias("q_start"), g[2].cast("int").alias("q_end"), g[3].alias("q_strand"), g[5].cast("int").alias("t_start"), g[6].cast("int").alias("t_end"), g[7].alias("t_strand")
    )


def sugar_line(target: str = "node") -> Column:
    """The sugar line of a hit; null if a field is."""
    parts = [F.lit("sugar:"), *(F.col(c).cast("string") for c in ("query", "q_start", "q_end", "q_strand", target, "t_start", "t_end", "t_strand", "score"))]
    return F.concat(*(x for i, p in enumerate(parts) for x in ((p,) if i == 0 else (F.lit(" "), p))))


def merge_hits(hits: DataFrame, target: str = "node") -> DataFrame:
    """One row per query and target: the hits of the better strand pair joined into one.

    Per strand pair scores are summed and the coordinates spanned. The pair
    of higher score stays; ties go to the smaller strand pair in byte order,
    so the result doesn't depend on the order of arrival. Exact repeats of a
    hit count once; rows with a null query, target or score don't count.
    """
    keys = ["query", target, "q_strand", "t_strand"]
    rows = hits.select(*keys, "score", "q_start", "q_end", "t_start", "t_end", *(["run_at"] if "run_at" in hits.columns else [])).where(f"query IS NOT NULL AND {target} IS NOT NULL AND score IS NOT NULL").distinct()
    low, high = lambda a, b: F.least(a, b), lambda a, b: F.greatest(a, b)
    merged = rows.groupBy(*keys).agg(
        F.sum("score").alias("score"), F.min(low("q_start", "q_end")).alias("q_start"), F.max(high("q_start", "q_end")).alias("q_end"), F.min(low("t_start", "t_end")).alias("t_start"), F.max(high("t_start", "t_end")).alias("t_end")
    )
    strands = F.concat(F.coalesce("q_strand", F.lit("")), F.coalesce("t_strand", F.lit("")))
    best = Window.partitionBy("query", target).orderBy(F.col("score").desc(), strands)
    return merged.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")


def keep_best(merged: DataFrame, k: int | None = 10, above: float | None = None, target: str = "node") -> DataFrame:
    """The hits of each query that are among its k best, or that exceed a share of its best score.

    Ties at the k-th place go to the smaller target. Expects one row per
    query and target (see merge_hits); for raw hits with very large queries
    the grouped top-N operator is the scalable way.
    """
    if above is not None:
        best = merged.groupBy("query").agg(F.max("score").alias("best"))
        return join_skewed(merged, best, "query").where(F.col("score") > above * F.col("best")).select(*merged.columns)
    # the window keeps k rows per query on each side of the shuffle (a group limit), so a hot query is small in it
    by = Window.partitionBy("query")
    return merged.withColumn("rank", F.row_number().over(by.orderBy(F.col("score").desc(), target))).where(F.col("rank") <= k)


def best_with_ties(merged: DataFrame, target: str = "node", one_only: bool = False) -> DataFrame:
    """(query, target, score): all targets of the best score of each query, or with one_only the last of them in byte order."""
    best = merged.groupBy("query").agg(F.max("score").alias("best"))
    rows = join_skewed(merged, best, "query").where("score = best").select("query", target, "score")
    return rows.groupBy("query", "score").agg(F.max(target).alias(target)).select("query", target, "score") if one_only else rows


def accepted(rows: DataFrame, least_overlap: float = 0.5, least_identity: float = 0.5) -> DataFrame:
    """Rows whose overlap and identity both exceed their limits."""
    return rows.where((F.col("overlap") > least_overlap) & (F.col("identity") > least_identity))


def _windows(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, row, at, code) of every window of k letters; at counts from the row's start."""
    letters, offsets = packed.letters_of(texts)
    code = packed.window_codes(letters, k)
    start = np.flatnonzero(packed.inside(offsets, k, len(letters))) if len(code) else np.zeros(0, np.int64)
    row = np.searchsorted(offsets, start, "right") - 1
    return letters, row, start - offsets[row], code[start]


def _row_kmers(k: int, passing=None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, text) -> (id, code), different codes of a row once."""
        for batch in batches:
            _, row, _, code = _windows(batch.column(1), k)
            code = packed.mixed(code)
            if passing is not None:
                bits = passing.value
                ok = bits[(code & np.uint64(len(bits) - 1)).astype(np.int64)]
                row, code = row[ok], code[ok]
            order = np.lexsort((code, row))
            row, code = row[order], code[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[new])), pa.array(code[new].view(np.int64))], ["id", "code"])

    return rows


def kmers(records: DataFrame, k: int, passing=None) -> DataFrame:
    """(id, code): the different windows of k letters of each record (id, text), as 64-bit codes.

    passing: a broadcast filter (see flags()) that leaves out codes it doesn't
    hold. Codes of up to 12 letters A to Z are one to one, longer ones are hashes.
    Null and shorter texts give no rows; ids are taken to be unique.
    """
    text = F.regexp_replace("text", r"[^\x00-\x7F]", "?")
    rows = records.where(F.length("text") >= k).select("id", text.alias("text"))
    return rows.mapInArrow(_row_kmers(k, passing), f"id {dict(rows.dtypes)['id']}, code long")


def _runs(k: int, m: int, buckets: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, text) -> (bucket, id, piece): neighbouring windows of k letters with the same smallest part of m letters travel as one piece."""
        for batch in batches:
            letters, offsets = packed.letters_of(batch.column(1))
            start = np.flatnonzero(packed.inside(offsets, k, len(letters)))
            key = packed.sliding_min(packed.mixed(packed.window_codes(letters, m)), k - m + 1)[start]
            row = np.searchsorted(offsets, start, "right") - 1
            new = np.ones(len(start), bool)
            new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            at = np.flatnonzero(new)
            length = np.diff(np.append(at, len(start))) + k - 1
            bucket = (packed.mixed(key[at]) % np.uint64(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column(0).take(pa.array(row[at])), packed.strings(letters, start[at], length)], ["bucket", "id", "piece"])

    return cut


def _heads(k: int):
    def count(pieces: pa.Table) -> pa.Table:
        """The pieces of a bucket -> (id, head, c): how many windows of k letters a record shares with the smallest id that has them."""
        _, row, _, code = _windows(pieces.column("piece"), k)
        code, own = packed.mixed(code), pieces.column("id").to_numpy()[row]
        order = np.lexsort((own, code))
        code, own = code[order], own[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (own[1:] != own[:-1])
        code, own = code[new], own[new]
        first = np.ones(len(code), bool)
        first[1:] = code[1:] != code[:-1]
        head = own[first][np.cumsum(first) - 1]
        own, head = own[~first], head[~first]
        order = np.lexsort((head, own))
        own, head = own[order], head[order]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (head[1:] != head[:-1])
        at = np.flatnonzero(new)
        return pa.table({"id": pa.array(own[at], pa.int64()), "head": pa.array(head[at], pa.int64()), "c": pa.array(np.diff(np.append(at, len(own))), pa.int64())})

    return count


def shared_with_first(records: DataFrame, k: int = 24, m: int = 12, bucket: int = 2_000_000) -> DataFrame:
    """(id, head, c): how many different windows of k letters a record (id, text) shares with the record of the smallest id that has them.

    Windows travel in pieces, each with its neighbours of the same smallest
    part, so the shuffle is a few bytes a letter; equal windows have equal
    parts and meet in one bucket of about `bucket` letters. The pieces of one
    part lie in one bucket however many there are. Ids are numbers.
    """
    text = F.regexp_replace("text", r"[^\x00-\x7F]", "?")
    rows = records.where((F.length("text") >= k) & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), text.alias("text"))
    letters = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), letters // bucket)
    pieces = rows.mapInArrow(_runs(k, m, buckets), "bucket int, id long, piece string")
    parts = pieces.groupBy("bucket").applyInArrow(_heads(k), "id long, head long, c long")
    return parts.groupBy("id", "head").agg(F.sum("c").alias("c"))


def _anchors(k: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, row, i, code = _windows(batch.column(1), k)
            y, other, j, wanted = _windows(batch.column(2), k)
            x_at = packed.letters_of(batch.column(1))[1]
            y_at = packed.letters_of(batch.column(2))[1]
            key = packed.mixed(code) ^ packed.mixed(row.astype(np.uint64) + np.uint64(1))
            at = packed.mixed(wanted) ^ packed.mixed(other.astype(np.uint64) + np.uint64(1))
            order = np.argsort(at, kind="stable")
            low, high = np.searchsorted(at[order], key, "left"), np.searchsorted(at[order], key, "right")
            left = np.repeat(np.arange(len(key)), high - low)
            right = order[packed.spread(low, high - low)]
            row, i, j, mate = row[left], i[left], j[right], other[right]
            same = row == mate
            for letter in range(k):  # chance hits of the codes go
                same &= x[x_at[row] + i + letter] == y[y_at[mate] + j + letter]
            row, i, j = row[same], i[same], j[same]
            order = np.lexsort((i, j - i, row))
            row, i, j = row[order], i[order], j[order]
            first = np.ones(len(row), bool)
            first[1:] = (row[1:] != row[:-1]) | ((j - i)[1:] != (j - i)[:-1]) | (i[1:] != i[:-1] + 1)
            at = np.flatnonzero(first)
            length = np.diff(np.append(at, len(row))) + k - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row[at])), pa.array(i[at], pa.int32()), pa.array(j[at], pa.int32()), pa.array(length, pa.int64())], ["id", "start_1", "start_2", "length"]
            )

    return find


def exact_anchors(pairs: DataFrame, k: int = 10) -> DataFrame:
    """(id, start_1, start_2, length): maximal common substrings of at least k letters of text_1 and text_2, per row of pairs.

    Each pair is worked on where it lies: its seeds meet by their codes, and
    seeds that touch on one diagonal are one anchor. Pairs with a null text
    give no rows.
    """
    texts = [F.regexp_replace(c, r"[^\x00-\x7F]", "?").alias(c) for c in ("text_1", "text_2")]
    rows = pairs.where("text_1 IS NOT NULL AND text_2 IS NOT NULL").select("id", *texts)
    return rows.mapInArrow(_anchors(k), f"id {dict(rows.dtypes)['id']}, start_1 int, start_2 int, length long")


def _pooled(k: int):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, firsts, second in zip(b["id"], b["firsts"], b["text_2"], strict=True):
                where: dict[str, list[int]] = {}
                for j in range(len(second) - k + 1):
                    where.setdefault(second[j : j + k], []).append(j)
                diagonals: dict[int, list[int]] = {}
                for first in firsts:
                    for i in range(len(first) - k + 1):
                        for j in where.get(first[i : i + k], ()):
                            diagonals.setdefault(j - i, []).extend([i] * len(firsts))
                for d, seeds in diagonals.items():
                    runs: dict[int, list[int]] = {}
                    for nth, i in enumerate(sorted(seeds)):
                        runs.setdefault(i - nth, []).append(i)
                    out += [(name, x[0], x[0] + d, len(x) + k - 1) for x in runs.values()]
            yield pd.DataFrame(out, columns=["id", "start_1", "start_2", "length"]).astype({"start_1": "int32", "start_2": "int32", "length": "int64"})

    return find


def pooled_anchors(pairs: DataFrame, k: int = 10) -> DataFrame:
    """exact_anchors() of pairs of which several may have one id, with one text_2 and different text_1.

    As SQL that knows pairs by their ids only: the seeds of all pairs of an
    id lie together, each as often as the id has pairs, and an anchor is a
    run of those that a diagonal has in order. Ids of one pair are as in
    exact_anchors().
    """
    texts = [F.regexp_replace(c, r"[^\x00-\x7F]", "?").alias(c) for c in ("text_1", "text_2")]
    rows = pairs.where("text_1 IS NOT NULL AND text_2 IS NOT NULL").select("id", *texts)
    held = materialise(rows.groupBy("id").agg(F.collect_list("text_1").alias("firsts"), F.min("text_2").alias("text_2")), "pairs")
    one = exact_anchors(held.where("size(firsts) = 1").select("id", F.col("firsts")[0].alias("text_1"), "text_2"), k)
    return one.unionByName(held.where("size(firsts) > 1").mapInPandas(_pooled(k), one.schema))


def shared_kmers(left: DataFrame, right: DataFrame, k: int, salts: int = 16) -> DataFrame:
    """(a, b, n): how many different k-mers a record of left shares with one of right (id, text), for searches of few left records.

    Each pair of records that shares a k-mer is a row, so left is a set of
    queries; shared_parts() tells the same of whole tables without pairs.
    The rows of left of a k-mer that many of them hold are spread by a salt.
    """
    x = materialise(kmers(left, k).select(F.col("id").alias("a"), F.col("code").alias("kmer")), "kmers")
    y = kmers(right, k).select(F.col("id").alias("b"), F.col("code").alias("kmer"))
    hot = F.broadcast(heavy_keys(x, "kmer", 0.001).select("kmer", F.lit(True).alias("hot")))
    x = x.join(hot, "kmer", "left").select("a", "kmer", F.when(F.col("hot"), F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int")).otherwise(0).alias("salt"))
    y = y.join(hot, "kmer", "left").select("b", "kmer", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    return x.join(y, ["kmer", "salt"]).groupBy("a", "b").agg(F.count("*").alias("n"))


def shared_parts(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(a, n_kmers, n_shared, n_holders) for each record of left (id, text) that has a k-mer.

    n_kmers: its different k-mers; n_shared: those that a record of right
    holds; n_holders: the records of right that hold them, added up. Right is
    counted per k-mer before the join (by a partial aggregate), so no pair of
    records is ever formed, and k-mers that many records of left hold are
    joined by broadcast. K-mers of right that a filter of fixed size doesn't
    know from left aren't shuffled.
    """
    x = materialise(kmers(left, k).select(F.col("id").alias("a"), "code"), "kmers")
    passing = x.sparkSession.sparkContext.broadcast(flags(x, "code", FILTER))
    held = kmers(right, k, passing).groupBy("code").agg(F.count("*").alias("n"))
    both = join_skewed(x, held, "code", "left")
    return both.groupBy("a").agg(F.count("*").alias("n_kmers"), F.count("n").alias("n_shared"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_holders"))


def chain_anchors(anchors: list[tuple[int, int, int, float]], trim: int = 0) -> list[tuple[int, int, int, float]]:
    """Anchors (start_1, start_2, length, score) that can hold together, in order.

    Trimmed at both ends first. The better ones drive out those that overlap
    them, then along the first sequence a step backwards on the second costs
    the lower score of the two.
    """
    cut = [(a + trim, b + trim, n - 2 * trim, s) for a, b, n, s in anchors if n > 2 * trim]
    kept: list[tuple[int, int, int, float]] = []
    for a, b, n, s in sorted(cut, key=lambda x: (-x[3], x[0], x[1])):
        if all((a + n <= c or c + m <= a) and (b + n <= d or d + m <= b) for c, d, m, _ in kept):
            kept.append((a, b, n, s))
    kept.sort()
    chain: list[tuple[int, int, int, float]] = []
    for x in kept:
        while chain and x[1] < chain[-1][1] + chain[-1][2] and chain[-1][3] < x[3]:
            chain.pop()
        if not chain or x[1] >= chain[-1][1] + chain[-1][2]:
            chain.append(x)
    return chain


def tunnel(chain: list[tuple[int, int, int, float]], n1: int, n2: int, offset: int = 15) -> tuple[list[int], list[int]]:
    """(lowest, highest) position of the second sequence for each of 0..n1 of the first, around a chain of anchors.

    Inside an anchor the path runs on its diagonal; between two anchors
    anything between their ends is open; all widened by offset. What an
    anchor has beyond n1 doesn't count.
    """
    low, high = [0] * (n1 + 1), [n2] * (n1 + 1)
    marks = [(0, 0, 0), *((a, b, n) for a, b, n, _ in chain), (n1, n2, 0)]
    for (a, b, n), (c, d, _) in zip(marks, marks[1:], strict=False):
        for i in range(a, min(a + n, n1 + 1)):
            low[i] = high[i] = b + i - a
        for i in range(a + n, min(c, n1) + 1):
            low[i], high[i] = b + n, d
    around = np.lib.stride_tricks.sliding_window_view
    lowest = around(np.pad(np.array(low), offset, "edge"), 2 * offset + 1).min(1) - offset
    highest = around(np.pad(np.array(high), offset, "edge"), 2 * offset + 1).max(1) + offset
    return np.maximum(0, lowest).tolist(), np.minimum(n2, highest).tolist()


def tunnels(anchors: DataFrame, sizes: DataFrame, trim: int = 5, offset: int = 15) -> DataFrame:
    """(id, n_anchors, coverage) per pair: anchors in the chain and the share of the full matrix inside the tunnel.

    anchors: (id, start_1, start_2, length, score); sizes: (id, n1, n2). A pair without anchors has coverage 1.
    """
    listed = anchors.groupBy("id").agg(F.collect_list(F.struct("start_1", "start_2", "length", "score")).alias("anchors"))  # anchors of one pair

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, n1, n2, got in zip(b["id"], b["n1"], b["n2"], b["anchors"], strict=True):
                chain = chain_anchors([(x["start_1"], x["start_2"], x["length"], x["score"]) for x in got], trim) if got is not None else []
                low, high = tunnel(chain, n1, n2, offset)
                rows.append((i, len(chain), sum(h - x for x, h in zip(low, high, strict=True)) / max(1, (n1 + 1) * n2) if chain else 1.0))
            yield pd.DataFrame(rows, columns=["id", "n_anchors", "coverage"])

    rows = sizes.join(listed, "id", "left").select("id", "n1", "n2", "anchors")
    return rows.mapInPandas(work, f"id {dict(rows.dtypes)['id']}, n_anchors int, coverage double")


def with_records(hits: DataFrame, records: DataFrame, columns: list[str]) -> DataFrame:
    """hits joined with the first record (by pos) of the query's name; hits without one drop out. A heavy query is joined by broadcast."""
    first = records.where("name IS NOT NULL").groupBy(F.col("name").alias("query")).agg(*(F.min_by(c, "pos").alias(f"r_{c}") for c in columns))
    return join_skewed(hits, first, "query")
