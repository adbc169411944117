"""Evaluation passages inside a corpus (problem 8).

Greedy string tiling: shared runs of SEED words join documents with items;
for each such pair the longest common runs of words are marked, longest
first and without overlap, as found by running Karp-Rabin hashes; what share
of an item is marked tells of passages whose parts were moved, the longest
tile of those that were kept in order.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweave.functions import packed
from arborweave.operators.skew import heavy_limit
from arborweave.session import materialise

SEED = 5
#: Most seeds of items that are sent to every task (8 bytes each and an id); more items go through a shuffled join.
MOST_SEEDS = 2_000_000
#: Most words of items that a task keeps to tile with.
MOST_WORDS = 4_000_000


def words(text: Column) -> Column:
    """Maximal runs of letters or digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _seed_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    v = packed.mixed(values)
    out = v[:n].copy()
    for i in range(1, k):
        out = out * np.uint64(0x100000001B3) + v[i : n + i]
    return packed.mixed(out)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list<long> column without nulls."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def tiles(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in text, start in item, length): the greedy tiling of two word sequences.

    Equal runs of at least `least` words, the longest first, the earlier in
    text and then in item among equal lengths; no word is in two tiles.
    """
    # running hashes of both sides; equal hashes are compared by word, so none is a chance hit
    a, b = _seed_hashes(text, least), _seed_hashes(item, least)
    where: dict[int, list[int]] = defaultdict(list)
    for j, h in enumerate(b.tolist()):
        where[h].append(j)
    runs = []  # a heap: longest first, then earliest in text, then in item
    for i in np.flatnonzero(np.isin(a, b)).tolist():
        for j in where[int(a[i])]:
            if i and j and text[i - 1] == item[j - 1]:
                continue  # within a run that began before
            m = min(len(text) - i, len(item) - j)
            differ = np.flatnonzero(text[i : i + m] != item[j : j + m])
            n = int(differ[0]) if len(differ) else m
            if n >= least:
                runs.append((-n, i, j))
    heapq.heapify(runs)
    in_text, in_item, out = np.zeros(len(text), bool), np.zeros(len(item), bool), []
    while runs:
        n, i, j = heapq.heappop(runs)
        taken = in_text[i : i - n] | in_item[j : j - n]
        if not taken.any():
            out.append((i, j, -n))
            in_text[i : i - n] = True
            in_item[j : j - n] = True
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (~taken).view(np.int8), [0]])))
        for s, e in edges.reshape(-1, 2).tolist():  # what is left of it
            if e - s >= least:
                heapq.heappush(runs, (s - e, i + s, j + s))
    return out


def _tiled(ids: Iterator[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    rows = []
    for doc, item, text, passage in ids:
        found = tiles(text, passage, SEED)
        if found:
            rows.append((doc, item, max(n for _, _, n in found), sum(n for _, _, n in found), len(found), len(passage)))
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.int32()] * 4, strict=True)], ["doc_id", "item_id", "longest", "covered", "n_tiles", "item_words"])


SCHEMA = "doc_id long, item_id long, longest int, covered int, n_tiles int, item_words int"


def _direct(spark: SparkSession, items: list[tuple[int, np.ndarray]]) -> Callable:
    """Tiles documents against items that every executor holds once, as a broadcast of at most a few times MOST_SEEDS numbers."""
    seeds = [_seed_hashes(w, SEED) for _, w in items]
    of = np.repeat(np.arange(len(items)), [len(s) for s in seeds])
    every = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")
    every, of = every[order], of[order]
    # a small table by the hashes' upper bits settles most seeds of a document
    bits = max(10, int(len(every) * 16).bit_length())
    table = np.zeros(1 << bits, bool)
    table[(every >> np.uint64(64 - bits)).astype(np.int64)] = True
    shared = spark.sparkContext.broadcast((items, every, of, bits, table))

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, every, of, bits, table = shared.value
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            values, offsets = _lists(batch.column(1))
            h = _seed_hashes(values, SEED)
            at = np.flatnonzero(table[(h >> np.uint64(64 - bits)).astype(np.int64)])
            low, high = np.searchsorted(every, h[at], "left"), np.searchsorted(every, h[at], "right")
            hit = high > low
            at, low, high = at[hit], low[hit], high[hit]
            row = np.searchsorted(offsets, at, "right") - 1
            inside = at + SEED <= offsets[row + 1]
            row, low, high = row[inside], low[inside], high[inside]
            n = high - low
            pairs = np.unique(np.stack([np.repeat(row, n), of[packed.spread(low, n)]], 1), axis=0)
            yield _tiled((int(docs[r]), items[i][0], values[offsets[r] : offsets[r + 1]], items[i][1]) for r, i in pairs.tolist())

    return tile


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, word hashes) -> (id, seed), distinct in a row."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        values, offsets = _lists(batch.column(1))
        h = _seed_hashes(values, SEED)
        row = np.searchsorted(offsets, np.arange(len(h)), "right") - 1
        ok = np.arange(len(h)) + SEED <= offsets[row + 1] if len(h) else np.zeros(0, bool)
        pairs = np.unique(np.stack([row[ok].astype(np.uint64), h[ok]], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0].astype(np.int64)], pa.int64()), pa.array(pairs[:, 1].view(np.int64))], ["id", "seed"])


def _placed_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, word hashes) -> (item_id, n_words, at, seed) for every place of an item."""
    for batch in batches:
        values, offsets = _lists(batch.column(1))
        h = _seed_hashes(values, SEED)
        start = np.arange(len(h))
        row = np.searchsorted(offsets, start, "right") - 1
        ok = start + SEED <= offsets[row + 1] if len(h) else np.zeros(0, bool)
        start, row = start[ok], row[ok]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row)).cast(pa.int64()), pa.array(np.diff(offsets)[row], pa.int32()), pa.array(start - offsets[row], pa.int32()), pa.array(h[ok].view(np.int64))], ["item_id", "n_words", "at", "seed"]
        )


def _by_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, item = (batch.column(i).to_pylist() for i in (0, 1))
        (a, x), (b, y) = _lists(batch.column(2)), _lists(batch.column(3))
        yield _tiled((d, k, a[x[i] : x[i + 1]], b[y[i] : y[i + 1]]) for i, (d, k) in enumerate(zip(doc, item, strict=True)))


def needed(words_: int, at: np.ndarray, common: np.ndarray, run: int, share: float) -> np.ndarray:
    """Mask of the seeds of an item without which no text leaks it: those of rarer use, as many as it takes.

    at: places of the item's seeds; common: how many texts hold each. Seeds
    are left out, the commonest first, as long as those left out hold no run
    of `run` words and cover less than `share` of the item's words; so a
    text that shares only seeds left out has neither.
    """
    out, covered, held = np.zeros(words_ + 1, bool), np.zeros(words_, bool), np.ones(len(at), bool)
    in_row = run - SEED + 1
    for k in np.lexsort((at, -common)).tolist():
        p = int(at[k])
        low, high = p, p
        while low > 0 and out[low - 1]:
            low -= 1
        while out[high + 1]:
            high += 1
        more = ~covered[p : p + SEED]
        if high - low + 1 >= in_row or covered.sum() + more.sum() >= share * words_:
            continue
        out[p], held[k] = True, False
        covered[p : p + SEED] = True
    return held


def _needed_rows(run: int, share: float) -> Callable:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, n, got in zip(batch["item_id"], batch["n_words"], batch["seeds"], strict=True):
                got = sorted(got, key=lambda x: x["at"])
                at, seed, common = (np.array([x[c] for x in got], np.int64) for c in ("at", "seed", "n"))
                keep = needed(int(n), at, common, run, share) & (common > 0)
                out += [(item, s, c) for s, c in dict(zip(seed[keep].tolist(), common[keep].tolist(), strict=True)).items()]
            yield pd.DataFrame(out, columns=["item_id", "seed", "n"])

    return rows


def candidates(left: DataFrame, right: DataFrame, run: int, share: float, least_heavy: int = 1000) -> DataFrame:
    """(doc_id, item_id): pairs that may have a run of `run` words or a coverage of `share`, by seeds in a shuffled join.

    Each item keeps only the seeds that a leak of it needs, rare ones before
    common ones by their exact counts in all texts; the texts of a seed that
    is still common are spread by a salt.
    """
    spark = left.sparkSession
    seeds = materialise(left.mapInArrow(_seed_rows, "doc_id long, seed long"), "seeds")
    every = materialise(right.mapInArrow(_placed_seeds, "item_id long, n_words int, at int, seed long"), "item_seeds")
    # how many texts hold each seed of an item: counted by a partial aggregate before anything is joined
    held = seeds.groupBy("seed").agg(F.count("*").alias("n")).join(every.select("seed").distinct(), "seed")
    listed = every.join(held, "seed", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    per_item = listed.groupBy("item_id", "n_words").agg(F.collect_list(F.struct("at", "seed", "n")).alias("seeds"))  # an item's words
    kept = materialise(per_item.mapInPandas(_needed_rows(run, share), "item_id long, seed long, n long"), "needed")
    limit = heavy_limit(seeds.count(), least_heavy)
    salts = F.ceil(F.col("n") / limit).cast("int")
    hot = F.broadcast(spark.createDataFrame(kept.where(F.col("n") > limit).select("seed", salts.alias("salts")).distinct().collect(), "seed long, salts int"))  # at most 4,096 seeds
    of_docs = seeds.join(hot, "seed", "left").select("doc_id", "seed", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).alias("salt"))
    of_items = kept.select("item_id", "seed", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("n") > limit, salts).otherwise(1).cast("long") - 1)).alias("salt"))
    return of_docs.join(of_items, ["seed", "salt"]).select("doc_id", "item_id").distinct()


def tilings(docs: DataFrame, items: DataFrame, run: int = 12, share: float = 0.8, most_seeds: int = MOST_SEEDS) -> DataFrame:
    """(doc_id, item_id, longest, covered, n_tiles, item_words): pairs of a text and an item that share SEED words in a row.

    Every pair with a tile of `run` words or tiles over `share` of the item
    is among them; pairs that share less may be left out.

    longest: words of the longest tile; covered: words of the item in any
    tile. Words are compared by 64-bit hashes. Null texts, null ids and texts
    of fewer words give no rows; of repeated rows each is worked on, and equal
    results count once. Items are sent to every executor if their exact number
    of words is within most_seeds; else seeds of both sides meet in a
    shuffled join (see candidates()), and only texts that share one are tiled.
    """
    left = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropna().select("doc_id", word_hashes(F.col("text")).alias("w"))
    right = items.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna().select("item_id", word_hashes(F.col("text")).alias("v")).distinct()
    size = right.agg(F.sum(F.size("v"))).first()[0] or 0
    if size <= min(most_seeds, MOST_WORDS):
        held = [(r[0], np.array(r[1], np.int64).view(np.uint64)) for r in right.collect()]  # at most most_seeds words
        return left.mapInArrow(_direct(docs.sparkSession, held), SCHEMA).distinct()
    pairs = candidates(left, right, run, share)
    return pairs.join(left, "doc_id").join(right, "item_id").select("doc_id", "item_id", "w", "v").mapInArrow(_by_pair, SCHEMA).distinct()


def leaked(docs: DataFrame, items: DataFrame, run: int = 12, share: float = 0.8, most_seeds: int = MOST_SEEDS) -> DataFrame:
    """tilings() of the pairs with a tile of at least `run` words, or with at least `share` of the item's words in tiles.

    kind is `run` or `reordered`.
    """
    found_ = tilings(docs, items, run, share, most_seeds)
    kind = F.when(F.col("longest") >= run, "run").when(F.col("covered") >= share * F.col("item_words"), "reordered")
    return found_.withColumn("kind", kind).where(F.col("kind").isNotNull())


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): the text holds at least 12 consecutive words of the item."""
    return leaked(docs, items).where("kind = 'run'").select("doc_id", "item_id").distinct()


def per_item(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, n_docs, longest): in how many texts an item leaked, and its longest run there."""
    return leaked(docs, items).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("longest").alias("longest"))


def tiled_frame(text: str, item: str, least: int = SEED) -> pd.DataFrame:
    """The tiles of two texts, for looking at one pair."""
    import re

    a, b = (re.findall(r"[^\W_]+", x.lower()) for x in (text, item))
    codes = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    x, y = (np.array([codes[w] for w in t], np.uint64) for t in (a, b))
    return pd.DataFrame([(i, j, n, " ".join(a[i : i + n])) for i, j, n in tiles(x, y, least)], columns=["in_text", "in_item", "words", "run"])
