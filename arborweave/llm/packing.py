"""Texts put into containers of a fixed number of tokens (problem 7).

Non-negative least squares on the histogram of lengths: short combinations of
lengths that fill a container are enumerated, how often to use each is solved
against the histogram and rounded, and what is left is packed greedily. All
of this works on the histogram, whose size is the capacity and not the number
of texts; the resulting patterns are then dealt to the texts by their rank
among those of equal length, which needs no order over all texts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborweave.session import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CAPACITY = 2048
#: Number of coarse length classes for the least squares, and most lengths in a combination.
CLASSES, DEPTH = 64, 4
#: Most slices that the texts of one length are ranked in.
MOST_SLICES = 4096
# The public pattern that parts a text before byte-pair merging; a fixed value of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts beyond this many characters are counted in pieces, which end where the pattern above always parts a text.
PIECE = 1 << 20
# A letter or digit before a blank; else any end of a run of letters or of digits, or a blank after another sign. No match of
# the pattern lies across such a place, and none before it looks beyond it.
_CUTS = (
    regex.compile(r"(?<=[A-Za-z0-9])(?=[ \n])"),
    regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\p{L}\p{N}\p{White_Space}])(?=\p{White_Space})"),
)


@lru_cache(1)
def encoder(path: str):
    """The tokenizer of a vocabulary file of ranks; once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of `size` characters and more, whose tokens are those of the whole text.

    A piece ends at the first place from `size` on where the tokenizer's
    pattern surely parts the text; without any such place it is the rest.
    """
    at = 0
    while len(text) - at > size:
        cut = next((m for c in _CUTS if (m := c.search(text, at + size, min(len(text), at + 2 * size)))), None) or _CUTS[1].search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of each text, exactly; a null or empty one has 0 tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for batch in batches:
            sizes = [sum(len(enc.encode_ordinary(p)) for p in pieces(text)) if text else 0 for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": np.array(sizes, np.int64)})

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(count, "doc_id long, n_tokens long")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 0) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method."""
    gram, target = a.T @ a, a.T @ b
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slack = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds or 3 * a.shape[0] + 10):
        gain = np.where(active, -np.inf, target - gram @ x)
        if gain.max(initial=-np.inf) <= slack:
            break
        active[int(np.argmax(gain))] = True
        while True:
            on = np.flatnonzero(active)
            z = np.linalg.lstsq(gram[np.ix_(on, on)], target[on], rcond=None)[0]
            if (z > slack * 1e-3).all():
                x[:] = 0
                x[on] = z
                break
            low = z <= slack * 1e-3
            step = np.min(x[on][low] / np.maximum(x[on][low] - z[low], 1e-300))
            x[on] += min(1.0, max(0.0, float(step))) * (z - x[on])
            drop = on[(x[on] <= 1e-12 * max(1.0, float(x.max()))) & low]
            if not len(drop):
                drop = on[low][:1]
            x[drop] = 0
            active[drop] = False
    return x


def combinations(classes: int, depth: int) -> list[tuple[int, ...]]:
    """Descending tuples of at most `depth` class sizes that add up to `classes`."""

    def parts(rest: int, most: int, left: int) -> Iterator[tuple[int, ...]]:
        if rest == 0:
            yield ()
        elif left:
            for first in range(min(rest, most), (rest + left - 1) // left - 1, -1):
                for more in parts(rest - first, first, left - 1):
                    yield (first, *more)

    return list(parts(classes, classes, depth))


def patterns(histogram: np.ndarray, capacity: int, classes: int = CLASSES, depth: int = DEPTH) -> list[tuple[dict[int, int], int]]:
    """[({length: how many}, how many containers)] that use up histogram[length], 1 <= length <= capacity.

    At most a few times `capacity` patterns, however large the counts are.
    """
    left = histogram.astype(np.int64).copy()
    width = -(-capacity // classes)
    n_classes = -(-capacity // width)
    of = lambda length: -(-length // width)  # noqa: E731  class of a length, rounded up
    sizes = np.zeros(n_classes + 1, np.int64)
    lengths = np.arange(len(left))
    np.add.at(sizes, np.minimum(-(-lengths // width), n_classes)[1:], left[1:])
    chosen: list[list] = []  # [lengths of a container, number of containers, free tokens]
    combos = combinations(capacity // width, depth)
    if combos and sizes.sum():
        matrix = np.zeros((n_classes + 1, len(combos)))
        for k, c in enumerate(combos):
            for size in c:
                matrix[size, k] += 1
        # scarce classes weigh as much as common ones
        weight = 1 / np.sqrt(np.maximum(sizes, 1))
        times = np.floor(nnls(matrix * weight[:, None], sizes * weight) + 1e-6).astype(np.int64)
        for k in np.flatnonzero(times > 0):
            need = {s: combos[k].count(s) for s in combos[k]}
            todo = int(min(times[k], *(sizes[s] // n for s, n in need.items())))
            while todo > 0:
                take, many = [], todo
                for s, n in need.items():  # the longest texts left in each class
                    span = [int(x) for x in range(min(s * width, capacity), (s - 1) * width, -1) if left[x] > 0]
                    while n and span:
                        x = span[0]
                        m = min(n, int(left[x]))
                        take.append((x, m))
                        n -= m
                        span = span[1:] if m == left[x] or n else span
                used: dict[int, int] = {}
                for x, m in take:
                    used[x] = used.get(x, 0) + m
                if sum(used.values()) < len(combos[k]) or sum(x * m for x, m in used.items()) > capacity:
                    break
                many = min(todo, *(int(left[x]) // m for x, m in used.items()))
                if many <= 0:
                    break
                for x, m in used.items():
                    left[x] -= m * many
                    sizes[of(x)] -= m * many
                chosen.append([used, many, capacity - sum(x * m for x, m in used.items())])
                todo -= many
    # the rest: longest first, each into the container with the least sufficient space
    for x in range(capacity, 0, -1):
        while left[x] > 0:
            fit = [c for c in chosen if c[2] >= x]
            if not fit:
                each = min(capacity // x, int(left[x]))
                many = int(left[x]) // each
                chosen.append([{x: each}, many, capacity - x * each])
                left[x] -= each * many
                continue
            best = min(fit, key=lambda c: c[2])
            each = min(best[2] // x, int(left[x]))
            many = min(best[1], int(left[x]) // each)
            if many < best[1]:
                chosen.append([dict(best[0]), best[1] - many, best[2]])
                best[1] = many
            best[0][x] = best[0].get(x, 0) + each
            best[2] -= x * each
            left[x] -= each * many
    return [(c[0], c[1]) for c in chosen]


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part, n_tokens, container): where each text, or each part of an oversized one, goes.

    A text within the capacity is one part, 0. A longer one is divided into
    full parts, each alone in its container, and a last part that is packed
    like a text. A text without tokens takes no space and goes to container
    0. Containers are numbered from 1 (their numbers are unique, not dense).
    Rows of sizes are (doc_id, n_tokens); repeated ids are packed each;
    an empty table gives no rows.
    """
    spark = sizes.sparkSession
    whole, rest = F.floor(F.col("n_tokens") / capacity).cast("int"), F.pmod("n_tokens", F.lit(capacity)).cast("int")
    sized = sizes.select("doc_id", whole.alias("full"), rest.alias("rest"), "n_tokens")
    items = sized.where("n_tokens > 0").select(
        "doc_id",
        F.explode(
            F.concat(
                F.when(F.col("full") > 0, F.transform(F.sequence(F.lit(0), F.col("full") - 1), lambda i: F.struct(i.cast("int").alias("part"), F.lit(capacity).alias("n_tokens")))).otherwise(
                    F.array().cast("array<struct<part:int,n_tokens:int>>")
                ),
                F.when(F.col("rest") > 0, F.array(F.struct(F.col("full").alias("part"), F.col("rest").alias("n_tokens")))).otherwise(F.array().cast("array<struct<part:int,n_tokens:int>>")),
            )
        ).alias("x"),
    )
    items = materialise(items.select("doc_id", F.col("x.part").alias("part"), F.col("x.n_tokens").alias("n_tokens")), "items")
    # slices make ranks countable without a sort over all texts of one length; none grows beyond a few million rows
    slices = int(min(MOST_SLICES, max(16, items.count() // 2_000_000)))
    items = items.withColumn("slice", F.pmod(F.xxhash64("doc_id", "part"), F.lit(slices)).cast("int"))
    # at most capacity * MOST_SLICES rows of three numbers, as arrays
    rows = items.groupBy("n_tokens", "slice").agg(F.count("*").alias("n")).toPandas()
    table = np.zeros((capacity + 1, slices), np.int64)
    table[rows["n_tokens"].to_numpy(np.int64), rows["slice"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    histogram = table.sum(axis=1)
    starts = np.cumsum(table, axis=1) - table
    # the patterns as runs of ranks: texts of one length, from rank `first` on, `each` to a container, from container `base` on
    runs, base, used = [], 1, np.zeros(capacity + 1, np.int64)
    for lengths, many in patterns(histogram, capacity):
        for x, each in sorted(lengths.items()):
            runs.append((x, int(used[x]), each, base))
            used[x] += each * many
        base += many
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for x in {r[0] for r in runs}:
        mine = sorted(r[1:] for r in runs if r[0] == x)
        by_length[x] = tuple(np.array(c, np.int64) for c in zip(*mine, strict=True))
    shared = spark.sparkContext.broadcast((starts, by_length))  # at most capacity * slices numbers and a few times capacity runs

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, by_length = shared.value
        for b in batches:
            x = b["n_tokens"].to_numpy()
            rank = starts[x, b["slice"].to_numpy()] + b["rn"].to_numpy() - 1
            container = np.zeros(len(b), np.int64)
            for length in np.unique(x):
                at = x == length
                begin, each, base = by_length[int(length)]
                run = np.searchsorted(begin, rank[at], "right") - 1
                container[at] = base[run] + (rank[at] - begin[run]) // each[run]
            yield pd.DataFrame({"doc_id": b["doc_id"], "part": b["part"], "n_tokens": x, "container": container})

    ranked = items.withColumn("rn", F.row_number().over(Window.partitionBy("n_tokens", "slice").orderBy("doc_id", "part")))
    dealt = ranked.mapInPandas(deal, "doc_id long, part int, n_tokens int, container long")
    none = sized.where("n_tokens = 0").select("doc_id", F.lit(0).alias("part"), F.lit(0).alias("n_tokens"), F.lit(0).cast("long").alias("container"))
    return dealt.unionByName(none)


def assignment(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """pack() of the texts of docs (doc_id, text), counted with a public tokenizer."""
    return pack(materialise(token_counts(docs, tokenizer), "sizes"), capacity)


def found(docs: DataFrame) -> DataFrame:
    """(doc_id): texts that alone exceed a container."""
    return assignment(docs).where("part > 0").select("doc_id").distinct()


def fill(docs: DataFrame) -> DataFrame:
    """(containers, tokens, used_share, overfull): how well the containers are filled."""
    per = assignment(docs).where("n_tokens > 0").groupBy("container").agg(F.sum("n_tokens").alias("t"))
    return per.agg(
        F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.round(F.sum("t") / (F.count("*") * CAPACITY), 6).alias("used_share"), F.sum((F.col("t") > CAPACITY).cast("int")).alias("overfull")
    )
