"""Records of similar sequence (problem 6).

Tiled exact comparison: the pieces of each record become a bit vector, and
tiles of vectors are compared by exclusive or and bit counts. Two vectors can
only belong to similar records if few bits differ, so tile pairs whose bit
counts differ beyond the radius are skipped and only pairs within the radius
are compared piece by piece.

Comparing all tiles with all is quadratic, so tiles are formed only of
records that can be similar. A pair of similarity t shares most of its
pieces, and the unshared ones come in runs (one edit spoils about `piece`
neighbours), so a long stretch without any edit is left; both records then
have the same smallest SEED-letter word in a window inside that stretch.
Where that doesn't hold, the exact prefix filter on the different pieces
gives the words: for records of few different pieces, and for those in which
any piece is repeated. Records tied by such words form candidate components,
each component is compared in tiles, and a pair counts if it shares a word,
however large its component is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborweave.functions import packed
from arborweave.llm.format_copies import letters
from arborweave.operators.components import components
from arborweave.operators.record_keys import one_per_pos
from arborweave.operators.skew import join_counted
from arborweave.session import materialise

PIECE = 12
SEED, WINDOW = 20, 11
#: Most records, and most letters, of a component that are compared in one group; larger ones are compared word by word.
GROUP, LETTERS = 8192, 4_000_000
TILE = 128
#: A word of so many rows in one slice leaves the task once and is remembered there.
COMMON = 32


def stretch(n: int, threshold: float, piece: int = PIECE) -> int:
    """Letters without an edit that two records of n and more pieces must share at the threshold.

    At most a share 1 - 2t/(1+t) of the smaller record's pieces is unshared,
    in runs of at least `piece`; the longest of the other runs is at least
    their mean.
    """
    lost = n * (1 - 2 * threshold / (1 + threshold))
    return int(np.ceil((n - lost) / (lost / piece + 1))) + piece - 1


def least_long(threshold: float) -> float:
    """Different pieces from which on the windows of SEED-letter words give the ties; below it, and everywhere if no length will do, the prefix filter does."""
    for n in range(2, 5000):
        if stretch(n, threshold) >= SEED + WINDOW - 1 and n * threshold >= 1:
            return n
    return np.inf


def _rows(batch: pa.RecordBatch, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Slices of a batch of about `most` letters in column text."""
    size = np.asarray(pa.compute.binary_length(batch.column(batch.schema.get_field_index("text"))))
    ends, row = np.cumsum(size), 0
    while row < len(size):
        end = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + most, "right")))
        yield row, end
        row = end


def _row_keys(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, int]:
    """(numbers in the order of row and then value as far as 64 bits reach, how many bits the row takes)."""
    bits = max(1, int(rows).bit_length())
    return (row.astype(np.uint64) << np.uint64(64 - bits)) | (value >> np.uint64(bits)), bits


def _distinct(value: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, row) in order of row and value, each once. Values of equal upper bits are put in order by a second sort."""
    key, _ = _row_keys(row, value, rows)
    order = np.argsort(key)
    key, value, row = key[order], value[order], row[order]
    if len(key) and ((key[1:] == key[:-1]) & (value[1:] < value[:-1])).any():
        order = np.lexsort((value, row))
        value, row = value[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], row[new]


def seeds(texts: pa.Array, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, word): the words by which each row is tied to those it may resemble; distinct in a row."""
    letters_, offsets = packed.letters_of(texts)
    size = np.diff(offsets)
    pieces = size - PIECE + 1
    # long: smallest SEED-letter word of each window of WINDOW such words
    reach = SEED + WINDOW - 1
    low = packed.sliding_min(packed.mixed(packed.window_codes(letters_, SEED)), WINDOW)
    ok = packed.inside(offsets, reach, len(letters_)) if len(low) else np.zeros(0, bool)
    at = np.flatnonzero(ok)
    row = np.searchsorted(offsets, at, "right") - 1
    word = low[at]
    new = np.ones(len(at), bool)
    new[1:] = (word[1:] != word[:-1]) | (row[1:] != row[:-1])
    row, word = row[new], word[new]
    # rows in which a piece may be repeated: two equal values of row and shortened hash
    count = np.maximum(pieces, 0)
    of = np.repeat(np.arange(len(size)), count)
    h = packed.mixed(packed.window_codes(letters_, PIECE))[packed.spread(offsets[:-1], count)] if len(of) else np.zeros(0, np.uint64)
    long = least_long(threshold)
    key, bits = _row_keys(of, h, len(size))
    key.sort()
    doubtful = count * threshold < long
    doubtful[(key[1:][key[1:] == key[:-1]] >> np.uint64(64 - bits)).astype(np.int64)] = True
    # their different pieces, in hash order; those of all others are as many as their windows
    keep = doubtful[of]
    h, of = _distinct(h[keep], of[keep], len(size))
    n = np.where(doubtful, np.bincount(of, minlength=len(size)), count)
    keep = n[row] >= long
    row, word = row[keep], word[keep] | np.uint64(1)  # the lowest bit tells the two kinds apart
    # few pieces, those that may resemble such a row, and rows with any repeat: the first pieces in hash order
    short = (n > 0) & ((n * threshold < long) | (n < count))
    if short.any():
        keep = short[of]
        h, of = h[keep], of[keep]
        n = np.where(short, n, 0)
        rank = np.arange(len(of)) - (np.cumsum(n) - n)[of]
        first = rank < n[of] - np.ceil(threshold * n[of] - 1e-9) + 1
        row, word = np.concatenate([row, of[first]]), np.concatenate([word, h[first] & ~np.uint64(1)])
    word, row = _distinct(word, row, len(size))
    return row, word


def _ties(threshold: float):
    """(rep, text) -> (word, rep), with what has one word in the same part of a task tied there.

    A word that many rows of a slice hold leaves the task once, so that a
    word of a third of all rows is one row per task in the shuffle. The ties
    found here leave as words of their own.
    """

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, heads = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # common words so far, sorted, and a row of each
        for batch in batches:
            reps = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in _rows(batch):
                row, word = seeds(batch.column(1).slice(a, b - a), threshold)
                rep = reps[a:b][row]
                order = np.argsort(word)
                rep, word = rep[order], word[order]
                first = np.ones(len(word), bool)
                first[1:] = word[1:] != word[:-1]
                begin = np.flatnonzero(first)
                size = np.diff(np.append(begin, len(word)))
                head = rep[begin]
                at = np.minimum(np.searchsorted(known, word[begin]), max(0, len(known) - 1))
                old = known[at] == word[begin] if len(known) else np.zeros(len(begin), bool)
                if old.any():
                    head[old] = heads[at[old]]
                fresh = ~old & (size >= COMMON)
                if fresh.any():
                    known, heads = np.concatenate([known, word[begin][fresh]]), np.concatenate([heads, head[fresh]])
                    order = np.argsort(known)
                    known, heads = known[order], heads[order]
                every = np.repeat(head, size)
                other = every != rep
                pairs = np.unique(np.stack([every[other], rep[other]], 1), axis=0)
                own = packed.mixed(pairs[:, 0].astype(np.uint64) ^ np.uint64(0x5555555555555555))
                words = np.concatenate([word[begin][~old], own, own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words.view(np.int64)), pa.array(np.concatenate([head[~old], pairs[:, 0], pairs[:, 1]]))], ["word", "rep"]
                )

    return tie


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, rep) in order of word -> (a, b): each rep of a word with the first of that word."""
    last, head = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        word, rep = (batch.column(i).to_numpy() for i in (0, 1))
        first = np.ones(len(word), bool)
        first[1:] = word[1:] != word[:-1]
        heads = rep[np.maximum.accumulate(np.where(first, np.arange(len(word)), 0))]
        if last == word[0]:
            heads[: len(word) if first.sum() == 1 else int(np.flatnonzero(first)[1])] = head
        last, head = word[-1], heads[-1]
        keep = heads != rep
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(rep[keep]), pa.array(heads[keep])], ["a", "b"])


class Sets:
    """Sets of numbers, one per row, given as (row, value) in order of row and without repeats."""

    def __init__(self, row: np.ndarray, value: np.ndarray, rows: int):
        self.n = np.bincount(row, minlength=rows)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.values, self.rank = np.unique(value, return_inverse=True)

    def common(self, i: np.ndarray, j: np.ndarray, most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
        """(how many values rows i and j share, the rank of the smallest shared one or -1), for each pair."""
        count, least = np.zeros(len(i), np.int64), np.full(len(i), -1)
        ends, begin = np.cumsum(self.n[i] + self.n[j]), 0
        width = max(1, len(self.values))
        while begin < len(i):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
            keys = []
            for side in (i[begin:end], j[begin:end]):
                keys.append(np.repeat(np.arange(len(side)), self.n[side]) * width + self.rank[packed.spread(self.at[side], self.n[side])])
            both = np.concatenate(keys)
            both.sort()
            both = both[1:][both[1:] == both[:-1]]
            pair = both // width
            count[begin:end] = np.bincount(pair, minlength=end - begin)
            first = np.ones(len(pair), bool)
            first[1:] = pair[1:] != pair[:-1]
            least[begin + pair[first]] = both[first] % width
            begin = end
        return count, least


class Pieces(Sets):
    """The piece sets of some rows, also as bit vectors with their bit counts."""

    def __init__(self, texts: pa.Array):
        letters_, offsets = packed.letters_of(texts)
        count = np.maximum(np.diff(offsets) - PIECE + 1, 0)
        of = np.repeat(np.arange(len(count)), count)
        code = packed.window_codes(letters_, PIECE)[packed.spread(offsets[:-1], count)] if len(of) else np.zeros(0, np.uint64)
        code, of = _distinct(packed.mixed(code), of, len(count))  # one to one with the codes
        super().__init__(of, code, len(count))
        width = 512
        while width < 4 * self.n.max(initial=0) and width < 16384:
            width *= 2
        self.bits = np.zeros((len(count), width // 64), np.uint64)
        bit = (code % np.uint64(width)).astype(np.int64)
        for a in range(0, len(count), 4096):  # a dense block at a time
            b = min(a + 4096, len(count))
            dense = np.zeros((b - a) * width, bool)
            lo, hi = self.at[a], self.at[b]
            dense[(of[lo:hi] - a) * width + bit[lo:hi]] = True
            self.bits[a:b] = np.packbits(dense.reshape(b - a, width), axis=1).view(np.uint64)
        self.count = np.bitwise_count(self.bits).sum(1).astype(np.int64)

    def near(self, i: np.ndarray, j: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask of the pairs of which no more bits differ than their radius."""
        out = np.zeros(len(i), bool)
        step = (1 << 22) // self.bits.shape[1]
        for a in range(0, len(i), step):
            s = slice(a, a + step)
            out[s] = np.bitwise_count(self.bits[i[s]] ^ self.bits[j[s]]).sum(1) <= radius[s]
        return out


def similar_rows(texts: pa.Array, group: np.ndarray, threshold: float, side: np.ndarray | None = None, tile: int = TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity) of the rows of one group that are similar; rows lie together by group, i < j.

    side: if given, rows are 1 (left), 2 (right) or 3 (both), and only pairs
    of a left with a right row count. Rows are put in order of their bit
    counts inside their group; a tile may hold several small groups.
    """
    p = Pieces(texts)
    order = np.lexsort((p.count, group))
    g, n, bits = group[order], p.n[order], p.count[order]
    reach = (1 - threshold) / (1 + threshold)  # no similar pair differs in more than this share of both sizes
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, len(g), tile):
        a_end = min(a + tile, len(g))
        for b in range(a, len(g), tile):
            b_end = min(b + tile, len(g))
            if b > a:
                if g[b] != g[a_end - 1]:
                    break
                if bits[b] - bits[a_end - 1] > reach * (n[a:a_end].max() + n[b:b_end].max()) + 1e-9:
                    continue  # the tiles' bit counts differ beyond the radius
            same = g[a:a_end, None] == g[None, b:b_end]
            if b == a:
                same &= np.arange(a_end - a)[:, None] < np.arange(b_end - b)[None, :]
            i, j = np.nonzero(same)
            i, j = i + a, j + b
            radius = reach * (n[i] + n[j]) + 1e-9
            keep = np.abs(bits[i] - bits[j]) <= radius
            if side is not None:
                x, y = side[order[i]], side[order[j]]
                keep &= (((x & 1) & (y >> 1)) | ((x >> 1) & (y & 1))) == 1
            i, j = order[i[keep]], order[j[keep]]
            keep = p.near(i, j, radius[keep])
            found.append((i[keep], j[keep]))
    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    common, _ = p.common(i, j)
    union = p.n[i] + p.n[j] - common
    share = common / np.maximum(union, 1)
    keep = (share >= threshold - 1e-12) & (common > 0)
    i, j = np.minimum(i, j)[keep], np.maximum(i, j)[keep]
    return i, j, share[keep]


def _by_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups, of a partition that is sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(key)
        keys = batch.column(at).to_numpy(zero_copy_only=False)
        cut = int(np.argmax(keys == keys[-1]))
        if cut or (held and held[-1].column(at)[0].as_py() != keys[0]):
            whole = [*held, batch.slice(0, cut)] if cut else held
            yield pa.Table.from_batches(whole)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _compare(threshold: float, by_word: bool):
    """Rows in order of `key` -> (rep_1, rep_2, similarity) of the similar pairs of a key that share a word.

    by_word: the key is made of a word and a tile pair; a pair of rows counts
    only at the first word that both hold, so that it comes once.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _by_group(batches, "key"):
            reps = part.column("rep").to_numpy()
            texts = part.column("text").combine_chunks()
            i, j, share = similar_rows(texts, part.column("key").to_numpy(), threshold, part.column("side").to_numpy() if by_word else None)
            if len(i):
                # only rows that are in a pair have their words taken again
                rows, back = np.unique(np.concatenate([i, j]), return_inverse=True)
                words = Sets(*seeds(texts.take(pa.array(rows)), threshold), len(rows))
                _, least = words.common(back[: len(i)], back[len(i) :])
                keep = least >= 0
                if by_word:
                    keep &= words.values[least] == part.column("word").to_numpy().view(np.uint64)[i]
                a, b = reps[i[keep]], reps[j[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(share[keep])], ["rep_1", "rep_2", "similarity"])

    return compare


def _explode_words(threshold: float):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _rows(batch, 200_000):
                part = batch.slice(a, b - a)
                row, word = seeds(part.column(1), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))], ["word", "rep", "text"])

    return explode


PAIRS = "rep_1 long, rep_2 long, similarity double"


def classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((pos, rep) of each record, (rep, n, text) of each different text); rep is the smallest pos of the text.

    Deliveries of one pos are one record (the first counts); rows without pos
    or without any letter are left out.
    """
    rows = records.where(F.col("pos").isNotNull()).select("pos", "loaded_at", letters(F.col("sequence")).alias("text")).where("text <> ''")
    keyed = rows.select("pos", "loaded_at", F.unhex(F.md5("text")).alias("m"))
    first = materialise(one_per_pos(keyed).drop("loaded_at"), "members")
    groups = materialise(first.groupBy("m").agg(F.min("pos").alias("rep"), F.count("*").alias("n")), "texts")
    text = rows.groupBy(F.unhex(F.md5("text")).alias("m")).agg(F.first("text").alias("text"))
    reps = materialise(groups.join(text, "m").select("rep", "n", "text"), "reps")
    members = join_counted(first, groups.select("m", "rep", "n"), ["m"], "n", first.count()).select("pos", "rep")
    return members, reps


def similar_texts(reps: DataFrame, threshold: float, group: int = GROUP, letters_: int = LETTERS) -> DataFrame:
    """(rep_1, rep_2, similarity): pairs of different texts (rep, text) of at least that similarity.

    A pair is found if it shares a word (see seeds()): surely where both
    texts have few different pieces or repeat any, and where the unshared
    pieces of the smaller one come in runs, as edits make them. group and
    letters_ only decide how a component is worked on, not what is found.
    """
    if not 0 < threshold <= 1:
        raise ValueError(f"threshold {threshold} is not in (0, 1]")
    spark = reps.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = reps.select("rep", "text").mapInArrow(_ties(threshold), "word long, rep long")
    links = words.repartition(tasks, "word").sortWithinPartitions("word", "rep").mapInArrow(_links, "a long, b long")
    member = materialise(components(links).join(reps.select(F.col("rep").alias("node"), F.length("text").alias("size")), "node"), "candidates")
    sizes = member.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    is_large = (F.col("n") > group) | (F.col("size") > letters_)
    large = materialise(sizes.where(is_large).select("component", "n"), "large")
    total = member.count()
    small = join_counted(member, sizes.where(~is_large).select("component", "n"), ["component"], "n", total, "left_semi", least=group)
    texts = reps.select("rep", "text")
    rows = small.select(F.col("node").alias("rep"), F.col("component").alias("key")).join(texts, "rep")
    out = rows.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_compare(threshold, False), PAIRS)
    if not large.isEmpty():
        # components that are too large for one group: compared by word, and words of too many rows by tile pairs
        inner = join_counted(member, large, ["component"], "n", total, "left_semi").select(F.col("node").alias("rep")).join(texts, "rep")
        spread = materialise(inner.mapInArrow(_explode_words(threshold), "word long, rep long, text string"), "words")
        tiles = F.ceil(F.greatest(F.col("n") / group, F.col("size") / letters_)).cast("int")
        count = spread.groupBy("word").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size")).where("n > 1").select("word", "n", tiles.alias("tiles"))
        tiled = join_counted(spread, count, ["word"], "n", spread.count()).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
        # a row meets every tile of its word once: (its tile, other) or (other, its tile), in order
        tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        low, high = F.least("tile", "other"), F.greatest("tile", "other")
        side = F.when(low == high, 3).when(F.col("tile") == low, 1).otherwise(2)
        tiled = tiled.select(F.xxhash64("word", low, high).alias("key"), "word", side.alias("side"), "rep", "text")
        out = out.unionByName(tiled.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_compare(threshold, True), PAIRS))
    return out


#: Most records of one text that travel as one row when pairs are written out.
BLOCK = 512


def found(records: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(pos_1, pos_2): pairs of records of at least that similarity, those of equal letters included.

    Similarity is taken of the sets of pieces of 12 letters. Records with
    fewer letters have no pieces and are similar only to equal ones; records
    without letters to none. Records of one text travel in blocks of about
    BLOCK, so a text of very many records is no hot key: its block pairs are
    spread before they are written out.
    """
    members, reps = classes(records)
    pairs = similar_texts(reps, threshold).select("rep_1", "rep_2").unionByName(reps.where("n > 1").select(F.col("rep").alias("rep_1"), F.col("rep").alias("rep_2")))
    several = reps.where("n > 1").select("rep", F.ceil(F.col("n") / BLOCK).alias("blocks"), "n")
    in_block = join_counted(members, several, ["rep"], "n", members.count()).withColumn("block", F.pmod(F.xxhash64("pos"), F.col("blocks")))
    blocks = in_block.groupBy("rep", "block").agg(F.collect_list("pos").alias("pos"))  # about BLOCK each
    alone = reps.where("n = 1").select("rep", F.lit(0).cast("long").alias("block"), F.array("rep").alias("pos"))
    blocks = materialise(blocks.unionByName(alone), "blocks")
    left = blocks.select(F.col("rep").alias("rep_1"), F.col("block").alias("block_1"), F.col("pos").alias("a"))
    right = blocks.select(F.col("rep").alias("rep_2"), F.col("block").alias("block_2"), F.col("pos").alias("b"))
    both = pairs.join(left, "rep_1").join(right, "rep_2").where("rep_1 <> rep_2 OR block_1 <= block_2")
    both = both.withColumn("a", F.explode("a")).withColumn("b", F.explode("b"))
    # inside a text every two records meet once: in their block, or in the pair of their blocks
    both = both.where("rep_1 <> rep_2 OR block_1 <> block_2 OR a < b")
    return both.select(F.least("a", "b").alias("pos_1"), F.greatest("a", "b").alias("pos_2"))


def groups(records: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(pos, group_pos, n_links): one row per record, with the smallest pos of its group and its number of similar records."""
    members, reps = classes(records)
    pairs = materialise(similar_texts(reps, threshold), "pairs")
    both = pairs.select(F.col("rep_1").alias("rep"), F.col("rep_2").alias("other")).unionByName(pairs.select(F.col("rep_2").alias("rep"), F.col("rep_1").alias("other")))
    links = both.join(reps.select(F.col("rep").alias("other"), "n"), "other").groupBy("rep").agg(F.sum("n").alias("links"))
    of = components(pairs.select(F.col("rep_1").alias("a"), F.col("rep_2").alias("b"))).select(F.col("node").alias("rep"), "component")
    per_rep = reps.select("rep", "n").join(of, "rep", "left").join(links, "rep", "left").select(
        "rep", F.coalesce("component", "rep").alias("group_pos"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "n"
    )
    return join_counted(members, per_rep, ["rep"], "n", members.count()).select("pos", "group_pos", "n_links")
