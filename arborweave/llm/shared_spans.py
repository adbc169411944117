"""Long exact spans that occur in more than one record (problem 2).

Prefix-partitioned suffix trees. The suffixes of all records are split by
prefixes into groups that fit in memory: a prefix is lengthened, step by
step, until it has no more suffixes than a constant. In each group the sorted
suffixes with their common prefix lengths (the array form of the subtree)
give the internal nodes of depth >= span whose leaves lie in two records;
where such nodes follow one another they make up the maximal repeats.

To move a letter or less per letter instead of `span`, a suffix travels under
the prefix that begins at its anchor, the smallest piece of ANCHOR letters in
its first `span` letters: equal suffixes have equal anchors, and neighbouring
ones mostly have the same and travel as one block. A first pass counts the
anchors alone, and only blocks whose anchor two records hold travel at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborweave.functions import packed
from arborweave.operators.skew import flags, join_counted
from arborweave.session import materialise

ANCHOR = 24
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Most letters that are worked on at once in a task.
CHUNK = 4_000_000
#: Lengths that a prefix has one after the other, up to the anchor's.
LENGTHS = (6, 12, 18, ANCHOR)
#: Most blocks of a prefix, at about 84 letters each; it doesn't grow with the data.
GROUP = 20_000
#: Places of the filter of anchors; where it fills up it only lets more blocks pass.
FILTER = 1 << 23


def normal(sequence: Column) -> Column:
    """Upper case; a character outside of ASCII becomes NUL, which no shared span may hold."""
    plain = F.octet_length(sequence) == F.length(sequence)
    return F.when(plain, F.upper(sequence)).otherwise(F.regexp_replace(F.translate(sequence, LOWER, UPPER), r"[^\x01-\x7F]", "\u0000"))


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, letters, offsets) of the rows of a batch, in parts of about CHUNK letters."""
    letters, offsets = packed.letters_of(batch.column(1))
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    row = 0
    while row < len(ids):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        yield ids[row:end], letters[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _cuts(letters: np.ndarray, offsets: np.ndarray, span: int) -> tuple[np.ndarray, ...] | None:
    """(row, start, end, anchor, hash) of the runs of neighbouring suffixes of `span` letters that have one anchor."""
    if len(letters) < span:
        return None
    ok = packed.inside(offsets, span, len(letters))
    bad = np.cumsum(np.concatenate(([0], letters == 0)))
    ok &= bad[span:] == bad[:-span]
    bits = np.uint64(max(1, int(len(letters)).bit_length()))
    whole = packed.mixed(packed.window_codes(letters, ANCHOR))
    h = (whole >> bits << bits) | np.arange(len(whole), dtype=np.uint64)
    anchor = (packed.sliding_min(h, span - ANCHOR + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first, last = ok.copy(), ok.copy()
    first[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
    last[:-1] &= ~ok[1:] | (anchor[1:] != anchor[:-1])
    start, end = np.flatnonzero(first), np.flatnonzero(last) + span
    at = anchor[start]
    return np.searchsorted(offsets, start, "right") - 1, start, end, at, whole[at]


def _anchors(span: int):
    """(id, text) -> (h, id): the hashes of a record's anchors."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, letters, offsets in _chunks(batch):
                if (cut := _cuts(letters, offsets, span)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(cut[4].view(np.int64)), pa.array(ids[cut[0]], pa.int64())], ["h", "id"])

    return find


def _blocks(span: int, shared):
    """(id, text) -> (id, off, a, block): the runs of suffixes whose anchor the filter lets pass; the anchor is at a in the block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for ids, letters, offsets in _chunks(batch):
                if (got := _cuts(letters, offsets, span)) is None:
                    continue
                keep = bits[(got[4] & np.uint64(FILTER - 1)).astype(np.int64)]
                row, start, end, anchor = (x[keep] for x in got[:4])
                columns = [pa.array(ids[row], pa.int64()), pa.array(start - offsets[row], pa.int64()), pa.array(anchor - start, pa.int32()), packed.strings(letters, start, end - start)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "off", "a", "block"])

    return cut


def _trees(span: int):
    """Sorted (prefix, h1, h2, shift, lo, hi, block) -> (h1, h2, s, e): stretches of a block, which begins at shift in the whole, that another record has too."""

    def shared(part: pa.Table) -> pa.RecordBatch | None:
        letters, offsets = packed.letters_of(part.column("block"))
        lo, hi = part.column("lo").to_numpy(), part.column("hi").to_numpy()
        n = np.diff(offsets) - span + 1
        leaf = packed.spread(offsets[:-1], n)  # a suffix begins at each of these letters
        block = np.repeat(np.arange(len(n)), n)
        suffix = np.lib.stride_tricks.sliding_window_view(letters, span)[leaf]
        order = np.argsort(suffix.view(f"S{span}").ravel(), kind="stable")
        deep = np.zeros(len(leaf), bool)  # common prefix with the suffix before reaches the span
        deep[1:] = (suffix[order[1:]] == suffix[order[:-1]]).all(axis=1)
        at = np.flatnonzero(~deep)  # each internal node (or single leaf) of that depth begins here
        twice = np.minimum.reduceat(lo[block[order]], at) != np.maximum.reduceat(hi[block[order]], at)
        hit = np.zeros(len(leaf), bool)
        hit[order] = np.repeat(twice, np.diff(np.append(at, len(leaf))))
        if not hit.any():
            return None
        begin, end = hit.copy(), hit.copy()
        begin[1:] &= ~(hit[:-1] & (block[1:] == block[:-1]))
        end[:-1] &= ~(hit[1:] & (block[1:] == block[:-1]))
        begin, end = np.flatnonzero(begin), np.flatnonzero(end)
        where = leaf - offsets[block] + part.column("shift").to_numpy()[block]
        of = pa.array(block[begin])
        return pa.RecordBatch.from_arrays(
            [part.column("h1").combine_chunks().take(of), part.column("h2").combine_chunks().take(of), pa.array(where[begin], pa.int32()), pa.array(where[end] + span, pa.int32())],
            ["h1", "h2", "s", "e"],
        )

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            codes = table.column("prefix").combine_chunks().dictionary_encode().indices.to_numpy()
            size = np.bincount(codes)[codes]
            several = (size > 1) | (table.column("lo").to_numpy() != table.column("hi").to_numpy())
            table = table.filter(pa.array(several))  # a prefix with one block of one record has no shared node
            codes, row = codes[several], 0
            if not len(codes):
                return
            ends = np.flatnonzero(np.append(codes[1:] != codes[:-1], True)) + 1
            sizes = np.cumsum(np.asarray(pa.compute.binary_length(table.column("block"))))
            while row < len(codes):  # whole prefixes, about CHUNK / 4 letters at a time
                until = np.searchsorted(sizes, (sizes[row - 1] if row else 0) + CHUNK // 4)
                end = int(ends[min(np.searchsorted(ends, max(until, row + 1)), len(ends) - 1)])
                if (out := shared(table.slice(row, end - row))) is not None:
                    yield out
                row = end

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            prefix = batch.column(0)
            open_ = prefix[len(prefix) - 1]
            cut = int(np.argmax(np.asarray(pa.compute.equal(prefix, open_))))  # the last prefix may go on in the next batch
            if held and (cut or prefix[0].as_py() != held[-1].column(0)[0].as_py()):
                yield from work(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            elif held:
                held.append(batch)
            else:
                if cut:
                    yield from work(pa.Table.from_batches([batch.slice(0, cut)]))
                held = [batch.slice(cut)]
        if held:
            yield from work(pa.Table.from_batches(held))

    return grow


def _windows(span: int):
    """(h1, h2, shift, lo, hi, block) -> (h1, h2, lo, hi, s, w): one row for each suffix of a block, of `span` letters."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, offsets = packed.letters_of(batch.column(5))
            shift = batch.column(2).to_numpy()
            for a in range(0, batch.num_rows, 1000):
                at = offsets[a : a + 1001]
                n = np.diff(at) - span + 1
                start = packed.spread(at[:-1], n)
                of = np.repeat(np.arange(len(n)), n)
                take = pa.array(of + a)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(take) for i in (0, 1, 3, 4)), pa.array((start - at[:-1][of] + shift[of + a]).astype(np.int32)), packed.strings(letters, start, np.full(len(start), span))],
                    ["h1", "h2", "lo", "hi", "s", "w"],
                )

    return cut


def joined_runs(spans: DataFrame, by: str) -> DataFrame:
    """Overlapping or touching (by, s, e) made into maximal (by, span_start, span_end)."""
    before = Window.partitionBy(by).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    new = spans.withColumn("new", (F.col("s") > F.coalesce(F.max("e").over(before), F.lit(-1))).cast("int"))
    island = F.sum("new").over(Window.partitionBy(by).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0))
    return new.withColumn("island", island).groupBy(by, "island").agg(F.min("s").alias("span_start"), F.max("e").alias("span_end")).drop("island")


TREE = ["prefix", "h1", "h2", "shift", "lo", "hi", "block"]


def _overfull(known: DataFrame, most: int) -> DataFrame:
    """(prefix, n, long): the prefixes of more blocks than a group may have."""
    return materialise(known.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") > most).withColumn("long", F.lit(True)), "overfull")


def _prefixed(known: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(blocks with the prefix of their group, blocks of anchors that are too common for a group).

    A prefix is the letters from the anchor on, as many of LENGTHS as it takes
    until no more than `most` blocks have it.
    """
    total = known.count()
    known = known.withColumn("prefix", F.expr(f"substring(block, a + 1, {LENGTHS[0]})"))
    for k, length in enumerate(LENGTHS):
        long = _overfull(known, most)
        if long.isEmpty():
            return known, None
        listed = join_counted(known, long, ["prefix"], "n", total, "left")
        if length == ANCHOR:
            listed = materialise(listed, "prefixed")
            return listed.where("long IS NULL").drop("long"), listed.where("long").drop("long", "prefix")
        known = materialise(listed.withColumn("prefix", F.when(F.col("long"), F.expr(f"substring(block, a + 1, {LENGTHS[k + 1]})")).otherwise(F.col("prefix"))).drop("long"), "prefixed")
    raise AssertionError


def _two_sided(blocks: DataFrame, span: int) -> DataFrame:
    """The blocks of very common anchors under prefixes of ANCHOR + 20 letters.

    A suffix that begins near the anchor has so many letters from the anchor
    on; any other has 20 letters before the anchor, and its prefix begins there.
    """
    more = (span - ANCHOR) // 2
    right = blocks.where(F.length("block") - F.greatest(F.col("a") - more, F.lit(0)) >= span).select(
        F.expr(f"concat('R', substring(block, a + 1, {ANCHOR + more}))").alias("prefix"), "h1", "h2", F.greatest(F.col("a") - more, F.lit(0)).alias("shift"), "lo", "hi", F.expr(f"substring(block, greatest(a - {more}, 0) + 1)").alias("block")
    )
    left = blocks.where(F.col("a") > more).select(
        F.expr(f"concat('L', substring(block, a - {more} + 1, {ANCHOR + more}))").alias("prefix"), "h1", "h2", F.lit(0).alias("shift"), "lo", "hi", F.expr(f"substring(block, 1, a - {more} - 1 + {span})").alias("block")
    )
    return right.unionByName(left.where(F.length("block") >= span))


def shared_spans(records: DataFrame, span: int = 64, least_heavy: int = 1000, group: int = GROUP) -> DataFrame:
    """(pos, span_start, span_end): maximal runs of letters that another record shares.

    A letter is shared if it lies in a run of at least `span` letters that
    also occurs, case apart, in a record with another pos. Starts count from
    0, ends are exclusive. Repeats within one record don't count. Records
    with null or too short sequences, and null pos, give no rows; equal rows
    count once; a character outside of ASCII matches nothing.
    """
    if span < ANCHOR + 2:
        raise ValueError(f"span must be at least {ANCHOR + 2}")
    spark = records.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = records.where(F.col("pos").isNotNull()).select(F.col("pos").cast("long").alias("id"), normal(F.col("sequence")).alias("text")).where(F.length("text") >= span)
    # anchors that two records hold, counted by a partial aggregate
    held = rows.mapInArrow(_anchors(span), "h long, id long").groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    bits = flags(held, "h", FILTER)
    blocks = rows.mapInArrow(_blocks(span, spark.sparkContext.broadcast(bits)), "id long, off long, a int, block string")
    blocks = materialise(blocks.withColumn("h1", F.xxhash64("block")).withColumn("h2", F.xxhash64(F.lit(1), "block")), "blocks")
    # equal blocks meet in a partial aggregate, so a span that most records hold is a single row afterwards
    first = [F.first(c).alias(c) for c in ("a", "block")]
    known = materialise(blocks.groupBy("h1", "h2").agg(*first, F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")), "known")
    some, rest = _prefixed(known, group)
    parts = [some.withColumn("shift", F.lit(0)).select(*TREE)]
    found_ = None
    if rest is not None:
        longer = materialise(_two_sided(rest, span), "longer")
        long = _overfull(longer, group)
        listed = materialise(join_counted(longer, long, ["prefix"], "n", longer.count(), "left"), "listed")
        parts.append(listed.where("long IS NULL").select(*TREE))
        # what is common even so is lengthened to the whole span: each prefix is then a node, found by an aggregate
        windows = materialise(listed.where("long").select(*TREE[1:]).mapInArrow(_windows(span), "h1 long, h2 long, lo long, hi long, s int, w string"), "windows")
        deep = windows.groupBy("w").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("w", "n")
        found_ = join_counted(windows.select("h1", "h2", "s", "w"), deep, ["w"], "n", windows.count(), least=least_heavy).select("h1", "h2", "s", (F.col("s") + span).alias("e"))
    for part in parts:
        grown = part.repartition(tasks, "prefix").sortWithinPartitions("prefix").mapInArrow(_trees(span), "h1 long, h2 long, s int, e int")
        found_ = grown if found_ is None else found_.unionByName(grown)
    nodes = materialise(found_, "nodes")
    # stretches of one block travel together, so each block is one row of the join
    per_block = nodes.groupBy("h1", "h2").agg(F.collect_list(F.struct("s", "e")).alias("runs"))  # at most a block's length
    counted = per_block.join(known.select("h1", "h2", "n"), ["h1", "h2"])
    placed = join_counted(blocks.select("id", "off", "h1", "h2"), counted, ["h1", "h2"], "n", blocks.count(), least=least_heavy)
    runs = placed.select("id", "off", F.explode("runs").alias("r")).select("id", (F.col("off") + F.col("r.s")).alias("s"), (F.col("off") + F.col("r.e")).alias("e"))
    return joined_runs(runs, "id").select(F.col("id").alias("pos"), "span_start", "span_end")


def found(records: DataFrame) -> DataFrame:
    """(pos, span_start, span_end) with spans of at least 64 letters."""
    return shared_spans(records).select("pos", F.col("span_start").cast("int").alias("span_start"), F.col("span_end").cast("int").alias("span_end"))


def shared_part(records: DataFrame) -> DataFrame:
    """(pos, shared_letters, share): how much of each record lies in shared spans; 0 where nothing does."""
    spans = shared_spans(records).groupBy("pos").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_letters"))
    sizes = records.where(F.col("pos").isNotNull()).groupBy("pos").agg(F.max(F.length("sequence")).alias("size"))
    shared = F.coalesce("shared_letters", F.lit(0))
    share = F.when(F.col("size") > 0, F.round(shared / F.col("size"), 6)).otherwise(0.0)
    return sizes.join(spans, "pos", "left").select("pos", shared.alias("shared_letters"), share.alias("share"))
