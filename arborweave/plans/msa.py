"""Progressive alignment along a tree, level by level, and what is read off its graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborweave.functions import jvm, models
from arborweave.functions import kernel as K
from arborweave.functions import sequences as S
from arborweave.operators import trees as T
from arborweave.session import materialise

#: A graph in one row: a pair's alignment needs both whole graphs.
GRAPH = "states array<long>, e_start array<int>, e_end array<int>, e_weight array<float>, e_skipped array<int>, e_distance array<float>, e_bounds array<int>, kind array<int>, left array<int>, right array<int>"
FIELDS = [x.split()[0] for x in GRAPH.split(", ")]
#: Rows in an Arrow batch of graphs, which may be long.
BATCH = 64


def to_row(g: K.Graph) -> dict:
    return {
        "states": [int(x) for x in g.states], "e_start": g.start.astype(np.int32), "e_end": g.end.astype(np.int32), "e_weight": g.weight, "e_skipped": g.skipped.astype(np.int32), "e_distance": g.distance,
        "e_bounds": g.bounds.astype(np.int32), "kind": g.kind.astype(np.int32), "left": g.left, "right": g.right,
    }


def from_row(r: dict, prefix: str = "") -> K.Graph:
    v = {f: np.asarray(r[prefix + f]) for f in FIELDS}
    return K.Graph(
        v["states"].astype(np.int64), v["e_start"].astype(np.int64), v["e_end"].astype(np.int64), v["e_weight"].astype(np.float32), v["e_skipped"].astype(np.int32), v["e_distance"].astype(np.float32),
        v["kind"].astype(np.int8), v["left"].astype(np.int32), v["right"].astype(np.int32), v["e_bounds"].astype(np.int32),
    )


def leaf_graphs(leaves: DataFrame, options: models.Options, homopolymer: float | None = None, qualities: bool = True, least_quality: int = 10) -> DataFrame:
    """Graphs of rows (node_id, sequence[, quality]): a chain, with shorter readings of equal bases at the given weight, and qualities below the least as unknown."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = models.model(options)
        for b in batches:
            rows = []
            for k in range(len(b)):
                text = (b["sequence"].iloc[k] or "").replace("-", "")
                quality = b["quality"].iloc[k] if qualities and "quality" in b else None
                states = K.quality_states(model, text, quality, least_quality) if quality else model.encode(text)
                g = K.graph_of(states, K.homopolymer_edges(states, homopolymer) if homopolymer else None)
                rows.append({"node_id": int(b["node_id"].iloc[k]), **to_row(g)})
            yield pd.DataFrame(rows, columns=["node_id", *FIELDS])

    columns = ["node_id", "sequence", *(["quality"] if "quality" in leaves.columns else [])]
    return leaves.select(*columns).mapInPandas(build, f"node_id long, {GRAPH}")


def _joined(level: DataFrame, done: DataFrame) -> DataFrame:
    """Rows (node_id, a, b, da, db) with both children's graphs."""
    a = done.select(F.col("node_id").alias("a"), *(F.col(f).alias(f"a_{f}") for f in FIELDS))
    b = done.select(F.col("node_id").alias("b"), *(F.col(f).alias(f"b_{f}") for f in FIELDS))
    return _met(_met(level, a, "a"), b, "b")


def _met(left: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """left join rows on `key` by a shuffle: graphs and gapped rows compress a hundredfold, so by the size of their file they'd be broadcast through the driver."""
    return left.join(rows.hint("merge"), key)


def _levels(tree: DataFrame) -> list[tuple[int, DataFrame]]:
    """(height, rows (node_id, a, b, da, db, ha, hb)) of the inner nodes of a binary tree, from the leaves up; ha and hb are the children's heights."""
    pairs = tree.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("node_id"), F.struct(F.coalesce("side", F.lit(0)).alias("side"), F.col("node_id").alias("c"), F.coalesce("dist", F.lit(0.0)).alias("d")).alias("x"))
    two = pairs.groupBy("node_id").agg(F.array_sort(F.collect_list("x")).alias("x")).where(F.size("x") == 2)
    rows = two.join(tree.select("node_id", "height"), "node_id").select("node_id", F.col("x")[0]["c"].alias("a"), F.col("x")[1]["c"].alias("b"), F.col("x")[0]["d"].alias("da"), F.col("x")[1]["d"].alias("db"), "height")
    below = tree.select(F.col("node_id").alias("c"), F.coalesce("height", F.lit(0)).alias("hc"))
    for side in ("a", "b"):
        rows = rows.join(below.withColumnsRenamed({"c": side, "hc": f"h{side}"}), side)
    rows = materialise(rows, "pairs")
    heights = sorted(r[0] for r in rows.select("height").distinct().collect())  # at most the tree's height
    return [(h, rows.where(F.col("height") == h).drop("height")) for h in heights]


def heights(tree: DataFrame) -> DataFrame:
    """tree with height as the longest way down to a leaf."""
    deep = T.closure(tree).join(T.leaves(tree).select("node_id"), "node_id").groupBy(F.col("ancestor_id").alias("node_id")).agg(F.max("depth").alias("height"))
    return tree.drop("height").join(deep, "node_id")


def balanced_forest(members: DataFrame, length: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(tree, tips) of families (family, member): a balanced binary tree for each, without any search.

    A family of f members is a heap of 2f - 1 nodes, whose last f are its
    members in order; node k hangs under k / 2. node_id is the family's
    number times 2^24 plus k, so a family has fewer than 2^23 members and
    families are numbered by non-negative integers below 2^39. tips: (node_id, family, member).
    """
    n = F.count("*").over(Window.partitionBy("family"))
    nth = F.row_number().over(Window.partitionBy("family").orderBy("member"))
    ranked = materialise(members.select("family", "member").distinct().withColumns({"n": n, "nth": nth}).where("n > 1"), "family")
    if not ranked.where((F.col("n") >= 1 << 23) | (F.col("family") < 0) | (F.col("family") >= 1 << 39)).isEmpty():
        raise ValueError("a family has 2^23 members or more, or a number outside of 0 to 2^39")
    base = F.shiftleft("family", 24)
    tips = ranked.select((base + F.col("n") - 1 + F.col("nth")).alias("node_id"), "family", "member")
    sizes = ranked.where("nth = 1").select("family", "n")
    nodes = sizes.select("family", "n", F.explode(F.expr("sequence(1L, 2 * n - 1)")).alias("k"))
    # node k of a heap of N nodes: its leftmost way down, k -> 2k, ends where 2k > N
    down = F.floor(F.log2((2 * F.col("n") - 1) / F.col("k")) + 1e-9).cast("int")
    tree = nodes.select(
        (base + F.col("k")).alias("node_id"),
        F.when(F.col("k") > 1, base + F.floor(F.col("k") / 2)).cast("long").alias("parent_id"),
        F.when(F.col("k") > 1, (F.col("k") % 2).cast("int")).alias("side"),
        F.when(F.col("k") > 1, F.lit(length)).alias("dist"),
        down.alias("height"),
    )
    return materialise(tree, "forest"), tips


def families(records: DataFrame, k: int = 24, least: int = 20) -> DataFrame:
    """(family, member): records (pos, sequence) tied by at least `least` shared k-mers with the first record of those k-mers; family is the smallest pos.

    Each k-mer ties its records to its smallest pos only, so a common k-mer makes links by the number of its records, not of their pairs.
    """
    from arborweave.operators.components import components
    from arborweave.operators.hits import shared_with_first

    links = shared_with_first(records.select(F.col("pos").alias("id"), F.col("sequence").alias("text")), k).where(F.col("c") >= least).select(F.col("id").alias("pos"), "head")
    return components(links.select(F.col("pos").alias("a"), F.col("head").alias("b"))).select(F.col("component").alias("family"), F.col("node").alias("member"))


def _climb(levels: list[tuple[int, DataFrame]], graphs: DataFrame, step: Callable, options: models.Options, paths: Callable | None = None) -> DataFrame:
    """Runs step(model, row) -> graph for each inner node, one distributed job per level of the tree; paths adds columns to the rows first."""
    spark = graphs.sparkSession
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    schema = f"node_id long, {GRAPH}"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = models.model(options)
        for b in batches:
            rows = [{"node_id": int(r["node_id"]), **to_row(step(model, r))} for r in b.to_dict("records")]
            yield pd.DataFrame(rows, columns=["node_id", *FIELDS])

    done = materialise(graphs, "leaves")
    every = {0: done}
    try:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        for h, level in levels:
            # only the levels that hold a child of this one are read
            need = {x for r in level.select("ha", "hb").distinct().collect() for x in r if x in every}
            known = None
            for x in sorted(need):
                known = every[x] if known is None else known.unionByName(every[x])
            if known is not None:
                rows = _joined(level, known).repartition(tasks, "node_id")
                every[h] = materialise((paths(rows) if paths else rows).mapInPandas(work, schema), "level")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    out = None
    for g in every.values():
        out = g if out is None else out.unionByName(g)
    return out


def align_tree(tree: DataFrame, leaves: DataFrame, options: models.Options | None = None, limits: K.Limits | None = None, homopolymer: float | None = None, least_quality: int = 10, anchors: dict | None = None) -> DataFrame:
    """Graphs (node_id, ...) of all nodes of a binary tree (node_id, parent_id, side, dist, height) from its leaves' sequences (node_id, sequence[, quality]).

    Each inner node is one dynamic programme over its children's graphs.
    Leaves without a sequence must have been pruned. anchors (least, trim,
    offset, most) restricts each programme to the tunnel around the exact
    matches of at least `least` residues of the two nodes' states; where that
    is more than the share `most` of the whole, or no path lies inside, the
    whole is filled.
    """
    options = options or models.preset("dna")

    levels = _levels(tree)
    paths = None if anchors else _paths(levels, options, limits, homopolymer)

    def step(model: models.Model, r: dict) -> K.Graph:
        a, b = from_row(r, "a_"), from_row(r, "b_")
        if "path" in r:
            path = K.Path(list(map(tuple, r["path"].reshape(-1, 5).tolist())), int(r["left_stop"]), int(r["right_stop"]), float(r["score"]), (a.n, b.n))
            return K.parent_of(a, b, path, model, r["da"], r["db"], limits)
        low, high = banded(a.states, b.states, **anchors) if anchors else (None, None)
        return K.parent_of(a, b, K.align(a, b, model.at(r["da"] + r["db"]), low, high), model, r["da"], r["db"], limits)

    return _climb(levels, leaf_graphs(leaves, options, homopolymer, least_quality=least_quality), step, options, paths)


def _paths(levels: list[tuple[int, DataFrame]], options: models.Options, limits: K.Limits | None, homopolymer: float | None, most: int = 256) -> Callable | None:
    """What adds the best path of both graphs (path, left_stop, right_stop, score) to joined rows, found in the executors' JVM; None where kernel.align() has to: states of other models have no table, nor have more than `most` different distances."""
    if options.kind != "dna" or not levels:
        return None
    between = F.col("da") + F.col("db")
    spans = levels[0][1].select(between.alias("d"))
    for _, level in levels[1:]:
        spans = spans.unionByName(level.select(between.alias("d")))
    distances = sorted(r[0] for r in spans.distinct().limit(most + 1).collect())
    if not distances or len(distances) > most:
        return None
    # the weights that leaves begin with and that are left each time an edge isn't used, with numpy's logarithms
    weights: list[np.float32] = []
    for w in {np.float32(1.0), np.float32(homopolymer or 1.0)}:
        while w > 1e-30 and w not in weights:
            weights.append(w)
            w = np.float32(float(w) * (limits or K.Limits()).weight)
    logs = np.log(np.maximum(np.array(weights, np.float32).astype(np.float64), 1e-30))
    found = jvm.function(levels[0][1].sparkSession, jvm.GRAPH, options, 0.0, distances=distances, logs={float(w): float(v) for w, v in zip(weights, logs, strict=True)})
    graph = lambda side: F.struct(*(f"{side}_{f}" for f in ("states", "e_start", "e_end", "e_weight")))
    return lambda rows: rows.select("*", F.inline(F.array(found(graph("a"), graph("b"), between))))


def banded(a: np.ndarray, b: np.ndarray, least: int, trim: int, offset: int, most: float) -> tuple[list[int] | None, list[int] | None]:
    """(lowest, highest) right site for each left site around the chained exact matches of two rows of states, or (None, None) without a band worth its while."""
    from arborweave.operators.hits import chain_anchors, tunnel

    known = {s: chr(0x4E00 + k) for k, s in enumerate(sorted({*map(int, a), *map(int, b)}))}
    chain = chain_anchors(local_anchors(*("".join(known[int(s)] for s in x) for x in (a, b)), least), trim)
    if not chain:
        return None, None
    low, high = tunnel(chain, len(a), len(b), offset)
    share = sum(h - x + 1 for x, h in zip(low, high, strict=True)) / ((len(a) + 1) * (len(b) + 1))
    return (low, high) if share <= most else (None, None)


def replay_tree(tree: DataFrame, rows: DataFrame, options: models.Options | None = None) -> DataFrame:
    """Graphs of all nodes for a given alignment (node_id, sequence with gaps): the paths follow from the gaps, nothing is searched.

    An inner node has a residue where either child has one.
    """
    options = options or models.preset("dna")
    masks = rows.select("node_id", F.regexp_replace("sequence", "[^-]", "N").alias("row"))
    done, levels = masks, _levels(tree)
    for _, level in levels:
        a, b = done.select(F.col("node_id").alias("a"), F.col("row").alias("x")), done.select(F.col("node_id").alias("b"), F.col("row").alias("y"))
        both = _met(_met(level, a, "a"), b, "b")
        merged = F.array_join(F.zip_with(F.split("x", ""), F.split("y", ""), lambda p, q: F.when((p == "N") | (q == "N"), "N").when((p == "-") | (q == "-"), "-").otherwise("")), "")
        done = materialise(done.unionByName(both.select("node_id", merged.alias("row"))), "masks")
    x, y = done.select(F.col("node_id").alias("a"), F.col("row").alias("a_row")), done.select(F.col("node_id").alias("b"), F.col("row").alias("b_row"))

    def step(model: models.Model, r: dict) -> K.Graph:
        a, b = from_row(r, "a_"), from_row(r, "b_")
        return K.parent_of(a, b, K.path_of_rows(r["a_row"], r["b_row"], a, b), model, r["da"], r["db"])

    levels = [(h, _met(_met(level, x, "a"), y, "b")) for h, level in levels]
    return _climb(levels, leaf_graphs(rows.select("node_id", S.degap(F.col("sequence")).alias("sequence")), options), step, options)


def replayed_rows(tree: DataFrame, rows: DataFrame, options: models.Options | None = None) -> DataFrame:
    """aligned_rows() of replay_tree(), ancestors included: (root, node_id, sequence) of all nodes of a given alignment (node_id, sequence with gaps).

    Nothing is searched, so no site passes another by and a node's states
    follow column by column from its children's; for DNA rows of states climb
    the levels and no graphs are made. Other models go by their graphs.
    """
    options = options or models.preset("dna")
    if options.kind != "dna":
        return aligned_rows(tree, replay_tree(tree, rows, options), options, ancestors=True)
    model = models.model(options)
    known = F.create_map(*(F.lit(x) for s, m in {"-": 0, **model.symbols}.items() for x in (s, m)))
    letters = F.filter(F.split(F.upper("sequence"), ""), lambda c: c != "")
    done = materialise(rows.select("node_id", F.transform(letters, lambda c: F.coalesce(known[c], F.lit(model.unknown)).cast("int")).alias("states")), "states")
    both = F.zip_with("x", "y", lambda p, q: F.when(p.bitwiseAND(q) != 0, p.bitwiseAND(q)).otherwise(p.bitwiseOR(q)))
    checked = F.when(F.size("x") == F.size("y"), both).otherwise(F.raise_error(F.lit("rows of one alignment differ in length")))
    every = {0: done}
    for h, level in _levels(tree):
        need = sorted({x for r in level.select("ha", "hb").distinct().collect() for x in r if x in every})
        if need:
            below = every[need[0]]
            for x in need[1:]:
                below = below.unionByName(every[x])
            a, b = below.select(F.col("node_id").alias("a"), F.col("states").alias("x")), below.select(F.col("node_id").alias("b"), F.col("states").alias("y"))
            every[h] = materialise(_met(_met(level, a, "a"), b, "b").select("node_id", checked.alias("states")), "states")
    whole = done
    for h in list(every)[1:]:
        whole = whole.unionByName(every[h])
    roots = tree.where("parent_id IS NULL").select(F.col("node_id").alias("root"))
    under = T.closure(tree).join(roots, F.col("ancestor_id") == F.col("root"), "left_semi").select("node_id", F.col("ancestor_id").alias("root"))
    top = _met(roots, whole.select(F.col("node_id").alias("root"), F.col("states").alias("top")), "root")
    shown = F.array(*(F.lit(x) for x in ("-", *model.decode(range(1, 16)))))
    # a root has a residue wherever any row below it has one
    text = F.array_join(F.zip_with("states", "top", lambda s, t: F.when(t == 0, "").otherwise(F.get(shown, s))), "")
    return _met(_met(under, whole, "node_id"), top, "root").where(F.exists("states", lambda s: s > 0)).select("root", "node_id", text.alias("sequence"))


def columns_of(tree: DataFrame, graphs: DataFrame) -> DataFrame:
    """(root, col, node_id, state, kind): the alignment under each root, with a column for each site of the root; a node has no row where it has a gap.

    From the roots down, each level's sites take the column of the parent's
    site that stems from them.
    """
    graphs = materialise(graphs, "graphs")
    sites = graphs.select("node_id", F.posexplode(F.arrays_zip("states", "kind", "left", "right"))).select("node_id", (F.col("pos") + 1).alias("site"), "col.states", "col.kind", "col.left", "col.right")
    sites = materialise(sites, "sites")
    children = tree.where("parent_id IS NOT NULL").select("parent_id", "node_id", F.coalesce("side", F.lit(0)).alias("side"))
    rank = F.row_number().over(Window.partitionBy("parent_id").orderBy("side", "node_id"))
    children = materialise(children.withColumn("nth", rank).select(F.col("parent_id").alias("p"), F.col("node_id").alias("c"), "nth"), "children")
    now = tree.where("parent_id IS NULL").select("node_id", F.col("node_id").alias("root")).join(sites, "node_id").withColumn("col", F.col("site") - 1)
    every = []
    while True:
        now = materialise(now, "columns")
        if now.isEmpty():
            break
        every.append(now.select("root", "col", "node_id", F.col("states").alias("state"), "kind"))
        below = now.hint("merge").join(children, now["node_id"] == children["p"]).select("root", "col", F.col("c").alias("node_id"), F.when(F.col("nth") == 1, F.col("left")).otherwise(F.col("right")).alias("site")).where("site > 0")
        now = below.join(sites.hint("merge"), ["node_id", "site"])
    if not every:
        return now.select("root", "col", "node_id", F.col("states").alias("state"), "kind")
    out = every[0]
    for e in every[1:]:
        out = out.unionByName(e)
    return out


def aligned_rows(tree: DataFrame, graphs: DataFrame, options: models.Options | None = None, ancestors: bool = False) -> DataFrame:
    """(root, node_id, sequence): the alignment under each root as rows of equal length, of the leaves or of all nodes; columns with only gaps are left out."""
    options = options or models.preset("dna")
    cells = materialise(columns_of(tree, graphs), "cells")
    tips = T.leaves(tree).select("node_id")
    live = cells.join(tips, "node_id", "left_semi").select("root", "col").distinct()
    # one alignment's columns are numbered in one window: they are as many as its longest row has letters
    dense = live.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("col")) - 1)
    dense = materialise(dense.withColumn("width", F.count("*").over(Window.partitionBy("root"))), "dense")
    chosen = cells if ancestors else cells.join(tips, "node_id", "left_semi")
    # what an ancestor has passed by prints as a gap
    shown = chosen.where(~F.col("kind").isin(K.X_SKIPPED, K.Y_SKIPPED)).join(dense.hint("merge"), ["root", "col"])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = models.model(options)
        gap = "---" if options.kind == "codon" else "-"
        for b in batches:
            out = []
            for root, node, width, places, states in b.itertuples(index=False, name=None):
                row = np.full(int(width), gap, object)
                row[np.asarray(places, np.int64)] = model.decode(states)
                out.append((root, node, "".join(row)))
            yield pd.DataFrame(out, columns=["root", "node_id", "sequence"])

    # a row's cells travel as plain arrays
    held = shown.groupBy("root", "node_id", "width").agg(F.collect_list(F.struct("place", "state")).alias("cells"))
    return held.select("root", "node_id", "width", "cells.place", "cells.state").mapInPandas(write, "root long, node_id long, sequence string")


def pairwise(pairs: DataFrame, options: models.Options | None = None, distance: float = 0.1, sums: bool = False, anchors: bool = False) -> DataFrame:
    """(id, score, n_match, n_equal, n_columns, row_1, row_2[, forward, backward, mean_posterior]) of rows (id, text_1, text_2).

    sums adds the forward and backward totals and the mean posterior of the
    path's matches; anchors restricts each programme to a tunnel around its
    exact matches. Null texts give no rows; empty ones align to gaps.
    """
    options = options or models.preset("dna")
    schema = "id string, score double, n_match int, n_equal int, n_columns int, row_1 string, row_2 string" + (", forward double, backward double, mean_posterior double" if sums else "")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from arborweave.operators.hits import chain_anchors, tunnel

        model = models.model(options)
        scores = model.at(distance)
        for batch in batches:
            out = []
            coded = [(model.encode(x), model.encode(y)) for x, y in zip(batch["text_1"], batch["text_2"], strict=True)]
            plain = None if anchors else K.align_many(coded, scores)
            for k, (i, t1, t2) in enumerate(zip(batch["id"], batch["text_1"], batch["text_2"], strict=True)):
                a, b = K.graph_of(coded[k][0]), K.graph_of(coded[k][1])
                if anchors:
                    chain = chain_anchors(local_anchors(t1, t2, 12))
                    low, high = tunnel(chain, a.n, b.n) if chain else (None, None)
                    path = K.align(a, b, scores, low, high)
                else:
                    path = plain[k]
                x, y = model.decode(a.states), model.decode(b.states)
                gap = "---" if options.kind == "codon" else "-"
                r1 = [x[p - 1] if p > 0 else gap for _, p, _, _, _ in path.steps]
                r2 = [y[q - 1] if q > 0 else gap for _, _, q, _, _ in path.steps]
                matches = [(p, q) for s, p, q, _, _ in path.steps if s == K.M]
                row = (str(i), path.score, len(matches), sum(a.states[p - 1] == b.states[q - 1] for p, q in matches), len(path.steps), "".join(r1), "".join(r2))
                if sums:
                    f, g, post, _ = K.posterior(a, b, scores)
                    row += (f, g, float(np.mean([post[p, q] for p, q in matches])) if matches else 0.0)
                out.append(row)
            yield pd.DataFrame(out, columns=[c.strip().split()[0] for c in schema.split(",")])

    rows = pairs.where("text_1 IS NOT NULL AND text_2 IS NOT NULL")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(F.col("id").cast("string").alias("id"), "text_1", "text_2").repartition(tasks, "id").mapInPandas(work, schema)


def spread_pairs(pairs: DataFrame) -> DataFrame:
    """Rows (id, text_1, text_2) without null texts, spread over all tasks."""
    rows = pairs.where("text_1 IS NOT NULL AND text_2 IS NOT NULL").select(F.col("id").cast("string").alias("id"), "text_1", "text_2")
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")


def sums(pairs: DataFrame, options: models.Options | None = None, distance: float = 0.1) -> DataFrame:
    """(id, forward, backward, mean_posterior) of rows (id, text_1, text_2), as pairwise() gives them."""
    total = jvm.function(pairs.sparkSession, jvm.SUMS, options or models.preset("dna"), distance)
    return spread_pairs(pairs).select("id", F.inline(F.array(total("text_1", "text_2"))))


def sampled(pairs: DataFrame, options: models.Options | None = None, distance: float = 0.1) -> DataFrame:
    """(id, n_columns, n_match) of a path drawn by its probability for each row (id, text_1, text_2).

    The generator's seed is the id's hash, and a step takes one of its numbers, as in kernel.sample().
    """

    def numbers(seeds: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng(int(s)).random(int(n)).astype("<f8").tobytes() for s, n in zip(seeds, counts, strict=True)])

    drawn = F.pandas_udf(numbers, "binary")(F.pmod(F.xxhash64("id"), F.lit(1 << 31)), F.length("text_1") + F.length("text_2") + 1)
    path = jvm.function(pairs.sparkSession, jvm.SAMPLE, options or models.preset("dna"), distance)
    rows = spread_pairs(pairs).select("id", "text_1", "text_2", drawn.alias("numbers"))
    return rows.select("id", F.inline(F.array(path("text_1", "text_2", F.col("numbers")))))


def local_anchors(a: str, b: str, k: int) -> list[tuple[int, int, int, float]]:
    """Maximal exact matches of at least k letters between two strings, as (start, start, length, score)."""
    where: dict[str, list[int]] = {}
    for j in range(len(b) - k + 1):
        where.setdefault(b[j : j + k], []).append(j)
    seeds = {(i, j) for i in range(len(a) - k + 1) for j in where.get(a[i : i + k], ())}
    out = []
    for i, j in seeds:
        if (i - 1, j - 1) not in seeds:
            n = 0
            while (i + n, j + n) in seeds:
                n += 1
            out.append((i, j, n + k - 1, float(n + k - 1)))
    return out


def p_matrices(distances: list[float], options: models.Options | None = None) -> list[tuple[float, int, int, float]]:
    """(distance, i, j, p) of the model's transition probabilities."""
    model = models.model(options or models.preset("dna"))
    return [(d, i, j, float(p[i, j])) for d in distances for p in [model.probabilities(d)] for i in range(model.size) for j in range(model.size)]
