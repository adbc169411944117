"""Operators on the guide tree (node_id, parent_id, side, name, dist, tid, height)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborweave.functions import sequences as S
from arborweave.session import materialise

#: Most nodes of heavy tags that are broadcast, and the parts a heavy tag's records are spread over beyond that.
MOST_NODES, SALTS = 100_000, 64


def closure(tree: DataFrame, most: int = 100_000) -> DataFrame:
    """(node_id, ancestor_id, depth, dist): each node with itself and all its ancestors; dist sums the branch lengths.

    Path doubling: each round joins paths with paths, so a tree of height h
    takes about log2(h) rounds, not h. A null dist counts 0. Links to missing
    parents end the path there; `most` bounds the rounds if links are circular.
    """
    step = tree.select("node_id", F.col("parent_id").alias("up"), F.coalesce("dist", F.lit(0.0)).alias("d")).where("node_id IS NOT NULL")
    paths = step.select("node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("depth"), F.lit(0.0).alias("dist"))
    # jumps of 1, 2, 4, ... steps
    jump = materialise(step.join(step.select(F.col("node_id").alias("up")), "up", "left_semi").select("node_id", "up", F.lit(1).alias("n"), "d"), "jump")
    rounds = 0
    while rounds < most.bit_length() and not jump.isEmpty():
        more = paths.join(jump.select(F.col("node_id").alias("ancestor_id"), "up", "n", "d"), "ancestor_id")
        more = more.select("node_id", F.col("up").alias("ancestor_id"), (F.col("depth") + F.col("n")).alias("depth"), (F.col("dist") + F.col("d")).alias("dist"))
        paths = materialise(paths.unionByName(more), "paths")
        far = jump.select(F.col("node_id").alias("up"), F.col("up").alias("top"), F.col("n").alias("m"), F.col("d").alias("e"))
        jump = materialise(jump.join(far, "up").select("node_id", F.col("top").alias("up"), (F.col("n") + F.col("m")).alias("n"), (F.col("d") + F.col("e")).alias("d")), "jump")
        rounds += 1
    return paths


def leaves(tree: DataFrame) -> DataFrame:
    """The rows of nodes that are nobody's parent."""
    parents = tree.select(F.col("parent_id").alias("node_id")).dropna().distinct()
    return tree.join(parents, "node_id", "left_anti")


def counts(tree: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(node_id, n_leaves, n_nodes, weight): leaves and nodes below each node (itself included), and the leaves' summed weight.

    weights: (name, weight) of leaves, e.g. numbers of copies; 1 for a leaf without one.
    """
    tip = leaves(tree).select("node_id", "name")
    tip = tip.join(weights, "name", "left").select("node_id", F.coalesce("weight", F.lit(1)).alias("w")) if weights is not None else tip.select("node_id", F.lit(1).alias("w"))
    return (
        closure(tree)
        .select("node_id", "ancestor_id")
        .join(tip, "node_id", "left")
        .groupBy(F.col("ancestor_id").alias("node_id"))
        .agg(F.count("w").alias("n_leaves"), F.count("*").alias("n_nodes"), F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("weight"))
    )


def closest_leaf(tree: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(node_id, leaf, dist): the leaf below each node that is nearest by branch lengths, of ties the smallest name.

    names: only leaves of these names count. Nodes without such a leaf give no rows.
    """
    tip = leaves(tree).select("node_id", "name").where("name IS NOT NULL")
    if names is not None:
        tip = tip.join(names.select("name").distinct(), "name", "left_semi")
    paths = closure(tree).join(tip, "node_id")
    best = F.min(F.struct(F.round("dist", 9).alias("dist"), F.col("name").alias("leaf")))
    return paths.groupBy(F.col("ancestor_id").alias("node_id")).agg(best.alias("b")).select("node_id", "b.leaf", "b.dist")


def branch_lengths(tree: DataFrame, scale: float = 1.0, longest: float | None = 0.2, least: float = 0.001, fixed: float | None = None, real: bool = False) -> DataFrame:
    """tree with dist by the policy: fixed, or non-positive ones set to least, scaled, and truncated at longest unless real. The root's null stays; a null elsewhere is taken as 0."""
    d = F.coalesce("dist", F.lit(0.0))
    if fixed is not None:
        new = F.lit(float(fixed))
    else:
        new = F.when(d <= 0, F.lit(least)).otherwise(d if real else d * scale)
        if not real and longest is not None:
            new = F.least(new, F.lit(longest))
    return tree.withColumn("dist", F.when(F.col("parent_id").isNotNull(), new))


def prune(tree: DataFrame, keep: DataFrame) -> DataFrame:
    """(node_id, parent_id, name, dist): the tree without the leaves whose name isn't in keep (name).

    Nodes without kept leaves go; a node with one child left is contracted,
    branch lengths adding up. The top of what is left becomes the root.
    """
    tip = leaves(tree).join(keep.select("name").dropna().distinct(), "name", "left_semi").select("node_id")
    paths = materialise(closure(tree), "closure")
    below = paths.join(tip, "node_id").groupBy(F.col("ancestor_id").alias("node_id")).agg(F.count("*").alias("n"))
    alive = tree.join(below, "node_id").select("node_id", "parent_id", "name", "n")
    # a node stays if it is a leaf or has two children with kept leaves below
    children = alive.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("c"))
    stays = materialise(alive.join(children, "node_id", "left").where("c IS NULL OR c >= 2").select("node_id", "name"), "stays")
    up = paths.where("depth > 0").join(stays.select("node_id"), "node_id").join(stays.select(F.col("node_id").alias("ancestor_id")), "ancestor_id")
    parent = up.groupBy("node_id").agg(F.min(F.struct("depth", F.col("ancestor_id").alias("parent_id"), "dist")).alias("p")).select("node_id", "p.parent_id", F.round("p.dist", 9).alias("dist"))
    return stays.join(parent, "node_id", "left").select("node_id", "parent_id", "name", "dist")


def named_inner(tree: DataFrame) -> DataFrame:
    """(node_id, name): inner nodes numbered #1#, #2#, ... in post-order; leaves keep their names.

    The post-order place of a node follows from its path: of two nodes the
    one in the left branch comes first, and a node after those below it.
    """
    sides = tree.select("node_id", F.coalesce("side", F.lit(0)).alias("side"))
    steps = closure(tree).select("node_id", F.col("ancestor_id").alias("via"), "depth").join(sides.select(F.col("node_id").alias("via"), "side"), "via")
    # the path from the root as a string of sides; '2' at its end sorts a node after its descendants
    path = steps.groupBy("node_id").agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("depth", F.col("side").cast("string").alias("s"))))), lambda x: x["s"]), "").alias("path"))
    inner = tree.select("node_id").join(leaves(tree).select("node_id"), "node_id", "left_anti").join(path, "node_id").select("node_id", F.concat("path", F.lit("2")).alias("path"))
    from arborweave.operators.records import global_rank

    numbered = global_rank(inner, [F.col("path")]).select("node_id", F.concat(F.lit("#"), F.col("place").cast("string"), F.lit("#")).alias("name"))
    return numbered.unionByName(leaves(tree).select("node_id", "name"))


def targets(tree: DataFrame, kind: str = "all", tid: str | None = None) -> DataFrame:
    """(name, tid): nodes a query may be placed at: all, internal or terminal; with tid those of that tag, or all if none has it."""
    rows = tree.select("name", F.trim("tid").alias("tid"), "height").where("name IS NOT NULL")
    rows = {"all": rows, "internal": rows.where("height > 0"), "terminal": rows.where("height = 0")}[kind].drop("height")
    if tid is not None:
        tagged = rows.where(F.col("tid") == tid)
        return rows if tagged.isEmpty() else tagged
    return rows


def placements_by_tag(records: DataFrame, tree: DataFrame) -> DataFrame:
    """(pos, name): each record with the nodes of its tag, by a join on tid that keeps heavy tags in place.

    The nodes of heavy tags are broadcast if they are at most MOST_NODES
    (counted); else the records of a heavy tag are spread by a salt and meet
    its nodes in a shuffle.
    """
    from arborweave.operators.skew import heavy_keys

    tagged = tree.select(F.trim("tid").alias("tid"), "name").where("tid <> '' AND name IS NOT NULL").distinct()
    tags = records.select("pos", F.regexp_replace("tid", r"^[ \t]+|[ \t]+$", "").alias("tid")).where("tid <> ''")
    names = [r[0] for r in heavy_keys(tags, "tid").collect()]
    hot = F.col("tid").isin(names) if names else F.lit(False)
    few, light = tagged.where(hot), tags.where(~hot).join(tagged.where(~hot), "tid")
    if not names:
        return light.select("pos", "name")
    if few.count() <= MOST_NODES:
        heavy = tags.where(hot).join(F.broadcast(few), "tid")
    else:
        salted = tags.where(hot).withColumn("salt", F.pmod(F.xxhash64("pos"), F.lit(SALTS)))
        heavy = salted.join(few.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["tid", "salt"])
    return heavy.select("pos", "name").unionByName(light.select("pos", "name"))


def parsimony_up(tree: DataFrame, states: DataFrame) -> DataFrame:
    """(node_id, state): base sets of all nodes from those of the leaves (name, state), as bit masks.

    Where the sets of the children overlap their intersection, else their
    union. One aggregate per level of height; a child without state is left
    out, a node without any gives no row.
    """
    level = leaves(tree).join(states, "name").select("node_id", "parent_id", "height", "state")
    done = materialise(level, "level")
    top = tree.agg(F.max("height")).first()[0] or 0
    waiting = done.where("false")
    for h in range(1, top + 1):
        waiting = waiting.unionByName(level)
        known = waiting.select(F.col("parent_id").alias("node_id"), F.col("state").alias("s")).groupBy("node_id").agg(F.bit_and("s").alias("a"), F.bit_or("s").alias("o"))
        here = tree.where(F.col("height") == h).select("node_id", "parent_id", "height")
        level = materialise(here.join(known, "node_id").select("node_id", "parent_id", "height", F.when(F.col("a") != 0, F.col("a")).otherwise(F.col("o")).alias("state")), "level")
        done = done.unionByName(level)
    return done.select("node_id", "state")


def parsimony_down(tree: DataFrame, up: DataFrame) -> DataFrame:
    """(node_id, state): the sets of parsimony_up refined from the root: the overlap with the parent's where there is one."""
    nodes = materialise(tree.select("node_id", "parent_id", "height").join(up, "node_id"), "up")
    level = nodes.where("parent_id IS NULL").select("node_id", "state")
    done = level
    top = tree.agg(F.max("height")).first()[0] or 0
    depth = 0
    while depth <= top + 1 and not level.isEmpty():
        below = nodes.join(level.select(F.col("node_id").alias("parent_id"), F.col("state").alias("p")), "parent_id")
        both = F.col("state").bitwiseAND(F.col("p"))
        level = materialise(below.select("node_id", F.when(both != 0, both).otherwise(F.col("state")).alias("state")), "down")
        done = done.unionByName(level)
        depth += 1
    return done


def midpoint(dists: DataFrame, tree: DataFrame) -> DataFrame:
    """(node_id, other_id, length, node_above, offset): the two most distant leaves and where their path's middle lies.

    dists is closure(tree). The middle lies on the branch above node_above,
    offset above it. The farthest pair is found from the two deepest leaves
    below each node, never from all pairs.
    """
    tip = leaves(tree).select("node_id")
    child = tree.select(F.col("node_id").alias("c"), F.col("parent_id").alias("ancestor_id"), F.coalesce("dist", F.lit(0.0)).alias("b")).where("ancestor_id IS NOT NULL")
    deep = dists.join(tip, "node_id").groupBy(F.col("ancestor_id").alias("c")).agg(F.max(F.struct("dist", F.col("node_id").alias("leaf"))).alias("m"))
    arms = child.join(deep, "c").select("ancestor_id", F.struct((F.col("m.dist") + F.col("b")).alias("d"), F.col("m.leaf").alias("leaf")).alias("arm"))
    two = arms.groupBy("ancestor_id").agg(F.sort_array(F.collect_list("arm"), asc=False).alias("arms")).where(F.size("arms") > 1)  # the children of one node
    best = two.select((F.col("arms")[0]["d"] + F.col("arms")[1]["d"]).alias("length"), F.col("arms")[0]["leaf"].alias("node_id"), F.col("arms")[1]["leaf"].alias("other_id"))
    far = best.orderBy(F.desc("length"), "node_id", "other_id").limit(1)
    half = far.join(dists, "node_id").withColumn("half", F.col("length") / 2).where("dist <= half")
    return half.groupBy("node_id", "other_id", "length", "half").agg(F.max(F.struct("dist", F.col("ancestor_id").alias("node_above"))).alias("m")).select("node_id", "other_id", "length", "m.node_above", (F.col("half") - F.col("m.dist")).alias("offset"))


def sorted_nodes(tree: DataFrame) -> DataFrame:
    """(name, place): leaves by name, then inner nodes by number, numbered from 1; equal names by node_id."""
    from arborweave.operators.records import global_rank

    rows = tree.where("name IS NOT NULL").select("name", "node_id", S.node_sort_key(F.col("name")).alias("k"))
    return global_rank(rows, [F.col("k.inner"), F.col("k.number"), F.col("k.name"), F.col("node_id")]).select("name", "place")


def thin(tree: DataFrame, keep: int, names: DataFrame | None = None) -> list[str]:
    """Greedy choice of `keep` mutually distant leaves (of those in names, if given), as sorted names.

    It begins with the smallest name and takes the leaf that is farthest from
    it next, then always the one whose distance to the nearest chosen one is
    greatest (of ties the smallest name). Each step measures the distances of
    all leaves to the newly chosen one only, so no table of pairs is made;
    the driver holds the chosen names. Fewer leaves than `keep` are all taken.
    """
    tip = leaves(tree).where("name IS NOT NULL")
    if names is not None:
        tip = tip.join(names.select("name").distinct(), "name", "left_semi")
    paths = materialise(closure(tree).join(tip.select("node_id", "name"), "node_id").select("name", "ancestor_id", "dist"), "paths")
    near = paths.select("name").distinct().withColumn("d", F.lit(float("inf")))
    chosen: list[str] = []
    while len(chosen) < keep:
        best = near.where(~F.col("name").isin(chosen)).orderBy(F.round("d", 9).desc(), "name").first()
        if best is None:
            break
        chosen.append(best["name"])
        if len(chosen) == keep:
            break
        up = F.broadcast(paths.where(F.col("name") == best["name"]).select("ancestor_id", F.col("dist").alias("y")))  # one leaf's ancestors
        new = paths.join(up, "ancestor_id").groupBy("name").agg(F.min(F.col("dist") + F.col("y")).alias("e"))
        near = near.join(new, "name").select("name", F.least("d", "e").alias("d"))
        near = materialise(near, "near")
    return sorted(chosen)


def nth_of(df: DataFrame, by: str, order: str) -> DataFrame:
    """df with nth, the row's number within `by` in order of `order`."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(order)))
