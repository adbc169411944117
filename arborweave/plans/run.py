"""A run on files: `python -m arborweave --seqfile F [--treefile T] ...`.

Three flows: alignment of sequences along a tree, placement of queries at a
reference alignment's nodes, and pile-ups of reads.
"""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweave.functions import models
from arborweave.functions import sequences as S
from arborweave.operators import columns as C
from arborweave.operators import hits as H
from arborweave.operators import records as R
from arborweave.operators import trees as T
from arborweave.plans import msa, placement
from arborweave.plans.options import Settings, checked, log
from arborweave.session import materialise, write_text
from arborweave.sources import formats, writers


_log = logging.getLogger("arborweave")
_begun = time.monotonic()


def _said(settings: Settings, what: str) -> None:
    """A message about a stage that is done, with the seconds since the run began; none with --silent."""
    if not settings.silent:
        _log.warning("%s after %.1f s", what, time.monotonic() - _begun)


def records(spark: SparkSession, path: str, settings: Settings, gaps: bool = False) -> DataFrame:
    """Numbered records of a file, translated if asked; repeated names become unique."""
    rows = formats.read_records(spark, path, gaps)
    rows = rows.withColumn("pos", F.monotonically_increasing_id())
    if settings.translate or settings.mt_translate:
        rows = rows.withColumn("sequence", S.translate(S.dna_letters(F.col("sequence"), True), settings.mt_translate))
    return materialise(R.number_names(rows), "records")


def _kind(rows: DataFrame, settings: Settings) -> tuple[str, tuple[float, ...]]:
    if settings.codons:
        return "codon", (0.25,) * 4
    if not R.data_type(rows).first()["is_dna"]:
        return "protein", (0.25,) * 4
    share = {r["base"]: r["share"] for r in R.base_frequencies(rows).collect()}
    return "dna", tuple(max(1e-6, share[b] or 0.25) for b in "ACGT")


def tree_of(spark: SparkSession, rows: DataFrame, path: str, settings: Settings) -> DataFrame:
    """The tree of a file, or one of the sequences' shared k-mers; branch lengths by the settings, inner nodes numbered."""
    if path:
        tree = formats.read_newick(spark, path)
    else:
        nodes = placement.guide_tree(rows.select(F.col("name").alias("id"), S.degap(F.col("sequence")).alias("text")))
        none = F.lit(None).cast("string")
        tree = nodes.select("node_id", "parent_id", "side", "name", "dist", none.alias("tid"), none.alias("nhx"), "height")
    tree = materialise(T.branch_lengths(
        tree, settings.scale_branches if settings.scale_branches > 0 else 1.0, settings.truncate_branches, settings.min_branch_length, settings.fixed_branches if settings.fixed_branches >= 0 else None, settings.real_branches
    ), "tree")
    pruned = T.prune(tree, rows.select("name"))
    kept = materialise(msa.heights(pruned.join(tree.select("node_id", "tid"), "node_id").withColumn("side", F.row_number().over(T.Window.partitionBy("parent_id").orderBy("node_id")) - 1)), "pruned")
    names = T.named_inner(kept)
    return materialise(kept.drop("name").join(names, "node_id"), "named")


def _write(rows: DataFrame, settings: Settings, suffix: str = "") -> None:
    writers.save(writers.written(rows, settings.outformat, 70), f"{settings.outfile}{suffix}")


def align(spark: SparkSession, settings: Settings) -> DataFrame:
    """Flow of --seqfile: (node_id, pos, name, comment, sequence) of the alignment, which is written as well."""
    rows = records(spark, settings.seqfile, settings)
    kind, pi = _kind(rows, settings)
    options = settings.model(kind, pi)
    tree = tree_of(spark, rows, settings.treefile, settings)
    leaves = T.leaves(tree).select("node_id", "name").join(rows.drop("pos"), "name")
    quality = leaves.select("node_id", "sequence", *(["quality"] if not settings.no_fastq else []))
    graphs = materialise(msa.align_tree(tree, quality, options, settings.limits(), 0.9 if settings.homopolymer else None, settings.qscore_minimum, settings.anchors()), "graphs")
    _said(settings, "aligned")
    return _results(tree, graphs, options, rows, settings)


def _results(tree: DataFrame, graphs: DataFrame, options, rows: DataFrame, settings: Settings) -> DataFrame:
    every = materialise(msa.aligned_rows(tree, graphs, options, ancestors=True).join(tree.select("node_id", "name", "parent_id", "height"), "node_id"), "rows")
    out = every if settings.output_ancestors or settings.ancestors else every.where("height = 0")
    out = materialise(out.join(rows.select("name", "comment", "pos"), "name", "left").select("node_id", F.coalesce("pos", F.lit(1 << 40) + F.col("node_id")).alias("pos"), "name", F.coalesce("comment", F.lit("")).alias("comment"), "sequence", (F.col("height") == 0).alias("is_leaf")), "out")
    _write(out, settings)
    if settings.output_graph:
        root = tree.where("parent_id IS NULL").select("node_id", "name")
        whole = graphs.join(root, "node_id")
        sites = whole.select("name", F.posexplode("states")).select("name", F.col("pos").alias("site"), F.col("col").alias("symbol"))
        letters = F.create_map(*(F.lit(x) for mask, letter in models.model(options).letters.items() for x in (mask, letter)))
        sites = sites.withColumn("symbol", F.coalesce(letters[F.col("symbol")], F.lit("N" if options.kind == "dna" else "X" if options.kind == "protein" else "NNN")))
        # sites of a graph file count from 0, its start and stop have none
        edges = whole.select("name", F.explode(F.arrays_zip("e_start", "e_end", "e_weight")).alias("e"), F.size("states").alias("n")).select("name", (F.col("e.e_start") - 1).alias("start"), (F.col("e.e_end") - 1).alias("end"), F.col("e.e_weight").alias("weight"), "n")
        writers.save(writers.graph(sites, edges.where("start >= 0 AND `end` < n").drop("n")), f"{settings.outfile}.graph")
    if settings.xml:
        writers.save(writers.xml(out, writers.newick_text(tree, "names")), f"{settings.outfile}.xml")
    if settings.guidetree or settings.output_nhx_tree:
        write_text(tree.sparkSession, f"{settings.outfile}.tre", writers.newick_text(tree, "nhx") + "\n")
    if settings.events:
        pairs = every.select("name", "parent_id", F.col("sequence").alias("child")).join(every.select(F.col("node_id").alias("parent_id"), F.col("sequence").alias("parent")), "parent_id")
        writers.save(writers.event_lines(C.branch_events(pairs.withColumnRenamed("name", "branch"))).select("branch", "ord", F.concat("branch", "value").alias("value")), f"{settings.outfile}.events", ["branch", "ord"])
    return out


def place(spark: SparkSession, settings: Settings) -> DataFrame:
    """Flow of --ref-seqfile and --queryfile: (query, node, score, overlap, identity, reversed), written as text, with the discarded queries if asked."""
    reference = records(spark, settings.ref_seqfile, settings, gaps=True)
    kind, pi = _kind(reference, settings)
    options = settings.model(kind, pi)
    tree = tree_of(spark, reference, settings.ref_treefile, settings)
    rows = T.leaves(tree).select("node_id", "name").join(reference.drop("pos"), "name").select("node_id", "sequence")
    graphs = msa.replay_tree(tree, rows, options)
    inner = "internal" if settings.internal_nodes else "terminal" if settings.terminal_nodes else "all"
    texts = msa.aligned_rows(tree, graphs, options, ancestors=True).join(tree.select("node_id", "name", "tid", "height"), "node_id").select(F.col("name").alias("node"), "tid", "height", "sequence", S.degap(F.col("sequence")).alias("t_text"))
    rows_all = materialise(texts, "rows")
    texts = {"all": rows_all, "internal": rows_all.where("height > 0"), "terminal": rows_all.where("height = 0")}[inner]
    queries = records(spark, settings.queryfile, settings).select(F.col("name").alias("query"), "pos", "tid", F.col("sequence").alias("q_text"))
    if settings.guided:
        candidates = queries.where("tid <> ''").join(texts.where("tid <> ''").select("tid", "node"), "tid").select("query", "node")
    else:
        shared = H.shared_kmers(queries.select(F.col("query").alias("id"), F.col("q_text").alias("text")), texts.select(F.col("node").alias("id"), F.col("t_text").alias("text")), 8 if kind == "dna" else 4)
        # a first choice by shared words, a second by the score of a local alignment
        by_words = shared.select(F.col("a").alias("query"), F.col("b").alias("node"), F.col("n").alias("score"))
        above = settings.exonerate_local_keep_above if settings.exonerate_local_keep_above >= 0 else None
        candidates = materialise(H.keep_best(by_words, None if above is not None else settings.exonerate_local_keep_best, above).select("query", "node"), "local")
        if 0 < settings.exonerate_gapped_keep_best:
            scored = placement.local_scores(candidates.join(queries, "query").join(texts.select("node", "t_text"), "node"), options)
            candidates = H.keep_best(scored, settings.exonerate_gapped_keep_best).select("query", "node")
    both = settings.both_strands or settings.compare_reverse
    limits = {"least_overlap": settings.min_query_overlap, "least_identity": settings.min_query_identity, "options": options, "query_distance": settings.query_distance, "both_strands": both, "by": "identity" if settings.use_identity_score else "score"}
    candidates = materialise(candidates, "candidates")
    if settings.fragments:
        placed = placement.place_all(candidates.join(queries, "query").join(texts.drop("tid", "height", "sequence"), "node"), one_only=settings.one_placement_only, **limits)
    else:
        order = R.global_rank(queries.select("query", "q_text", "pos"), [F.col("pos")])
        placed = placement.place_in_turn(order, texts.select("node", "t_text"), candidates, settings.placement_rounds or None, **limits)
    placed = materialise(placed, "placed")
    _said(settings, "placed")
    placed.withColumn("value", F.concat_ws("\t", "query", "node", F.format_number("score", 4), F.format_number("overlap", 4), F.format_number("identity", 4))).select("value").write.text(f"{settings.outfile}.placements")
    _extended(tree, rows_all, placed, queries, options, settings)
    if settings.output_discarded_queries:
        lost = placement.discarded(queries, placed)
        writers.save(writers.fasta(lost.select("pos", F.col("query").alias("name"), F.lit("").alias("comment"), F.col("q_text").alias("sequence"))), f"{settings.outfile}.discarded")
    return placed


def _extended(tree: DataFrame, rows: DataFrame, placed: DataFrame, queries: DataFrame, options, settings: Settings) -> None:
    """Writes the reference with the queries that were placed on its own nodes, pruned and trimmed as asked."""
    own = placed.join(rows.select("node"), "node", "left_semi")
    leaves = rows.where("height = 0").select(F.col("node").alias("name"), "sequence")
    shown = rows.select(F.col("node").alias("name"), "sequence") if settings.output_ancestors else leaves
    cells = materialise(placement.extended(shown, rows.select("node", "sequence"), own, queries, options, settings.query_distance), "extended")
    new = cells.select("name").distinct().join(shown.select("name"), "name", "left_anti")
    gap = "---" if options.kind == "codon" else "-"

    def give(suffix: str, **how) -> None:
        out = placement.rows_of(cells, gap, **how)
        _write(R.global_rank(out.withColumn("comment", F.lit("")), [F.col("name")]).withColumn("pos", F.col("place")), settings, suffix)

    give("")
    if settings.prune_extended_alignment:
        if settings.prune_keep_closest:
            near = T.closest_leaf(tree).join(tree.select("node_id", F.col("name").alias("node")), "node_id").join(own.select("node").distinct(), "node")
            give(".pruned_closest", keep=near.select(F.col("leaf").alias("name")).unionByName(new))
        if settings.prune_keep_number > 0:
            kept = tree.sparkSession.createDataFrame([(x,) for x in T.thin(tree, settings.prune_keep_number)], "name string")
            give(".pruned", keep=kept.unionByName(new))
        if not settings.prune_keep_closest and settings.prune_keep_number <= 0:
            give(".pruned", keep=new)
    if settings.trim_extended_alignment:
        give(".trimmed", around=new, margin=settings.trim_keep_sites)


def pile(spark: SparkSession, settings: Settings) -> DataFrame:
    """Flow of --pileup-alignment: the first record of --queryfile is the seed; rows and consensus are written."""
    rows = records(spark, settings.queryfile, settings)
    if settings.find_orfs:
        best = R.frames(rows, settings.min_orf_length, settings.min_orf_coverage, settings.mt_translate).withColumn("r", F.row_number().over(T.Window.partitionBy("pos").orderBy(F.length("translation").desc(), "frame")))
        rows = rows.drop("sequence").join(best.where("r = 1").select("pos", F.col("translation").alias("sequence")), "pos")
    kind, pi = _kind(rows, settings)
    seed = rows.orderBy("pos").limit(1).select(F.lit("g").alias("group"), F.col("sequence").alias("seed"))
    piled, seed_row = placement.pile(
        rows.select(F.lit("g").alias("group"), "pos", "sequence"), materialise(seed, "seed"), settings.model(kind, pi), settings.min_query_overlap, settings.min_query_identity, settings.both_strands, 1 + max(1, settings.query_cluster_attempts)
    )
    piled = materialise(piled, "piled")
    _said(settings, "piled up")
    out = piled.join(rows.select("pos", "name", "comment"), "pos").select("pos", "name", "comment", F.col("row").alias("sequence"))
    _write(out, settings)
    if settings.output_consensus or settings.build_contigs:
        weights = rows.select("pos", F.col("num_duplicates").alias("w")) if settings.use_duplicate_weights else None
        contig = placement.contigs_of(piled, seed_row, settings.consensus_minimum, settings.consensus_minimum_proportion, weights, settings.show_contig_ancestor)
        writers.save(writers.fasta(contig.select(F.lit(0).alias("pos"), F.lit("consensus").alias("name"), F.lit("").alias("comment"), S.degap(F.col("consensus")).alias("sequence"))), f"{settings.outfile}.consensus")
    return out


def run(spark: SparkSession, settings: Settings) -> DataFrame:
    """The flow that the settings ask for; what it can't do is an error."""
    global _begun
    _begun = time.monotonic()
    checked(settings)
    if settings.config_log_file:
        write_text(spark, settings.config_log_file, log(settings))
    if settings.pileup_alignment and settings.queryfile:
        return pile(spark, settings)
    if settings.ref_seqfile and settings.queryfile:
        return place(spark, settings)
    if settings.seqfile:
        return align(spark, settings)
    raise ValueError("give --seqfile, or --ref-seqfile and --queryfile, or --pileup-alignment and --queryfile")
