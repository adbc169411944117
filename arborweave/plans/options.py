"""The options of a run, from the command line and a config file."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from arborweave.functions import kernel as K
from arborweave.functions import models
from arborweave.sources.formats import merged_options, read_options


@dataclass(frozen=True)
class Settings:
    """Names are those of the command line with _ for -. Empty or negative values stand for `not given`."""

    seqfile: str = ""
    treefile: str = ""
    ref_seqfile: str = ""
    ref_treefile: str = ""
    queryfile: str = ""
    outfile: str = "outfile"
    outformat: str = "fasta"
    config_file: str = ""
    config_log_file: str = ""
    events: bool = False
    xml: bool = False
    guidetree: bool = False
    output_nhx_tree: bool = False
    output_ancestors: bool = False
    ancestors: bool = False
    output_graph: bool = False
    translate: bool = False
    mt_translate: bool = False
    find_orfs: bool = False
    codons: bool = False
    no_terminal_edges: bool = False
    # placement
    fragments: bool = False
    both_strands: bool = False
    compare_reverse: bool = False
    one_placement_only: bool = False
    all_nodes: bool = False
    internal_nodes: bool = False
    terminal_nodes: bool = False
    guided: bool = False
    query_distance: float = 0.1
    min_query_overlap: float = 0.5
    min_query_identity: float = 0.5
    use_identity_score: bool = False
    exonerate_local_keep_best: int = 10
    exonerate_local_keep_above: float = -1.0
    exonerate_gapped_keep_best: int = 3
    placement_rounds: int = 0  # one query after the other per node; else so many equal portions
    output_discarded_queries: bool = False
    # pile-up and contigs
    pileup_alignment: bool = False
    build_contigs: bool = False
    show_contig_ancestor: bool = False
    use_duplicate_weights: bool = False
    no_read_ordering: bool = False
    consensus_minimum: int = 5
    consensus_minimum_proportion: float = 0.5
    output_consensus: bool = False
    query_cluster_attempts: int = 1
    min_orf_length: int = 50
    min_orf_coverage: float = 0.0
    # reads
    homopolymer: bool = False
    pacbio: bool = False
    no_fastq: bool = False
    qscore_minimum: int = 10
    pair_end: bool = False
    # pruning and trimming
    prune_extended_alignment: bool = False
    prune_keep_number: int = 0
    prune_keep_closest: bool = False
    trim_extended_alignment: bool = False
    trim_keep_sites: int = 15
    # anchors
    no_anchors: bool = False
    use_prefix_anchors: bool = False
    prefix_hit_length: int = 30
    exonerate_hit_trim: int = 5
    anchors_offset: int = 15
    anchoring_threshold: float = 1.0
    # model
    ins_rate: float = -1.0
    del_rate: float = -1.0
    indel_rate: float = -1.0
    gap_extension: float = -1.0
    end_gap_extension: float = -1.0
    pair_read_gap_extension: float = -1.0
    dna_kappa: float = 2.0
    dna_rho: float = 1.0
    ambiguity_factor: float = 1.0
    no_log_odds: bool = False
    no_score_scaling: bool = False
    no_reduced_terminal_penalties: bool = False
    # branches
    scale_branches: float = -1.0
    truncate_branches: float = 0.2
    real_branches: bool = False
    fixed_branches: float = -1.0
    min_branch_length: float = 0.001
    # skipped sites
    any_skips_confirm_insertion: int = 10
    match_skips_confirm_insertion: int = 5
    branch_length_confirm_insertion: float = 0.5
    branch_skip_penalty_per_branch: float = 0.9
    keep_all_edges: bool = False
    silent: bool = False

    def model(self, kind: str, pi: tuple[float, ...] = (0.25,) * 4) -> models.Options:
        """The model's options; what isn't given takes the default of the data type."""
        given = {
            "ins_rate": self.ins_rate if self.ins_rate >= 0 else self.indel_rate, "del_rate": self.del_rate if self.del_rate >= 0 else self.indel_rate,
            "gap_extension": self.gap_extension, "end_gap_extension": self.end_gap_extension, "pair_gap_extension": self.pair_read_gap_extension,
        }
        return models.preset(
            kind, **{k: v for k, v in given.items() if v >= 0}, kappa=self.dna_kappa, rho=self.dna_rho, ambiguity_factor=self.ambiguity_factor, log_odds=not self.no_log_odds,
            score_scaling=not self.no_score_scaling, reduced_terminal=not self.no_reduced_terminal_penalties, terminal_edges=not self.no_terminal_edges, pi=pi,
        )

    def anchors(self) -> dict | None:
        """How alignments are restricted to tunnels around exact matches; None if they aren't."""
        if self.no_anchors or not self.use_prefix_anchors:
            return None
        return {"least": self.prefix_hit_length, "trim": self.exonerate_hit_trim, "offset": self.anchors_offset, "most": self.anchoring_threshold}

    def limits(self) -> K.Limits:
        if self.keep_all_edges:
            return K.Limits(1 << 30, 1e9, 1 << 30, 1.0)
        return K.Limits(self.any_skips_confirm_insertion, self.branch_length_confirm_insertion, self.match_skips_confirm_insertion, self.branch_skip_penalty_per_branch)


#: Options that are known and not supported: giving one is an error rather than silently nothing.
UNSUPPORTED = {
    "pacbio": "the correction for missing data of that platform isn't built",
    "pair_end": "read pairs are joined by operators.records.paired, the alignment doesn't treat their break specially",
    "no_read_ordering": "a pile doesn't depend on the order of its reads",
}


def checked(settings: Settings) -> Settings:
    """settings, or a ValueError that names an option without effect."""
    defaults = Settings()
    for name, why in UNSUPPORTED.items():
        if getattr(settings, name) != getattr(defaults, name):
            raise ValueError(f"--{name.replace('_', '-')} is not supported: {why}")
    if settings.no_anchors and settings.use_prefix_anchors:
        raise ValueError("--no-anchors and --use-prefix-anchors exclude each other")
    if settings.all_nodes and (settings.internal_nodes or settings.terminal_nodes) or settings.internal_nodes and settings.terminal_nodes:
        raise ValueError("give one of --all-nodes, --internal-nodes and --terminal-nodes")
    return settings


def parse(arguments: list[str]) -> Settings:
    """Settings of `--key value` and `--flag` arguments; those of a --config-file come after them."""
    fields = {f.name.replace("_", "-"): f for f in dataclasses.fields(Settings)}
    line: dict[str, str] = {}
    rest = list(arguments)
    while rest:
        key, _, value = rest.pop(0).removeprefix("--").partition("=")
        if key not in fields:
            raise KeyError(f"unknown option {key}")
        if not isinstance(fields[key].default, bool) and not value:
            value = rest.pop(0)
        line[key] = value or "1"
    file = {}
    if "config-file" in line:
        with open(line["config-file"]) as f:
            file = read_options(f.read())
    return merged_options(Settings, line, file)


def log(settings: Settings) -> str:
    """A config file that gives the same settings: all that differ from their defaults."""
    out = []
    for f in dataclasses.fields(Settings):
        value = getattr(settings, f.name)
        if value != f.default and f.name not in ("config_file", "config_log_file"):
            out.append(f"{f.name.replace('_', '-')} = {int(value) if isinstance(value, bool) else value}")
    return "\n".join(out) + "\n"
