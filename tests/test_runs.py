import random

import pytest
from pyspark.sql import functions as F

from arborweave.plans.options import Settings, checked, log, parse
from arborweave.plans.run import run
from arborweave.sources.formats import graph_faults, read_fasta, read_graphs, read_options
from arborweave.streaming import arriving


def fasta(path, items):
    path.write_text("".join(f">{n}\n{s}\n" for n, s in items))
    return f"file://{path}"


def family(rng, n=5, size=80):
    base = "".join(rng.choice("ACGT") for _ in range(size))
    out = []
    for i in range(n):
        s = list(base)
        for _ in range(4):
            s[rng.randrange(size)] = rng.choice("ACGT")
        at = rng.randrange(60)
        out.append((f"s{i}", "".join(s[:at] + s[at + rng.choice([0, 3]) :])))
    return out


def test_options(tmp_path):
    (tmp_path / "c").write_text("dna-kappa = 3 # x\nevents\nquery-distance = 0.2\n")
    s = parse(["--seqfile", "a.fas", "--config-file", str(tmp_path / "c"), "--query-distance=0.3"])
    assert s.dna_kappa == 3.0 and s.events and s.query_distance == 0.3 and s.seqfile == "a.fas"
    assert read_options(log(s)) == {"seqfile": "a.fas", "events": "1", "query-distance": "0.3", "dna-kappa": "3.0"}
    with pytest.raises(KeyError):
        parse(["--no-such-option"])
    for bad in (Settings(pacbio=True), Settings(pair_end=True), Settings(no_read_ordering=True), Settings(no_anchors=True, use_prefix_anchors=True), Settings(internal_nodes=True, all_nodes=True)):
        with pytest.raises(ValueError):
            checked(bad)
    assert checked(Settings(silent=True)).anchors() is None and Settings(use_prefix_anchors=True, anchors_offset=7).anchors()["offset"] == 7
    assert Settings(keep_all_edges=True).limits().weight == 1.0 and Settings(indel_rate=0.2).model("protein").ins_rate == 0.2


def test_align_run(spark, tmp_path):
    items = family(random.Random(1))
    path = fasta(tmp_path / "in.fas", items)
    (tmp_path / "t.nwk").write_text("((s0:0.1,s1:0.1):0.05,((s2:0.1,s3:0.1):0.1,s4:0.2):0.05);")
    for tree in ("", f"file://{tmp_path}/t.nwk"):
        out = f"{tmp_path}/out{bool(tree)}"
        run(spark, Settings(seqfile=path, treefile=tree, outfile=out, xml=True, events=True, guidetree=True, output_ancestors=bool(tree)))
        rows = {r["name"]: r["sequence"] for r in read_fasta(spark, f"file://{out}").collect()}
        assert {n: rows[n].replace("-", "") for n, _ in items} == dict(items)
        assert len({len(s) for s in rows.values()}) == 1 and len(rows) == (9 if tree else 5)
        assert spark.read.text(f"file://{out}.events").count() > 0 and spark.read.text(f"file://{out}.xml").count() > 0


def test_run_with_anchors_quality_and_graph(spark, tmp_path, caplog):
    items = family(random.Random(5), 4, 120)
    path = fasta(tmp_path / "in.fas", items)
    (tmp_path / "t.nwk").write_text("((s0:0.1,s1:0.1):0.05,(s2:0.1,s3:0.1):0.05);")
    got = {}
    for anchored in (False, True):
        out = f"{tmp_path}/a{anchored}"
        run(spark, Settings(seqfile=path, treefile=f"file://{tmp_path}/t.nwk", outfile=out, use_prefix_anchors=anchored, prefix_hit_length=12, exonerate_hit_trim=2, output_graph=True, silent=anchored))
        got[anchored] = {r["name"]: r["sequence"] for r in read_fasta(spark, f"file://{out}").collect()}
        assert {n: s.replace("-", "") for n, s in got[anchored].items()} == dict(items)
        sites, edges = read_graphs(spark, f"file://{out}.graph")
        assert sites.count() >= max(len(s) for _, s in items) and graph_faults(sites, edges).where("fault <> 'weight'").count() == 0 and edges.count() >= sites.count() - 1
    assert got[True] == got[False] and sum("aligned after" in m for m in caplog.messages) == 1
    reads = "".join(f"@{n}\n{s}\n+\n{'I' * 20 + '5' * (len(s) - 20)}\n" for n, s in items)
    (tmp_path / "q.fq").write_text(reads)
    for least, unknown in ((10, False), (30, True)):
        out = f"{tmp_path}/q{least}"
        run(spark, Settings(seqfile=f"file://{tmp_path}/q.fq", treefile=f"file://{tmp_path}/t.nwk", outfile=out, qscore_minimum=least))
        rows = [r["sequence"] for r in read_fasta(spark, f"file://{out}").collect()]
        assert any("N" in r for r in rows) == unknown


def test_place_and_pile_runs(spark, tmp_path):
    items = family(random.Random(2), 4, 90)
    size = max(len(s) for _, s in items)
    reference = fasta(tmp_path / "ref.fas", [(n, s.ljust(size, "-")) for n, s in items])
    (tmp_path / "t.nwk").write_text("((s0:0.1,s1:0.1):0.05,(s2:0.1,s3:0.1):0.05);")
    queries = fasta(tmp_path / "q.fas", [("q0", items[0][1][10:70]), ("junk", "ACGT" * 3)])
    for fragments in (True, False):
        out = f"{tmp_path}/p{fragments}"
        placed = run(spark, Settings(ref_seqfile=reference, ref_treefile=f"file://{tmp_path}/t.nwk", queryfile=queries, outfile=out, fragments=fragments, output_discarded_queries=True, prune_extended_alignment=True, prune_keep_number=2, trim_extended_alignment=True, trim_keep_sites=3))
        assert "q0" in {r["query"] for r in placed.collect()}
        whole, pruned, trimmed = ({r["name"]: r["sequence"] for r in read_fasta(spark, f"file://{out}{x}").collect()} for x in ("", ".pruned", ".trimmed"))
        new = {n for n in whole if n.startswith("q0")}
        assert {n: whole[n].replace("-", "") for n, _ in items} == dict(items) and all(whole[n].replace("-", "") == items[0][1][10:70] for n in new) and new
        assert len({len(s) for s in whole.values()}) == 1 and len(pruned) == 2 + len(new)
        assert 60 <= len(trimmed["s0"]) <= 70 and all(trimmed[n].replace("-", "") == items[0][1][10:70] for n in new)
    reads = fasta(tmp_path / "r.fas", [("r0", items[0][1]), ("r1", items[0][1][:50]), ("r2", items[0][1][20:])])
    run(spark, Settings(pileup_alignment=True, queryfile=reads, outfile=f"{tmp_path}/pile", output_consensus=True, consensus_minimum=1, consensus_minimum_proportion=0.0))
    assert read_fasta(spark, f"file://{tmp_path}/pile.consensus").first()["sequence"] == items[0][1]
    with pytest.raises(ValueError):
        run(spark, Settings())


def test_streams(spark, tmp_path):
    rows = [(1, "a", "x y", 2, "2025-01-01 00:00:00"), (1, "a", "x y", 2, "2025-01-01 00:00:00"), (2, "a", "x", None, "2025-01-01 05:00:00"), (3, "b", None, 1, "2025-03-01 00:00:00")]
    df = spark.createDataFrame(rows, "pos long, tid string, node_to_align string, num_duplicates int, t string").withColumn("read_at", F.to_timestamp("t")).drop("t")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = arriving.stream_of(spark, f"{tmp_path}/in", df.schema)
    counts = arriving.running_counts(stream)
    q = counts.writeStream.outputMode("append").format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["field"], r["key"]): r["n_records"] for r in spark.sql("select * from counts where window.start < '2025-02-01'").collect()}
    assert got == {("tid", "a"): 3, ("node_to_align", "x"): 3, ("node_to_align", "y"): 2}
    once = arriving.once_per_pos(arriving.stream_of(spark, f"{tmp_path}/in", df.schema))
    q = once.writeStream.outputMode("append").format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["pos"] for r in spark.sql("select pos from once").collect()) == [1, 2, 3]
    text = "ACGTTGCAAGGCTTAACGGATCCATGCAAGT"
    queries = spark.createDataFrame([("q", "n", text[3:28])], "query string, node string, q_text string")
    queries.write.parquet(f"{tmp_path}/q")
    targets = spark.createDataFrame([("n", text)], "node string, t_text string")
    q = arriving.placing(arriving.stream_of(spark, f"{tmp_path}/q", queries.schema), lambda: targets, f"{tmp_path}/out", f"{tmp_path}/c3")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1
