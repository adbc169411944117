"""Writers: each makes a DataFrame (ord, value) of text, which save() puts into files in that order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborweave.functions import sequences as S
from arborweave.operators import records as R

FORMATS = ("fasta", "phylipi", "phylip", "phylips", "paml", "raxml", "nexus", "fastq")


def _head(mark: str) -> Column:
    """Mark, name and comment on one line; without a name there is no comment either, which would be read as the name."""
    tail = F.when((F.coalesce("name", F.lit("")) != "") & (F.coalesce("comment", F.lit("")) != ""), F.concat(F.lit(" "), F.regexp_replace("comment", r"[\r\n]+", " "))).otherwise("")
    return F.concat(F.lit(mark), F.coalesce("name", F.lit("")), tail)


def fasta(rows: DataFrame, width: int = 60) -> DataFrame:
    """Rows (pos, name, comment, sequence) as FASTA; a null name is empty, a null sequence too."""
    return rows.select(F.col("pos").alias("ord"), F.concat(_head(">"), F.lit("\n"), S.wrapped(F.regexp_replace(F.coalesce("sequence", F.lit("")), r"\s", ""), width)).alias("value"))


def back_translated(rows: DataFrame, dna: Column, width: int = 60) -> DataFrame:
    """Rows (pos, name, comment, sequence) of gapped protein as FASTA of the DNA they were read from; rows without DNA are left out."""
    return fasta(rows.withColumn("sequence", S.back_translate(F.col("sequence"), dna)).where(F.col("sequence").isNotNull()), width)


def fastq(rows: DataFrame) -> DataFrame:
    """Rows with a quality as long as the sequence as FASTQ; others are left out."""
    ok = rows.where(F.length("sequence") == F.length("quality"))
    return ok.select(F.col("pos").alias("ord"), F.concat_ws("\n", _head("@"), "sequence", F.lit("+"), "quality").alias("value"))


def _sizes(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.max(F.length("sequence")), F.lit(0)).alias("n_cols")))  # one row


def _name(width: int) -> Column:
    return S.padded(F.coalesce("name", F.lit("")), width)


def phylip_sequential(rows: DataFrame, cut: bool = True) -> DataFrame:
    """A header, then name and sequence a line; names cut to 10 letters (phylips) or whole (paml)."""
    name = _name(10) if cut else F.concat(F.coalesce("name", F.lit("")), F.lit("  "))
    head = _sizes(rows).select(F.lit(-1).cast("long").alias("ord"), F.concat_ws(" ", F.col("n_rows").cast("string"), F.col("n_cols").cast("string")).alias("value"))
    return head.unionByName(rows.select(F.col("pos").cast("long").alias("ord"), F.concat(name, F.coalesce("sequence", F.lit(""))).alias("value")))


def raxml(rows: DataFrame) -> DataFrame:
    """A header, then a line with the name and one with the whole sequence."""
    head = _sizes(rows).select(F.lit(-1).cast("long").alias("ord"), F.concat_ws(" ", F.col("n_rows").cast("string"), F.col("n_cols").cast("string")).alias("value"))
    return head.unionByName(rows.select(F.col("pos").cast("long").alias("ord"), F.concat(F.coalesce("name", F.lit("")), F.lit("\n"), F.coalesce("sequence", F.lit(""))).alias("value")))


def _blocks(rows: DataFrame, width: int, name: Column, later: bool) -> DataFrame:
    """(block, pos, value): each row's pieces of `width` letters; the name stands in the first block (later: in all)."""
    n = F.greatest(F.length(F.coalesce("sequence", F.lit(""))), F.lit(1))
    cut = rows.select("pos", name.alias("label"), F.coalesce("sequence", F.lit("")).alias("s"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int"))).alias("block"))
    label = F.col("label") if later else F.when(F.col("block") == 0, F.col("label")).otherwise("")
    return cut.select("block", "pos", F.concat(label, F.expr(f"substring(s, block * {width} + 1, {width})")).alias("value"))


def phylip_interleaved(rows: DataFrame, width: int = 60) -> DataFrame:
    """A header, then blocks of `width` columns with 10-letter names in the first, parted by empty lines; ord is (block, pos) in one number."""
    lines = _blocks(rows, width, _name(10), False)
    sizes = _sizes(rows)
    span = F.lit(1 << 40)
    head = sizes.select(F.lit(-1).cast("long").alias("ord"), F.concat_ws(" ", F.col("n_rows").cast("string"), F.col("n_cols").cast("string")).alias("value"))
    gap = lines.where("block > 0").select("block").distinct().select((F.col("block") * span).alias("ord"), F.lit("").alias("value"))
    return head.unionByName(lines.select((F.col("block") * span + F.col("pos") + 1).alias("ord"), "value")).unionByName(gap)


def nexus(rows: DataFrame, width: int = 60, least: float = 0.9) -> DataFrame:
    """A NEXUS data block, interleaved, with quoted names padded to 20 letters."""
    span = F.lit(1 << 40)
    kind = R.data_type(rows, least).select(F.when(F.col("is_dna"), "dna").otherwise("protein").alias("kind"))
    head = _sizes(rows).crossJoin(F.broadcast(kind)).select(  # one row each
        F.lit(-1).cast("long").alias("ord"),
        F.format_string("#NEXUS\nbegin data;\ndimensions ntax=%d nchar=%d;\nformat datatype=%s interleave=yes gap=-;\nmatrix\n", F.col("n_rows"), F.col("n_cols"), F.col("kind")).alias("value"),
    )
    label = F.concat(S.padded(F.concat(F.lit("'"), F.coalesce("name", F.lit("")), F.lit("'")), 20), F.lit("     "))
    lines = _blocks(rows, width, label, True).select((F.col("block") * span + F.col("pos") + 1).alias("ord"), "value")
    end = rows.sparkSession.createDataFrame([((1 << 62), ";\nend;\n")], "ord long, value string")
    return head.unionByName(lines).unionByName(end)


def graph(sites: DataFrame, edges: DataFrame) -> DataFrame:
    """Sequence graphs (see read_graphs) as text, one value per graph; a graph's sites and edges are put together in one row.

    Sites and edges meet by a shuffle: made from texts, they are many times
    what the size of a file tells, by which they'd be broadcast through the driver.
    """
    into = edges.groupBy("name", F.col("end").alias("site")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "weight"))).alias("into"))
    lines = sites.join(into.hint("merge"), ["name", "site"], "left").select("name", F.struct("site", "symbol", "into").alias("l"))
    return graph_rows(lines.groupBy("name").agg(F.array_sort(F.collect_list("l")).alias("sites")))


def graph_rows(graphs: DataFrame) -> DataFrame:
    """The same of graphs that are rows already: (name, sites), sites in order with what leads into them, as structs (site, symbol, into), into as structs (start, end, weight)."""
    edges = lambda x: F.coalesce(F.array_join(F.transform(x["into"], lambda e: F.format_string("; %d %d %.6g", e["start"], e["end"], e["weight"].cast("double"))), ""), F.lit(""))
    body = F.array_join(F.transform("sites", lambda x: F.concat(x["site"].cast("string"), F.lit(" "), x["symbol"], edges(x))), "\n")
    return graphs.select(F.col("name").alias("ord"), F.concat(F.lit("#"), "name", F.lit("\n"), body).alias("value"))


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def xml(rows: DataFrame, newick: str) -> DataFrame:
    """An XML alignment: the tree, then an element per row (pos, name, sequence, is_leaf)."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(-1, f"<ms_alignment>\n<newick>\n{newick}\n</newick>\n<nodes>"), ((1 << 62), "</nodes>\n</ms_alignment>")], "ord long, value string")
    tag = F.when(F.col("is_leaf"), "leaf").otherwise("node")
    name = _escaped(F.coalesce("name", F.lit("")))
    body = F.concat(F.lit("<"), tag, F.lit(' id="'), name, F.lit('" name="'), name, F.lit('">\n  <sequence>\n    '), F.coalesce("sequence", F.lit("")), F.lit("\n  </sequence>\n</"), tag, F.lit(">"))
    return head.unionByName(rows.select(F.col("pos").cast("long").alias("ord"), body.alias("value")))


def newick_of(nodes: list[tuple], kind: str = "newick") -> str:
    """The text of a tree from rows (node_id, parent_id, side, name, dist, tid): newick, nhx, names (with inner names) or topology.

    Children stand in the order of side. Works without recursion.
    """
    below: dict = {}
    for r in nodes:
        below.setdefault(r[1], []).append(r)
    for rows in below.values():
        rows.sort(key=lambda r: (r[2] is None, r[2], r[0]))
    if len(below.get(None, ())) != 1:
        raise ValueError("a tree needs one root")
    out: list[str] = []
    todo: list = [(below[None][0], False)]

    def tail(r: tuple, inner: bool) -> str:
        name = (r[3] or "") if not inner or kind in ("names", "nhx") else ""
        text = name + ("" if kind == "topology" or r[4] is None else f":{r[4]:.10g}")
        return text + (f"[&&NHX:TID={r[5].strip()}]" if kind == "nhx" and r[5] and r[5].strip() else "")

    while todo:
        r, closing = todo.pop()
        if isinstance(r, str):
            out.append(r)
        elif closing:
            out.append(")" + tail(r, True))
        elif r[0] in below:
            out.append("(")
            todo.append((r, True))
            for k, c in enumerate(reversed(below[r[0]])):
                if k:
                    todo.append((",", False))
                todo.append((c, False))
        else:
            out.append(tail(r, False))
    return "".join(out) + ";"


def newick_text(tree: DataFrame, kind: str = "newick", most: int = 5_000_000) -> str:
    """newick_of a tree table; a text is one value, so the nodes are gathered, up to `most` (counted first)."""
    if (n := tree.count()) > most:
        raise ValueError(f"{n} nodes are too many for one text")
    return newick_of([tuple(r) for r in tree.select("node_id", "parent_id", "side", "name", "dist", "tid").collect()], kind)


def event_lines(events: DataFrame) -> DataFrame:
    """Events (branch, kind, start, end, from_state, to_state) as report lines, ordered by branch and column."""
    where = F.when(F.col("start") == F.col("end"), F.col("start").cast("string")).otherwise(F.concat_ws("..", F.col("start").cast("string"), F.col("end").cast("string")))
    text = F.concat_ws(" ", where, "kind", F.when(F.col("kind") == "substitution", F.concat("from_state", F.lit(" -> "), "to_state")))
    return events.select("branch", F.col("start").alias("ord"), F.concat(F.lit(" "), text).alias("value"))


def save(lines: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Writes the values as text; range-partitioned in order, so the files one after another are the whole."""
    order = order or ["ord"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)


def written(rows: DataFrame, kind: str, width: int = 60) -> DataFrame:
    """The text of rows in one of FORMATS; an unknown name gives FASTA. Repeated names are numbered."""
    named = R.number_names(rows, "/", True)
    return {
        "phylipi": lambda: phylip_interleaved(named, width), "phylip": lambda: phylip_interleaved(named, width), "phylips": lambda: phylip_sequential(named), "paml": lambda: phylip_sequential(named, False),
        "raxml": lambda: raxml(named), "nexus": lambda: nexus(named, width), "fastq": lambda: fastq(named),
    }.get(kind, lambda: fasta(named, width))()
