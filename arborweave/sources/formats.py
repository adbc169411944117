"""Readers of FASTA, FASTQ, sequence-graph, PHYLIP, Newick/NHX and option files.

FASTA and graph records are read with record separators inside the JVM,
FASTQ by byte ranges, so that a large file is divided over tasks; trees and
PHYLIP files are read whole.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweave.functions import sequences as S

#: First byte of a file's first non-blank line, and the format it tells.
MARKS = {">": "fasta", "@": "fastq", "#": "graph"}


def sniff(spark: SparkSession, path: str) -> str:
    """The format of a file by its first non-blank byte; ValueError for any other."""
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    mark = first[0]["value"].lstrip()[:1] if first else ""
    if mark not in MARKS:
        raise ValueError(f"{path}: the format can't be told from {mark!r}")
    return MARKS[mark]


def _header(head, sequence, quality=None):
    """Name, comment and tags of a header line."""
    name = F.regexp_extract(head, r"^\s*(\S*)", 1)
    comment = F.trim(F.regexp_replace(head, r"^\s*\S*", ""))
    return [
        name.alias("name"), comment.alias("comment"), sequence.alias("sequence"), (quality if quality is not None else F.lit("")).alias("quality"),
        F.coalesce(S.tag_of(comment, "TID"), F.lit("")).alias("tid"), F.coalesce(S.number(S.tag_of(comment, "NumDuplicates"), "int"), F.lit(1)).alias("num_duplicates"),
    ]


def read_fasta(spark: SparkSession, path: str, gaps: bool = True) -> DataFrame:
    """(name, comment, sequence, quality, tid, num_duplicates) of FASTA files; sequences in upper case without blanks.

    A > inside a header doesn't begin a record. Records without a header are left out.
    """
    parts = spark.read.option("lineSep", "\n>").text(path)
    # the first record of a file still has its mark, after possible blank lines
    body = F.regexp_replace(F.regexp_replace("value", "\r", ""), r"\A\s*>", "")
    rows = parts.select(body.alias("v")).where(~F.col("v").rlike(r"\A\s*\z"))
    rows = rows.select(F.substring_index("v", "\n", 1).alias("head"), F.expr("case when instr(v, '\n') > 0 then substring(v, instr(v, '\n') + 1) else '' end").alias("s"))
    sequence = F.upper(F.regexp_replace("s", r"\s", ""))
    return rows.select(*_header(F.col("head"), sequence if gaps else S.degap(sequence)))


def ranges(spark: SparkSession, path: str, size: int = 64 << 20) -> DataFrame:
    """(path, start, end): the byte ranges of at most `size` bytes that the files of a path are divided into, one to a task."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")  # the contents aren't read
    cut = files.select("path", "length", F.explode(F.expr(f"sequence(0, cast((length - 1) div {size} as bigint))")).alias("k"))
    rows = cut.select("path", (F.col("k") * size).alias("start"), F.least(F.col("length"), (F.col("k") + 1) * size).alias("end"))
    return rows.repartition(max(1, min(10_000, rows.count())), "path", "start")


def _fastq_records(path: str, start: int, end: int, step: int = 4 << 20) -> Iterator[tuple[str, str, str, str]]:
    """(header, sequence, quality, '') of the four-line records that begin in a byte range, and (line, '', '', reason) of the lines of no record.

    A range begins anywhere; the first record after it is where a line begins
    with @, the next but one with +, and the second and fourth are equally long.
    """
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as f:
        at = start
        base = max(0, start - 1)  # to see whether a line begins at start
        f.seek(base)
        held, eof = b"", False

        def more() -> None:
            nonlocal held, eof
            got = f.read(step)
            eof = not got
            held += got

        more()
        if start:
            while (cut := held.find(b"\n")) < 0 and not eof:
                more()
            if cut < 0:
                return
            held, at = held[cut + 1 :], base + cut + 1
        while at < end:
            lines = held.split(b"\n", 4)
            while len(lines) < 5 and not eof:
                more()
                lines = held.split(b"\n", 4)
            parts = [x.rstrip(b"\r") for x in lines[:4]]
            if len(parts) == 4 and parts[0][:1] == b"@" and parts[2][:1] == b"+" and len(parts[1]) == len(parts[3]):
                yield (*(x.decode("utf-8", "replace") for x in (parts[0][1:], parts[1], parts[3])), "")
                used = sum(len(x) + 1 for x in lines[:4])
            elif not held:
                return
            else:
                used = len(lines[0]) + 1
                whole = len(parts) == 4 and parts[0][:1] == b"@" and parts[2][:1] == b"+"
                if parts[0]:
                    yield parts[0].decode("utf-8", "replace"), "", "", "length" if whole else "short" if parts[0][:1] == b"@" and len(lines) < 5 else "line"
            held, at = held[used:], at + used


def read_fastq(spark: SparkSession, path: str, size: int = 64 << 20) -> DataFrame:
    """The same columns of FASTQ files of four-line records, read by byte ranges.

    A quality may begin with @, so a record is known by all its lines; lines
    that belong to no whole record are left to fastq_faults().
    """
    rows = _fastq_lines(spark, path, size).where("reason = ''")
    return rows.select(*_header(F.col("head"), F.upper("s"), F.col("q")))


def fastq_faults(spark: SparkSession, path: str, size: int = 64 << 20) -> DataFrame:
    """(line, reason): the lines of FASTQ files that belong to no record.

    length: the header of a record whose sequence and quality differ in
    length; short: a header with too few lines after it; line: any other,
    among them what follows such a header. Empty lines are none.
    """
    return _fastq_lines(spark, path, size).where("reason <> ''").select(F.col("head").alias("line"), "reason")


def _fastq_lines(spark: SparkSession, path: str, size: int) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, start, end in zip(b["path"], b["start"], b["end"], strict=True):
                rows: list[tuple[str, str, str, str]] = []
                for r in _fastq_records(p, int(start), int(end)):
                    rows.append(r)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["head", "s", "q", "reason"])
                        rows = []
                yield pd.DataFrame(rows, columns=["head", "s", "q", "reason"])

    return ranges(spark, path, size).mapInPandas(read, "head string, s string, q string, reason string")


def read_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sites (name, site, symbol), edges (name, start, end, weight)) of sequence-graph files.

    A record is `#name` and then, for each site in order from 0, a line
    `site symbol; start end weight; ...` with the edges that end there.
    """
    lines = _graph_lines(spark, path).where("good")
    fields = lines.select("name", F.split("line", ";").alias("f"))
    site = F.split(F.trim(F.col("f")[0]), r"\s+")
    sites = fields.select("name", site[0].cast("int").alias("site"), site[1].alias("symbol"))
    edge = F.split(F.trim("e"), r"\s+")
    edges = fields.select("name", F.explode(F.expr("slice(f, 2, size(f))")).alias("e")).where("trim(e) <> ''").select("name", edge[0].cast("int").alias("start"), edge[1].cast("int").alias("end"), edge[2].cast("float").alias("weight"))
    return sites, edges


def _graph_lines(spark: SparkSession, path: str) -> DataFrame:
    """(name, line, good): the lines of each graph below its name; good ones have the form of a site."""
    parts = spark.read.option("lineSep", "\n#").text(path).select(F.regexp_replace(F.regexp_replace("value", "\r", ""), r"\A\s*#", "").alias("v")).where("trim(v) <> ''")
    lines = parts.select(F.regexp_extract("v", r"^\s*(\S*)", 1).alias("name"), F.explode(F.split(F.expr("substring(v, instr(v, '\n') + 1)"), "\n")).alias("line")).where("trim(line) <> '' AND line NOT RLIKE '^#'")
    return lines.withColumn("good", F.col("line").rlike(r"^\s*\d+\s+\S+\s*(?:;\s*(?:-?\d+\s+-?\d+\s+[-+.\deE]+)?\s*)*$"))


def graph_line_faults(spark: SparkSession, path: str) -> DataFrame:
    """(name, line): the lines of sequence-graph files that are no site."""
    return _graph_lines(spark, path).where("NOT good").select("name", "line")


def graph_faults(sites: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, fault): graphs with gaps in the site numbers, edges that don't go forwards, or weights into a site above 1."""
    gap = sites.groupBy("name").agg(F.min("site").alias("a"), F.max("site").alias("b"), F.countDistinct("site").alias("n")).where("a <> 0 OR b + 1 <> n").select("name", F.lit("sites").alias("fault"))
    back = edges.where("start >= `end` OR start < 0").select("name", F.lit("direction").alias("fault"))
    much = edges.groupBy("name", "end").agg(F.sum("weight").alias("w")).where("w > 1.000001").select("name", F.lit("weight").alias("fault"))
    return gap.unionByName(back).unionByName(much).distinct()


def read_phylip(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence) of sequential PHYLIP files, one name and row a line, up to the first blank line."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r", "").alias("v"))
    lines = whole.select(F.posexplode(F.split(F.expr("split(v, '\n[ \t]*\n')[0]"), "\n"))).where("pos > 0 AND trim(col) <> ''")
    return lines.select(F.regexp_extract("col", r"^\s*(\S+)\s+", 1).alias("name"), F.regexp_replace(F.regexp_replace("col", r"^\s*\S+\s+", ""), r"\s", "").alias("sequence"))


NODES = "node_id long, parent_id long, side int, name string, dist double, tid string, nhx string, height int"


def parse_newick(text: str) -> list[tuple]:
    """Rows of NODES of one Newick or NHX text, children before parents; ValueError if it is malformed.

    Branch lengths, names of inner nodes, #n# labels and [&&NHX:...] tags are
    read; other comments are skipped. Works without recursion at any depth.
    """
    s, at, n = "".join(text.split()), 0, 0
    nodes: list[dict] = []
    open_: list[list[int]] = []
    done: list[int] | None = None

    def label(i: int) -> int:
        """Reads what follows a node: name, length, tags."""
        nonlocal s
        node, start = nodes[i], at
        j = start
        if j < len(s) and s[j] in "'\"":
            end = s.index(s[j], j + 1)
            node["name"], j = s[j + 1 : end], end + 1
        else:
            while j < len(s) and s[j] not in ":,()[;":
                j += 1
            node["name"] = s[start:j] or None
        while j < len(s) and s[j] in ":[":
            if s[j] == ":":
                k = j + 1
                while k < len(s) and s[k] not in ",()[;:":
                    k += 1
                node["dist"], j = float(s[j + 1 : k]), k
            else:
                end = s.index("]", j)
                if s.startswith("[&&NHX", j):
                    node["nhx"] = s[j : end + 1]
                    tags = dict(t.split("=", 1) for t in s[j + 6 : end].split(":") if "=" in t)
                    node["tid"] = tags.get("TID")
                j = end + 1
        return j

    def new(children: list[int]) -> int:
        nonlocal n
        n += 1
        nodes.append({"id": n, "children": children, "height": 1 + max((nodes[c]["height"] for c in children), default=-1), "name": None, "dist": None, "tid": None, "nhx": None, "parent": None, "side": None})
        for side, c in enumerate(children):
            nodes[c]["parent"], nodes[c]["side"] = n, side
        return n - 1

    while at < len(s) and s[at] != ";":
        ch = s[at]
        if ch == "(":
            open_.append([])
            at += 1
        elif ch == ",":
            if not open_ or done is None:
                raise ValueError("a comma outside of parentheses or without a node before it")
            at, done = at + 1, None
        elif ch == ")":
            if not open_ or done is None:
                raise ValueError("unbalanced parentheses")
            at += 1
            i = new(open_.pop())
            at = label(i)
            done = [i]
            if open_:
                open_[-1].append(i)
        else:
            if done is not None:
                raise ValueError(f"unexpected text at {at}")
            i = new([])
            at = label(i)
            done = [i]
            if open_:
                open_[-1].append(i)
    if open_ or not nodes:
        raise ValueError("unbalanced parentheses or no tree")
    return [(x["id"], x["parent"], x["side"], x["name"], x["dist"], x["tid"], x["nhx"], x["height"]) for x in nodes]


def read_trees(texts: DataFrame, text: str = "value", key: str | None = None) -> DataFrame:
    """The nodes of Newick texts, one row each (with the text's key first, if named); blank and null texts give none."""
    schema = (f"{key} {dict(texts.dtypes)[key]}, " if key else "") + NODES

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in enumerate(b[text]):
                if t and t.strip():
                    rows += [((b[key].iloc[i], *r) if key else r) for r in parse_newick(t)]
            frame = pd.DataFrame(rows, columns=[c.strip().split()[0] for c in schema.split(",")])
            yield frame.astype({"node_id": "Int64", "parent_id": "Int64", "side": "Int32", "height": "Int32", "dist": "Float64"})

    return texts.select(*([key] if key else []), text).mapInPandas(parse, schema)


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of a Newick or NHX file; white space counts nowhere."""
    return read_trees(spark.read.text(path, wholetext=True))


def read_options(text: str) -> dict[str, str]:
    """The options of a config file: `key = value` lines, a bare key is a flag; # begins a comment."""
    out = {}
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].strip()
        if line:
            key, _, value = line.partition("=")
            out[key.strip()] = value.strip() or "1"
    return out


def merged_options(cls, line: dict[str, str], file: dict[str, str]):
    """A dataclass of options; what the command line gives goes before the file. Unknown names raise KeyError."""
    fields = {f.name.replace("_", "-"): f for f in dataclasses.fields(cls)}
    values = {}
    for key, value in {**file, **line}.items():
        f = fields[key]
        kind = type(f.default)
        values[f.name] = (value not in ("0", "false", "")) if kind is bool else kind(value)
    return cls(**values)


def read_records(spark: SparkSession, path: str, gaps: bool = True) -> DataFrame:
    """Records of a FASTA or FASTQ file, whichever it is."""
    return read_fasta(spark, path, gaps) if sniff(spark, path) == "fasta" else read_fastq(spark, path)
