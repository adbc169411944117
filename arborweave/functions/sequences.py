"""Sequence functions as Column expressions that stay inside the JVM.

All return null for null input unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborweave.functions import codons

# One-letter codes. The index in DNA is the state number in models; fixed values of the public nomenclature.
DNA = "ACGTRYMKWSBDHVN"
AMINO = "ARNDCQEGHILKMFPSTWYV"
COMPLEMENT = ("ACGTUNRYKMSWBDHVacgtunrykmswbdhv", "TGCAANYRMKSWVHDBtgcaanyrmkswvhdb")


def degap(s: Column) -> Column:
    """Without gap symbols."""
    return F.translate(s, "-", "")


def reverse_complement(s: Column) -> Column:
    """Reverse complement with ambiguity codes; case is kept, U becomes A, others stay."""
    return F.reverse(F.translate(s, *COMPLEMENT))


def dna_letters(s: Column, gaps: bool = False) -> Column:
    """Upper case, U as T, and only symbols of the DNA alphabet (with gaps if asked)."""
    return F.regexp_replace(F.translate(F.upper(s), "U", "T"), f"[^{DNA}{'-' if gaps else ''}]", "")


def protein_letters(s: Column, gaps: bool = False) -> Column:
    """Upper case, U as X, and only amino acids and X (with gaps if asked)."""
    return F.regexp_replace(F.translate(F.upper(s), "U", "X"), f"[^{AMINO}X{'-' if gaps else ''}]", "")


def count_of(s: Column, letters: str) -> Column:
    """How many characters of s are among letters."""
    return F.length(s) - F.length(F.translate(s, letters, ""))


def looks_like_dna(s: Column, least: float = 0.9) -> Column:
    """More than `least` of the amino-acid letters of s are A, C, G, T, U or N; false where there are none."""
    up = F.upper(s)
    amino = count_of(up, AMINO)
    return F.when(amino > 0, count_of(up, "ACGTUN") / amino > least).otherwise(F.when(s.isNotNull(), False))


def codon_list(s: Column) -> Column:
    """The codons of a string, the last one as short as it is."""
    n = F.length(s)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n, F.lit(3)), lambda i: F.substring(s, i, F.lit(3)))).otherwise(F.when(s.isNotNull(), F.array().cast("array<string>")))


def _amino(codon: Column, mitochondrial: bool) -> Column:
    digits = F.translate(codon, codons.BASES, "0123")
    known = codon.rlike(f"^[{codons.BASES}]{{3}}$")
    index = F.conv(digits, 4, 10).cast("int")
    return F.when(known, F.substring(F.lit(codons.code(mitochondrial)), index + 1, F.lit(1))).when(codon == "---", "-").otherwise("X")


def translate(s: Column, mitochondrial: bool = False) -> Column:
    """Protein of an upper-case DNA string; --- gives -, an unknown or partial codon and a stop give X."""
    return F.array_join(F.transform(codon_list(s), lambda c: _amino(c, mitochondrial)), "")


def mask_codons(s: Column, mitochondrial: bool = False) -> Column:
    """The DNA that belongs to translate(): codons that gave X become NNN."""
    return F.array_join(F.transform(codon_list(s), lambda c: F.when(_amino(c, mitochondrial) == "X", "NNN").otherwise(c)), "")


def back_translate(protein: Column, dna: Column) -> Column:
    """DNA of a gapped protein: each gap is ---, each residue takes the next codon, NNN when they run out."""
    chars = F.filter(F.split(protein, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        codon = F.substring(dna, acc["at"], F.lit(3))
        add = F.when(c == "-", F.lit("---")).when(F.length(codon) == 3, codon).otherwise("NNN")
        return F.struct(F.concat(acc["out"], add).alias("out"), (acc["at"] + F.when(c == "-", 0).otherwise(3)).alias("at"))

    return F.when(protein.isNotNull() & dna.isNotNull(), F.aggregate(chars, start, step, lambda acc: acc["out"]))


def mock_dna(protein: Column) -> Column:
    """NNN for each residue and --- for each gap."""
    return F.regexp_replace(F.regexp_replace(protein, "[^-]", "NNN"), "-", "---")


def quality_masked(s: Column, quality: Column, least: int = 10, offset: int = 33) -> Column:
    """Bases whose quality is below `least` become n (a masked N); without a quality of equal length s stays."""
    # a quality character below the limit is any of the `least` lowest ones
    low = "".join(chr(offset + q) for q in range(least))
    chars, marks = F.split(s, ""), F.split(F.translate(quality, low, "\u0001" * least), "")
    masked = F.array_join(F.zip_with(chars, marks, lambda c, q: F.when(q == "\u0001", "n").otherwise(c)), "")
    return F.when(quality.isNull() | (F.length(quality) != F.length(s)), s).otherwise(masked)


def edge_weight(w: Column, kind: str = "sqrt") -> Column:
    """Transform of an edge weight: sqrt (default), cbrt or plain."""
    return {"sqrt": F.sqrt, "cbrt": F.cbrt, "plain": lambda x: x}[kind](w)


def tag_of(comment: Column, key: str) -> Column:
    """Value of a key=value token of a comment; null where there is none."""
    value = F.regexp_extract(comment, rf"(?:^|[\s,;]){key}=([^\s,;]*)", 1)
    return F.when(value != "", value)


def without(s: Column, *pieces: str) -> Column:
    """s with every occurrence of the pieces removed."""
    for p in pieces:
        s = F.replace(s, F.lit(p), F.lit(""))
    return s


def padded(s: Column, width: int) -> Column:
    """Blanks to the right up to width, cut beyond it."""
    return F.rpad(s, width, " ")


def wrapped(s: Column, width: int = 60) -> Column:
    """Line breaks after every `width` characters, none at the end."""
    return F.regexp_replace(s, f"(.{{{width}}})(?=.)", "$1\n")


def number(s: Column, kind: str = "double") -> Column:
    """The number a string holds, null where it holds none."""
    return F.trim(s).try_cast(kind)


def is_inner_name(name: Column) -> Column:
    """The name has the form #n# of an inner node."""
    return name.rlike(r"^#\d+#$")


def node_sort_key(name: Column) -> Column:
    """Order of node names: leaves by name, then inner nodes by number."""
    return F.struct(is_inner_name(name).alias("inner"), F.regexp_extract(name, r"^#(\d+)#$", 1).try_cast("long").alias("number"), name.alias("name"))
