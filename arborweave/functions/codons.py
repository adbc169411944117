"""Genetic codes, as rules over the base order TCAG."""

from __future__ import annotations

from itertools import product

# Amino acids of the 64 codons in the order of the published code tables (TTT, TTC, TTA, ...). Fixed values.
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# The vertebrate mitochondrial code differs from it in these codons. Fixed values.
MITOCHONDRIAL_CHANGES = {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"}
BASES = "TCAG"
CODONS = ["".join(c) for c in product(BASES, repeat=3)]
MITOCHONDRIAL = "".join(MITOCHONDRIAL_CHANGES.get(c, a) for c, a in zip(CODONS, STANDARD, strict=True))


def code(mitochondrial: bool = False) -> str:
    """The 64 amino acids in codon order, with stops as X."""
    return (MITOCHONDRIAL if mitochondrial else STANDARD).replace("*", "X")


def table(mitochondrial: bool = False) -> dict[str, str]:
    """Codon to amino acid, with NNN for unknown and --- for a gap."""
    return dict(zip(CODONS, code(mitochondrial), strict=True)) | {"NNN": "X", "---": "-"}


def sense_codons(mitochondrial: bool = False) -> list[str]:
    """The codons that are no stops, in alphabetical order."""
    return sorted(c for c, a in zip(CODONS, MITOCHONDRIAL if mitochondrial else STANDARD, strict=True) if a != "*")


def translate(dna: str, mitochondrial: bool = False) -> tuple[str, str]:
    """(protein, dna) of a string; an unknown or partial codon gives X and NNN."""
    t = table(mitochondrial)
    codons = [dna[i : i + 3] for i in range(0, len(dna), 3)]
    known = [c in t and c != "---" or c == "---" for c in codons]
    return "".join(t.get(c, "X") for c in codons), "".join(c if k and t[c] != "X" else "NNN" for c, k in zip(codons, known, strict=True))
