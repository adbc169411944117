"""Substitution and indel models (numpy, on the driver and in Python workers).

A state is a bit mask over the residues of the alphabet; ambiguity is a mask
of several bits.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np

from arborweave.functions import codons
from arborweave.functions.sequences import AMINO
from arborweave.operators.columns import IUPAC

# Exchangeabilities (lower triangle, by rows) and frequencies of the published WAG model, residues in the order of AMINO. Fixed values.
WAG = """
0.551571
0.509848 0.635346
0.738998 0.147304 5.429420
1.027040 0.528191 0.265256 0.0302949
0.908598 3.035500 1.543640 0.616783 0.0988179
1.582850 0.439157 0.947198 6.174160 0.021352 5.469470
1.416720 0.584665 1.125560 0.865584 0.306674 0.330052 0.567717
0.316954 2.137150 3.956290 0.930676 0.248972 4.294110 0.570025 0.249410
0.193335 0.186979 0.554236 0.039437 0.170135 0.113917 0.127395 0.0304501 0.138190
0.397915 0.497671 0.131528 0.0848047 0.384287 0.869489 0.154263 0.0613037 0.499462 3.170970
0.906265 5.351420 3.012010 0.479855 0.0740339 3.894900 2.584430 0.373558 0.890432 0.323832 0.257555
0.893496 0.683162 0.198221 0.103754 0.390482 1.545260 0.315124 0.174100 0.404141 4.257460 4.854020 0.934276
0.210494 0.102711 0.0961621 0.0467304 0.398020 0.0999208 0.0811339 0.049931 0.679371 1.059470 2.115170 0.088836 1.190630
1.438550 0.679489 0.195081 0.423984 0.109404 0.933372 0.682355 0.243570 0.696198 0.0999288 0.415844 0.556896 0.171329 0.161444
3.370790 1.224190 3.974230 1.071760 1.407660 1.028870 0.704939 1.341820 0.740169 0.319440 0.344739 0.967130 0.493905 0.545931 1.613280
2.121110 0.554413 2.030060 0.374866 0.512984 0.857928 0.822765 0.225833 0.473307 1.458160 0.326622 1.386980 1.516120 0.171903 0.795384 4.378020
0.113133 1.163920 0.0719167 0.129767 0.717070 0.215737 0.156557 0.336983 0.262569 0.212483 0.665309 0.137505 0.515706 1.529640 0.139405 0.523742 0.110864
0.240735 0.381533 1.086000 0.325711 0.543833 0.227710 0.196303 0.103604 3.873440 0.420170 0.398618 0.133264 0.428437 6.454280 0.216046 0.786993 0.291148 2.485390
2.006010 0.251849 0.196246 0.152335 1.002140 0.301281 0.588731 0.187247 0.118358 7.821300 1.800340 0.305434 2.058450 0.649892 0.314887 0.232739 1.388230 0.365369 0.314730
"""
WAG_PI = """0.0866279 0.0439720 0.0390894 0.0570451 0.0193078 0.0367281 0.0580589 0.0832518 0.0244313 0.0484660
0.0862090 0.0620286 0.0195027 0.0384319 0.0457631 0.0695179 0.0610127 0.0143859 0.0352742 0.0708956"""


def scaled(q: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Rates with zero row sums and one expected change per unit of time."""
    q = q.copy()
    np.fill_diagonal(q, 0)
    np.fill_diagonal(q, -q.sum(1))
    return q / -(pi * np.diag(q)).sum()


def dna_rates(pi: np.ndarray, kappa: float = 2.0, rho: float = 1.0) -> np.ndarray:
    """Rates of the four bases A, C, G, T.

    Transversions happen at a rate proportional to the target's frequency;
    within purines and pyrimidines an additional rate is added, so that the
    expected ratio of transitions to transversions is kappa / 2 and the
    addition for purines is rho times that for pyrimidines.
    """
    a, c, g, t = pi
    r, y, ratio = a + g, c + t, kappa / 2
    base = 1 / (2 * r * y * (1 + ratio))
    extra = (ratio / (1 + ratio) - 2 * base * (a * g + c * t)) / (2 * (rho * a * g / r + c * t / y))
    extra = max(extra, 0.0)
    q = base * np.tile(pi, (4, 1))
    for (i, j), group, rate in (((0, 2), r, rho * extra), ((1, 3), y, extra)):
        q[i, j] += rate * pi[j] / group
        q[j, i] += rate * pi[i] / group
    return scaled(q, pi)


def protein_rates() -> tuple[np.ndarray, np.ndarray]:
    pi = np.array(WAG_PI.split(), float)
    pi /= pi.sum()
    s = np.zeros((20, 20))
    s[np.tril_indices(20, -1)] = np.array(WAG.split(), float)
    return scaled((s + s.T) * pi, pi), pi


def codon_rates(kappa: float = 2.0, omega: float = 0.2, pi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rates of the 61 sense codons by rule: one base changes at a time, transitions kappa times, changes of the amino acid omega times as often."""
    names, aa = codons.sense_codons(), codons.table()
    pi = np.full(len(names), 1 / len(names)) if pi is None else pi
    q = np.zeros((len(names), len(names)))
    for i, x in enumerate(names):
        for j, y in enumerate(names):
            changed = [(p, r) for p, r in zip(x, y, strict=True) if p != r]
            if len(changed) == 1:
                q[i, j] = pi[j] * (kappa if set(changed[0]) in ({"A", "G"}, {"C", "T"}) else 1) * (omega if aa[x] != aa[y] else 1)
    return scaled(q, pi), pi


@dataclass(frozen=True)
class Options:
    """Options of the model; the defaults of each data type are in preset()."""

    kind: str = "dna"
    ins_rate: float = 0.01
    del_rate: float = 0.01
    gap_extension: float = 0.8
    end_gap_extension: float = 0.95
    pair_gap_extension: float = 0.99
    kappa: float = 2.0
    rho: float = 1.0
    ambiguity_factor: float = 1.0
    log_odds: bool = True
    score_scaling: bool = True
    reduced_terminal: bool = True
    terminal_edges: bool = True
    pi: tuple[float, ...] = (0.25, 0.25, 0.25, 0.25)


def preset(kind: str, **changes) -> Options:
    """Options with the defaults of dna, protein or codon data."""
    base = {"dna": {}, "protein": {"ins_rate": 0.05, "del_rate": 0.05, "gap_extension": 0.5, "end_gap_extension": 0.75}, "codon": {"ins_rate": 0.01, "del_rate": 0.01, "gap_extension": 0.5, "end_gap_extension": 0.75}}[kind]
    return Options(kind=kind, **(base | changes))


@dataclass
class Model:
    """A model of one data type; at() gives its scores at a distance."""

    options: Options
    _at: dict = field(default_factory=dict, repr=False)

    @cached_property
    def rates(self) -> tuple[np.ndarray, np.ndarray]:
        o = self.options
        if o.kind == "dna":
            pi = np.array(o.pi) / sum(o.pi)
            return dna_rates(pi, o.kappa, o.rho), pi
        return protein_rates() if o.kind == "protein" else codon_rates(o.kappa)

    @cached_property
    def eigen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, left, right) of the reversible rates, from the symmetric matrix similar to them."""
        q, pi = self.rates
        root = np.sqrt(pi)
        values, vectors = np.linalg.eigh(root[:, None] * q / root)
        return values, vectors / root[:, None], (vectors * root[:, None]).T

    def probabilities(self, distance: float) -> np.ndarray:
        """P(t): rows add up to 1, P(0) is the identity."""
        values, left, right = self.eigen
        return np.clip((left * np.exp(values * distance)) @ right, 0, 1)

    @cached_property
    def size(self) -> int:
        return len(self.rates[1])

    @cached_property
    def unknown(self) -> int:
        return (1 << self.size) - 1

    @cached_property
    def symbols(self) -> dict[str, int]:
        """Symbol to mask."""
        if self.options.kind == "dna":
            return dict(IUPAC) | {"U": IUPAC["T"]}
        names = AMINO if self.options.kind == "protein" else codons.sense_codons()
        return {a: 1 << i for i, a in enumerate(names)} | {"X" if self.options.kind == "protein" else "NNN": self.unknown}

    @cached_property
    def letters(self) -> dict[int, str]:
        """Mask to symbol; a mask of several residues without a code of its own shows as the unknown one."""
        return {m: s for s, m in reversed(self.symbols.items()) if s != "U"}

    def encode(self, text: str) -> np.ndarray:
        """Masks of the residues of an ungapped text; unknown symbols become the unknown state."""
        step = 3 if self.options.kind == "codon" else 1
        text = text.upper()
        return np.array([self.symbols.get(text[i : i + step], self.unknown) for i in range(0, len(text), step)], dtype=object if self.size > 60 else np.int64)

    def decode(self, masks) -> list[str]:
        unknown = {"dna": "N", "protein": "X", "codon": "NNN"}[self.options.kind]
        return [self.letters.get(int(m), unknown) for m in masks]

    def members(self, mask: int) -> list[int]:
        return [i for i in range(self.size) if mask >> i & 1]

    def parent_state(self, a: int, b: int) -> int:
        """The state of an ancestor whose children have states a and b."""
        if self.options.kind == "dna":
            return a & b or a | b
        if a == self.unknown:
            return b
        if b == self.unknown:
            return a
        if a & b:
            return a & b
        x, y = self.members(a), self.members(b)
        if len(x) == 1 and len(y) == 1:
            return a | b
        q = self.rates[0]
        i, j = max(((i, j) for i in x for j in y), key=lambda p: q[p])  # of equal ones the first
        return 1 << i | 1 << j

    def refined(self, child: int, parent: int) -> int:
        """The child's state after a look at its parent's."""
        return child & parent or child

    def at(self, distance: float) -> "Scores":
        key = round(distance, 9)
        if key not in self._at:
            self._at[key] = Scores(self, key)
        return self._at[key]


class Scores:
    """Logarithms of the scores at one distance."""

    def __init__(self, model: Model, distance: float):
        o, (_, pi) = model.options, model.rates
        p = model.probabilities(distance)
        score = p * pi[:, None]
        if o.log_odds:
            score = p / pi[None, :]
            if o.score_scaling:
                score = score * 0.5 * (pi[:, None] + pi[None, :]) / pi[:, None]
        with np.errstate(divide="ignore"):
            self.base = np.log(np.maximum(score, 1e-300)).astype(np.float32).astype(np.float64)
        self.model, self.cache = model, {}
        t = float(np.clip(1 - np.exp(-0.5 * (o.ins_rate + o.del_rate) * distance), 1e-12, 0.49))
        f = lambda x: float(np.float32(np.log(x)))
        self.no_gap, self.open, self.extend, self.end_extend, self.pair_extend, self.close = f(1 - 2 * t), f(t), f(o.gap_extension), f(o.end_gap_extension), f(o.pair_gap_extension), 0.0
        self.first_open = 0.0 if o.reduced_terminal else self.open
        if not o.terminal_edges:
            self.end_extend = 0.0

    def pair(self, a: int, b: int) -> float:
        """Score of two states: the best of their members, less the price of ambiguity."""
        key = (a, b)
        if key not in self.cache:
            x, y = self.model.members(a), self.model.members(b)
            n = (len(x) > 1) + (len(y) > 1)
            self.cache[key] = float(self.base[np.ix_(x, y)].max()) + n * np.log(self.model.options.ambiguity_factor) if x and y else -1e9
        return self.cache[key]

    def matrix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Scores of all pairs of two sequences of states."""
        ua, ia = np.unique(a, return_inverse=True)
        ub, ib = np.unique(b, return_inverse=True)
        table = np.array([[self.pair(int(x), int(y)) for y in ub] for x in ua]).reshape(len(ua), len(ub))
        return table[np.ix_(ia, ib)]


@lru_cache(8)
def model(options: Options) -> Model:
    """One model per options and worker."""
    return Model(options)
