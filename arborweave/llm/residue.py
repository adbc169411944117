"""Template residue, filler and error pages in texts (problem 9).

Records of one template are aligned by their fixed words: a place that may be
an unfilled slot (a template syntax, or a name, default or blank in any
other) has a frame of up to three words on either side within its sentence,
and a second pass over all texts takes every value that stands in such a
frame, filled ones included. Where the values vary, the place is a slot.
Error pages, notices and filler are found by recurrence: a few sure signs
name the first texts, and the sentences that recur in such texts, whatever
they say, make up the templates of whole pages and of filler.

All texts are read by numpy: words get hashes from running sums over bytes,
frames and sentences from running sums over words.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweave.functions import packed
from arborweave.operators.skew import flags, join_counted
from arborweave.session import materialise

# Forms of a slot that kept its variable name, default or blank. Public template syntaxes.
_NAME = r"[A-Za-z][\w .-]{0,40}?"
SLOTS = (
    rf"\{{\{{\s*{_NAME}\s*(?:\|[^{{}}]{{0,40}})?\}}\}}",
    rf"[$#]\{{\s*{_NAME}\s*\}}",
    rf"<%=?\s*{_NAME}\s*%>",
    rf"\[\[\s*{_NAME}\s*\]\]",
    r"\[(?i:insert|todo|tbd|enter|add|your)\b[^\[\]]{0,60}\]",
    r"\[object\s+Object\]",
    r"(?<!\w)\[[A-Z][A-Z0-9]*(?:[_ ]+[A-Z0-9]+)*\]",
    r"<(?i:your|insert|enter)\s[^<>]{1,40}>",
    r"<[A-Z][A-Z0-9]*(?:[_ ]+[A-Z0-9]+)*>",
    r"&lt;[A-Za-z][A-Za-z0-9]*(?:[_ ]+[A-Za-z0-9]+)*&gt;",
    r"(?<!\w)__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?!\w)",
    rf"XXX[-–\s]{_NAME}[-–\s]XXX",
    r"\$[A-Z][A-Z0-9_]*\$",
    r"(?<![\w%])%[A-Z][A-Z0-9_]*%(?![\w%])",
    rf"%\({_NAME}\)s",
    r"@@\w{1,40}@@",
    r"_{4,}",
    r"\([A-Za-z][\w ]{0,40}?\s+(?i:to\s+be\s+filled\s+in)\)",
    r"(?<![\w{$#])\{[a-zA-Z][a-zA-Z0-9_]*\}(?!\})",
    r"(?<![\w{$#])\{\d{1,2}\}(?!\})",
)
_SLOT = re.compile(r"(?=[{$#<\[&_X%@(])(?:" + "|".join(f"(?:{x})" for x in SLOTS) + ")")
# Signs of a slot in any syntax: a blank before a stop, a doubled blank, empty brackets, a default, a name between equal signs or after one, a variable's name.
_CUE = re.compile(
    r"(?P<blank>(?<=[^\W\d_])[ ](?=[,.;!?](?:\s|$))|(?<!\w)(?:\(\s*\)|\[\s*\]|\{\s*\}|<\s*>|\"\s*\"))"
    r"|(?<![\w/.])(?:undefined|null|NULL|nil|NaN|N/A|n/a|None|TBD|TBA)(?![\w/])"
    r"|(?<!\w)(?P<sign>[^\w\s.,;:!?'\"()*`~\\/-]{1,3})[A-Za-z][\w .-]{0,40}?(?P=sign)(?!\w)"
    r"|(?<!\w)[$%#@]{1,2}[A-Za-z_]\w*"
    r"|(?<![\w.-])(?:[a-z]+(?:_[a-z0-9]+)+|[A-Z]+(?:_[A-Z0-9]+)+)(?![\w(])"
)
_GAP = re.compile(r"(?<=\w)[ ]{2,}(?=\w)")
# Texts that none of these match hold no slot (RE2 syntax, looked for in whole batches).
_ODD = r"""[^\pL\pN_\s.,;:!?'"()*`~\\/\-][A-Za-z]|[_{<\[$%@]|&lt;|XXX|(?i:filled\s+in)|[({]\s*[)}]|"\s*"|[^\pN\s_] [,.;!?](?:\s|$)|\pL  +\pL|\b(?:undefined|null|NULL|nil|NaN|N/A|n/a|None|TBD|TBA)\b"""

# Words of the public filler text, without those that are ordinary words of other languages. Fixed values.
LOREM = frozenset(
    "lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua enim minim "
    "veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit "
    "voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia "
    "deserunt mollit anim laborum sit sed".split()
)
# Signs of filler beside its words: the text names itself, or a word is said over and over. What else is filler is learnt.
_FILLER = re.compile(
    r"^\W*(?:this\s+is\s+)?(?:a\s+|some\s+)?(?:sample|dummy|placeholder|filler|example)\s+(?:text|paragraph|copy|content|sentence|heading)\b"
    r"|^(?:\W*\w+){1,3}\s+(?:goes|comes)\s+here\W*$"
    r"|^\W*(?:your|insert|enter|add)\s+(?:\w+\s+){1,2}here\W*$|^\W*(?:\w+\s+){1,2}to\s+come\W*$"
    r"|^\W*(\w{3,})(?:\W+(?:more\s+)?\1\b){2,}",
    re.I,
)
_FILLER_SIGNS = r"(?i)lorem|ipsum|eiusmod|aliqua|veniam|consequat|cillum|pariatur|fugiat|officia|mollit|\bnulla|\bamet\b|(?:sample|dummy|placeholder|filler|example)\s+(?:text|paragraph|copy|content|sentence|heading)|\bhere\b|to\s+come|asdf|blah|text text"

# Sure signs of an error page: the public reason phrases of HTTP (fixed values) as a heading, with or without their number.
_STATUS = (
    "not found", "forbidden", "bad gateway", "service unavailable", "internal server error", "gone", "unauthorized", "unauthorised", "gateway timeout", "gateway time-out", "bad request",
    "too many requests", "moved permanently", "request timeout", "access denied", "permission denied", "nicht gefunden", "no encontrada", "introuvable", "service indisponible", "interner serverfehler",
    "error interno", "zugriff verweigert", "accès refusé",
)
_ERROR = re.compile(
    rf"^\W*(?:(?:http\s+|error\s+|erreur\s+|fehler\s+)*[1-5]\d\d\W+(?:{'|'.join(_STATUS)})\b|(?:http|error|erreur|fehler)\s+[1-5]\d\d\b(?!\s+(?:in|of|at|on)\b)"
    rf"|(?:\w+\s+){{0,3}}(?:{'|'.join(x for x in _STATUS if x not in ('gone', 'forbidden'))})\W*$)",
    re.I,
)
# And of a notice: scripts or cookies, and what is to be done about them.
_SCRIPTS = r"(?:java\s?scripts?|js|scripts?|scripting|active\s+content|cookies)"
_NOTICE = re.compile(
    rf"^(?=.*\b{_SCRIPTS}\b)(?=.*(?:\b(?:enabl|activ(?:at|er|ez|a\b|ar\b|e\s+java)|allow|disabled|block|requir|support|need|habilit|autoris|aktivier|einschalt)\w*|\b(?:turn|switch)(?:ed)?\s+(?:it\s+)?(?:on|off)\b|(?:load|work|run)\s+without\b))",
    re.I | re.S,
)
# Words of trouble; they count only in sentences and pages that recur.
_TROUBLE = r"(?i)\b(?:sorry|oops|whoops|error|fault|fatal|fail(?:ed|ure)|went wrong|unavailable|unable|unreachable|cannot|can't|not found|tim(?:ed|e)\s?-?out|blocked|denied|refused|expired|ended|deleted|broken|try again|reload|offline|outage|maintenance|permission|gateway|page|désolée?|indisponible|impossible|échoué|introuvable|erreur|fehler|leider|fehlgeschlagen|gefunden|serverfehler|verweigert|sentimos|disponible|encontrada|permitido|too many|scripts?|scripting|java\s?scripts?|js|cookies|active content)\b"
_WEAK = re.compile(_TROUBLE)
# What a text must hold to be looked at as a page (RE2 syntax).
_PAGE_SIGNS = _TROUBLE + rf"|(?:{'|'.join(x for x in _STATUS if x != 'gone')})\b|\b(?:[1-5]\d\d\W+gone|http)\b"
_NAV = re.compile(r"^\W*[\w' ]{1,24}(?:\s*[|·>»]\s*[\w' ]{1,24})+\W*$")
# Words by which a sentence talks about a slot.
_TALK = re.compile(r"\b(?:replaces?|is\s+given\s+as|are\s+given\s+as|is\s+written\s+as|such\s+as|for\s+instance|for\s+example|prints?|puts|syntax|variables?|placeholders?)\b", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
MOST_SHARE = 0.6
REPEATED = 3
# Share of the texts with a sentence that have a sure sign, or are pages, from which on it is a page's; far above what chance gives.
NEAR = 0.25
# Words of a value in a frame, of a unit of navigation, and of one that is no sentence of its own, at most.
VALUE, LINK, SHORT = 4, 6, 4
# Words at its beginning by which a longer unit is aligned too, as its end may run on into the next.
HEAD = 6
#: Places of the filters that the second pass reads; where one fills up it only lets more rows pass.
FILTER = 1 << 21
#: Most letters that are worked on at once in a task (a longer text alone is more).
CHUNK = 2_000_000

_MARK = "\x02"  # stands for a place that may be a slot
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[48:58] = ord("9")
_WORDS = np.zeros(256, bool)
_WORDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), ord("_"), ord(_MARK)]] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_STOPS, _MINORS = np.zeros(256, bool), np.zeros(256, bool)
_STOPS[[ord(x) for x in ".!?"]] = True
_MINORS[[ord(x) for x in ";:"]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(base^k, base^-k) for k up to n, modulo 2^64."""
    if len(_powers[0]) <= n:
        for i, x in enumerate((_BASE, _INVERSE)):
            steps = np.full(n + 1, x)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def _runs(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of values[first:last] for each pair, the same wherever the run stands."""
    up, down = _power(len(values))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])
    return packed.mixed((total[last] - total[first]) * down[first])


@dataclass
class Words:
    """The words of some texts in order, and the marks between them: kind 0 is a word, 1 the end of a sentence or text, 2 a lesser end."""

    hash: np.ndarray
    kind: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    row: np.ndarray


def words(letters: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of texts (bytes, offsets) in lower case, each run of digits as one 9."""
    n = len(letters)
    is_word, is_digit, space = _WORDS[letters], _DIGITS[letters], _SPACES[letters]
    before, after = np.empty(n, bool), np.empty(n, bool)

    def neighbours(x: np.ndarray, outside: bool) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.empty(n, bool), np.empty(n, bool)
        left[1:], right[:-1] = x[:-1], x[1:]
        inner = offsets[:-1][np.diff(offsets) > 0]
        left[inner] = outside
        right[np.append(inner[1:], n) - 1] = outside
        return left, right

    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, none, none)
    before, after = neighbours(is_word, False)
    begin, end = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
    kept = is_word & ~(is_digit & neighbours(is_digit, False)[0])
    place = np.concatenate([[0], np.cumsum(kept)])
    value = _runs(_LOWER[letters[kept]].astype(np.uint64) + np.uint64(1), place[begin], place[end])
    space_before, space_after = neighbours(space, True)
    newline = letters == 10
    stop = np.flatnonzero((_STOPS[letters] & space_after) | newline)
    minor = np.flatnonzero((_MINORS[letters] & space_after) | ((letters == ord("-")) & space_before & space_after))
    at = np.concatenate([2 * begin, 2 * stop, 2 * minor, 2 * offsets[1:] - 1])
    kind = np.repeat(np.array([0, 1, 2, 1]), [len(begin), len(stop), len(minor), len(offsets) - 1])
    hashes = np.concatenate([value, np.ones(len(at) - len(begin), np.uint64)])
    ends = np.concatenate([end, stop, minor, offsets[1:]])
    order = np.argsort(at, kind="stable")
    at = at[order]
    row = np.searchsorted(2 * offsets[1:] - 1, at, "left")
    return Words(hashes[order], kind[order], (at + 1) // 2, ends[order], row)


def units(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, key of the first HEAD words, number of words, first) of each run of words between marks; first is a place in w."""
    inside = w.kind == 0
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return _runs(w.hash, first, last), _runs(w.hash, first, np.minimum(first + HEAD, last)), last - first, first


def frames(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places in w without lesser marks, left, right, known): hashes of the up to three words before and after each place, within its sentence, and how many words both hold."""
    at = np.flatnonzero(w.kind != 2)
    h, stop = w.hash[at], w.kind[at] == 1
    n = len(h)

    def side(step: int) -> tuple[np.ndarray, np.ndarray]:
        out, known, open_ = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.ones(n, bool)
        for k in (1, 2, 3):
            x, s = np.ones(n, np.uint64), np.ones(n, bool)
            if k < n:
                if step < 0:
                    x[k:], s[k:] = h[:-k], stop[:-k]
                else:
                    x[:-k], s[:-k] = h[k:], stop[k:]
            out = np.where(open_, out * _BASE + x, out)
            known += open_ & ~s
            open_ &= ~s
        return packed.mixed(out + np.uint64(7 if step < 0 else 8)), known

    (left, a), (right, b) = side(-1), side(1)
    return at, left, right, a + b


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices of a string column of about CHUNK letters."""
    ends, row = np.cumsum(np.asarray(pc.binary_length(texts))), 0
    while row < len(ends):
        end = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + CHUNK, "right")))
        yield row, end
        row = end


def _entities(text: str) -> str:
    return re.sub(r"&(?!lt;|gt;)(\w{2,8}|#\d{1,6});", lambda m: html.unescape(m[0]), text) if "&" in text else text


def is_filler(unit: str) -> bool:
    """The sentence is surely filler text."""
    found = re.findall(r"[^\W\d_]+", unit.lower())
    if len(found) >= 4 and sum(w in LOREM for w in found) >= 0.7 * len(found):
        return True
    return bool(_FILLER.search(unit))


def _places(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, it is a known syntax) of what may be an unfilled slot, in order and without overlap."""
    out = [(m.start(), m.end(), True) for m in _SLOT.finditer(text)]
    taken = list(out)
    out += [(m.start(), m.end(), False) for m in _CUE.finditer(text) if not any(a < m.end() and m.start() < b for a, b, _ in taken)]
    gaps = list(_GAP.finditer(text)) if "  " in text else []
    if len(gaps) <= max(2, 0.1 * text.count(" ")):  # doubled blanks that are the text's usual spacing tell nothing
        out += [(m.start(), m.end(), False) for m in gaps]
    out.sort()
    return [x for k, x in enumerate(out) if k == 0 or x[0] >= out[k - 1][1]]


def _talks(text: str, start: int, end: int) -> bool:
    """The sentence talks about the place."""
    left, right = text[max(0, start - 200) : start], text[end : end + 200]
    return bool(_TALK.search(_SENTENCE.split(left)[-1][-80:]) or _TALK.search(_SENTENCE.split(right)[0][:40]))


MARKS = "doc_id long, copy long, kind string, key long, value long, left long, flag boolean, words int"
STRONG, WEAK, NAV = 1, 2, 3


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _marked(doc: pa.Array, copy: pa.Array, texts: list[str]) -> pa.RecordBatch:
    """Rows slot and cue of texts: the frame (key), its left side, the value, flag = the sentence talks, words = those of the frame."""
    mark = _runs(_LOWER[[ord(_MARK)]].astype(np.uint64) + np.uint64(1), np.array([0]), np.array([1]))[0]
    masked, known, talk, values, of = [], [], [], [], []
    for k, text in enumerate(texts):
        pieces, at = [], 0
        for a, b, is_known in _places(text):
            pieces += [text[at:a], f" {_MARK} "]
            known.append(is_known)
            talk.append(_talks(text, a, b))
            values.append(text[a:b].encode("utf-8", "replace"))
            of.append(k)
            at = b
        masked.append("".join([*pieces, text[at:]]).encode("utf-8", "replace") if pieces else b"")
    w = words(*packed.letters_of(pa.array(masked, pa.binary())))
    at, left, right, width = frames(w)
    hit = w.hash[at] == mark
    of = np.array(of, np.int64)
    # the value is told by its words, as the second pass tells it
    v = words(*packed.letters_of(pa.array(values, pa.binary())))
    inside = v.kind == 0
    size = np.bincount(v.row[inside], minlength=len(values))
    value = _runs(v.hash[inside], np.cumsum(size) - size, np.cumsum(size))
    take = pa.array(of)
    kind = pa.array(["slot" if x else "cue" for x in known], pa.string())
    return pa.RecordBatch.from_arrays(
        [doc.take(take), copy.take(take), kind, _signed(packed.mixed(left[hit] ^ (right[hit] * _BASE))), _signed(value), _signed(left[hit]), pa.array(talk, pa.bool_()), pa.array(width[hit], pa.int32())], NAMES
    )


NAMES = [c.split()[0] for c in MARKS.split(", ")]


def _units_of(doc: pa.Array, copy: pa.Array, texts: pa.Array, filler: np.ndarray, page: np.ndarray) -> pa.RecordBatch:
    """Rows unit (left = key of its head, value = STRONG, WEAK, NAV or 0, flag = short as a link), filler, beside (what stands next to filler) and whole of texts."""
    letters, offsets = packed.letters_of(texts)
    w = words(letters, offsets)
    key, head, size, first = units(w)
    row = w.row[first]
    begin = w.begin[first]
    end = np.where(np.append(row[1:] == row[:-1], False), np.append(begin[1:], 0), offsets[row + 1])
    raw = letters.tobytes()
    pick: dict[str, list] = {"unit": [], "filler": [], "beside": []}
    value, link = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    is_fill = np.zeros(len(key), bool)
    strong = np.zeros(len(offsets) - 1, bool)
    for k in range(len(key)):
        r = row[k]
        text = _entities(raw[begin[k] : end[k]].decode("utf-8", "replace"))
        if filler[r] and is_filler(text):
            is_fill[k] = True
        if page[r]:
            if _ERROR.search(text) or _NOTICE.search(text):
                value[k] = STRONG
                strong[r] = True
            else:
                value[k] = NAV if _NAV.match(text) else WEAK if _WEAK.search(text) else 0
            link[k] = size[k] <= LINK and not re.search(r"[.!?;]\W*$", text)
    weak = np.zeros(len(offsets) - 1, bool)
    weak[row[value == WEAK]] = True
    # beside a sure sign, words of trouble and short lines need not recur
    value[strong[row] & ((value == WEAK) | ((link | (size <= SHORT)) & (value == 0)))] = NAV
    pick["unit"] = np.flatnonzero(page[row] & (strong | weak)[row])
    pick["filler"] = np.flatnonzero(is_fill)
    near = np.zeros(len(key), bool)
    same = row[1:] == row[:-1]
    near[1:] |= is_fill[:-1] & same
    near[:-1] |= is_fill[1:] & same
    pick["beside"] = np.flatnonzero(near & ~is_fill)
    # the page as a whole: all its units in order
    ends = np.cumsum(np.bincount(row, minlength=len(strong)))
    whole = _runs(key, ends - np.bincount(row, minlength=len(strong)), ends)
    told = np.flatnonzero(weak & page)
    at = np.concatenate([pick[k] for k in ("unit", "filler", "beside")])
    kind = np.repeat(np.array(["unit", "filler", "beside", "whole"]), [*(len(pick[k]) for k in ("unit", "filler", "beside")), len(told)])
    take = pa.array(np.concatenate([row[at], told]))

    def column(x: np.ndarray, of_whole: np.ndarray) -> np.ndarray:
        return np.concatenate([x[at], of_whole.astype(x.dtype)])

    none = np.zeros(len(told), np.int64)
    numbers = [_signed(column(key, whole[told])), pa.array(column(value, none)), _signed(column(head, none)), pa.array(column(link, none)), pa.array(column(size, none), pa.int32())]
    return pa.RecordBatch.from_arrays([doc.take(take), copy.take(take), pa.array(kind, pa.string()), *numbers], NAMES)


def _analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, copy, text) -> MARKS: everything that may be residue. Most texts have no sign of it and are left after one search of the batch."""
    for batch in batches:
        for a, b in _chunks(batch.column(2)):
            part = batch.slice(a, b - a)
            doc, copy, texts = (part.column(i) for i in range(3))
            odd, filler, page = (np.asarray(pc.match_substring_regex(texts, pattern).cast(pa.uint8())) > 0 for pattern in (_ODD, _FILLER_SIGNS, _PAGE_SIGNS))
            if odd.any():
                at = pa.array(np.flatnonzero(odd))
                yield _marked(doc.take(at), copy.take(at), [_entities(x) for x in texts.take(at).to_pylist()])
            if (filler | page).any():
                at = np.flatnonzero(filler | page)
                take = pa.array(at)
                yield _units_of(doc.take(take), copy.take(take), texts.take(take), filler[at], page[at])


SEEN = "doc_id long, copy long, kind string, key long, value long"


def _told(keys: np.ndarray, values: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Places of the rows that tell all that is asked of a frame: its least and greatest value, and REPEATED different texts if it has so many."""
    if not len(keys):
        return np.zeros(0, np.int64)
    keep = np.zeros(len(keys), bool)
    order = np.lexsort((values, keys))
    new = keys[order][1:] != keys[order][:-1]
    keep[order[np.append(True, new)]] = True
    keep[order[np.append(new, True)]] = True
    order = np.lexsort((copies, keys))
    k, c = keys[order], copies[order]
    first = np.append(True, k[1:] != k[:-1])
    distinct = first | np.append(True, c[1:] != c[:-1])
    rank = np.cumsum(distinct)
    rank -= np.maximum.accumulate(np.where(first, rank, 0))
    keep[order[distinct & (rank < REPEATED)]] = True
    return np.flatnonzero(keep)


def _aligned(filters):
    """(doc_id, copy, text) -> SEEN: fill (a value in a frame) and seen (a unit), of those that the filters let pass."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_bits, frame_bits, unit_bits = filters.value
        mask = np.uint64(FILTER - 1)
        for batch in batches:
            for a, b in _chunks(batch.column(2)):
                part = batch.slice(a, b - a)
                letters, offsets = packed.letters_of(part.column(2))
                w = words(letters, offsets)
                key, head, _, first = units(w)
                key, first = np.concatenate([key, head[head != key]]), np.concatenate([first, first[head != key]])
                hit = unit_bits[(key & mask).astype(np.int64)]
                rows, kinds, keys, values = [w.row[first[hit]]], [int(hit.sum())], [key[hit]], [np.zeros(hit.sum(), np.uint64)]
                at, left, right, _ = frames(w)
                h, stop = w.hash[at], w.kind[at] == 1
                begin = np.flatnonzero(left_bits[(left & mask).astype(np.int64)] & ~stop)
                for n in range(1, VALUE + 1):  # a value of n words begins there
                    begin = begin[begin + n <= len(h)]
                    begin = begin[~stop[begin + n - 1]]
                    frame = packed.mixed(left[begin] ^ (right[begin + n - 1] * _BASE))
                    ok = frame_bits[(frame & mask).astype(np.int64)]
                    some = begin[ok]
                    rows.append(w.row[at[some]])
                    kinds.append(len(some))
                    keys.append(frame[ok])
                    values.append(_runs(h, some, some + n))
                row, keys_, values_ = (np.concatenate(x) for x in (rows, keys, values))
                n_seen = kinds[0]
                copies = part.column(1).to_numpy(zero_copy_only=False)[row[n_seen:]]
                kept = n_seen + _told(keys_[n_seen:].view(np.int64), values_[n_seen:].view(np.int64), copies)
                at = np.concatenate([np.arange(n_seen), kept])
                kind = pa.array(np.repeat(np.array(["seen", "fill"]), [n_seen, len(kept)]), pa.string())
                take = pa.array(row[at])
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), kind, _signed(keys_[at]), _signed(values_[at])], [c.split()[0] for c in SEEN.split(", ")])

    return align


def _filters(spark: SparkSession, found: DataFrame):
    """A flag for each number below FILTER, by kind of hash: what the second pass looks for. Their size doesn't depend on the table."""
    places, unit = found.where("kind IN ('slot', 'cue')"), found.where("kind IN ('unit', 'beside')")
    keys = unit.select("key").unionByName(unit.where("kind = 'unit'").select(F.col("left").alias("key")))
    return spark.sparkContext.broadcast((flags(places, "left", FILTER), flags(places, "key", FILTER), flags(keys, "key", FILTER)))


def _slots(found: DataFrame, fills: DataFrame) -> DataFrame:
    """doc_id of the places that are slots."""
    places = found.where("kind IN ('slot', 'cue')")
    every = places.select("key", "copy", "value", F.lit(1).alias("own")).unionByName(fills.select("key", "copy", "value", F.lit(0).alias("own")))
    per_frame = every.groupBy("key").agg(F.sum("own").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.count_distinct("copy").alias("times")).where("n > 0")
    placed = join_counted(places.select("doc_id", "kind", "key", "flag", "words"), per_frame, ["key"], "n", places.count())
    varies = F.col("low") != F.col("high")
    known = (F.col("kind") == "slot") & (varies | ~F.col("flag"))
    induced = (F.col("kind") == "cue") & varies & ~F.col("flag") & (F.col("times") >= REPEATED) & (F.col("words") >= 3)
    return placed.where(known | induced).select("doc_id")


def _fillers(found: DataFrame, seen: DataFrame) -> DataFrame:
    """doc_id of filler: sure sentences, and those that recur and nearly always stand beside filler."""
    beside = found.where("kind = 'beside'").groupBy("key").agg(F.count_distinct("copy").alias("near"))
    times = seen.groupBy("key").agg(F.count_distinct("copy").alias("times"))
    learnt = beside.join(times, "key").where((F.col("times") >= REPEATED) & (F.col("near") >= 0.8 * F.col("times"))).select("key", F.col("times").alias("n"))
    more = join_counted(seen.select("doc_id", "key"), learnt, ["key"], "n", seen.count(), "left_semi").select("doc_id")
    return found.where("kind = 'filler'").select("doc_id").unionByName(more)


def _pages(found: DataFrame, seen: DataFrame) -> DataFrame:
    """doc_id of error pages and notices, from their units and how these recur."""
    unit = materialise(found.where("kind = 'unit'").select("doc_id", "copy", "key", F.col("left").alias("head"), "value", "flag", "words"), "units")
    total = unit.count()
    times = seen.groupBy("key").agg(F.count_distinct("copy").alias("times")).where(F.col("times") >= REPEATED)
    both = unit.select("doc_id", "copy", "key").unionByName(unit.where("head <> key").select("doc_id", "copy", F.col("head").alias("key")))

    def part(of: DataFrame, name: str) -> DataFrame:
        """(key, name): the share of the texts with a unit that are among `of`."""
        on = both.join(of, "doc_id", "left_semi").groupBy("key").agg(F.count_distinct("copy").alias("k"))
        return on.join(times, "key").select("key", (F.col("k") / F.col("times")).alias(name))

    strong = unit.where(F.col("value") == STRONG).select("doc_id").distinct()
    counts = both.groupBy("key").agg(F.count("*").alias("n"))
    shapes = materialise(counts.join(times.select("key"), "key").join(part(strong, "part"), "key", "left").select("key", "n", F.coalesce("part", F.lit(0.0)).alias("part")), "shapes")

    def placed(shapes: DataFrame, name: str) -> DataFrame:
        """unit with name, its figure, and of_head, that of its head; null where they don't recur."""
        figures = shapes.select("key", "n", name)
        whole = join_counted(unit, figures, ["key"], "n", 2 * total, how="left")
        return join_counted(whole, figures.select(F.col("key").alias("head"), "n", F.col(name).alias("of_head")), ["head"], "n", 2 * total, how="left")

    def pages(rows: DataFrame) -> DataFrame:
        recurs = F.col("part").isNotNull() & (F.col("flag") | (F.col("part") >= NEAR))
        template = F.col("value").isin(STRONG, NAV) | recurs
        by_head = F.when(F.col("of_head") >= NEAR, F.least(F.col("words"), F.lit(HEAD))).otherwise(0)
        share = F.sum(F.when(template, F.col("words")).otherwise(by_head)) / F.sum("words")
        told = (F.col("value") == STRONG) | (template & (F.col("value") == WEAK))
        return rows.groupBy("doc_id").agg(share.alias("share"), F.max(told.cast("int")).alias("told")).where((F.col("told") == 1) & (F.col("share") >= MOST_SHARE)).select("doc_id")

    # signs, links that recur, and sentences that recur and stand on pages with a sign
    first = pages(placed(shapes, "part"))
    # and what recurs on the pages found so
    learnt = materialise(shapes.join(part(materialise(first, "pages"), "on_pages"), "key", "left").select("key", "n", F.greatest("part", F.coalesce("on_pages", F.lit(0.0))).alias("part")), "learnt")
    second = pages(placed(learnt, "part"))
    # a page with a word of trouble may also recur as a whole, whatever its wording
    whole = found.where("kind = 'whole'").select("doc_id", "copy", "key")
    again = whole.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("copy").alias("times")).where(F.col("times") >= REPEATED).drop("times")
    return second.unionByName(join_counted(whole.select("doc_id", "key"), again, ["key"], "n", whole.count(), "left_semi").select("doc_id"))


def reasons(docs: DataFrame) -> DataFrame:
    """(doc_id, reason): slot, filler or page for each text that holds residue; a text may have several.

    slot: a form of SLOTS stands where a value should, unless it is fixed
    wording: the only value of its frame in all texts, in a sentence that
    talks about it. A blank, default or name in another syntax is a slot if
    its frame has several values in at least REPEATED different texts, and
    three words at least. filler: a sentence of filler text, or one that
    recurs beside such sentences. page: sure signs of an error or a script
    notice, site navigation (links that recur), and sentences that recur on
    such pages make up MOST_SHARE of the words; or the text recurs as a
    whole, but for numbers, and has a word of trouble. Equal texts count once wherever
    something must recur. Null, empty and blank texts and null ids give no
    rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text").dropna()
    found = materialise(rows.mapInArrow(_analyse, MARKS), "marks")
    second = materialise(rows.mapInArrow(_aligned(_filters(docs.sparkSession, found)), SEEN), "aligned")
    seen = second.where("kind = 'seen'")
    parts = {"slot": _slots(found, second.where("kind = 'fill'")), "filler": _fillers(found, seen), "page": _pages(found, seen)}
    out = None
    for reason, part in parts.items():
        some = part.select("doc_id", F.lit(reason).alias("reason"))
        out = some if out is None else out.unionByName(some)
    return out.distinct()


def found(docs: DataFrame) -> DataFrame:
    """(doc_id): texts that hold residue."""
    return reasons(docs).select("doc_id").distinct()


def clean(docs: DataFrame) -> DataFrame:
    """The rows of docs that hold no residue, with all their columns."""
    return docs.join(found(docs), "doc_id", "left_anti")
