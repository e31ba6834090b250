"""Noise of scanning in page text: its repair into continuous paragraphs, and the defects found.

Lines of page furniture (running headers, page numbers) are taken out, so the text on both sides joins. What is left is one
stream of characters, de-lined: line ends are places where a word may go on. Wherever the stream holds something that is
no known word, the cheapest joint segmentation of it and its neighbours is found by dynamic programming over the
characters: a piece may be a word as it stands, a word misread by known confusions, parts of a word split by spaces, a
word broken by a hyphen, one of several words run together, or any of these at once, each at its cost. Paragraph
boundaries are then chosen by dynamic programming over the lines.

The lexicon is counted over all pages. Words that make up one in MOST_WORDS running words are broadcast; rarer ones stay a
table, of which each page gets all that its search may look up (`asked`), so a page is read as if every word were broadcast.
A filter of fixed size leaves out what is surely none of them before the join.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections import ChainMap
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import materialise, spread

# Characters as scanners misread them, and what they stand for.
MISREAD = {
    "0": "o", "1": "l", "|": "l", "!": "i", "3": "e", "4": "a", "5": "s", "$": "s", "6": "b", "8": "b", "9": "g", "7": "t",
    "@": "a", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ɑ": "a", "ο": "o", "е": "e", "а": "a", "о": "o", "¡": "i", "€": "e", "£": "e",
}
#: Letter groups that are taken for each other come out the same, applied in this order after single letters. Where two
#: confusions meet (`cli` is a misread `ch` or `di`, `lii` a misread `hi` or `lu`) both readings do.
CONFUSED = [("clu", "du"), ("lii", "hi"), ("lu", "hi"), ("ii", "u"), ("cli", "ch"), ("di", "ch"), ("rn", "m"), ("rm", "nn"), ("cl", "d"), ("li", "h"), ("vv", "w")]
#: e and c, f and t are taken for each other.
_FIRST = str.maketrans({k: v.replace("e", "c").replace("f", "t") for k, v in MISREAD.items()} | {"e": "c", "f": "t"})
#: The words that workers hold make up at least one in so many running words, so they are no more than this.
MOST_WORDS = 1 << 20
#: A form is a misreading of a word that looks alike if the word is at least so many times as frequent.
RATIO = 12
#: Places of 32 bits in the filter of rare words, a power of 2.
SIEVE = 1 << 20
#: Occurrences of a word of the lexicon, and what counts for a form that is none.
LEAST, NEVER = 2, 0.2
#: What it costs, in the logarithm of frequencies, to put parts of a word together, to cut words that run together, and to
#: leave what is no word as it stands.
MERGE, CUT, UNKNOWN = 6.0, 1.0, 6.0
#: Letters of a word in the search, of a token that may be cut, and of its parts.
LONGEST, CUTTABLE, PART = 26, 6, 3
HYPHENS = "-‐‑\xad¬"
_LINES = re.compile(r"\r\n|\r|\n|\x0b|\x0c|\x85| | ")
_ROMAN = re.compile(r"(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,4})(?:ix|iv|v?i{0,4})", re.I)
_NUMBER = re.compile(
    r"\d{1,4}|\[\s*\d{1,4}\s*\]|[-–—~]\s*\d{1,4}\s*[-–—~]|(?:page|pg?\.|p\.?)\s*\d{1,4}|\d{1,4}\s+/\s+\d{1,4}|(?:page\s+)?\d{1,4}\s+of\s+\d{1,4}", re.I
)
_WITH_NUMBER = re.compile(r"^(?:\d{1,4}\s+[|.·—-]*\s*)?(.*?)(?:\s*(?:\|\s*|[.·]{3,}\s*)\d{1,4})?$")
_CHAPTER = re.compile(r"(\S{6,9})\s+(\S{1,5})\s+(\S.*)$")
_TOKEN = re.compile(r"\S+")
_EDGES = "\"“”„«»'‘’()[]{}<>.,;:?…*"
_ODD = frozenset(MISREAD)
#: What stands between the parts of a compound.
_INNER = "-‐‑'’\"“(["


def skeleton(word: str) -> str:
    """A form that a word and its misreadings share, kept for short ones."""
    return _skeleton(word) if len(word) <= 60 else _skeleton.__wrapped__(word)


@lru_cache(1 << 17)
def _skeleton(word: str) -> str:
    s = word.lower().translate(_FIRST)
    for a, b in CONFUSED:
        if a in s:
            s = s.replace(a, b)
    return s


def word_counts(pages: DataFrame, fields: list[str]) -> tuple[DataFrame, float]:
    """((word, n), total): the running words of the first field that is there, words at the end of a line left out, compounds
    whole, of those that occur LEAST times or more; and how many running words there are."""
    text = F.coalesce(*[pages[f] for f in fields])
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?<=[ \n\r(\"“]|^)[\p{L}\d|!$@]+(?:['’‐-][\p{L}]+)*(?=[ .,;:?)\"”])"), 0)
    counts = pages.select(F.explode(words).alias("word")).where(F.col("word").rlike(r"\p{L}{2}")).groupBy("word").agg(F.count("*").alias("n"))
    counts = materialise(counts, "scan-words")
    return counts.where(F.col("n") >= LEAST), counts.agg(F.sum("n")).first()[0] or 0


class Lexicon:
    """Words with their counts, by skeleton. extra are rare words of the page at hand, beside those that all pages share, each
    of which is more frequent than any of them."""

    shared: Lexicon | None = None

    def __init__(self, counts: dict[str, int], total: float | None = None) -> None:
        self.counts = counts
        self.by: dict[str, list[str]] = {}
        for w in counts:
            self._list(self.by, w)
        self.logs = math.log((sum(counts.values()) if total is None else total) + 1)
        self._kept: dict[str, str | None] = {}
        self._passing: dict[str, bool] = {}

    @staticmethod
    def _list(by: dict[str, list[str]], w: str) -> None:
        if w.isalpha() and not _ODD.intersection(w):
            by.setdefault(skeleton(w), []).append(w)

    def with_extra(self, extra: dict[str, int]) -> Lexicon:
        """This lexicon with more words; it shares what it holds."""
        if not extra:
            return self
        out = Lexicon.__new__(Lexicon)
        out.counts, out.logs, out._kept, out._passing = ChainMap(extra, self.counts), self.logs, {}, {}
        own: dict[str, list[str]] = {}
        for w in extra:
            self._list(own, w)
        out.by = ChainMap({k: [*self.by.get(k, ()), *ws] for k, ws in own.items()}, self.by)
        out.shared = self
        return out

    def cost(self, word: str) -> float:
        return self.logs - math.log(self.counts.get(word, NEVER))

    def misread(self, form: str) -> str | None:
        """The word that a form is a misreading of, None if it may stand: a form with a sign or digit among its letters
        is misread if any word looks alike, another if a word that does is RATIO times as frequent."""
        if form in self._kept:
            return self._kept[form]
        if self.shared is not None and form not in self.counts.maps[0] and skeleton(form) not in self.by.maps[0]:
            return self.shared.misread(form)
        if len(self._kept) > 500_000:
            self._kept.clear()
        own, out = self.counts.get(form, NEVER), None
        others = [w for w in self.by.get(skeleton(form), ()) if w != form]
        if others and len(form) >= 3:
            best = max(others, key=lambda w: (self.counts[w], w))
            if _ODD.intersection(form) or self.counts[best] >= RATIO * own:
                out = best
        self._kept[form] = out
        return out

    def passes(self, form: str) -> bool:
        """Whether a form of the lexicon stands as it is, kept for each: however frequent, one that is misread does not."""
        got = self._passing.get(form)
        if got is None and self.shared is not None and self.shared.passes(form):
            return True
        if got is None:
            got = self._passing[form] = form in self.counts and form.isalpha() and not _ODD.intersection(form) and self.misread(form) is None
            if len(self._passing) > 500_000:
                self._passing.clear()
        return got

    def read(self, form: str) -> tuple[float, str] | None:
        """(cost, word) of reading a form as the word it is, or of which it is a misreading; None if there is none. That the
        word is more frequent is what a confusion costs."""
        right = self.misread(form)
        if right:
            return self.cost(right) + (0.0 if _ODD.intersection(form) else LOG_RATIO), right
        return (self.cost(form), form) if form in self.counts else None


LOG_RATIO = math.log(RATIO)


def is_page_number(line: str) -> bool:
    """A line, trimmed, with nothing but the page's number."""
    return len(line) < 20 and (_NUMBER.fullmatch(line) is not None or (len(line) < 9 and _ROMAN.fullmatch(line) is not None))


def is_header(line: str, title: str) -> bool:
    """A line with the book's title (as a skeleton) or its chapter, with or without a number on either side."""
    if not 6 < len(line) < 110:
        return False
    core = _WITH_NUMBER.match(line)[1]
    if title and abs(len(core) - len(title)) <= 8 and skeleton(core) == title:
        return True
    m = _CHAPTER.match(core)
    return bool(m and skeleton(m[1]) == _CHAPTER_WORD and skeleton(m[2]).translate(_DIGITS).isdigit() and len(core.split()) <= 9 and core[-1] not in ".,;:!?-")


_CHAPTER_WORD = skeleton("chapter")
#: A chapter's number is a number in the skeleton too.
_DIGITS = str.maketrans("olsbgtca", "01569734")


def title_of(source_file: str | None) -> str:
    """The skeleton of the book's title: the file's name without its ending."""
    return skeleton(" ".join(re.sub(r"\.\w{1,5}$", "", re.split(r"[/\\]", source_file)[-1]).replace("_", " ").split())) if source_file else ""


@dataclass
class Unit:
    """A token of the stream: what stands before its letters, the letters as they are, whether a hyphen breaks them off, and
    what stands after. It may be read otherwise if it is open; line counts the lines."""

    lead: str
    core: str
    broken: str
    tail: str
    line: int
    open: bool
    known: bool

    def text(self) -> str:
        return self.lead + self.core + self.broken + self.tail


def _low(core: str) -> str:
    """A core in small letters, each in its place: where one becomes two only the first is taken."""
    low = core.lower()
    return low if len(low) == len(core) else "".join(c.lower()[0] for c in core)


def _split(token: str, head: str) -> tuple[str, str, str, str, str]:
    """(lead, core, broken, tail, short) of a token; short is the core without signs at its end."""
    body = token.lstrip(_EDGES)
    lead, broken = token[: len(token) - len(body)], ""
    core = body.rstrip(_EDGES)
    tail = body[len(core) :]
    if len(token) > 1 and token[-1] in HYPHENS and token[-2].isalpha():
        # broken off: of a compound only its last part goes on
        core, broken, tail = core.rstrip(HYPHENS), token[-1], ""
        k = max(core.rfind(c) for c in _INNER) + 1
        lead, core = lead + core[:k], core[k:]
    if head and (k := min((i for i in map(core.find, _INNER) if i >= 0), default=-1)) > 0:
        core, broken, tail = core[:k], "", core[k:] + broken + tail
    return lead, core, broken, tail, core.rstrip("!|")


def _unit(token: str, line: int, lexicon: Lexicon, head: str = "") -> Unit:
    """The unit of a token; head is what a hyphen broke off right before it."""
    if not head and lexicon.passes(token.lower()):
        return Unit("", token, "", "", line, True, True)
    lead, core, broken, tail, short = _split(token, head)
    # a sign at the end may be punctuation or a misread letter: punctuation, unless only with it there is a word
    if short != core and short:
        with_sign, without = (lexicon.read((head + x).lower()) for x in (core, short))
        if without or head and not with_sign:
            core, broken, tail = short, "", core[len(short) :] + broken + tail
    return _fitted(lead, core, broken, tail, line, lexicon, head)


def _fitted(lead: str, core: str, broken: str, tail: str, line: int, lexicon: Lexicon, head: str) -> Unit:
    """The unit of a token's parts: open if its core may be a word or part of one, known if it is one that stands."""
    form = _low(core)
    fit = bool(core) and (len(core) > 1 or bool(broken) or bool(head)) and (core[0].isalnum() or core[0] in _ODD)
    fit = fit and sum(map(str.isalpha, core)) * 2 >= len(core) and all(c.isalnum() or c in _ODD for c in core)
    return Unit(lead, core, broken, tail, line, fit, fit and lexicon.passes(form))


def _cuts(u: Unit) -> range:
    """Where a unit may be cut: within an unknown token long enough to be several words."""
    fit = u.open and not u.known and not u.broken and CUTTABLE <= len(u.core) <= 40 and u.core.isalpha()
    return range(PART, len(u.core) - PART + 1) if fit else range(0)


def _region(units: list[Unit], lexicon: Lexicon, defects: dict[tuple[str, str], None]) -> None:
    """Reads the units of a stretch by the cheapest joint segmentation of their letters, and writes them as read: what is put
    together goes to its first unit, and the others become empty."""
    cores = [u.core for u in units]
    stream, marks = "".join(map(_low, cores)), [0]
    for c in cores:
        marks.append(marks[-1] + len(c))
    at = {p: k for k, p in enumerate(marks)}
    # where a piece may begin or end: between tokens, and within some
    cuts = {marks[k] + p for k, u in enumerate(units) for p in _cuts(u)}
    places = sorted(set(marks) | cuts)
    best: dict[int, tuple[float, int, str | None, bool]] = {0: (0.0, 0, None, False)}

    def across(i: int, j: int) -> range:
        return range(bisect_right(marks, i), bisect_left(marks, j))

    for n, j in enumerate(places):
        if not j:
            continue
        top = (math.inf, 0, None, False)
        for m in range(n - 1, -1, -1):
            i = places[m]
            single = i in at and j in at and at[j] == at[i] + 1
            if j - i > LONGEST and not single:
                if j not in at or i < marks[at[j] - 1]:
                    break
                continue
            if i not in best:
                continue
            base, joints = best[i][0], across(i, j)
            # only letters join letters: nothing may stand between the parts
            if any(units[k - 1].tail or units[k].lead or not units[k - 1].open or not units[k].open for k in joints) or len(joints) > 2:
                continue
            first = bisect_right(marks, i) - 1
            form = stream[i:j]
            extra = CUT * (i not in at) + sum(MERGE for k in joints if not units[k - 1].broken)
            hyphens = [k for k in joints if units[k - 1].broken]
            whole = i in at and j in at
            options: list[tuple[float, str | None, bool]] = []
            if units[first].open:
                if whole or j - i >= PART:
                    got = lexicon.read(form)
                    if got and (whole or len(got[1]) >= PART):
                        options.append((got[0] + extra, got[1], got[1] != form))
                if len(hyphens) == 1 and len(joints) == 1 and units[hyphens[0] - 1].broken != "\xad":
                    k = marks[hyphens[0]]
                    compound = f"{stream[i:k]}-{stream[k:j]}"
                    if compound in lexicon.counts:
                        # its own hyphen, on equal terms too
                        options.append((lexicon.cost(compound) - 1e-6, None, False))
                    elif not options and whole and form.isalpha() and not units[hyphens[0]].core[0].isupper():
                        # not in the lexicon: two words of their own keep the hyphen, parts that are none are a broken word
                        if not (lexicon.passes(stream[i:k]) and lexicon.passes(stream[k:j])):
                            options.append((lexicon.cost("") + CUT, form, False))
                elif len(hyphens) == 1 and len(joints) == 1 and not options and whole and form.isalpha():
                    options.append((lexicon.cost("") + CUT, form, False))
            if single:
                # as it stands
                options.append((lexicon.cost(form) + (0.0 if form in lexicon.counts else UNKNOWN), None, False))
            for c, word, wrong in options:
                if base + c < top[0]:
                    top = (base + c, i, word, wrong)
        if top[0] < math.inf:
            best[j] = top
    j = len(stream)
    steps = []
    while j > 0:
        c, i, word, wrong = best[j]
        steps.append((i, j, word, wrong))
        j = i
    written = [""] * len(units)
    letters = "".join(cores)
    joined: dict[int, int] = {}
    ends: dict[int, int] = {}
    for i, j, word, wrong in reversed(steps):
        first = bisect_right(marks, i) - 1
        inside = across(i, j)
        like = letters[i:j]
        if word is None:
            written[first] += "".join(f"{cores[k]}{units[k].broken}" if k < (inside[-1] if inside else first) else cores[k] for k in range(first, (inside[-1] if inside else first) + 1))
        else:
            written[first] += (" " if i not in at and written[first] else "") + _cased(word, like)
            if any(units[k - 1].broken for k in inside):
                defects["hyphen_break", word] = None
            elif wrong:
                defects["char_error", word] = None
        for k in inside:
            joined[k] = first
            ends[first] = k
    for k, u in enumerate(units):
        if k in joined:
            continue
        last = ends.get(k, k)
        u.core = written[k]
        if last != k:
            u.broken, u.tail = units[last].broken, units[last].tail
            for m in range(k + 1, last + 1):
                units[m].lead = units[m].core = units[m].broken = units[m].tail = ""


def _running(text: str, title: str, defects: dict[tuple[str, str], None]) -> Iterator[tuple[list[str], bool]]:
    """The tokens of each line of a text that is no furniture, with whether a blank line stands before; furniture goes to
    defects."""
    blank = False
    for raw in _LINES.split(text):
        tokens = raw.split()
        if not tokens:
            blank = True
            continue
        if len(raw) < 120 and len(tokens) < 14:
            line = " ".join(tokens)
            if is_page_number(line):
                defects["page_number", line] = None
                continue
            if (title or "h" in line or "H" in line) and is_header(line, title):
                defects["running_header", line] = None
                continue
        yield tokens, blank
        blank = False


def decode(text: str, title: str, lexicon: Lexicon) -> tuple[list[tuple[str, str]], list[tuple[str, bool]]]:
    """(defects, lines) of a text: each (defect, token), and the repaired lines with whether a blank line or furniture
    stands before. A word broken across furniture still joins."""
    defects: dict[tuple[str, str], None] = {}
    blanks: list[bool] = []
    units: list[Unit] = []
    head = ""
    for tokens, blank in _running(text, title, defects):
        for t in tokens:
            u = _unit(t, len(blanks), lexicon, head)
            head = u.core if u.broken else ""
            units.append(u)
        blanks.append(blank)
    # stretches of unknown units, with their neighbours; a break belongs to what follows it
    odd = [not u.known or bool(u.broken) for u in units]
    k = 0
    while k < len(units):
        if not odd[k]:
            k += 1
            continue
        end = k
        while end + 1 < len(units) and odd[end + 1]:
            end += 1
        lo, hi = max(0, k - 1), min(len(units), end + 2)
        stretch = units[lo:hi]
        # what cannot be read otherwise parts the stretch
        part: list[Unit] = []
        for u in [*stretch, None]:
            if u is None or not u.open or not u.core:
                if part and any(not x.known or x.broken for x in part):
                    _region(part, lexicon, defects)
                part = []
            else:
                part.append(u)
        k = end + 1
    out: list[list[str]] = [[] for _ in blanks]
    for u in units:
        if t := u.text():
            out[u.line].append(t)
    return list(defects), [(" ".join(t), b) for t, b in zip(out, blanks) if t]


def _cased(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.capitalize() if like[:1].isupper() else word


def forms(text: str, title: str, lexicon: Lexicon) -> set[str]:
    """The forms that decode() may look up in a text, with any words at all beside those of the lexicon, none as frequent,
    and that the lexicon's own words do not settle.

    More words only make more tokens known, so the stretches that decode() searches then lie within those of this lexicon,
    and so do their pieces. Only a sign at a token's end may be cut off by one set of words and not by another: both ways
    are followed."""
    out: set[str] = set()
    # units a piece may begin with, with the one after it where a piece may reach over it; calm if it is but one known word
    chains: list[tuple[Unit, ...]] = []
    calm, word = True, ""
    for tokens, _ in _running(text, title, {}):
        for t in tokens:
            if calm and lexicon.passes(t.lower()):
                chains, word = [], t
                continue
            if calm and not chains and word:
                chains = [(Unit("", word, "", "", 0, True, True),)]
            grown: list[tuple[Unit, ...]] = []
            for head in {_head(c[-1]) for c in chains} or {""}:
                for u in _readings(t, lexicon, head, out):
                    grown.append((u,))
                    _pieces((u,), out)
                    odd = not u.known or bool(u.broken)
                    for c in chains:
                        p = c[-1]
                        if _head(p) == head and p.open and u.open and not p.tail and not u.lead and (odd or not p.known or p.broken):
                            _pieces((*c, u), out)
                            if odd and len(c) == 1:
                                grown.append((p, u))
            chains = grown
            calm = len(chains) == 1 and not u.broken and (u.known or not u.open)
    return out


def _head(u: Unit) -> str:
    return u.core if u.broken else ""


def _readings(token: str, lexicon: Lexicon, head: str, out: set[str]) -> list[Unit]:
    """The units that a token may be with more words than the lexicon's; what decides goes to out."""
    if not head and lexicon.passes(token.lower()):
        return [Unit("", token, "", "", 0, True, True)]
    lead, core, broken, tail, short = _split(token, head)
    ways = [(core, broken, tail)]
    if short != core and short:
        with_sign, without = ((head + x).lower() for x in (core, short))
        out.update((with_sign, without))
        bare = (short, "", core[len(short) :] + broken + tail)
        ways = [bare] if lexicon.read(without) else [*ways, bare]
    return [_fitted(lead, c, b, t, 0, lexicon, head) for c, b, t in ways]


def _pieces(units: tuple[Unit, ...], out: set[str]) -> None:
    """Adds to out what is looked up of pieces that begin in the first of some units and end in the last."""
    if not units[0].open:
        return
    lows = [_low(u.core) for u in units]
    stream = "".join(lows)
    last = len(stream) - len(lows[-1])
    begins, ends = [0, *_cuts(units[0])], [*(last + p for p in _cuts(units[-1])), len(stream)]
    if len(units) == 1 and not units[0].known:
        out.add(stream)
    for i in begins:
        for j in ends:
            if PART <= j - i <= LONGEST or 0 < j - i < PART and (i, j) == (0, len(stream)):
                form = stream[i:j]
                if len(units) > 1 or not units[0].known:
                    out.add(form)
                if len(units) == 2 and units[0].broken and units[0].broken != "\xad":
                    out.add(f"{stream[i:last]}-{stream[last:j]}")


def paragraphs(lines: list[tuple[str, bool]]) -> list[str]:
    """The lines as paragraphs. A boundary before a line gains by a blank line, a sentence's end before it, a numbered
    entry or a short line before it, and costs where the text runs on; the sum over all boundaries is the best where each
    paragraph of one line in running text costs a little, found by dynamic programming over the last two lines."""
    if not lines:
        return []
    width = sorted(len(t) for t, _ in lines)[len(lines) * 3 // 4]
    gains = [0.0]
    for (a, _), (b, blank) in zip(lines, lines[1:]):
        ended = a.rstrip("\"”’)»")[-1:] in set(".!?。…:")
        entry = re.match(r"\d{1,3}[.)]\s|[-*•]\s", b) is not None
        g = 4.0 * blank + (1.0 if ended else -1.5) + 2.0 * entry + (0.8 if len(a) < 0.75 * width else -0.5) - 2.5 * b[:1].islower()
        gains.append(g - (4.0 if a.endswith(("," , "-")) else 0.0))
    # best sums where a boundary does and does not stand before the line
    best = [(0.0, -math.inf)]
    came: list[tuple[bool, bool]] = [(True, True)]
    for g in gains[1:]:
        cut, run = best[-1]
        yes = max((cut + g - 0.7, True), (run + g, False))
        no = max((cut, True), (run, False))
        best.append((yes[0], no[0]))
        came.append((yes[1], no[1]))
    cut, out, block = best[-1][0] > best[-1][1], [], []
    for k in range(len(lines) - 1, -1, -1):
        block.append(lines[k][0])
        if cut or not k:
            out.append(" ".join(reversed(block)))
            block = []
        cut = came[k][0] if cut else came[k][1]
    return out[::-1]


def _in_joined(lines: str, joined: str) -> bool:
    """Whether joined is the text with its lines put together and lines of bare digits dropped."""
    kept = [x for x in (" ".join(raw.split()) for raw in _LINES.split(lines)) if x and not x.isdigit()]
    return " ".join(kept) == " ".join(joined.split())


def _relined(joined: str, title: str, words: int) -> str:
    """A joined text with line ends put round what must be furniture: the title or a chapter, with their numbers, and
    page numbers in a dress of their own."""
    t = " ".join(joined.split())
    out, at = [], 0
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(t)]
    k = 0
    while k < len(tokens):
        hit = _header_length(t, tokens, k, title, words)
        if hit is None:
            for n in (3, 2, 1):
                if k + n <= len(tokens):
                    part = t[tokens[k][0] : tokens[k + n - 1][1]]
                    if not part.isdigit() and len(part) > 1 and (part[0] in "[-–—~" or part[:1] in "pP" or "/" in part or n == 1) and is_page_number(part):
                        hit = n
                        break
        if hit:
            out += [t[at : tokens[k][0]], t[tokens[k][0] : tokens[k + hit - 1][1]]]
            at = tokens[k + hit - 1][1]
            k += hit
        else:
            k += 1
    return "\n".join([*out, t[at:]])


def _header_length(t: str, tokens: list[tuple[int, int]], k: int, title: str, words: int) -> int | None:
    """How many tokens from k on are a header in a joined text: a number before the title or chapter, or one after | or dots
    behind it. A chapter ends with the word after `of`."""
    word = lambda i: t[tokens[i][0] : tokens[i][1]]
    ahead = int(word(k).isdigit())
    at = k + ahead
    if at >= len(tokens):
        return None
    first = skeleton(word(at))
    if first == _CHAPTER_WORD:
        n = next((i + 2 for i in range(2, 7) if at + i + 1 < len(tokens) and word(at + i).lower() == "of"), 0)
    else:
        n = words if title and title.split(" ", 1)[0] == first else 0
    if not n or at + n > len(tokens) or not is_header(t[tokens[at][0] : tokens[at + n - 1][1]], title):
        return None
    after = at + n
    behind = not ahead and after + 1 < len(tokens) and re.fullmatch(r"\||[.·]{3,}", word(after)) and word(after + 1).isdigit()
    return ahead + n + 2 * bool(behind)


def _texts(lined: str | None, joined: str | None, title: str) -> list[tuple[str, str | None]]:
    """(field, text) of the fields that are not blank, as they are decoded; no text where it says the same as the lined one."""
    out: list[tuple[str, str | None]] = []
    if lined and lined.strip():
        out.append(("lined", lined))
    if joined and joined.strip():
        out.append(("joined", None if out and _in_joined(lined, joined) else _relined(joined, title, title.count(" ") + 1)))
    return out


class _Titles(dict):
    """The skeleton of each book's title."""

    def __missing__(self, source: str | None) -> str:
        if len(self) > 10_000:
            self.clear()
        self[source] = title_of(source)
        return self[source]


def _pages(batches: Iterator[pd.DataFrame], shared, want: str) -> Iterator[pd.DataFrame]:
    common, titles = Lexicon(*shared.value), _Titles()
    for b in batches:
        rows = []
        for i, source, lined, joined, words, ns in b.itertuples(index=False):
            title, got = titles[source], None
            lexicon = common.with_extra(dict(zip(words.tolist(), ns.tolist()))) if words is not None else common
            for field, text in _texts(lined, joined, title):
                if text is None:
                    found = ([d for d in got[0] if d[0] != "page_number" or not d[1].isdigit()], got[1])
                else:
                    found = decode(text, title, lexicon)
                got = got or found
                if want == "defects":
                    rows += [(i, field, d, t) for d, t in found[0]]
                else:
                    rows.append((i, field, paragraphs(found[1]), len(found[0])))
        yield pd.DataFrame(rows, columns=["page_id", "field", "defect", "token"] if want == "defects" else ["page_id", "field", "paragraphs", "defects"])


def _place(k: str) -> tuple[int, int]:
    """Where a skeleton is in the filter, and its bits there."""
    h = zlib.crc32(k.encode("utf-8", "surrogatepass"))
    return h % SIEVE, 1 << (h >> 20 & 31) | 1 << (h >> 25 & 31)


def _asked(batches: Iterator[pd.DataFrame], shared, sieve) -> Iterator[pd.DataFrame]:
    """(i, k): the skeletons of what each page may look up and the common words do not settle, where a rare word may have it."""
    common, titles, bits = Lexicon(*shared.value), _Titles(), array("I", sieve.value)
    for b in batches:
        rows = []
        for i, source, lined, joined in b.itertuples(index=False):
            seen: set[str] = set()
            for _, text in _texts(lined, joined, titles[source]):
                if text is not None:
                    seen |= forms(text, titles[source], common)
            for k in set(map(skeleton, seen)):
                at, mask = _place(k)
                if bits[at] & mask == mask:
                    rows.append((i, k))
        yield pd.DataFrame(rows, columns=["i", "k"])


def _skeletons(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ks = [skeleton(w) for w in b["word"]]
        places = [_place(k) for k in ks]
        yield b.assign(k=ks, at=[p for p, _ in places], bits=[m for _, m in places])


def _sieve(keyed: DataFrame) -> bytes:
    """The filter of the rare words' skeletons: 4 bytes for each of its places."""
    got = keyed.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = array("I", bytes(4 * SIEVE))
    for at, bits in zip(got["at"].to_pylist(), got["bits"].to_pylist()):
        out[at] = bits
    return out.tobytes()


def _run(pages: DataFrame, want: str, schema: str, id_col: str, book_col: str, lined: str, joined: str, most_words: int) -> DataFrame:
    counts, total = word_counts(pages, [lined, joined])
    common = {r[0]: r[1] for r in counts.where(F.col("n") >= total / most_words).collect()}
    sc = pages.sparkSession.sparkContext
    shared = sc.broadcast((common, total))
    rows = spread(pages.where(pages[id_col].isNotNull()).select(pages[id_col].cast("bigint").alias("i"), pages[book_col].alias("s"), pages[lined].alias("a"), pages[joined].alias("b")))
    ready = rows.select("i", "s", "a", "b", F.lit(None).cast("array<string>").alias("words"), F.lit(None).cast("array<bigint>").alias("ns"))
    rare = counts.where(F.col("n") < total / most_words)
    if not rare.isEmpty():
        keyed = materialise(rare.mapInPandas(_skeletons, "word string, n bigint, k string, at int, bits bigint"), "scan-rare")
        sieve = sc.broadcast(_sieve(keyed))
        asked = rows.mapInPandas(lambda b: _asked(b, shared, sieve), "i bigint, k string").distinct()
        extra = asked.join(keyed, "k").groupBy("i").agg(F.collect_set(F.struct("word", "n")).alias("extra"))
        ready = rows.join(extra, "i", "left").select("i", "s", "a", "b", F.col("extra.word").alias("words"), F.col("extra.n").alias("ns"))
    name = F.when(F.col("field") == "lined", F.lit(lined)).otherwise(F.lit(joined))
    return ready.mapInPandas(lambda batches: _pages(batches, shared, want), schema).withColumn("field", name)


def defects(pages: DataFrame, id_col: str = "page_id", book_col: str = "source_file", lined: str = "original_prompt", joined: str = "positive_template", most_words: int = MOST_WORDS) -> DataFrame:
    """(page_id, field, defect, token), distinct, for the text with its lines and the text whose lines were joined.

    defect is hyphen_break, char_error, running_header or page_number; token the whole word as it must read, or the line
    with single spaces. A null or blank field has none; a null book has no title, only chapters are its headers."""
    return _run(pages, "defects", "page_id bigint, field string, defect string, token string", id_col, book_col, lined, joined, most_words).distinct()


def repair(pages: DataFrame, id_col: str = "page_id", book_col: str = "source_file", lined: str = "original_prompt", joined: str = "positive_template", most_words: int = MOST_WORDS) -> DataFrame:
    """(page_id, field, paragraphs, defects): the readable paragraphs of each field and how many different defects were
    repaired. A null or blank field gives no row."""
    return _run(pages, "text", "page_id bigint, field string, paragraphs array<string>, defects int", id_col, book_col, lined, joined, most_words)
