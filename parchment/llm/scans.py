"""Noise of scanned pages: joint decoding of de-lined words, running headers, page numbers, paragraphs.

A page's (or block's) lines are read as one stream of words with joints where lines meet.
Each word is decoded over a lattice: as itself, as a word with characters that the scanner
confused, as two words run together, as one word with its neighbour, or over a joint as one
cut word or a hyphenated pair. The cheapest way through the lattice is the reading. The
lexicon and the page titles are counted over the whole corpus first.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import BROADCAST_ROWS, checkpointed, salted_join, spread
from .normal import WIDTHLESS, transducer

#: What a scanner reads (left) for what is printed (right).
CONFUSIONS = (
    ("c", "e"), ("@", "a"), ("f", "t"), ("5", "s"), ("1", "i"), ("1", "l"), ("0", "o"), ("cl", "d"), ("ii", "u"), ("b", "h"), ("rn", "m"), ("ri", "n"), ("9", "g"), ("6", "b"), ("vv", "w"), ("8", "b"), ("3", "e"), ("4", "a"), ("7", "t"), ("2", "z"), ("h", "li"), ("m", "rn"), ("d", "cl"),
    ("F", "E"), ("0", "O"), ("5", "S"), ("1", "I"), ("8", "B"), ("6", "G"), ("VV", "W"), ("CL", "D"), ("RN", "M"), ("II", "U"), ("4", "A"), ("|", "l"), ("!", "i"), ("$", "s"), ("€", "e"),
)
#: Letters read for digits.
DIGITS = str.maketrans("lI|iOoQSsZzBGgq", "111100055228699")
CUTS = "-‐‑¬­⁃"
#: A word belongs to the lexicon from this share of all words (so it holds at most 1 / SHARE words) and this count.
SHARE, LEAST = 2e-7, 4
#: A word this many times rarer than one it may be a misreading of isn't trusted.
RARER = 25
_TOKEN = re.compile(r"[^\W_](?:[^\W_]|[@|!$€](?=[^\W_]))*|[@](?:[^\W_]|[@])*", re.UNICODE)
_ASCII_TOKEN = re.compile(r"[A-Za-z0-9@]+(?:[|!$][A-Za-z0-9@]+)*")
_ASCII_ROW = re.compile(_ASCII_TOKEN.pattern + r"|\n")
#: A line end that may bear a cut mark, or a sign that the transducer maps.
_MARKED_END = re.compile(r"-[^\S\n]*(?:\n|\Z)|[\x00-\x09\x0b-\x1f\x7f]").search
_COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
_ROMAN = re.compile(r"(?=.)m{0,3}(c[md]|d?c{0,3})(x[cl]|l?x{0,3})(i[xv]|v?i{0,3})$", re.I)
_VALUES = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
#: Words that stand in a sentence or notice, never in a title.
_NO_TITLE = frozenset("is are was were be been may shall must not no this that these those all you your our by said send join tell ask was it has have can draft downloaded prepared compiled posted share text print".split())
_SMALL = frozenset("and of the for in on to a an or with at from".split())
_NUMBERING = re.compile(r"\b(?:chapter|section|page|part|appendix|article)\b", re.I)
_MARKED = re.compile(r"^(?:[-–—\[(]\s*)?(?:(page|p\.|pg\.?)\s*)?([0-9A-Za-z|]{1,8}(?:\s?[-.–]\s?[0-9A-Za-z|]{1,5})?)(?:\s*[-–—\])])?$", re.I)


def roman(text: str) -> int | None:
    if not _ROMAN.match(text):
        return None
    v = [_VALUES[c] for c in text.lower()]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))


def page_value(text: str) -> int | None:
    """The number that a page label tells: decimal, roman or the last part of chapter-page, letters read as digits."""
    last = re.split(r"\s?[-.–]\s?", text)[-1]
    if last.isdecimal():
        return int(last)
    if (r := roman(last)) is not None and last not in ("l", "I"):
        return r
    fixed = last.translate(DIGITS)
    if fixed.isdecimal() and len(fixed) == len(last):
        return int(fixed)
    return roman(last.replace("1", "i").replace("l", "i"))


def misread_label(text: str | None) -> bool:
    """Whether a printed page label holds a letter taken for a digit."""
    if not text or not (t := text.strip()):
        return False
    if t.isdecimal() or re.fullmatch(r"\d+-\d+", t) or re.fullmatch(r"[A-HJ-Z]-\d+", t):
        return False
    if roman(t) is not None and t not in ("l", "I"):
        return False
    return bool(re.fullmatch(r"(?:[A-HJ-Z]-)?\d+(?:-\d+)?", re.sub(r"^[A-HJ-Z]-", lambda m: m.group(), t).translate(DIGITS) if not re.match(r"[A-HJ-Z]-", t) else t[:2] + t[2:].translate(DIGITS)))


def true_label(text: str | None) -> str | None:
    """A printed page label with misread digits put right."""
    if not misread_label(text):
        return text
    t = text.strip()
    return t[:2] + t[2:].translate(DIGITS) if re.match(r"[A-HJ-Z]-", t) else t.translate(DIGITS)


class Lexicon(dict):
    """Trusted words with counts; as a dict, a word's reading: (word, confusions) or (None, 0) if unknown."""

    def __init__(self, counts: dict[str, int], pairs: frozenset[str]) -> None:
        super().__init__()
        self.counts, self.pairs = counts, pairs
        self.most = 600_000
        self.misread = Flags(self)

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """Words that one or two confusions lead to; the seen text may stand for the printed one at any place."""
        first = set()
        for seen, printed in CONFUSIONS:
            i = word.find(seen)
            while i >= 0:
                w = word[:i] + printed + word[i + len(seen) :]
                if w not in first:
                    first.add(w)
                    yield w, 1
                i = word.find(seen, i + 1)
        if len(word) > 3:
            for w in first:
                for seen, printed in CONFUSIONS:
                    i = w.find(seen)
                    while i >= 0:
                        yield w[:i] + printed + w[i + len(seen) :], 2
                        i = w.find(seen, i + 1)

    def explained(self, word: str, own: int) -> tuple[str | None, int]:
        """The printed word of a misread one: most frequent of the fewest confusions, RARER times as frequent as the seen word."""
        best: tuple[int, int, str] | None = None
        for w, n in self.near(word):
            if (c := self.counts.get(w.lower(), 0)) >= max(LEAST, RARER * own) and (best is None or (n, -c) < best[:2]):
                best = (n, -c, w)
            if best and n > best[0]:
                break
        return (best[2], best[0]) if best else (None, 0)

    def __missing__(self, word: str) -> tuple[str | None, int]:
        if len(self) >= self.most:
            self.clear()
        low = word.lower()
        if low in self.counts or word.isdecimal() or not any(c.isalpha() or c == "@" for c in word):
            got = (word, 0)
        elif word[0].isdecimal() and len(word) > 1 and not any(c.islower() for c in word[1:]):
            got = (word, 0)
        else:
            got = self.explained(word, 0)
            if got[0] and word.isupper():
                got = got[0].upper(), got[1]
        self[word] = got
        return got

    def known(self, word: str) -> int:
        return self.counts.get(word.lower(), 0)


class Flags(dict):
    """Whether a word was misread, kept apart so that a line is tested without Python code a word."""

    def __init__(self, lex: Lexicon) -> None:
        super().__init__()
        self.lex = lex

    def __missing__(self, word: str) -> bool:
        if len(self) >= self.lex.most:
            self.clear()
        self[word] = got = self.lex[word][1] > 0
        return got


def untrusted(counts: dict[str, int], words: list[str]) -> list[str]:
    """Those of ``words`` that are misreadings of much more frequent ones."""
    full = Lexicon(counts, frozenset())
    return [w for w in words if full.explained(w, counts[w])[0] is not None or full.explained(w.upper(), counts[w])[0] is not None]


class Block:
    """The lines of a page or block, prepared: cut marks off, characters consistent, words found."""

    def __init__(self, lines: list[str]) -> None:
        run = transducer()
        text = "\n".join(lines)
        if text.isascii() and not _MARKED_END(text):
            # nothing to take off and nothing to map: all words at once, line ends among them
            self.plain, self.cut = [x.rstrip() for x in lines], [""] * len(lines)
            self.words = [[]]
            row = self.words[0]
            for w in _ASCII_ROW.findall(text):
                if w == "\n":
                    self.words.append(row := [])
                else:
                    row.append(w)
            return
        self.cut, self.plain, self.words = [], [], []
        for raw in lines:
            t = raw.rstrip()
            while t and t[-1] in WIDTHLESS and t[-1] != "­":
                t = t[:-1].rstrip()
            mark = t[-1] if len(t) > 1 and t[-1] in CUTS and (t[-2].isalnum() or t[-2] in WIDTHLESS) else ""
            self.cut.append(mark)
            p = run(t[: -1] if mark else t)
            self.plain.append(p)
            self.words.append(_ASCII_TOKEN.findall(p) if p.isascii() else _TOKEN.findall(p))


_CLOSED = frozenset(".,;:")


def title_form(line: str) -> bool:
    """Whether a line is written as a title: a few words in capitals or each with a capital, no sentence."""
    if len(line) > 120 or line[-1:] in _CLOSED or line[:1].islower():
        return False
    bare = re.sub(r"[\d.]*\d", " ", line)
    ws = re.findall(r"[^\W\d_]+", bare)
    if not 1 < len(ws) <= 9 or re.search(r"[.;:,!?©|]", bare):
        return False
    low = {w.lower() for w in ws}
    if low & _NO_TITLE:
        return False
    return line.isupper() or all(w[0].isupper() or w in _SMALL for w in ws)


def corrected(line: str, words: list[str], lex: Lexicon) -> str:
    """A line with its misread words put right."""
    if any(map(lex.misread.__getitem__, words)):
        for w in words:
            if lex[w][1]:
                line = line.replace(w, lex[w][0], 1)
    return line


def skeleton(words: list[str]) -> str:
    """A title's letters without numbering and numbers, marked if all are capitals."""
    kept = [w for w in words if not w.isdecimal() and not _NUMBERING.fullmatch(w)]
    text = " ".join(kept)
    return f"{text.lower()}\t^" if text.isupper() else text.lower()


def numbering(line: str) -> bool:
    return bool(_MARKED.match(line.strip())) and any(c.isdigit() or c in "ivxlcIVXLCO|S" for c in line)


def is_page_number(line: str, page: int | None, printed: str | None) -> bool:
    """A line of a page label alone. A bare one must tell the page's own number, printed or by position."""
    t = line.strip()
    if len(t) > 20 or not (m := _MARKED.match(t)):
        return False
    body = m.group(2)
    value = page_value(body)
    if value is None:
        return False
    marked = bool(m.group(1)) or (t[0] in "-–—[(" and t[-1] in "-–—])")
    if marked or re.fullmatch(r"[0-9lIO|]+[-–][0-9A-Za-z|]+|[ivxlc]+|[IVXLC]{2,}", body):
        return True
    if "." in body:
        return False
    own = {page} | ({page_value(printed.strip())} if printed and printed.strip() else set())
    return value in own - {None}


def edges(block: Block, page: int | None, printed: str | None) -> tuple[set[int], set[int]]:
    """(lines at the head or foot, page numbers): the outermost line on each side, and the next where that one is a number."""
    n = len(block.plain)
    full = [i for i in range(n) if block.plain[i].strip()]
    head: set[int] = set()
    nums: set[int] = set()
    for order in (full, full[::-1]):
        left = 2
        for i in order[:3]:
            if is_page_number(block.plain[i], page, printed):
                nums.add(i)
                continue
            if left == 2:
                head.add(i)
            left -= 1
            if not left:
                break
    return head, nums


#: Costs of the lattice's arcs; a cut mark that is read as it stands costs most.
_KNOWN, _CONFUSED, _SPLIT, _MERGED, _UNKNOWN, _PAIR, _OPEN, _STANDS = 0.0, 2.0, 3.0, 3.0, 6.0, 1.0, 12.0, 40.0


class Arc(NamedTuple):
    """A piece of the reading: the places in the stream that it takes, what is printed there, confusions, and its kind (word, split, merger, cut, pair)."""

    at: tuple[int, ...]
    text: str
    confused: int
    kind: str


class Stream:
    """A block's body as one de-lined row of words; ``line`` tells each one's line, ``ends`` the marked line ends by their last word."""

    def __init__(self, block: Block, lines: list[int]) -> None:
        self.block, self.words, self.line = block, [], []
        self.ends: dict[int, int] = {}
        self.starts: dict[int, int] = {}
        for i in lines:
            ws = block.words[i]
            if not ws:
                continue
            if block.plain[i].lstrip().startswith(ws[0]):
                self.starts[i] = len(self.words)
            self.words += ws
            self.line += [i] * len(ws)
            if block.cut[i] and block.plain[i].endswith(ws[-1]) and any(c.isalpha() or c == "@" for c in ws[-1]):
                self.ends[len(self.words) - 1] = i
        self.order = lines

    def hyphens(self, t: int, lex: Lexicon) -> list[tuple[int, float, Arc]]:
        """(next place, cost, arc) of the ways over the marked line end after word ``t``; lines put in between may be passed."""
        i, left = self.ends[t], self.words[t]
        mark, at = self.block.cut[i], self.order.index(i)
        out: list[tuple[int, float, Arc]] = []
        for skipped, j in enumerate(self.order[at + 1 : at + 4]):
            if (u := self.starts.get(j)) is None:
                continue
            right = self.words[u]
            word, n = lex[left + right]
            if word is not None and lex.known(word) and any(c.isalpha() for c in right):
                pair = mark == "-" and f"{left}-{right}".lower() in lex.pairs and lex.known(word) < LEAST * 5
                if not pair:
                    out.append((u + 1, _CONFUSED * n + skipped, Arc((t, u), word, n, "cut")))
                elif not skipped:
                    out.append((u + 1, _PAIR, Arc((t, u), f"{left}-{right}", 0, "pair")))
        nxt = self.order[at + 1] if at + 1 < len(self.order) else None
        u = self.starts.get(nxt)
        if mark in "¬\xad":
            # these marks are never printed: the word is cut even if nothing known comes of it
            way = next((self.starts[j] for j in self.order[at + 1 : at + 4] if j in self.starts and self.block.plain[j].lstrip()[:1].islower()), None)
            out.append((t + 1, _OPEN + 1, Arc((t,), left, 0, "cut")) if way is None else (way + 1, _OPEN, Arc((t, way), left + self.words[way], 0, "cut")))
        elif u is not None and self.words[u][:1].islower() and lex[left][0] is None and lex[self.words[u]][0] is None:
            out.append((u + 1, _OPEN, Arc((t, u), left + self.words[u], 0, "cut")))
        return out


def decode(words: list[str], lex: Lexicon, stream: Stream | None = None, first: int = 0) -> list[Arc]:
    """The cheapest way through the lattice over ``words``, which begin at place ``first`` of the stream.

    Arcs: a word as itself or with its confusions put right, its split into two known words,
    its merger with its neighbour, and over a marked line end a cut word or a hyphenated
    pair. Words known by themselves between known ones have no other way, so the lattice is
    opened only around the others. Words that a cut passes over are read on their own.
    """
    n = len(words)
    reads = [lex[w] for w in words]
    ends = stream.ends if stream else {}
    open_ = [first + i in ends or r[1] > 0 or r[0] is None for i, r in enumerate(reads)]
    if not any(open_):
        return [Arc((first + i,), w, 0, "word") for i, w in enumerate(words)]
    best: list[tuple[float, int, Arc | None]] = [(0.0, 0, None)] + [(math.inf, 0, None)] * n
    for i, w in enumerate(words):
        base, t = best[i][0], first + i
        if base == math.inf:
            continue
        if not open_[i] and not (i + 1 < n and open_[i + 1]):
            # a known word with no other way; its arc is spelt out on the way back
            if base < best[i + 1][0]:
                best[i + 1] = (base, i, None)
            continue

        def arc(to: int, cost: float, what: Arc, base: float = base, i: int = i) -> None:
            if to <= n and base + cost < best[to][0]:
                best[to] = (base + cost, i, what)

        word, k = reads[i]
        stands = 0.0
        if t in ends:
            for to, cost, what in stream.hyphens(t, lex):
                arc(to - first, cost, what)
            stands = _STANDS
        if word is not None:
            arc(i + 1, stands + _KNOWN + _CONFUSED * k, Arc((t,), word, k, "word"))
        else:
            arc(i + 1, stands + _UNKNOWN, Arc((t,), w, 0, "word"))
            for c in range(2, len(w) - 1):
                if lex.known(w[:c]) > 20 * LEAST and lex.known(w[c:]) > 20 * LEAST:
                    arc(i + 1, stands + _SPLIT, Arc((t,), f"{w[:c]} {w[c:]}", 0, "split"))
        if i + 1 < n and (open_[i] or open_[i + 1]) and (word is None or k or reads[i + 1][0] is None or reads[i + 1][1]):
            m, k2 = lex[w + words[i + 1]]
            if m is not None and lex.known(m) and k2 == 0 and not w.isdecimal() and not words[i + 1].isdecimal() and (stream is None or t not in ends):
                arc(i + 2, _MERGED + (_STANDS if t + 1 in ends else 0.0), Arc((t, t + 1), m, 0, "merger"))
    out: list[Arc] = []
    i = n
    while i:
        _, before, what = best[i]
        what = what or Arc((first + before,), words[before], 0, "word")
        out.append(what)
        if len(what.at) > 1 and what.at[1] > what.at[0] + 1:
            between = slice(what.at[0] + 1 - first, what.at[1] - first)
            out += decode(words[between], lex, stream, what.at[0] + 1)[::-1]
        i = before
    return out[::-1]


class Reading(NamedTuple):
    """Lines by kind of noise, and the way through the body that told them."""

    headers: set[int]
    numbers: set[int]
    cuts: set[int]
    misread: set[int]
    stream: Stream | None
    path: list[Arc]


def readings(block: Block, lex: Lexicon, titles: set[str], page: int | None, printed: str | None, stem: str, whole: bool = False) -> Reading:
    """What the decoder finds in a block: running lines and page numbers leave the stream, the rest is decoded over line ends.

    Cut words are the arcs over marked line ends, misread lines those with an arc that puts
    confusions right. A block in which every word is known and no line end marked has only
    one way, which is spelt out for ``whole`` only.
    """
    head, nums = edges(block, page, printed)
    headers = set()
    for i in range(len(block.plain)) if stem else sorted(head):
        # no misreading changes a line's last sign, so most lines of prose end here
        if (i in head or 2 <= len(block.words[i]) <= 9) and block.plain[i][-1:] not in _CLOSED and title_form(corrected(block.plain[i], block.words[i], lex)):
            fixed = skeleton([lex[w][0] or w for w in block.words[i]])
            own = fixed.removesuffix("\t^").split(" ")
            # a publication's own title is no content of a block, even where a notice stands before it
            if i in head and fixed in titles or stem and own[0] == stem and (len(own) == 3 or fixed in titles):
                headers.add(i)
    body = [i for i in range(len(block.words)) if i not in headers and i not in nums]
    flag = lex.misread.__getitem__
    if not whole and not any(block.cut[i] or any(map(flag, block.words[i])) for i in body):
        return Reading(headers, nums, set(), set(), None, [])
    stream = Stream(block, body)
    cuts, misread = set(), set()
    path = decode(stream.words, lex, stream)
    for arc in path:
        if arc.kind == "cut":
            cuts.add(stream.line[arc.at[0]])
        if arc.confused:
            lines = [stream.line[t] for t in arc.at]
            if len(lines) > 1:
                # the confusion is in the part whose characters differ
                left, right, word = stream.words[arc.at[0]].lower(), stream.words[arc.at[1]].lower(), arc.text.lower()
                lines = lines[1:] if word.startswith(left) else lines[:1] if word.endswith(right) else lines
            misread.update(lines)
    return Reading(headers, nums, cuts, misread, stream, path)


def paragraphs(block: Block, found: Reading) -> list[str]:
    """The page as paragraphs: the reading's words in their lines, boundaries by dynamic programming over line ends.

    A boundary costs less after a short line that ends a sentence and before a capital; two
    boundaries in a row (a paragraph of one line) cost extra; a cut word forbids one.
    """
    body = [i for i in range(len(block.words)) if i not in found.headers and i not in found.numbers and block.plain[i].strip()]
    if not body:
        return []
    stream = found.stream
    text_of: dict[int, str] = {}
    joined: set[int] = set()
    for arc in found.path:
        text_of[arc.at[0]] = arc.text
        for t in arc.at[1:]:
            text_of[t] = ""
        if arc.kind in ("cut", "pair"):
            joined.add(stream.line[arc.at[0]])
    width = max(len(block.plain[i]) for i in body)
    cost: list[float] = []
    for a, b in zip(body, body[1:]):
        t, u = block.plain[a].rstrip(), block.plain[b].lstrip()
        c = 4.0 - 3.0 * (t[-1:] in ".!?:") - 3.0 * (len(t) < 0.8 * width) + 3.0 * u[:1].islower()
        cost.append(math.inf if a in joined or block.cut[a] else c)
    # states: the previous gap was no boundary / was one; a gap left open costs 1
    way: list[list[tuple[float, int]]] = [[(0.0, 0), (math.inf, 0)]]
    for c in cost:
        prev = way[-1]
        open_ = min((prev[0][0] + 1.0, 0), (prev[1][0] + 1.0, 1))
        shut = min((prev[0][0] + c, 0), (prev[1][0] + c + 0.5, 1))
        way.append([open_, shut])
    state = 0 if way[-1][0][0] <= way[-1][1][0] else 1
    bounds = []
    for k in range(len(cost), 0, -1):
        bounds.append(state)
        state = way[k][state][1]
    bounds = [*bounds[::-1], 1]
    place = {}
    for t, i in enumerate(stream.line):
        place.setdefault(i, t)
    out, text = [], ""
    for i, end in zip(body, bounds):
        line, piece, at = block.plain[i].strip(), "", 0
        for k, w in enumerate(block.words[i]):
            spot = line.find(w, at)
            piece += line[at:spot] + text_of.get(place[i] + k, w)
            at = spot + len(w)
        piece += line[at:]
        if block.cut[i] and i not in joined:
            piece += "-"
        piece = piece.strip()
        glue = "" if not text or text.endswith("-") or piece[:1] in (",", ".", ";", ":", ")") else " "
        text = re.sub(r" {2,}", " ", text + glue + piece)
        if end:
            out.append(text.strip())
            text = ""
    return [x for x in out if x]


def blocks(evidence: DataFrame, page_line: DataFrame) -> DataFrame:
    """Both tables in one form: a block's table, source, page, label, title stem, keys and text.

    A page's lines are ordered by line_id, a line delivered twice is one; a line without a
    page is a block of its own, so no group is larger than a page.
    """
    e = evidence.where("text is not null or printed_page is not null").select(
        F.lit("evidence").alias("table_name"), "source_id", F.col("pdf_page").alias("page"), "printed_page", F.lower(F.split("publication_key", "-")[0]).alias("stem"), F.col("evidence_id").alias("key"), F.coalesce("text", F.lit("")).alias("text")
    )
    lines = page_line.where("line_id is not null and text is not null").select("source_id", "pdf_page", F.when(F.col("pdf_page").isNull(), F.col("line_id")).alias("alone"), F.struct("line_id", F.translate("text", "\n", " ").alias("text")).alias("line"))
    p = lines.groupBy("source_id", "pdf_page", "alone").agg(F.sort_array(F.collect_set("line")).alias("lines")).select(
        F.lit("page_line").alias("table_name"), "source_id", F.col("pdf_page").alias("page"), F.lit(None).cast("string").alias("printed_page"), F.lit("").alias("stem"), F.array_join("lines.line_id", "\n").alias("key"), F.array_join("lines.text", "\n").alias("text")
    )
    return spread(e).unionByName(p)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pre-aggregated per task: words ('w'), hyphenated pairs ('p'), title candidates by table and source ('t': all, at an edge)."""
    seen: Counter = Counter()
    pairs: Counter = Counter()
    titles: dict[tuple[str, str], list[int]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for k, n in seen.items():
            words[k.lower()] += n
        rows = [("w", "", k, n, 0) for k, n in words.items()] + [("p", "", k, n, 0) for k, n in pairs.items()] + [("t", s, k, *v) for (s, k), v in titles.items()]
        for at in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 50_000]), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["kind", "source", "key", "n", "good"])
        seen.clear(), pairs.clear(), titles.clear()

    for b in batches:
        for table, source, page, printed, text in zip(*(b.column(i).to_pylist() for i in range(5))):
            lines = text.split("\n")
            plain = text.isascii() and not _MARKED_END(text)
            block = None if plain else Block(lines)
            if plain:
                seen.update(_ASCII_TOKEN.findall(text))
            else:
                for ws in block.words:
                    seen.update(ws)
            if "-" in text:
                for line in lines if plain else block.plain:
                    if "-" in line:
                        for c in _COMPOUND.findall(line):
                            ps = c.lower().split("-")
                            pairs.update(f"{x}-{y}" for x, y in zip(ps, ps[1:]))
            head = None
            for i, line in enumerate(lines if plain else block.plain):
                # what no title can be is told before its words are found
                line = line.rstrip() if plain else line
                if not line or line[-1] in _CLOSED or not (line[0].isupper() or line[0].isdecimal() or not line[0].isalnum()) or not title_form(line):
                    continue
                ws = _ASCII_TOKEN.findall(line) if plain else block.words[i]
                if 1 < len(ws) <= 12 and ws[0][:1].isupper() | ws[0][:1].isdecimal():
                    if head is None:
                        block = block or Block(lines)
                        head = edges(block, page, printed)[0]
                    if key := skeleton(ws):
                        t = titles.setdefault((f"{table}|{source or ''}", key), [0, 0])
                        t[0] += 1
                        t[1] += i in head
        if len(seen) + len(titles) > 400_000:
            yield from flush()
    yield from flush()


_NOISE = pa.schema([("table_name", pa.string()), ("row_key", pa.string()), ("noise_kind", pa.string())])


class Scans:
    """The corpus counts that decoding needs, and the two results made with them."""

    def __init__(self, evidence: DataFrame, page_line: DataFrame, min_pages: int = 3, title_share: float = 0.6, of_most: float = 0.15) -> None:
        """Counts every word and title candidate of the corpus.

        The lexicon holds words of at least SHARE of all words, hence at most 1 / SHARE: this
        bounds what is collected and broadcast at any size. Titles stay distributed, by table and
        source; one counts if it stands at an edge on ``min_pages`` pages, mostly there, and at
        least ``of_most`` times as often as its source's most frequent one.
        """
        self.blocks = blocks(evidence, page_line)
        spark = evidence.sparkSession
        counted = self.blocks.select("table_name", "source_id", "page", "printed_page", "text").where("text <> ''").mapInArrow(_count, "kind string, source string, key string, n long, good long")
        self.counts = checkpointed(counted.groupBy("kind", "source", "key").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).where(f"kind <> 'w' and n >= 2 or n >= {LEAST}"))
        total = {r.kind: r.n for r in self.counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
        least = max(LEAST, math.ceil(SHARE * total.get("w", 0)))
        kept = self.counts.where(f"kind = 'w' and n >= {least}").select("key", "n")
        words = {r.key: r.n for r in kept.toLocalIterator()}
        every = spark.sparkContext.broadcast(words)

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(untrusted(every.value, b.column(0).to_pylist()), pa.string())], names=["key"])

        for r in spread(kept.select("key")).mapInArrow(clean, "key string").toLocalIterator():
            words.pop(r.key)
        pairs = frozenset(r.key for r in self.counts.where(f"kind = 'p' and n >= {max(2, math.ceil(SHARE * total.get('p', 0)))}").select("key").toLocalIterator())
        self.shared = spark.sparkContext.broadcast((words, pairs))
        every.unpersist()
        often = self.counts.where(f"kind = 't' and good >= {min_pages}").where(F.col("good") >= F.col("n") * F.lit(title_share))
        most = often.groupBy("source").agg(F.max("good").alias("most"))
        kept = often.join(most, "source").where(F.col("good") >= F.col("most") * F.lit(of_most))
        self.titles = checkpointed(kept.groupBy("source").agg(F.collect_list("key").alias("titles")))
        self.few = self.titles.count() <= BROADCAST_ROWS

    def _placed(self) -> DataFrame:
        """Blocks with their source's titles; a source has few, so one row of them, broadcast if there are few sources."""
        own = self.blocks.withColumn("source", F.concat_ws("|", "table_name", F.coalesce("source_id", F.lit(""))))
        joined = own.join(F.broadcast(self.titles), "source", "left") if self.few else salted_join(own, self.titles, ["source"], "key", "left")
        return joined.select("table_name", "key", "source_id", "page", "printed_page", "stem", "text", F.array_join(F.coalesce("titles", F.array().cast("array<string>")), "\n").alias("titles"))

    def noise(self) -> DataFrame:
        """(table_name, row_key, noise_kind), each once."""
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lex = Lexicon(*shared.value)
            for b in batches:
                out: list[tuple[str, str, str]] = []
                cols = [b.column(i).to_pylist() for i in range(8)]
                for table, key, _, page, printed, stem, text, titles in zip(*cols):
                    one = table == "evidence"
                    if one and misread_label(printed):
                        out.append((table, key, "printed_page"))
                    if not text:
                        continue
                    block = Block(text.split("\n"))
                    found = readings(block, lex, set(titles.split("\n")) if titles else set(), page, printed, stem or "")[:4]
                    keys = None if one else key.split("\n")
                    for kind, lines in zip(("running_header", "page_number", "hyphen_break", "misread"), found):
                        if lines and one:
                            out.append((table, key, kind))
                        elif lines:
                            out += [(table, keys[i], kind) for i in lines]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(3)], schema=_NOISE)

        return self._placed().mapInArrow(run, "table_name string, row_key string, noise_kind string").distinct()

    def repaired(self) -> DataFrame:
        """(table_name, row_key, source_id, page, label, paragraph_no, text): continuous paragraphs and right page labels.

        row_key is the evidence_id or the page's first line_id. A block without text gives no paragraph.
        """
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lex = Lexicon(*shared.value)
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string())
            for b in batches:
                out = []
                for table, key, source, page, printed, stem, text, titles in zip(*(b.column(i).to_pylist() for i in range(8))):
                    if text:
                        block = Block(text.split("\n"))
                        found = readings(block, lex, set(titles.split("\n")) if titles else set(), page, printed, stem or "", whole=True)
                        for n, p in enumerate(paragraphs(block, found), 1):
                            out.append((table, key.split("\n")[0], source, page, true_label(printed), n, p))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["table_name", "row_key", "source_id", "page", "label", "paragraph_no", "text"])

        placed = self._placed().dropDuplicates(["table_name", "key", "text"])
        return placed.mapInArrow(run, "table_name string, row_key string, source_id string, page int, label string, paragraph_no int, text string")
