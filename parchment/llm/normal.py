"""One consistent form for text that looks the same, by a compiled transducer over grapheme clusters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import permutations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import spread

#: Letters of other scripts and the Latin letters of the same look.
LOOK_ALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "с": "c", "р": "p", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ѵ": "V",
    # Greek
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "Օ": "O", "Ս": "U",
}
#: Other hyphens, line ends, characters without width.
HYPHENS = "‐‑﹣"
LINE_ENDS = ("\r\n", "\r", "\x85", " ", " ")
_WIDTHLESS = [(0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF)]
WIDTHLESS = frozenset(chr(c) for a, b in _WIDTHLESS for c in range(a, b + 1))
#: What a JVM filter may pass over: plain ASCII and line feeds are fixed points of the transducer.
UNPLAIN = r"[^\n\x20-\x7E]"
_CONTROL = re.compile(r"[\x00-\x09\x0b-\x1f\x7f]").search
_JOINING = regex.compile(r"[\p{Arabic}\p{Syriac}\p{Mongolian}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Khmer}\p{Myanmar}]")
_LATIN = regex.compile(r"\p{Latin}")


def families() -> Iterator[tuple[str, str]]:
    """Every rule as (source, target), family by family; one source may be named by several families."""
    yield from ((end, "\n") for end in LINE_ENDS)
    yield from ((c, " ") for c in "\t\x0b\x0c")
    yield from ((c, "-") for c in HYPHENS)
    yield from ((c, "") for c in WIDTHLESS)
    for cp in (*range(0xA0, 0xD800), *range(0xF900, 0x30000)):
        c = chr(cp)
        if unicodedata.category(c) == "Zs":
            yield c, " "
        kind, _, parts = unicodedata.decomposition(c).rpartition("> ")
        text = "".join(chr(int(x, 16)) for x in parts.split()) if kind else ""
        if kind in ("<wide", "<narrow", "<small") or kind == "<font" and 0x1D400 <= cp < 0x1D800 and text.isalnum():
            yield c, unicodedata.normalize("NFC", text)
        elif kind == "<compat" and text.isalpha() and ("LIGATURE" in (name := unicodedata.name(c, "")) or regex.search(r"LETTERS? (?:DZ|LJ|NJ)\b|WITH SMALL LETTER [JZ]", name)) and not _JOINING.match(c):
            yield c, unicodedata.normalize("NFC", text)
        elif not kind and parts and unicodedata.normalize("NFC", c) != c:
            yield c, unicodedata.normalize("NFC", c)


def rules(extra: Iterable[tuple[str, str]] = ()) -> dict[str, str]:
    """The precomputed mapping of single code points (and CR LF) to their consistent form, all families and ``extra`` followed to the end.

    Raises ValueError if two families, followed to the end, disagree about a source or lead
    in a circle. An output holds no input, so that one pass is enough and a second changes
    nothing.
    """
    named: dict[str, set[str]] = {}
    for source, target in (*families(), *extra):
        named.setdefault(source, set()).add(target)
    done: dict[str, str] = {}

    def end(c: str, above: tuple[str, ...] = ()) -> str:
        if c == "\n" or c not in named:
            return c
        if c in above:
            raise ValueError(f"the mapping of {c!r} leads in a circle")
        if c not in done:
            ends = {unicodedata.normalize("NFC", "".join(end(x, (*above, c)) for x in t)) for t in named[c]}
            if len(ends) > 1:
                raise ValueError(f"{c!r} has several mappings: {sorted(ends)}")
            done[c] = ends.pop()
        return done[c]

    table = {c: end(c) for c in named}
    if any(x in table for t in table.values() for x in t if x != "\n"):
        raise ValueError("an output of the mapping is again an input")
    return table


def look_alikes() -> Iterator[tuple[str, str]]:
    """Letters of other scripts, bare or with accents, for the Latin letters of the same look."""
    yield from LOOK_ALIKES.items()
    for cp in (*range(0x370, 0x590), *range(0x1F00, 0x2000)):
        c = chr(cp)
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and base in LOOK_ALIKES and unicodedata.normalize("NFC", c) == c:
            yield c, unicodedata.normalize("NFC", LOOK_ALIKES[base] + "".join(marks))


def compiled(table: dict[str, str]) -> dict:
    """A trie of every source: the table's, and of each composed letter all sequences of letter and accents that mean it, from any source of that letter. A node's output stands under ''."""
    trie: dict = {}

    def add(source: str, target: str) -> None:
        node = trie
        for c in source:
            node = node.setdefault(c, {})
        if node.setdefault("", target) != target:
            raise ValueError(f"two mappings of {source!r}")

    for source, target in table.items():
        if source not in WIDTHLESS:
            add(source, target)
    looks: dict[str, list[str]] = {}
    for source, target in table.items():
        if len(source) == len(target) == 1:
            looks.setdefault(target, []).append(source)
    for cp in (*range(0xC0, 0x2000), *range(0x2190, 0x2300), *range(0x3040, 0x3100)):
        c = chr(cp)
        base, *marks = unicodedata.normalize("NFD", c)
        if not marks or unicodedata.normalize("NFC", c) != c:
            continue
        for some in permutations(marks):
            for n in range(len(some)):
                # the letter with its first n accents composed, the rest separate
                head = unicodedata.normalize("NFC", base + "".join(some[:n]))
                if len(head) == 1 and unicodedata.normalize("NFC", head + "".join(some[n:])) == c:
                    for first in (head, *looks.get(head, ())):
                        add(first + "".join(some[n:]), table.get(c, c))
    return trie


class Transducer:
    """Maps text in one pass of longest matches: emoji sequences (kept), words with anything unplain, other characters.

    A word is a run of letters, marks and characters without width. In it the longest match
    of a compiled trie is taken at each letter: letters with separate accents, width forms,
    joined letters, and, in the trie for words that hold a Latin letter, look-alikes of other
    scripts, with their accents. Characters without width are passed over within a match and
    dropped. Accents that no rule composes come in canonical order. Joiners stay in scripts
    that need them. Words met before are looked up.
    """

    def __init__(self, memo: int = 500_000) -> None:
        self.table, self.memo, self.most = rules(), {}, memo
        self.tries = compiled(self.table), compiled(rules(look_alikes()))
        odd = "".join(regex.escape(c) for c in self.table if len(c) == 1 and not unicodedata.category(c)[0] in "LM" and c not in WIDTHLESS)
        word = r"[[\p{L}\p{M}" + "".join(regex.escape(c) for c in sorted(WIDTHLESS)) + r"]--[A-Za-z]]"
        emoji = r"\p{Extended_Pictographic}(?:\p{EMod}|️)?(?:‍\p{Extended_Pictographic}(?:\p{EMod}|️)?)*"
        self.token = regex.compile(rf"(?V1)(?:{emoji})(*SKIP)(*FAIL)|(?<![A-Za-z])[A-Za-z]*{word}[A-Za-z\p{{L}}\p{{M}}{''.join(regex.escape(c) for c in sorted(WIDTHLESS))}]*|\r\n|[{odd}]")

    def _word(self, token: str) -> str:
        kept = "‌‍" if _JOINING.search(token) else ""
        trie = self.tries[bool(_LATIN.search(token))]
        out, i, n = [], 0, len(token)
        while i < n:
            c = token[i]
            if c in WIDTHLESS and c not in kept:
                i += 1
                continue
            node = trie.get(c)
            text, end, j = (c if node is None else node.get("", c)), i + 1, i + 1
            while node is not None and j < n:
                d = token[j]
                j += 1
                if d in WIDTHLESS and d not in kept:
                    continue
                node = node.get(d)
                if node is not None and "" in node:
                    text, end = node[""], j
            out.append(text)
            i = end
        return unicodedata.normalize("NFC", "".join(out))

    def _one(self, m: regex.Match) -> str:
        token = m.group()
        if (got := self.memo.get(token)) is None:
            got = self.table[token] if token in self.table and not token[0].isalpha() else self._word(token)
            if len(self.memo) >= self.most:
                self.memo.clear()
            if len(token) <= 64:
                self.memo[token] = got
        return got

    def __call__(self, text: str) -> str:
        return text if text.isascii() and not _CONTROL(text) else self.token.sub(self._one, text)


_SHARED: list[Transducer] = []


def transducer() -> Transducer:
    """The process's own transducer, compiled at first use."""
    if not _SHARED:
        _SHARED.append(Transducer())
    return _SHARED[0]


@F.pandas_udf(T.StringType())
def _normal(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    run = transducer()
    for s in parts:
        yield s.map(lambda x: None if x is None else run(x))


def unplain(text: Column) -> Column:
    return text.rlike(UNPLAIN)


def normalized(text: Column) -> Column:
    """The consistent form of a text column; null stays null, and plain text never visits Python."""
    return F.coalesce(_normal(F.when(unplain(text), text)), text)


def variants(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows whose text isn't in the consistent form: (row_key, text, normal_text). Null and empty texts never are."""
    rows = df.select(F.col(f"`{key}`").cast("string").alias("row_key"), F.col(f"`{text}`").alias("text")).where(unplain(F.col("text")))
    return spread(rows).withColumn("normal_text", _normal("text")).where("normal_text <> text")
