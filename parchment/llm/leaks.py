"""Evaluation passages in a training corpus: CGK embedding, bit-sampling LSH, exact verification of edits.

Windows of an item as long as the passages looked for, and windows of every document of that
length and up to the allowed edits more or less, are embedded by shared random walks (CGK):
windows few edits apart become strings that differ in few places. Each repetition samples some
places; windows that agree there are candidates, and each is verified by its edit distance.
Repetitions are as many as the target recall needs. A count filter goes before: k edits
change at most 2k neighbouring pairs of words, so a document's window with more pairs that no
item holds can't be near one, and is left out without loss.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import BROADCAST_ROWS, checkpointed, salted_join, spread
from .normal import transducer

#: Words are runs of letters or digits.
_WORDS = re.compile(r"[^\W_]+").findall
_PLAIN = re.compile(r"[a-z0-9]+").findall
#: Windows of items that one broadcast holds; the windows of more items meet the documents' in a shuffle join.
BLOCK = 200_000
#: Bits of the broadcast filter of items' word pairs: 32 a pair up to this bound (16 MB), beyond which it only lets more through.
FILTER_BITS = 2**27
_PAD = np.uint64(0)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[str]:
    """Lower-case words of a text in its consistent form."""
    if not text:
        return []
    return _PLAIN(text.lower()) if text.isascii() else _WORDS(transducer()(text).lower())


class WordHash(dict):
    def __missing__(self, w: str) -> int:
        h = xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) | 1
        if len(self) < 1_000_000:
            self[w] = h
        return h


class Walk:
    """One repetition: a shared random walk (CGK) over windows of about ``size`` words, of which ``bits`` places are sampled.

    At step j the walk copies the symbol it stands on and moves on if the j-th random
    function of that symbol says so; two windows few edits apart soon walk in step again,
    so their walks differ in few places. The sampled places are hashed to one key.
    """

    def __init__(self, size: int, bits: int, seed: int) -> None:
        r = random.Random(seed)
        self.size, self.steps = size, 2 * size
        self.mult = [np.uint64(r.getrandbits(64) | 1) for _ in range(self.steps)]
        self.places = sorted(r.sample(range(self.steps), min(bits, self.steps)))
        self.mix = np.uint64(r.getrandbits(64) | 1)

    def keys(self, symbols: np.ndarray, starts: np.ndarray, length: int | None = None) -> np.ndarray:
        """The keys of the windows of ``symbols`` that begin at ``starts``, of ``size`` words or of another ``length``."""
        length = self.size if length is None else length
        padded = np.concatenate([symbols, np.full(length + 1, _PAD, np.uint64)])
        at, key = starts.astype(np.int64).copy(), np.zeros(len(starts), np.uint64)
        end = at + length
        sampled, last = set(self.places), self.places[-1]
        with np.errstate(over="ignore"):
            for j in range(last + 1):
                now = padded[at]
                now[at >= end] = _PAD
                if j in sampled:
                    key = (key ^ now) * self.mix
                    key ^= key >> np.uint64(29)
                if j < last:
                    at = np.minimum(at + ((now * self.mult[j]) >> np.uint64(63)).astype(np.int64), end)
        return key


def edited(words: list, kind: str, at: list[int], new: list) -> list:
    """``words`` with one word inserted, dropped or changed at each place of ``at``, from the last to the first."""
    out = [*words]
    for i, w in zip(sorted(at, reverse=True), new):
        out[i : i + (kind != "insert")] = [] if kind == "drop" else [w]
    return out


@lru_cache
def meeting(size: int, bits: int, max_edits: int) -> float:
    """The measured probability that a window and its copy with ``max_edits`` inner edits get one key in a walk; the least over kinds of edit."""
    r, got = random.Random(3), []
    for kind in ("insert", "drop", "change"):
        meets = 0
        for t in range(40):
            walk, pairs = Walk(size, bits, 1000 + t), []
            for _ in range(40):
                w = [r.getrandbits(64) | 1 for _ in range(size)]
                v = edited(w, kind, r.sample(range(1, size - 1), max_edits), [r.getrandbits(64) | 1 for _ in range(max_edits)])
                pairs.append((w, v))
            a, b = (np.array([x for p in pairs for x in p[i]], np.uint64) for i in (0, 1))
            n = len(pairs[0][1])
            meets += int((walk.keys(a, np.arange(len(pairs)) * size) == walk.keys(b, np.arange(len(pairs)) * n, n)).sum())
        got.append(meets / 1600)
    return min(got)


def repetitions(size: int, bits: int, max_edits: int, recall: float) -> int:
    """Walks needed so that a window ``max_edits`` edits away meets in one of them with probability ``recall``. Equal windows meet in every walk."""
    if not max_edits:
        return 1
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - max(1e-3, meeting(size, bits, max_edits)))))


def edits(a: list, b: list, most: int) -> int:
    """Edit distance of two word lists, given up beyond ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return most + 1
        row = new
    return row[-1]


def _pairs(sym: np.ndarray, mask: int) -> np.ndarray:
    """For each place the filter's slot of the word there and the next one."""
    with np.errstate(over="ignore"):
        x = sym[:-1] * _A + sym[1:]
        x = (x ^ (x >> np.uint64(31))) * _B
    return (x >> np.uint64(20)).astype(np.int64) & mask


class Finder:
    """What both ways share: the walks, the filter, and a batch's windows that pass it."""

    def __init__(self, size: int, max_edits: int, walks: list[Walk], bitmap: np.ndarray) -> None:
        self.size, self.most, self.walks, self.bitmap, self.hashes = size, max_edits, walks, bitmap, WordHash()
        self.lengths = range(max(1, size - max_edits), size + max_edits + 1)

    def windows(self, texts: list[str | None]) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
        """(word hashes of all texts in a row, (length, text's index, start) of the windows that may be near an item)."""
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        sym = np.fromiter((self.hashes[w] for t in words for w in t), np.uint64, int(first[-1]))
        if len(sym) < self.lengths[0]:
            return sym, []
        slots = _pairs(sym, len(self.bitmap) * 8 - 1)
        good = np.concatenate([[0], np.cumsum((self.bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1, dtype=np.int64)])
        which = np.repeat(np.arange(len(sizes)), sizes)
        out = []
        for n in self.lengths:
            starts = np.arange(len(sym) - n + 1)
            kept = starts[(good[starts + n - 1] - good[starts] >= self.size - 1 - 2 * self.most) & (which[starts] == which[starts + n - 1])]
            out.append((n, which[kept], kept))
        return sym, out


def distances(own: np.ndarray, theirs: np.ndarray, most: int) -> np.ndarray:
    """Edit distances of pairs of word-hash windows (a row each), ``most`` + 1 for more; all pairs at once, over the band of diagonals that ``most`` edits reach."""
    n, m, none = own.shape[1], theirs.shape[1], most + 1
    if not most:
        return np.where((own == theirs).all(axis=1), 0, none) if n == m else np.full(len(own), none)
    band = [np.full(len(own), d - most if d >= most else none) for d in range(2 * most + 1)]
    for i in range(1, n + 1):
        new: list[np.ndarray] = []
        for d in range(2 * most + 1):
            j = i + d - most
            if j < 0 or j > m:
                new.append(np.full(len(own), none))
                continue
            best = np.full(len(own), i) if j == 0 else band[d] + (own[:, i - 1] != theirs[:, j - 1])
            if d < 2 * most:
                best = np.minimum(best, band[d + 1] + 1)
            if d and j:
                best = np.minimum(best, new[-1] + 1)
            new.append(best)
        band = new
    return np.minimum(band[m - n + most], none) if abs(m - n) <= most else np.full(len(own), none)


def item_words(items: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """(item, words): word hashes of the items of at least ``size`` words."""
    kind = items.schema[item].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            words = [[hashes[w] - 2**63 for w in words_of(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.int64()))], names=["item", "words"])

    rows = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text")).where("item is not null and text is not null").distinct()
    return rows.mapInArrow(run, f"item {kind}, words array<long>").where(F.size("words") >= size)


def _symbols(words: list) -> np.ndarray:
    return (np.array(words, np.int64).astype(np.uint64) + np.uint64(2**63)) if len(words) else np.zeros(0, np.uint64)


def pair_filter(words: DataFrame, pairs: int) -> np.ndarray:
    """Bits of the items' word pairs, OR-ed on the executors; at most FILTER_BITS / 64 rows come back."""
    size = 1024
    while size < min(FILTER_BITS, 32 * pairs):
        size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots = np.unique(np.concatenate([np.zeros(0, np.int64), *[_pairs(_symbols(w), size - 1) for w in b.column(0).to_pylist()]]))
            yield pa.RecordBatch.from_arrays([pa.array(slots >> 3, pa.int64()), pa.array(np.int64(1) << (slots & 7), pa.int64())], names=["at", "bits"])

    bitmap = np.zeros(size // 8, np.uint8)
    got = words.select("words").mapInArrow(run, "at long, bits long").groupBy(F.shiftright("at", 3).alias("at"), (F.col("at") % 8).alias("byte")).agg(F.bit_or("bits").alias("bits"))
    for r in got.toLocalIterator():
        bitmap[r.at * 8 + r.byte] = r.bits
    return bitmap


def leaks(docs: DataFrame, items: DataFrame, doc: str, item: str, text: str = "text", size: int = 12, max_edits: int = 1, recall: float = 0.98, bits: int = 4, seed: int = 7) -> DataFrame:
    """(doc, item, edits): documents that hold a passage of ``size`` consecutive words of an item, within ``max_edits`` edits; edits is the fewest met.

    A word may be inserted, dropped or changed. Every window of every item and of every
    document, whole texts, is compared as the module says, in one pass over the documents. A
    passage within the edits is found with probability ``recall`` or more; an unchanged one
    always, as equal windows meet in every walk. Items of fewer words than ``size``, null and
    empty texts leak nothing; rows repeated on either side give one result row. Items' windows
    are broadcast up to BLOCK; beyond, document windows that pass the filter are shuffled to
    them by key, hot keys salted, with the same result.
    """
    walks = [Walk(size, bits, seed + t) for t in range(repetitions(size, bits, max_edits, recall))]
    spark = docs.sparkSession
    words = checkpointed(item_words(items, item, text, size))
    held = words.agg(F.sum(F.size("words") - size + 1).alias("w"), F.sum(F.size("words")).alias("p")).first()
    finder = Finder(size, max_edits, walks, pair_filter(words, held.p or 0))
    own = spread(docs.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text")).where("doc is not null and text is not null"))
    found = _by_broadcast(own, words, finder) if (held.w or 0) <= BLOCK else _by_shuffle(own, words, finder)
    return found.groupBy("doc", "item").agg(F.min("edits").alias("edits"))


def _by_broadcast(docs: DataFrame, words: DataFrame, finder: Finder) -> DataFrame:
    size, most = finder.size, finder.most
    owners: dict[bytes, set] = {}
    for r in words.toLocalIterator():
        sym = _symbols(r.words)
        for w in np.lib.stride_tricks.sliding_window_view(sym, size):
            owners.setdefault(w.tobytes(), set()).add(r.item)
    flat = np.frombuffer(b"".join(owners), np.uint64).copy() if owners else np.zeros(0, np.uint64)
    ranked = []
    for w in finder.walks:
        k = w.keys(flat, np.arange(len(owners)) * size)
        o = np.argsort(k, kind="stable")
        ranked.append((k[o], o))
    shared = docs.sparkSession.sparkContext.broadcast((finder, flat.reshape(-1, size), [sorted(x, key=str) for x in owners.values()], ranked))
    kind = words.schema["item"].dataType.simpleString()
    arrow = pa.array([], pa.int64()).type if kind in ("bigint", "long") else pa.int32() if kind == "int" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, theirs, owner, ranked = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                sym, windows = finder.windows(part.column(1).to_pylist())
                best: dict[tuple[int, object], int] = {}
                for n, which, starts in windows:
                    met = []
                    for walk, (keys, order) in zip(finder.walks, ranked):
                        k = walk.keys(sym, starts, n)
                        lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
                        x = np.repeat(np.arange(len(k)), hi - lo)
                        within = np.arange(len(x)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
                        met.append(x * len(theirs) + order[lo[x] + within])
                    pairs = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
                    x, k = pairs // max(1, len(theirs)), pairs % max(1, len(theirs))
                    for d, k, e in zip(which[x].tolist(), k.tolist(), distances(sym[starts[x][:, None] + np.arange(n)], theirs[k], most).tolist()):
                        if e <= most:
                            for i in owner[k]:
                                best[d, i] = min(e, best.get((d, i), e))
                ids = part.column(0)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([d for d, _ in best], pa.int64())), pa.array([i for _, i in best], arrow), pa.array(list(best.values()), pa.int32())], names=["doc", "item", "edits"])

    return docs.mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, item {kind}, edits int")


def _by_shuffle(docs: DataFrame, words: DataFrame, finder: Finder) -> DataFrame:
    size, most, walks = finder.size, finder.most, finder.walks
    shared = docs.sparkSession.sparkContext.broadcast(finder)
    signed = lambda x: x.view(np.int64)

    def keyed(sym: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Each window's key of each walk (the walk mixed in), and its words."""
        with np.errstate(over="ignore"):
            return np.concatenate([w.keys(sym, starts, n) + _A * np.uint64(t) for t, w in enumerate(walks)]), np.tile(signed(sym[starts[:, None] + np.arange(n)]), (len(walks), 1))

    def lists(x: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, ws in enumerate(b.column(1).to_pylist()):
                sym = _symbols(ws)
                k, w = keyed(sym, np.arange(len(sym) - size + 1), size)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(k), pa.int64())), pa.array(signed(k)), lists(w)], names=["item", "key", "theirs"])

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                sym, windows = finder.windows(part.column(1).to_pylist())
                for n, which, starts in windows:
                    if len(starts):
                        k, w = keyed(sym, starts, n)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.tile(which, len(walks)))), pa.array(signed(k)), lists(w)], names=["doc", "key", "own"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, theirs = b.column(2), b.column(3).flatten().to_numpy().reshape(-1, size)
            sizes = np.diff(own.offsets.to_numpy())
            e = np.full(b.num_rows, most + 1)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                e[at] = distances(own.take(pa.array(at)).flatten().to_numpy().reshape(-1, n), theirs[at], most)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(e, pa.int32())], names=["doc", "item", "edits"]).filter(pa.array(e <= most))

    doc_kind, kind = docs.schema["doc"].dataType.simpleString(), words.schema["item"].dataType.simpleString()
    theirs = words.mapInArrow(of_items, f"item {kind}, key long, theirs array<long>").distinct()
    own = docs.mapInArrow(of_docs, f"doc {doc_kind}, key long, own array<long>").distinct()
    met = salted_join(own, theirs, ["key"], "doc")
    return met.select("doc", "item", "own", "theirs").distinct().mapInArrow(verify, f"doc {doc_kind}, item {kind}, edits int")
