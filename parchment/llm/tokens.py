"""Token ids of a corpus by a public byte-level tokenizer, merged over contiguous rank arrays."""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ..session import spread

#: Folder of the vocabulary files, if the caller names none.
FOLDER = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
#: The splitting pattern of byte-level BPE, with white space spelt out.
_S = r"\t-\r \x85\xA0  -     　"
PATTERN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Longest word, in bytes, whose rank array is scanned; longer ones keep a heap of the same ranks.
SHORT = 128
_NONE = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file's tokens with their ranks, which are their ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: boundaries and ranks of adjacent parts lie side by side; the least is merged until none is left."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    cut = list(range(len(word) + 1))
    rank = [ranks.get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while rank and (least := min(rank)) != _NONE:
        i = rank.index(least)
        del cut[i + 1], rank[i]
        if i < len(rank):
            rank[i] = ranks.get(word[cut[i] : cut[i + 2]], _NONE)
        if i:
            rank[i - 1] = ranks.get(word[cut[i - 1] : cut[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(cut, cut[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a long word: (rank, place) pairs in a heap, boundaries in a linked list."""
    n = len(word)
    end, back, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    get = lambda i: ranks.get(word[i : end[end[i]]]) if end[i] < n else None
    now = [get(i) for i in range(n)]
    heap = [(r, i) for i, r in enumerate(now) if r is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if not alive[i] or now[i] != r:
            continue
        j = end[i]
        end[i], alive[j] = end[j], False
        if end[i] < n:
            back[end[i]] = i
        for k in (i, back[i]):
            if k >= 0:
                now[k] = get(k)
                if now[k] is not None:
                    heapq.heappush(heap, (now[k], k))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Encoder(dict):
    """Ids by word: a word met for the first time is merged, then kept."""

    def __init__(self, ranks: dict[bytes, int], most: int = 400_000) -> None:
        super().__init__()
        self.ranks, self.most = ranks, most
        self.words, self.plain = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall

    def __missing__(self, word: str) -> list[int]:
        data = word.encode("utf-8", "replace")
        ids = merge_short(data, self.ranks) if len(data) <= SHORT else merge_long(data, self.ranks)
        if len(data) <= SHORT:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for w in (self.plain if text.isascii() else self.words)(text):
            out += self[w]
        return out


def decode(ids: list[int], ranks: dict[bytes, int]) -> str:
    back = {i: b for b, i in ranks.items()}
    return b"".join(back[i] for i in ids).decode("utf-8", "replace")


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids array<int>) of each row, without special tokens, whose strings are ordinary text.

    An empty and a null text give an empty list. The vocabulary (a fixed 50,256 entries, under
    1 MB) is read once on the driver and broadcast. No shuffle: each Arrow batch is encoded
    where it is read; repeated rows come out as often as they came.
    """
    ranks = read_ranks(os.path.join(folder or FOLDER, f"{vocabulary}.tiktoken"))
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                lists = [enc.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "ids"])

    return spread(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))).mapInArrow(run, f"key {kind.simpleString()}, ids array<int>").withColumnRenamed("key", key)
