import base64
import os
import random

import pytest
from tokenizers import Tokenizer

from parchment.llm import tokens

RANKS = tokens.read_ranks(os.path.join(tokens.FOLDER, "byte_bpe_50k.tiktoken"))
TEXTS = ["", "Hello  world\n\n\tx", "<|endoftext|> I'll we've 'S", "日本語" * 60, "a" * 3000, "🧱🔥 x　y \x85z\x1cq", " 12 345abc'd", "x" * 129, "\r\n \r\n", "naïve café ½ m²", "  a"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(os.path.join(tokens.FOLDER, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_like_the_public_library(reference):
    enc = tokens.Encoder(RANKS)
    r = random.Random(8)
    made = ["".join(r.choice("ab1 \n'é日.\t-_sdt🔥 ") for _ in range(r.randrange(60))) for _ in range(400)]
    for x in TEXTS + made:
        assert enc.encode(x) == reference(x), x
        assert tokens.decode(enc.encode(x), RANKS) == x


def test_short_and_long_merge_agree():
    r = random.Random(1)
    for n in (1, 2, 3, 40, 200):
        w = bytes(r.choice(b"abcde th") for _ in range(n))
        assert tokens.merge_short(w, RANKS) == tokens.merge_long(w, RANKS)


def test_column(spark, reference):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(TEXTS)] + [(99, None, "", ""), (0, "", "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, key string")
    got = [(r.doc_id, r.ids) for r in tokens.encode_corpus(df, "doc_id", "text").collect()]
    assert len(got) == len(rows) and all(ids == (reference(TEXTS[i]) if i < 99 else []) for i, ids in got)
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]


def test_other_vocabulary_file(tmp_path, spark):
    (tmp_path / "own.tiktoken").write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)))
    df = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    assert tokens.encode_corpus(df, "doc_id", "text", "own", str(tmp_path)).first().ids == [97, 98]
