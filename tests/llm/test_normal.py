import itertools
import unicodedata

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from parchment.llm import normal

CASES = {
    "ｃｏｎｃｅａｌ， １０．３": "conceal, 10.3",
    "café piñón": "café piñón",
    "re­adi​ng": "reading",
    "a b c　d\te": "a b c d e",
    "coeﬃcient ﬁrst ﬀ": "coefficient first ff",
    "out‑of‐plane": "out-of-plane",
    "thе shаll Ѕection": "the shall Section",
    "one\r\ntwo\rthree": "one\ntwo\nthree",
    "e​́tat": "état",
    "crѐche": "crèche",
}
CONTENT = ["", "château § 4 © ° ±3 m² ½ – — “x” …", "μονάδα Нормы", "the ratio Ω, the angle φ", "¬", "第3章 🧱🔥 → ✓", "a\nb", "👩‍🔧 ok", "می‌خواهم"]


def test_cases():
    t = normal.Transducer()
    for a, b in CASES.items():
        assert t(a) == b and t(b) == b
    for c in CONTENT:
        assert t(c) == c


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aeо́​­Ａ ﬁ‐\r\n")), max_size=30))
def test_idempotent(text):
    t = normal.transducer()
    once = t(text)
    assert t(once) == once


def test_rules_have_no_conflict():
    table = normal.rules()
    assert not any(x in table for v in table.values() for x in v if x != "\n")
    assert all(unicodedata.normalize("NFC", v) == v for v in table.values())


@pytest.mark.parametrize("extra", [[("﹣", "~")], [(" ", " ")], [(" ", "_")], [("а", "b"), ("а", "a")]])
def test_conflicts_are_raised(extra):
    with pytest.raises(ValueError):
        normal.rules(extra)


def test_all_spellings_of_a_letter():
    """Composed, separate, parted by a character without width, in full width and as look-alikes with accents: one form."""
    t = normal.Transducer()
    for c in "éÅấộǖñ":
        marks = unicodedata.normalize("NFD", c)
        for order in itertools.permutations(marks[1:]):
            if unicodedata.normalize("NFC", marks[0] + "".join(order)) == c:
                for base in (marks[0], chr(ord(marks[0]) + 0xFEE0)):
                    assert t("x" + base + "".join(order) + "x") == t("x" + base + "​".join(order) + "​x") == f"x{c}x"
    assert t("ёlan") == t("ёlan") == "ëlan" and t("ёлка") == "ёлка" and t("𝐊𝐞𝐲") == "Key"


def test_column(spark):
    df = spark.createDataFrame([("a", "the"), ("b", "thе"), ("c", None), ("d", ""), ("b", "thе"), ("e", "x" * 200_000 + "​")], "id string, text string")
    got = {r.id: r.t for r in df.select("id", normal.normalized(F.col("text")).alias("t")).collect()}
    assert (got["a"], got["b"], got["c"], got["d"], len(got["e"])) == ("the", "the", None, "", 200_000)
    assert {r.row_key for r in normal.variants(df, "id", "text").collect()} == {"b", "e"}
    assert normal.variants(df.limit(0), "id", "text").count() == 0
