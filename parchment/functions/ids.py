"""Deterministic identities: SHA-256 over text and over canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def text_sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def json_text(c: Column) -> Column:
    """A string as a JSON literal; null as null. Quotes, backslashes and control characters are escaped."""
    body = c
    for raw, esc in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(esc))
    return F.when(c.isNull(), "null").otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def canonical_object(**parts: Column) -> Column:
    """Compact JSON of already rendered members, keys in order."""
    out: list[Column] = [F.lit("{")]
    for n, k in enumerate(sorted(parts)):
        out += [F.lit(("," if n else "") + f'"{k}":'), parts[k]]
    return F.concat(*out, F.lit("}"))


def number_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def stable_id(prefix: str, **parts: Column) -> Column:
    """``prefix`` and the digest of the canonical object: it depends on the named members only."""
    return F.concat(F.lit(prefix), text_sha256(canonical_object(**parts)))


def short_id(kind: str, key: Column, length: int = 24) -> Column:
    """``kind:`` and the first hex digits of the digest of kind and key."""
    return F.concat(F.lit(f"{kind}:"), F.substring(text_sha256(F.concat(F.lit(f"{kind}|"), key)), 1, length))


def evidence_id(source_sha: Column, page: Column, block: Column, bbox: Column) -> Column:
    """Identity of a block by where it stands, not by its text; coordinates to three places."""
    box = F.when(bbox.isNull(), "null").otherwise(F.concat(F.lit("["), F.array_join(F.transform(bbox, lambda x: F.format_string("%.3f", x)), ","), F.lit("]")))
    return stable_id("evidence:sha256:", bbox=box, block_index=number_text(block), pdf_page=number_text(page), source_sha256=json_text(source_sha))
