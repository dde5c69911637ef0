"""Evidence rows: one delivery each, lines, lexical and structural search, context, grounding."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.ids import text_sha256


def current(df: DataFrame, key: str = "evidence_id", at: str = "loaded_at") -> DataFrame:
    """One row a key: the first delivery."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(at)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def lines(df: DataFrame, key: str = "evidence_id", text: str = "text") -> DataFrame:
    """(key, line_no from 1, line, text_sha256); a null text has no lines, an empty one a single empty line."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).select(key, (F.col("pos") + 1).alias("line_no"), "line", text_sha256(F.col("line")).alias("text_sha256"))


def occurrences(text: Column, needle: str) -> Column:
    """How often ``needle`` stands in ``text`` without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("int")


_ORDER = ("source_id", "pdf_page", "block_index", "evidence_id")


def in_source_order(df: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` in physical order, not by rank; ``limit`` is the search's own parameter. Without one nothing is sorted: the order of all hits is left to whoever writes them."""
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in _ORDER]).limit(limit) if limit else df


def _hits(df: DataFrame, score: Column, method: str, limit: int | None) -> DataFrame:
    return in_source_order(df.select(*_ORDER, score.cast("double").alias("score"), F.lit(method).alias("score_method")), limit)


def search_exact(df: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    q = query.strip()
    return _hits(df.where(F.col("text").contains(q)), occurrences(F.col("text"), q), "literal_occurrence_count", limit)


def search_phrase(df: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Case is set aside by lower(), which keeps letters such as 'ß'."""
    q = query.strip().lower()
    low = F.lower("text")
    return _hits(df.where(low.contains(q)), occurrences(low, q), "casefold_phrase_occurrence_count", limit)


def search_tokens(df: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """All tokens as substrings; the score is their mean count."""
    tokens = re.findall(r"\w+", query.lower())
    low = F.lower("text")
    found = df
    total: Column = F.lit(0)
    for t in tokens:
        found = found.where(low.contains(t))
        total = total + occurrences(low, t)
    return _hits(found, total / F.lit(len(tokens)), "token_coverage_fallback", limit)


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _statistics(df: DataFrame, text: str, tokens: Sequence[str]) -> dict[str, float]:
    """One row: texts, words, and per query token the texts that hold it. Constant in size, so the driver may hold it."""
    t = df.select(_terms(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    row = t.agg(F.count("*").alias("n"), F.sum(F.size("t")).alias("words"), *[F.count_if(F.array_contains("t", x)).alias(f"df_{i}") for i, x in enumerate(tokens)]).first()
    return {"n": row.n, "avg": (row.words or 0) / max(1, row.n)} | {x: row[f"df_{i}"] for i, x in enumerate(tokens)}


def _frequency(token: str) -> Column:
    return F.size(F.filter("t", lambda x: x == token))


def search_ranked(df: DataFrame, query: str, key: str, text: str = "text", k1: float = 1.4, b: float = 0.75, phrase_bonus: float = 8.0) -> DataFrame:
    """(key, score): BM25 with a bonus where the whole query stands as a phrase. A token repeated in the query counts repeatedly.

    Statistics come from all texts in one pass; a second scores each text on its own, with no
    shuffle. Only rows with a positive score are returned.
    """
    tokens = re.findall(r"[a-z0-9]+", query.lower())
    distinct = list(dict.fromkeys(tokens))
    s = _statistics(df, text, distinct)
    rows = df.select(key, _terms(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    score: Column = F.lit(0.0)
    for tok in tokens:
        f = _frequency(tok)
        idf = F.log(F.lit(1.0 + (s["n"] - s[tok] + 0.5) / (s[tok] + 0.5)))
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.size("t") / F.lit(max(s["avg"], 1e-9))))
    phrase = F.concat(F.lit(" "), F.array_join("t", " "), F.lit(" "))
    score = score + F.when(phrase.contains(" ".join(tokens)), F.lit(phrase_bonus)).otherwise(0.0)
    return rows.withColumn("score", F.round(score, 6)).where("score > 0").select(key, "score")


def postings(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(term, key, tf, length): an index built once, so that a search reads only its own terms' rows. Term '' has a row for each text, with its length."""
    t = df.select(key, _terms(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    words = t.select(key, F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("term", key, "length").agg(F.count("*").alias("tf"))
    return words.select("term", key, "tf", "length").unionByName(t.select(F.lit("").alias("term"), key, F.lit(0).cast("long").alias("tf"), F.size("t").alias("length")))


def write_postings(index: DataFrame, path: str, parts: int = 256) -> None:
    """The index as Parquet, in folders by the term's hash and sorted by term, so a term is one folder and few row groups."""
    part = F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")
    index.withColumn("part", part).repartition("part", F.pmod(F.xxhash64(*index.columns[1:2]), F.lit(8))).sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(path)


def read_postings(spark: SparkSession, path: str, query: str, parts: int = 256) -> DataFrame:
    """The rows of an index that a query needs: the folders of its terms, and of the lengths."""
    terms = ["", *dict.fromkeys(re.findall(r"[a-z0-9]+", query.lower()))]
    folders = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")).collect()]
    return spark.read.parquet(path).where(F.col("part").isin(*folders) & F.col("term").isin(*terms)).drop("part")


def search_postings(index: DataFrame, query: str, key: str, k1: float = 1.4, b: float = 0.75) -> DataFrame:
    """(key, score): BM25 from an index alone, without a phrase bonus; only the query's terms are shuffled."""
    tokens = re.findall(r"[a-z0-9]+", query.lower())
    own = index.where(F.col("term").isin("", *tokens))
    seen = {r.term: r for r in own.groupBy("term").agg(F.count("*").alias("n"), F.avg("length").alias("avg")).collect()}
    n, avg = (seen[""].n, max(seen[""].avg, 1e-9)) if "" in seen else (0, 1.0)
    weight = F.lit(0.0)
    for t in dict.fromkeys(tokens):
        df = seen[t].n if t in seen else 0
        weight = F.when(F.col("term") == t, F.lit(tokens.count(t) * math.log(1.0 + (n - df + 0.5) / (df + 0.5)))).otherwise(weight)
    score = weight * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(avg)))
    return own.where("term <> ''").groupBy(key).agg(F.round(F.sum(score), 6).alias("score")).where("score > 0")


def search_all_tokens_ranked(df: DataFrame, query: str, limit: int | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Rows that hold every token, scored by the classic BM25 whose idf isn't below 1e-6, in source order."""
    tokens = list(dict.fromkeys(re.findall(r"[a-z0-9]+", query.lower())))
    s = _statistics(df, "text", tokens)
    rows = df.where("text is not null").withColumn("t", _terms(F.col("text")))
    score: Column = F.lit(0.0)
    for tok in tokens:
        rows = rows.where(F.array_contains("t", tok))
        f = _frequency(tok)
        idf = F.greatest(F.log(F.lit((s["n"] - s[tok] + 0.5) / (s[tok] + 0.5))), F.lit(1e-6))
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.size("t") / F.lit(s["avg"])))
    return _hits(rows, F.round(F.greatest(score, F.lit(0.0)), 6), "bm25", limit)


def with_context(df: DataFrame, before: int = 1, after: int = 1, page_local: bool = False, pages: int = 64) -> DataFrame:
    """Each row with the keys of its neighbours in source order, itself included.

    The order runs within a page, or over the pages of one source. A source is cut into cells
    of ``pages`` pages, each sorted on its own; a row near a cell's edge takes the missing
    neighbours from the ends of the next ``before`` or ``after`` cells, none of which is
    empty. So no source is sorted in one task. Rows without a page stand first, in cells of
    64 block numbers. Of a cell only the ends are gathered.
    """
    missing = F.floor(F.coalesce("block_index", F.lit(-1)) / 64) - F.lit(1 << 40)
    part = ["source_id", "pdf_page"] if page_local else ["source_id", "_cell"]
    d = df.select("evidence_id", "source_id", "pdf_page", "block_index").withColumn("_cell", F.coalesce(F.floor(F.col("pdf_page") / pages), missing))
    w = Window.partitionBy(*part).orderBy("pdf_page", "block_index", "evidence_id")
    own = F.collect_list("evidence_id").over(w.rowsBetween(-before, after))
    if page_local:
        return d.select("evidence_id", "source_id", "pdf_page", "block_index", F.array_join(own, ",").alias("context"))
    up = Window.partitionBy(*part).orderBy(F.col("pdf_page").desc(), F.col("block_index").desc(), F.col("evidence_id").desc())
    d = d.withColumn("_r", F.row_number().over(w)).withColumn("_u", F.row_number().over(up))
    some = lambda n, c: F.transform(F.sort_array(F.collect_list(F.when(F.col(c) <= max(1, n), F.struct("_r", "evidence_id")))), lambda x: x["evidence_id"])
    ends = d.groupBy("source_id", "_cell").agg(F.count("*").alias("_n"), some(before, "_u").alias("_tail"), some(after, "_r").alias("_head"))
    c = Window.partitionBy("source_id").orderBy("_cell")
    ends = ends.withColumn("_prev", F.flatten(F.collect_list("_tail").over(c.rowsBetween(-before, -1))) if before else F.array().cast("array<string>")).withColumn("_next", F.flatten(F.collect_list("_head").over(c.rowsBetween(1, after))) if after else F.array().cast("array<string>"))
    j = d.withColumn("_own", own).alias("l").join(ends.alias("r"), F.col("l.source_id").eqNullSafe(F.col("r.source_id")) & (F.col("l._cell") == F.col("r._cell"))).select("l.*", "r._n", "r._prev", "r._next")
    lack_b, lack_a = F.greatest(F.lit(before) - (F.col("_r") - 1), F.lit(0)), F.greatest(F.lit(after) - (F.col("_n") - F.col("_r")), F.lit(0))
    take_b = F.least(lack_b, F.size("_prev"))
    left = F.when(take_b > 0, F.slice("_prev", F.size("_prev") - take_b + 1, take_b)).otherwise(F.array().cast("array<string>"))
    right = F.when(lack_a > 0, F.slice("_next", F.lit(1), lack_a)).otherwise(F.array().cast("array<string>"))
    return j.select("evidence_id", "source_id", "pdf_page", "block_index", F.array_join(F.concat(left, "_own", right), ",").alias("context"))


def page_rows(df: DataFrame, source: str, page: int) -> DataFrame:
    return in_source_order(df.where((F.col("source_id") == source) & (F.col("pdf_page") == page)), None)


def structural(df: DataFrame, width: float = 595.0, height: float = 842.0) -> DataFrame:
    """Layout fractions and flags: heading (short, large type or mostly capitals), table, figure, equation, exception."""
    t = F.trim("text")
    low = F.lower(t)
    size = F.expr("try_cast(observed_metadata['font_size'] as double)")
    body = F.expr("try_cast(observed_metadata['body_font_size'] as double)")
    letters = F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    upper = F.length(F.regexp_replace(t, "[^A-Z]", ""))
    short = (F.length(t) > 0) & (F.length(t) <= 120) & (F.regexp_count(t, F.lit("\n")) <= 1)
    heading = short & (F.coalesce(size / body >= 1.15, F.lit(False)) | ((letters > 0) & (upper >= 0.8 * letters)))
    fraction = lambda v, of: F.round(v / F.lit(of), 6)
    at = lambda i: F.get("bbox", F.lit(i))
    return df.select(
        "evidence_id", "source_id", "pdf_page", "block_index",
        fraction(at(0), width).alias("x_fraction"), fraction(at(1), height).alias("y_fraction"), fraction(at(2) - at(0), width).alias("width_fraction"), fraction(at(3) - at(1), height).alias("height_fraction"),
        size.alias("font_size"), F.coalesce(heading, F.lit(False)).alias("heading"),
        *[F.coalesce(low.startswith(k), F.lit(False)).alias(k) for k in ("table", "figure", "equation", "exception")],
    )


def structural_search(df: DataFrame, query: str, first_page: int | None = None, last_page: int | None = None, flag: str | None = None, min_font: float | None = None, max_font: float | None = None) -> DataFrame:
    """Phrase search among rows that pass the filters; a missing value fails a bound set on it."""
    s = structural(df)
    ok: Column = F.lit(True)
    for c, op in ((F.col("pdf_page") >= first_page if first_page is not None else None, 0), (F.col("pdf_page") <= last_page if last_page is not None else None, 0), (F.col(flag) if flag else None, 0), (F.col("font_size") >= min_font if min_font is not None else None, 0), (F.col("font_size") <= max_font if max_font is not None else None, 0)):
        if c is not None:
            ok = ok & F.coalesce(c, F.lit(False))
    return search_phrase(df.join(s.where(ok).select("evidence_id"), "evidence_id", "left_semi"), query)


def grounding_packet(df: DataFrame, query: str, limit: int = 20, before: int = 1, after: int = 1) -> DataFrame:
    """The first ``limit`` phrase hits with the rows around them: (hit_id, rank, context)."""
    hits = search_phrase(df, query, limit).select("evidence_id", *_ORDER[:3])
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(*[F.col(c).asc_nulls_first() for c in _ORDER])))  # at most `limit` rows
    pages = df.join(F.broadcast(hits.select("source_id").distinct()), "source_id", "left_semi")
    return ranked.select("evidence_id", "rank").join(with_context(pages, before, after).select("evidence_id", "context"), "evidence_id").select(F.col("evidence_id").alias("hit_id"), "rank", "context")


def check_citations(packet: DataFrame, cited: DataFrame) -> DataFrame:
    """(citation, supported): whether each cited key is in the packet. An empty packet supports nothing."""
    allowed = packet.select(F.explode(F.split("context", ",")).alias("citation")).distinct().withColumn("supported", F.lit(True))
    return cited.select("citation").distinct().join(allowed, "citation", "left").select("citation", F.coalesce("supported", F.lit(False)).alias("supported"))
