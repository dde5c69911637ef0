"""Page layout: recurring margins, body font, reading order, spacing repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.locators import margin_key

#: Prefixes that aren't split off a word.
PREFIXES = ("com", "con", "de", "dis", "em", "en", "il", "im", "in", "inter", "ir", "non", "per", "pre", "pro", "re", "sub", "trans", "un")


def page_lines(df: DataFrame) -> DataFrame:
    """Page lines once each, with their box's corners."""
    at = lambda i: F.get("bbox", F.lit(i))
    return df.where("line_id is not null").groupBy("line_id").agg(F.min_by(F.struct("source_id", "pdf_page", "text", "bbox"), "loaded_at").alias("r")).select("line_id", "r.*").select("*", at(0).alias("x0"), at(1).alias("y0"), at(2).alias("x1"), at(3).alias("y1")).drop("bbox")


def recurring_margins(lines: DataFrame, height: float = 842.0, top: float = 0.1, bottom: float = 0.1, share: float = 0.4, least: int = 2) -> DataFrame:
    """(source_id, zone, key, pages): margin keys on at least ``share`` of a source's pages, and on ``least``."""
    zone = F.when(F.col("y0") <= height * top, "header").when(F.col("y1") >= height * (1 - bottom), "footer")
    marked = lines.select("source_id", "pdf_page", zone.alias("zone"), margin_key(F.col("text")).alias("key"))
    pages = lines.groupBy("source_id").agg(F.countDistinct("pdf_page").alias("n"))
    seen = marked.where("zone is not null and key <> ''").distinct().groupBy("source_id", "zone", "key").agg(F.count("*").alias("pages"))
    return seen.join(pages, "source_id").where(F.col("pages") >= F.greatest(F.lit(least), F.ceil(F.col("n") * F.lit(share)))).select("source_id", "zone", "key", "pages")


def clean_margins(lines: DataFrame, margins: DataFrame, height: float = 842.0, top: float = 0.1, bottom: float = 0.1, fixed_top: float = 0.06, fixed_bottom: float = 0.055) -> DataFrame:
    """(line_id, reason): why a line is margin, or null where it is kept; the first reason that holds counts.

    Every line comes out once. Margin keys are few per source, so they are joined as a list by source.
    """
    by = margins.groupBy("source_id").agg(F.collect_set(F.concat_ws("|", "zone", "key")).alias("keys"))
    k = margin_key(F.col("text"))
    has = lambda z: (k != "") & F.coalesce(F.array_contains("keys", F.concat(F.lit(f"{z}|"), k)), F.lit(False))
    reason = F.when((F.col("y0") <= height * top) & has("header"), "recurring_header").when((F.col("y1") >= height * (1 - bottom)) & has("footer"), "recurring_footer").when(F.col("y1") <= height * fixed_top, "fixed_header").when(F.col("y0") >= height * (1 - fixed_bottom), "fixed_footer")
    return lines.join(by, "source_id", "left").select("line_id", reason.alias("reason"))


def weighted_median(df: DataFrame, part: str, value: Column, weight: Column) -> DataFrame:
    """(part, body, threshold): median of ``value``, each counted ``weight`` times, without repeating rows.

    Values are summed to one row per distinct value first, so the window runs over distinct
    values only. An even total takes the mean of the two middle ones.
    """
    d = df.select(part, value.alias("v"), weight.cast("long").alias("w")).where("v is not null and w > 0").groupBy(part, "v").agg(F.sum("w").alias("w"))
    up = Window.partitionBy(part).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("upto", F.sum("w").over(up)).withColumn("total", F.sum("w").over(Window.partitionBy(part)))
    lo, hi = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col("v")))
    m = d.groupBy(part).agg(at(lo).alias("lo"), at(hi).alias("hi"))
    return m.select(part, F.round((F.col("lo") + F.col("hi")) / 2, 3).alias("body"), F.round(F.round((F.col("lo") + F.col("hi")) / 2, 3) * 1.15, 3).alias("threshold"))


def page_order(lines: DataFrame, width: float = 595.0) -> DataFrame:
    """Per page: lines, share of wide ones, start columns' medians and quartiles, and whether two columns speak for themselves."""
    wide = (F.col("x1") - F.col("x0") >= width * 0.65) | ((F.col("x0") <= width * 0.4) & (F.col("x1") >= width * 0.6))
    right = ~wide & (F.col("x0") >= width / 2)
    left = ~wide & (F.col("x0") < width / 2)
    g = lines.where("pdf_page is not null and x0 is not null").groupBy("source_id", "pdf_page").agg(
        F.count("*").alias("lines"), F.count_if(wide).alias("wide_lines"), F.count_if(left).alias("left_lines"), F.count_if(right).alias("right_lines"), F.percentile("x0", F.lit(0.5)).alias("x_median"), F.percentile(F.col("x1") - F.col("x0"), F.lit(0.75)).alias("width_p75")
    )
    return g.withColumn("two_columns", (F.col("left_lines") >= 4) & (F.col("right_lines") >= 4) & (F.col("wide_lines") * 2 <= F.col("lines")))


def reading_order(lines: DataFrame, width: float = 595.0) -> DataFrame:
    """(line_id, reading_no): bands parted by wide lines, in a band the left column before the right, then top down."""
    wide = (F.col("x1") - F.col("x0") >= width * 0.65) | ((F.col("x0") <= width * 0.4) & (F.col("x1") >= width * 0.6))
    page = Window.partitionBy("source_id", "pdf_page")
    d = lines.where("pdf_page is not null and x0 is not null").withColumn("wide", wide).withColumn("band", F.sum(F.when(wide, 2).otherwise(0)).over(page.orderBy("y0", "x0", "line_id").rowsBetween(Window.unboundedPreceding, 0)) - F.when(wide, 1).otherwise(0))
    column = F.when(F.col("wide"), 0).when(F.col("x0") < width / 2, 1).otherwise(2)
    return d.select("line_id", "source_id", "pdf_page", F.row_number().over(page.orderBy("band", column, "y0", "x0", "line_id")).alias("reading_no"))


def spacing_repairs(df: DataFrame, text: str = "text") -> DataFrame:
    """(token, left, right, pairs): words that stand for two others run together, by the corpus's own counts.

    A word of five letters or more is split where the pair stands at least twice, and twice
    as often as the word, and the first part is no mere prefix; of several splits the most
    frequent, then the most balanced, counts. Words and pairs are counted first; only the
    distinct words are split, so the join is over the vocabulary, not the text.
    """
    t = df.where(f"{text} is not null").select(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)).alias("t"))
    words = t.select(F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("length(token) >= 5")
    pairs = t.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("t") - 1, F.lit(1))), lambda i: F.struct(F.get("t", i - 1).alias("left"), F.get("t", i).alias("right")))).alias("p")).select("p.*").where("right is not null").groupBy("left", "right").agg(F.count("*").alias("pairs")).where("pairs >= 2")
    split = words.select("token", "n", F.explode(F.sequence(F.lit(2), F.length("token") - 2)).alias("at")).select("token", "n", F.expr("substring(token, 1, at)").alias("left"), F.expr("substring(token, at + 1)").alias("right"))
    ok = split.where(~F.col("left").isin(*PREFIXES)).join(pairs, ["left", "right"]).where("pairs >= 2 * n")
    best = F.max(F.struct("pairs", F.least(F.length("left"), F.length("right")).alias("balance"), "left", "right"))
    return ok.groupBy("token").agg(best.alias("b")).select("token", "b.left", "b.right", "b.pairs")


def hyphenation_lexicon(df: DataFrame, text: str = "text") -> DataFrame:
    """(joined, hyphenated, plain_count, hyphen_count): words cut at line ends with how often each spelling stands within a line."""
    body = df.where(f"{text} is not null").select(text)
    cut = body.select(F.explode(F.regexp_extract_all(text, F.lit(r"([A-Za-z]+-\n[a-z]+)"), F.lit(1))).alias("c")).select(F.lower(F.split_part("c", F.lit("-\n"), F.lit(1))).alias("a"), F.split_part("c", F.lit("-\n"), F.lit(2)).alias("b")).distinct()
    flat = F.lower(F.regexp_replace(text, r"-\n", " "))
    plain = body.select(F.explode(F.regexp_extract_all(flat, F.lit("[a-z]+"), F.lit(0))).alias("joined")).groupBy("joined").agg(F.count("*").alias("plain_count"))
    hyph = body.select(F.explode(F.regexp_extract_all(flat, F.lit("[a-z]+-[a-z]+"), F.lit(0))).alias("hyphenated")).groupBy("hyphenated").agg(F.count("*").alias("hyphen_count"))
    d = cut.select(F.concat("a", "b").alias("joined"), F.concat_ws("-", "a", "b").alias("hyphenated"))
    return d.join(plain, "joined", "left").join(hyph, "hyphenated", "left").select("joined", "hyphenated", F.coalesce("plain_count", F.lit(0).cast("long")).alias("plain_count"), F.coalesce("hyphen_count", F.lit(0).cast("long")).alias("hyphen_count"))
