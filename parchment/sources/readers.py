"""Sources: strict JSON, CSV and HTML readers, identity-checked files, text adapters. Malformed input is isolated, never dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

PAGE_LINES = "pdf_page int, lines array<struct<text: string, bbox: array<double>, line_id: string>>"
LAYOUT = "pages array<struct<page_number: int, width: double, height: double, blocks: array<struct<block_index: int, bbox: array<double>, lines: array<string>>>>>"


def page_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pdf_page, line_no from 1, text, bbox, line_id) of a JSON-lines file; a malformed row fails the read."""
    d = spark.read.schema(PAGE_LINES).option("mode", "FAILFAST").json(path)
    return d.select("pdf_page", F.posexplode("lines").alias("pos", "line")).select("pdf_page", (F.col("pos") + 1).alias("line_no"), "line.*")


def missing_pages(lines: DataFrame, first: int, last: int) -> DataFrame:
    """Pages of the range without a line."""
    return lines.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("pdf_page")).join(lines.select("pdf_page").distinct(), "pdf_page", "left_anti")


def layout_evidence(layouts: DataFrame, source_sha: str) -> DataFrame:
    """A nested layout column ``layout`` (LAYOUT) as evidence rows in page and block order."""
    from ..functions.ids import evidence_id

    pages = layouts.select(F.explode("layout.pages").alias("p"))
    b = pages.select(F.col("p.page_number").alias("pdf_page"), F.explode("p.blocks").alias("b")).select("pdf_page", "b.block_index", "b.bbox", F.array_join("b.lines", "\n").alias("text"))
    return b.withColumn("source_sha256", F.lit(source_sha)).withColumn("evidence_id", evidence_id(F.col("source_sha256"), F.col("pdf_page"), F.col("block_index"), F.col("bbox")))


def strict_json(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """``df`` with ``record`` and ``problem``: null, 'malformed', 'unknown-field' or 'missing-field'.

    All of the schema's fields must be there, and no others; a problem leaves the record null.
    """
    names = sorted(schema.fieldNames())
    keys = F.array_sort(F.json_object_keys(column))
    want = F.array(*[F.lit(n) for n in names])
    corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    got = F.from_json(F.col(column), corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    d = df.withColumn("_k", keys).withColumn("_r", got)
    problem = F.when(F.col("_k").isNull() | F.col("_r._corrupt").isNotNull(), "malformed").when(F.size(F.array_except("_k", want)) > 0, "unknown-field").when(F.size(F.array_except(want, F.col("_k"))) > 0, "missing-field")
    record = F.struct(*[F.col(f"_r.{n}").alias(n) for n in schema.fieldNames()])
    return d.withColumn("problem", problem).withColumn("record", F.when(F.col("problem").isNull(), record)).drop("_k", "_r")


def clause_csv(spark: SparkSession, path: str) -> DataFrame:
    """Hierarchy records of a CSV file with the header locator, title, parent, depth; blank cells are null."""
    return spark.read.option("header", True).option("mode", "FAILFAST").schema("locator string, title string, parent string, depth int").csv(path)


def verify_files(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """(name, state): verified, wrong-size, wrong-hash, missing or unexpected, from the files' own bytes.

    ``expected``: name, size, sha256. Contents are hashed where they are read.
    """
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("found_size"), F.sha2("content", 256).alias("found_sha"))
    j = expected.join(files, "name", "full")
    state = F.when(F.col("found_size").isNull(), "missing").when(F.col("size").isNull(), "unexpected").when(F.col("found_size") != F.col("size"), "wrong-size").when(F.col("found_sha") != F.col("sha256"), "wrong-hash").otherwise("verified")
    return j.select("name", state.alias("state"))


def html_blocks(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, block_no, tag, text) of h1 to h6, p and li elements in order; scripts, styles, navigation and footers are cut first."""
    body = F.regexp_replace(html, r"(?is)<(script|style|nav|footer)\b.*?</\1\s*>|<!--.*?-->", " ")
    found = F.regexp_extract_all(body, F.lit(r"(?is)(<(?:h[1-6]|p|li)\b[^>]*>.*?</(?:h[1-6]|p|li)\s*>)"), F.lit(1))
    t = F.trim(F.regexp_replace(F.regexp_replace("b", r"(?s)<[^>]*>", " "), r"\s+", " "))
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    return df.select(key, F.posexplode(found).alias("pos", "b")).select(key, (F.col("pos") + 1).alias("block_no"), F.lower(F.regexp_extract("b", r"(?i)^<(h[1-6]|p|li)", 1)).alias("tag"), t.alias("text"))


def errata_entries(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, entry_no, page, target, directive, operation) of entries written 'Page N, target: directive'; other lines go on the entry before."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    pat = r"^Page ([0-9]+), ([^:]+): (.*)$"
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumn("entry_no", F.sum(F.when(F.col("line").rlike(pat), 1).otherwise(0)).over(w)).where("entry_no > 0")
    g = d.groupBy(key, "entry_no").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    head = F.get("ls", F.lit(0))["line"]
    rest = F.array_join(F.transform(F.slice("ls", F.lit(2), F.greatest(F.size("ls") - 1, F.lit(0))), lambda x: F.trim(x["line"])), " ")
    directive = F.trim(F.concat_ws(" ", F.regexp_extract(head, pat, 3), rest))
    op = F.when(F.lower(directive).rlike("^(delete|remove)"), "delete").when(F.lower(directive).rlike("^(add|insert)"), "add").when(F.lower(directive).rlike("^(replace|revise|change|correct)"), "replace").otherwise("unsupported")
    return g.select(key, "entry_no", F.regexp_extract(head, pat, 1).cast("int").alias("page"), F.trim(F.regexp_extract(head, pat, 2)).alias("target"), directive.alias("directive"), op.alias("operation"))


def labelled_blocks(df: DataFrame, key: str, text: str = "text", start: str = r"^([A-Z]{1,4}[0-9]+(?:-[0-9]+)?)\s*$") -> DataFrame:
    """(key, block_id, label, value) of blocks that begin with an id line and hold 'Label: value' lines; a value runs on to the next label."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ident, lab = F.nullif(F.regexp_extract("line", start, 1), F.lit("")), r"^([A-Z][A-Za-z ]{0,30}):\s*(.*)$"
    d = lines.withColumn("block_id", F.last(ident, ignorenulls=True).over(w)).withColumn("is_label", F.col("line").rlike(lab)).withColumn("n", F.sum(F.when(F.col("is_label") | ident.isNotNull(), 1).otherwise(0)).over(w))
    d = d.where(F.col("block_id").isNotNull() & ~F.col("line").rlike(start))
    g = d.groupBy(key, "block_id", "n").agg(F.max(F.when(F.col("is_label"), F.regexp_extract("line", lab, 1))).alias("label"), F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("is_label"), F.regexp_extract("line", lab, 2)).otherwise(F.trim("line")).alias("v")))).alias("vs"))
    return g.where("label is not null").select(key, "block_id", "label", F.trim(F.array_join(F.filter(F.transform("vs", lambda x: x["v"]), lambda x: x != ""), " ")).alias("value"))
