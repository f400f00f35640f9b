"""Readers: CSV imports, captured pages, JSON pages of APIs, PDFs and folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IMPORT_COLUMNS = ("vendor", "product", "source_name", "base_url")


def read_import_csv(spark: SparkSession, path: str) -> DataFrame:
    """An import file: headers trimmed and lower-cased, values trimmed, ``row_no`` from 2. Raises ``ValueError`` without the needed columns."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    out = raw.toDF(*[c.strip().lower() for c in raw.columns])
    if missing := [c for c in IMPORT_COLUMNS if c not in out.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    out = out.select(*[F.trim(c).alias(c) for c in out.columns])
    # An import is one file that a person made; its lines are numbered in their order.
    return out.withColumn("row_no", (F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) + 1).cast("int"))


def plan_import(rows: DataFrame, sources: DataFrame, products: DataFrame, vendors: DataFrame) -> DataFrame:
    """Outcome of each row: error (a value is missing), skipped (its product has the URL, or an earlier row does) or created."""
    bad = F.lit(False)
    for c in IMPORT_COLUMNS:
        bad = bad | (F.coalesce(F.col(c), F.lit("")) == "")
    known = sources.join(products.select(F.col("id").alias("product_id"), F.lower("name").alias("__p"), "vendor_id"), "product_id").join(vendors.select(F.col("id").alias("vendor_id"), F.lower("name").alias("__v")), "vendor_id")
    known = known.select("__v", "__p", F.col("base_url").alias("__u"), F.lit(True).alias("__known")).distinct()
    keyed = rows.withColumns({"__bad": bad, "__v": F.lower("vendor"), "__p": F.lower("product"), "__u": F.col("base_url")})
    first = F.row_number().over(Window.partitionBy("__bad", "__v", "__p", "__u").orderBy("row_no"))
    out = keyed.withColumn("__n", first).join(known, ["__v", "__p", "__u"], "left")
    result = F.when(F.col("__bad"), "error").when(F.col("__known") | (F.col("__n") > 1), "skipped").otherwise("created")
    return out.select("row_no", *IMPORT_COLUMNS, result.alias("result"))


def first_casing(rows: DataFrame, column: str) -> DataFrame:
    """Names by their lower-cased form, as first written."""
    return rows.groupBy(F.lower(column).alias("key")).agg(F.min_by(column, "row_no").alias(column))


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """path, content, sha256; empty files are left out."""
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content", F.sha2("content", 256).alias("pdf_hash"))


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Captured responses (url, html): what a live fetch would give."""
    return spark.read.parquet(path).select("url", "html")


def pages_of_api(bodies: DataFrame, schema: str, rows: str) -> DataFrame:
    """Captured pages of a paged API (page_no, body) as one table of their ``rows`` arrays, in page order."""
    parsed = bodies.select("page_no", F.from_json("body", schema).alias("j"))
    return parsed.select("page_no", F.posexplode(F.col(f"j.{rows}")).alias("pos", "row")).select("page_no", "pos", "row.*")


def sitemap_urls(bodies: DataFrame) -> DataFrame:
    """(url) of every location in sitemaps (body), namespaces or not."""
    return bodies.select(F.explode(F.regexp_extract_all("body", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)).alias("url"))


Connector = Callable[[SparkSession, dict], DataFrame]
CONNECTORS: dict[str, Connector] = {"captures": lambda spark, o: read_captures(spark, o["path"]), "pdf": lambda spark, o: read_pdfs(spark, o["path"])}


def register(name: str, connector: Connector) -> None:
    """Live fetching, rendering, conversion and model calls plug in here."""
    CONNECTORS[name] = connector


def load(spark: SparkSession, kind: str, **options: str) -> DataFrame:
    if kind not in CONNECTORS:
        raise LookupError(f"no connector {kind}; register one")
    return CONNECTORS[kind](spark, options)
