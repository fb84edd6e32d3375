"""File sources: snapshots of a folder, JSON Lines records, and classes of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.globs import allowed

#: Classes by extension; anything else is sniffed.
TEXT = (
    "txt", "md", "mdx", "markdown", "yaml", "yml", "json", "jsonl", "toml", "csv", "xml", "html", "htm", "css", "js", "ts", "tsx", "jsx", "go", "py", "rb", "rs", "java", "kt", "cs", "php",
    "sql", "sh", "bash", "zsh", "cue", "proto", "graphql", "env", "cfg", "ini", "rst", "adoc", "tex", "swift", "scala", "r", "tf", "hcl",
)
OFFICE = ("docx", "doc", "xlsx", "xls", "pptx", "ppt", "odt", "ods", "odp", "rtf")
IMAGE = ("png", "jpg", "jpeg", "gif", "svg", "bmp", "ico", "webp", "tiff", "tif")
SKIPPED = ("**/.git/**", "**/node_modules/**", "**/vendor/**", "**/dist/**", "**/build/**")

RECORD = T.StructType([T.StructField(n, t) for n, t in (("source_id", T.StringType()), ("version_id", T.StringType()), ("locator", T.StringType()), ("content_hash", T.StringType()), ("size_bytes", T.LongType()), ("captured_at", T.StringType()), ("source_type", T.StringType()), ("export_path", T.StringType()))])


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_class(path: Column, head: Column | None = None) -> Column:
    """text, pdf, office, image or binary: by extension, else by the first bytes (a NUL byte makes it binary)."""
    ext = extension(path)
    sniffed = F.when(F.hex(head).rlike("^25504446"), "pdf").when(F.hex(head).rlike("^(..)*00"), "binary").otherwise("text") if head is not None else F.lit("binary")
    return F.when(ext.isin(*TEXT), "text").when(ext == "pdf", "pdf").when(ext.isin(*OFFICE), "office").when(ext.isin(*IMAGE), "image").otherwise(sniffed)


def class_action(cls: Column, policy: dict[str, str]) -> Column:
    """allow, warn or block; text is always allowed, an unknown class blocked."""
    out = F.when(cls == "text", "allow")
    for name, action in policy.items():
        out = out.when(cls == name, action)
    return out.otherwise("block")


def scan_folder(spark: SparkSession, root: str, allow: list[str] | None = None, ignore: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, content_hash, size_bytes, ext, class) of every file below ``root``; filters see only the path before bytes are hashed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].replace("file:", "") + "/"
    path = F.expr(f"substring_index(path, '{base}', -1)")
    kept = files.withColumn("rel", path).where(allowed(F.col("rel"), list(allow or []), list(ignore)))
    return kept.select(F.col("rel").alias("path"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size_bytes"), extension(F.col("rel")).alias("ext"), file_class(F.col("rel"), F.expr("substring(content, 1, 512)")).alias("class"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot records from JSON Lines; blank lines are skipped, a malformed line is an error."""
    return spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)


def format_inventory(files: DataFrame, supported: dict[str, str]) -> DataFrame:
    """(ext, files, parser, supported) per extension."""
    parsers = files.sparkSession.createDataFrame(sorted(supported.items()), "ext string, parser string")
    return files.groupBy("ext").agg(F.count(F.lit(1)).alias("files")).join(F.broadcast(parsers), "ext", "left").withColumn("supported", F.col("parser").isNotNull())
