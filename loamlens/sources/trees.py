"""Reading source trees from a file system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlens.functions.paths import detected_language, is_skipped_path
from loamlens.functions.text import line_count

#: Files beyond this size are left out.
MAX_BYTES = 10 * 1024 * 1024


def source_tree(spark: SparkSession, root: str, *, repo: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The files below ``root`` as rows of the index: repo, path, mtime (ms), size, lang, lines, bytes, content.

    Skipped folders, hidden names and endings without source are left out, so are files beyond ``max_bytes``; Spark
    itself passes over empty files and hidden folders. Files are read by executors; ``root`` must be reachable by all.
    """
    base = root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    path = F.substring_index("path", base, -1)
    listed = raw.where(F.col("length") <= max_bytes).select(path.alias("path"), (F.unix_millis("modificationTime")).alias("mtime"), F.col("length").alias("size"), "content")
    text = listed.where(~is_skipped_path(F.col("path"))).withColumn("content", F.decode("content", "UTF-8"))
    return text.select(
        F.lit(repo).alias("repo"), "path", "mtime", "size", detected_language(F.col("path")).alias("lang"), line_count(F.col("content")).alias("lines"), F.octet_length("content").cast("bigint").alias("bytes"), "content"
    )
