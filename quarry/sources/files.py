"""Files and folders as documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file, depth of a folder, and what is read or left out by default.
CAP, DEPTH = 8 * 1024 * 1024, 5
ENDINGS = ("md", "txt", "rst", "json", "yaml", "yml", "toml", "py", "ts", "js", "go", "rs", "sql", "sh", "html")
EXCLUDED = ("node_modules", ".git", "dist", "build", ".next", "coverage", "__pycache__", ".venv", "vendor")


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob over a relative path: ** crosses folders, * and ? don't; a bare name matches any part of the path."""
    out = "".join(".*" if p == "**" else "[^/]*" if p == "*" else "[^/]" if p == "?" else re.escape(p) for p in re.split(r"(\*\*|\*|\?)", glob.strip("/")) if p)
    return f"^{out}$" if "/" in glob.strip("/") else f"(?:^|/){out}(?:/|$)"


def ignore_patterns(text: str) -> list[str]:
    """Globs of an ignore file: comments, blank lines and negations are left out."""
    return [line.strip() for line in text.splitlines() if line.strip() and not line.strip().startswith(("#", "!"))]


def read_folder(spark: SparkSession, folder: str, endings: tuple[str, ...] = ENDINGS, exclude: tuple[str, ...] = EXCLUDED, depth: int = DEPTH, cap: int = CAP) -> DataFrame:
    """path, label, text, bytes, content_hash, error of every file below folder that the rules keep; a file over the cap has an error and no text."""
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace("path", "^.*?" + re.escape(root.removeprefix("file:")) + "/+", "")
    keep: Column = F.lower(F.regexp_extract(relative, r"\.([^./]+)$", 1)).isin(*endings) & (F.size(F.split(relative, "/")) <= depth + 1)
    for g in exclude:
        keep = keep & ~F.rlike(relative, F.lit(glob_pattern(g)))
    label, kept = F.concat(F.lit("file:"), relative).alias("label"), files.where(keep)
    small = kept.where(F.col("length") <= cap).select("path", label, F.decode("content", "UTF-8").alias("text"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("content_hash"), F.lit(None).cast("string").alias("error"))
    # of larger files only what the file system knows is asked for, so their bytes are never read
    large = kept.where(F.col("length") > cap).select("path", label, F.lit(None).cast("string").alias("text"), F.col("length").alias("bytes"), F.lit(None).cast("string").alias("content_hash"), F.lit("over the cap").alias("error"))
    return small.unionByName(large)


def folder_counts(files: DataFrame) -> DataFrame:
    """Files read, files over the cap, and bytes of a folder as read_folder gives it, in one row."""
    return files.agg(F.count_if(F.col("error").isNull()).alias("indexed"), F.count_if(F.col("error").isNotNull()).alias("capped"), F.count("*").alias("seen"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
