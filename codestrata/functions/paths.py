"""Expressions over paths, lines and levels that reports need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def posix(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def relative_uri(path: Column, root: Column) -> Column:
    """Path below ``root``; outside of it the file's name; relative paths lose a leading './'."""
    p, r = posix(path), F.regexp_replace(posix(root), "/+$", "")
    inside = F.startswith(p, F.concat(r, F.lit("/")))
    outside = F.when(F.startswith(p, F.lit("/")), F.regexp_extract(p, r"([^/]+)$", 1)).otherwise(F.regexp_replace(p, r"^\./", ""))
    return F.when(inside, F.substring(p, F.length(r) + 2, F.length(p))).otherwise(outside)


def start_line(line: Column) -> Column:
    return F.greatest(F.coalesce(line, F.lit(1)), F.lit(1))


def corpus_fingerprint(files: DataFrame) -> DataFrame:
    """(repo, n_files, fingerprint): order-free hash over path and content of all files of a repository.

    Sums of 60-bit hashes combine before the shuffle, so no list of files is ever gathered.
    """
    h = lambda lane: F.shiftrightunsigned(F.xxhash64(F.lit(lane), F.coalesce("rel_path", F.lit("")), F.coalesce("content", F.lit(""))), 34)
    g = files.groupBy("repo").agg(F.count(F.lit(1)).alias("n_files"), F.sum(h(1)).alias("a"), F.sum(h(2)).alias("b"))
    return g.select("repo", "n_files", F.substring(F.sha2(F.concat_ws(":", F.col("n_files").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256), 1, 16).alias("fingerprint"))
