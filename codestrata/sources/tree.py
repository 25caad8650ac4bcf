"""A directory tree of source text as the files table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.paths import relative_uri
from codestrata.operators.corpus import language, loc
from codestrata.session import ship


def read_tree(spark: SparkSession, root: str, repo: str, most_bytes: int | None = None) -> DataFrame:
    """(path, rel_path, repo, language, lines, content, n_bytes) of every file below ``root``.

    All files are read whole. With ``most_bytes``, larger ones keep their row and ``n_bytes``, with null content and null lines,
    so that they don't count as empty.
    """
    ship(spark)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", r"^file:/*", "/")
    fits = F.lit(True) if most_bytes is None else F.col("length") <= most_bytes
    base = raw.select(path.alias("path"), F.when(fits, F.decode("content", "UTF-8")).alias("content"), F.col("length").alias("n_bytes"))
    rel = relative_uri(F.col("path"), F.lit(root))
    lines = F.when(F.col("content").isNotNull(), loc(F.col("content")))
    return base.select("path", rel.alias("rel_path"), F.lit(repo).alias("repo"), language(rel).alias("language"), lines.alias("lines"), "content", "n_bytes")
