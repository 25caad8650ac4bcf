"""Scoring findings against labelled weaknesses, and statistics of scores and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines between a finding and a weakness that still match.
LINES = 5


def same_file(a: Column, b: Column) -> Column:
    """Equal paths, or one ends with the other at a folder's border."""
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def candidates(findings: DataFrame, weaknesses: DataFrame) -> DataFrame:
    """(source, corpus, ord, id): findings and the weaknesses they may claim: type, file, and line unless project-wide.

    Paths that match at a folder's border share their last part, so corpus, type and file name are equi-keys and
    only rows of one file name are compared; a fixed labelled table is broadcast by its size.
    """
    name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1).alias("name")
    f = findings.select("source", F.col("repo").alias("corpus"), "ord", "type", name("file"), F.col("file").alias("f_file"), F.col("line").alias("f_line"))
    w = weaknesses.select("corpus", "type", "id", name("file"), "file", "line", "scope")
    near = (F.col("scope") == "project") | (F.abs(F.col("f_line") - F.col("line")) <= LINES)
    return f.join(w, ["corpus", "type", "name"]).where(same_file(F.col("f_file"), F.col("file")) & near).select("source", "corpus", "ord", "id")


def claims(candidates: DataFrame) -> DataFrame:
    """(source, corpus, ord, id): greedy one-to-one assignment in order of findings, first free weakness by id.

    Of the findings that may claim exactly the same set of weaknesses only as many can succeed as the set has, so
    the rest are dropped by rank before anything is gathered. What reaches one task is bounded by the labels of one corpus,
    which people wrote: for each set of them at most as many findings as the set has, whatever the findings.
    """
    sets = candidates.groupBy("source", "corpus", "ord").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    w = Window.partitionBy("source", "corpus", "ids").orderBy("ord")
    kept = sets.withColumn("rn", F.row_number().over(w)).where("rn <= size(ids)").drop("rn")

    def assign(pdf):
        import pandas as pd

        taken, out = set(), []
        for r in pdf.sort_values("ord").itertuples():
            free = next((i for i in r.ids if i not in taken), None)
            if free is not None:
                taken.add(free)
                out.append((r.source, r.corpus, r.ord, free))
        return pd.DataFrame(out, columns=["source", "corpus", "ord", "id"])

    return kept.groupBy("source", "corpus").applyInPandas(assign, "source string, corpus string, ord long, id string")


def ratios(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """precision, recall and F1; null where undefined, F1 0 where both are 0."""
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    f1 = F.when(p.isNull() | r.isNull(), None).when(p + r == 0, 0.0).otherwise(F.try_divide(2 * p * r, p + r))
    return {"precision_val": p, "recall": r, "f1": f1}


def scored(findings: DataFrame, weaknesses: DataFrame) -> DataFrame:
    """(source, corpus, tp, fp, fn, precision_val, recall, f1) of each engine on each labelled corpus."""
    labels = weaknesses.groupBy("corpus").agg(F.count(F.lit(1)).alias("n_labels"))
    total = findings.groupBy("source", F.col("repo").alias("corpus")).agg(F.count(F.lit(1)).alias("n"))
    hit = claims(candidates(findings, weaknesses)).groupBy("source", "corpus").agg(F.count(F.lit(1)).alias("tp"))
    j = total.join(labels, "corpus").join(hit, ["source", "corpus"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    j = j.withColumns({"fp": F.col("n") - F.col("tp"), "fn": F.col("n_labels") - F.col("tp")})
    return j.select("source", "corpus", "tp", "fp", "fn", *[c.alias(k) for k, c in ratios(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def harmonic_f1(scores: DataFrame, by: str = "tool") -> DataFrame:
    """(by, n, f1): harmonic mean; null if any is null, 0 if any is 0."""
    f = F.col("f1")
    value = F.when(F.bool_or(f.isNull()), None).when(F.bool_or(f == 0), 0.0).otherwise(F.count(F.lit(1)) / F.sum(F.try_divide(F.lit(1.0), f)))
    return scores.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(value, 9).alias("f1"))


def leaderboard(scores: DataFrame) -> DataFrame:
    """(rank, tool, n_corpora, tp, fp, fn, precision_val, recall, f1): micro-averaged, best first, undefined last."""
    t = scores.groupBy("tool").agg(F.count_distinct("corpus").alias("n_corpora"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    r = t.select("*", *[F.round(c, 9).alias(k) for k, c in ratios(F.col("tp"), F.col("fp"), F.col("fn")).items()])
    return r.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("f1"), "tool")))


def run_variance(runs: DataFrame) -> DataFrame:
    """(corpus, stage, n, median_ms, variance_pct): largest deviation from the median of the valid times, in percent."""
    real = runs.where("total_ms > 0 and not isnan(total_ms)")
    g = real.groupBy("corpus", "stage").agg(F.count(F.lit(1)).alias("n"), F.median("total_ms").alias("median_ms"), F.max("total_ms").alias("hi"), F.min("total_ms").alias("lo"))
    far = F.greatest(F.col("hi") - F.col("median_ms"), F.col("median_ms") - F.col("lo"))
    return g.select("corpus", "stage", "n", F.round(F.col("median_ms") + 1e-9, 6).alias("median_ms"), F.round(100 * far / F.col("median_ms") + 1e-9, 6).alias("variance_pct"))
