"""Findings: one shape for all engines, ids, classification, set algebra, filters and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.operators import weakness
from codestrata.operators.patterns import NOT_PRODUCT

# SARIF levels and the order of severities.
SEVERITY_LEVEL = {"CRITICAL": "error", "HIGH": "error", "MED": "warning", "MEDIUM": "warning", "LOW": "note"}
SEVERITY_RANK = {"HIGH": 0, "MED": 1, "LOW": 2}
PAYLOAD = "file string, line string, type string, description string"
#: Columns of findings as they are delivered.
DELIVERED = ("ord", "scan_id", "repo", "source", "file", "line", "type", "severity", "description", "payload")


def delivered(findings: DataFrame) -> DataFrame:
    """One shape of findings: fields that are null in their columns come from the JSON payload; line is at least 0."""
    p = F.when(F.col("payload").isNotNull(), F.from_json("payload", PAYLOAD))
    f = findings.withColumn("_p", p)
    line = F.coalesce("line", F.expr("try_cast(trim(_p.line) as int)"), F.lit(0))
    return f.select(
        "ord", "scan_id", "repo", "source", F.coalesce("file", "_p.file").alias("file"), F.greatest(line, F.lit(0)).alias("line"), F.coalesce("type", "_p.type").alias("type"),
        F.coalesce("severity", F.lit("LOW")).alias("severity"), F.coalesce("description", "_p.description").alias("description"),
    )


def anchored(path: Column) -> Column:
    """Path from its first src, app, lib, routes or packages folder; else the file's name."""
    deep = F.regexp_extract(path, r"(?:^|/)((?:src|app|lib|routes|packages)/.*)$", 1)
    return F.when(deep != "", deep).otherwise(F.regexp_extract(path, r"([^/]+)$", 1))


def finding_id(source: Column, file: Column, line: Column, kind: Column, description: Column) -> Column:
    """Stable id: engine and the first 12 digits of a hash over what identifies a finding."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (source, anchored(file), line, kind, description)])
    return F.concat(F.lower(source), F.lit("_"), F.substring(F.sha1(text), 1, 12))


def classified(findings: DataFrame) -> DataFrame:
    """Delivered findings with id, primary CWE, CWE set, surface, level and whether the path is no product's."""
    kind, d = F.col("type"), F.col("description")
    out = findings.withColumns({"_text": weakness.lowered(d), "_kind": weakness.lowered(kind), "_path": weakness.lowered(F.col("file"))})
    out = out.withColumns({"finding_id": finding_id(F.col("source"), F.coalesce("file", F.lit("")), F.col("line"), kind, d), "cwe": weakness.primary(F.col("_text"), F.col("_kind"))})
    levels = F.create_map(*[F.lit(x) for kv in SEVERITY_LEVEL.items() for x in kv])
    level = F.coalesce(F.try_element_at(levels, F.upper("severity")), F.lit("warning"))
    out = out.withColumns({"cwes": weakness.classes(F.col("cwe"), F.col("_text")), "surface": weakness.surface(F.col("_text"), kind, F.col("_path")), "level": level, "is_test": F.coalesce(F.col("file").rlike(NOT_PRODUCT), F.lit(False))})
    return out.drop("_text", "_kind", "_path")


def first_of(findings: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The first row of each key by ``order``; a partial aggregate, so hot keys shrink before the shuffle."""
    rest = [c for c in findings.columns if c not in keys]
    firsts = findings.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("f"))
    return firsts.select(*keys, *[F.col("f")[c].alias(c) for c in rest])


def merged(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` and the rows of ``other`` whose key it lacks, first of each key; null keys equal nulls."""
    cond = None
    b = base.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        cond = c if cond is None else cond & c
    return base.unionByName(first_of(other.join(b, cond, "left_anti"), keys).select(base.columns))


def suppressed(findings: DataFrame, taint: DataFrame) -> DataFrame:
    """Pattern injections where taint analysis ran (file_id of ``taint``): only operator, regexp and query rules stay."""
    keep = findings.where("type <> 'injection' or rule in ('where-clause', 'regexp-of-input', 'query-template')")
    return findings.join(taint.select("file_id").distinct(), "file_id", "left_anti").unionByName(keep.join(taint.select("file_id").distinct(), "file_id", "left_semi"))


def selected(findings: DataFrame, severity: str | None = None, engine: str | None = None, file_part: str | None = None, only: str | None = None, with_tests: bool = False) -> DataFrame:
    """Filters of a caller: severity, engine, part of the file's name in any case, surface, and tests on request."""
    out = findings if with_tests else findings.where(~F.col("is_test"))
    if severity:
        out = out.where(F.col("severity") == severity)
    if engine:
        out = out.where(F.lower("source") == engine.lower())
    if file_part:
        out = out.where(F.contains(F.lower("file"), F.lit(file_part.lower())))
    return out.where(F.col("surface") == only) if only else out


def difference(before: DataFrame, after: DataFrame, key: str = "finding_id") -> DataFrame:
    """(key, state): resolved, remaining or new between two scans."""
    b, a = before.select(key).distinct(), after.select(key).distinct()
    joined = b.withColumn("b", F.lit(1)).join(a.withColumn("a", F.lit(1)), key, "full")
    return joined.select(key, F.when(F.col("a").isNull(), "resolved").when(F.col("b").isNull(), "new").otherwise("remaining").alias("state"))


def top_issues(findings: DataFrame, per_repo: int = 10) -> DataFrame:
    """The ``per_repo`` gravest issues of each repository, one for each file and severity; the limit is the report's."""
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])
    once = first_of(findings.where("file is not null").select("repo", "file", "severity", "ord", "type", "description"), ["repo", "file", "severity"])
    w = Window.partitionBy("repo").orderBy(F.coalesce(F.try_element_at(rank, F.col("severity")), F.lit(3)), "ord")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_repo).select("repo", "rank", "file", "severity", "type", "ord")


def sarif_results(classified: DataFrame) -> DataFrame:
    """(repo, ord, rule_id, result): one SARIF result as JSON for each finding; line from 1, POSIX paths."""
    rule = F.concat_ws("/", "type", F.concat(F.lit("CWE-"), F.col("cwe").cast("string")))
    uri = F.regexp_replace(F.coalesce("file", F.lit("unknown")), r"\\", "/")
    region = F.struct(F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)).alias("startLine"))
    place = F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.to_json(F.struct(rule.alias("ruleId"), F.col("level"), F.struct(F.col("description").alias("text")).alias("message"), F.array(place).alias("locations")))
    return classified.select("repo", "ord", rule.alias("rule_id"), result.alias("result"))


def sarif_rules(classified: DataFrame) -> DataFrame:
    """(rule_id, type, cwe, description): the first finding of each rule describes it."""
    rule = F.concat_ws("/", "type", F.concat(F.lit("CWE-"), F.col("cwe").cast("string")))
    return first_of(classified.select(rule.alias("rule_id"), "type", "cwe", "description", "ord"), ["rule_id"]).select("rule_id", "type", "cwe", "description", "ord")
