"""Risk of files and the verdict over a repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.operators.corpus import LANGUAGES

# Steps (upper bound inclusive, risk), what lies above, and the weights of the factors.
COMPLEXITY = ((5, 0.0), (10, 0.3), (20, 0.6), (40, 0.8)), 1.0
COUPLING = ((0, 0.0), (2, 0.1), (5, 0.4), (8, 0.6)), 1.0
SIZE = ((30, 0.0), (60, 0.2), (100, 0.4), (200, 0.7)), 1.0
DENSITY = ((0.005, 0.1), (0.01, 0.3), (0.02, 0.5))
WEIGHTS = {"complexity": 0.3, "coupling": 0.25, "untested": 0.2, "density": 0.1, "size": 0.15}
HIGH, MEDIUM, THRESHOLD = 0.65, 0.4, 0.8
PENALTY = {"HIGH": (0.12, 0.10, 0.08), "MED": (0.05, 0.04, 0.025)}
# Endings of test files, and parts of paths that show that a repository is tested.
TEST_SUFFIXES = tuple(x for g in LANGUAGES for x in g.tests.split())
TEST_FOLDERS = ("__tests__", "test/", "tests/", "Tests/", "testdata/", "src/test/", "spec/")
# Most issues of each source in a repository's audit, in the order of sources, and of all of them.
ISSUES, MOST_ISSUES = {"cycle": 3, "risk": 5, "finding": 5, "god-module": 3, "coupling": 3, "large-function": 3}, 10


def step(value: Column, table: tuple) -> Column:
    out = F.lit(table[1])
    for bound, risk in reversed(table[0]):
        out = F.when(value <= bound, risk).otherwise(out)
    return out


def density_step(d: Column) -> Column:
    out = F.lit(0.8)
    for bound, risk in reversed(DENSITY):
        out = F.when(d < bound, risk).otherwise(out)
    return F.when(d == 0, 0.0).otherwise(out)


def tested(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repositories with a path of TEST_FOLDERS (repo), and names of tested files without extension (repo, stem).

    A file is tested by one of its name with one of TEST_SUFFIXES, or with ``test_`` before it.
    """
    path, name = F.col("rel_path"), F.regexp_extract("rel_path", r"([^/]+)$", 1)
    folder = F.lit(False)
    for f in TEST_FOLDERS:
        folder = folder | F.contains(path, F.lit(f))
    ends = F.transform(F.filter(F.array(*[F.lit(x) for x in TEST_SUFFIXES]), lambda x: F.endswith(name, x)), lambda x: F.substring(name, F.lit(1), F.length(name) - F.length(x)))
    before = F.when(name.rlike(r"^test_.*\.pyw?$"), F.regexp_extract(name, r"^test_(.*)\.pyw?$", 1))
    stems = files.select("repo", F.explode_outer(F.concat(ends, F.array_compact(F.array(before)))).alias("stem")).where("stem is not null").distinct()
    return files.where(folder).select("repo").distinct(), stems


def risk_scores(lined: DataFrame, functions: DataFrame, todos: DataFrame, degrees: DataFrame, module: Column) -> DataFrame:
    """(file_id, repo, rel_path, complexity, coupling, untested, density, size, score, tier) of every file but markdown.

    Factors come from aggregates by file, joined on ids; content does not travel. ``untested`` is 0.5 unless the file or its
    repository is ``tested``. A file without functions has complexity 1 and size 0.
    """
    f = functions.groupBy("file_id").agg(F.avg("complexity").alias("avg_c"), F.max("n_lines").alias("max_l"))
    t = todos.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_todo"))
    repos, stems = tested(lined)
    stem = F.regexp_replace(F.regexp_extract("rel_path", r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")
    base = lined.where("lang is not null and lang <> 'markdown'").select("file_id", "repo", "rel_path", "n_lines", stem.alias("stem"), module.alias("module"))
    joined = base.join(f, "file_id", "left").join(t, "file_id", "left").join(degrees, ["repo", "module"], "left")
    joined = joined.join(stems.withColumn("has_test", F.lit(True)), ["repo", "stem"], "left").join(repos.withColumn("has_tests", F.lit(True)), "repo", "left")
    factors = joined.select(
        "file_id", "repo", "rel_path",
        step(F.coalesce("avg_c", F.lit(1.0)), COMPLEXITY).alias("complexity"),
        step(F.coalesce("n", F.lit(0)), COUPLING).alias("coupling"),
        F.when(F.col("has_test") | F.col("has_tests"), 0.0).otherwise(0.5).alias("untested"),
        density_step(F.coalesce("n_todo", F.lit(0)) / F.greatest("n_lines", F.lit(1))).alias("density"),
        step(F.coalesce("max_l", F.lit(0)), SIZE).alias("size"),
    )
    score = sum((F.lit(w) * F.col(k) for k, w in WEIGHTS.items()), F.lit(0.0))
    out = factors.withColumn("score", F.round(F.least(F.lit(1.0), score), 9))
    return out.withColumn("tier", F.when(F.col("score") >= HIGH, "high").when(F.col("score") >= MEDIUM, "medium").otherwise("low"))


def verdicts(risk: DataFrame, functions: DataFrame, findings: DataFrame, members: DataFrame, coupled: DataFrame, gods: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row a repository: the four part scores, the score, the verdict and the counts behind them.

    ``findings`` has file_id, severity and surface; only those of the security surface are penalised, the more the higher the
    file's tier. ``members`` are the modules on cycles by component: each cycle is penalised once. All inputs are aggregated
    before they are joined, by repository.
    """
    repo = risk.groupBy("repo").agg(F.count(F.lit(1)).alias("n_files"), F.avg("score").alias("mean_risk"), F.count_if(F.col("tier") == "high").alias("n_high"), F.count_if(F.col("tier") == "medium").alias("n_medium"))
    ids = risk.select("file_id", "repo", "tier")
    fn = functions.select("file_id", "complexity").join(ids, "file_id").groupBy("repo").agg(F.avg("complexity").alias("avg_c"))
    weight = F.lit(0.0)
    for sev, (hi, med, low) in PENALTY.items():
        w = F.when(F.col("tier") == "high", hi).when(F.col("tier") == "medium", med).otherwise(low)
        weight = F.when((F.col("severity") == sev) & (F.col("surface") != "quality"), w).otherwise(weight)
    cycles = members.select("repo", "component").distinct()
    adv = findings.select("file_id", "severity", "surface").join(ids, "file_id").groupBy("repo").agg(F.sum(weight).alias("penalty"), F.count(F.lit(1)).alias("n_findings"), F.count_if(F.col("surface") == "quality").alias("n_quality"))
    count = lambda df, name: df.groupBy("repo").agg(F.count(F.lit(1)).alias(name))
    j = repo.join(fn, "repo", "left").join(adv, "repo", "left")
    for df, name in ((cycles, "n_cycles"), (coupled, "n_coupled"), (gods, "n_god")):
        j = j.join(count(df, name), "repo", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    j = j.select(
        "repo", "n_files", "n_high", "n_medium", zero("n_findings").alias("n_findings"), zero("n_quality").alias("n_quality"), zero("n_cycles").alias("n_cycles"), zero("n_coupled").alias("n_coupled"), zero("n_god").alias("n_god"),
        F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), (F.coalesce("avg_c", F.lit(1.0)) - 1) / 30)).alias("complexity_score"),
        F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), 0.15 * zero("n_cycles")) - F.least(F.lit(0.3), 0.05 * zero("n_coupled")) - F.least(F.lit(0.2), 0.05 * zero("n_god"))).alias("dependency_score"),
        (1 - F.col("mean_risk")).alias("risk_score"),
        (1 - F.least(F.lit(1.0), F.coalesce("penalty", F.lit(0.0)))).alias("adversarial_score"),
        F.least(F.lit(0.99), 1.5 * F.col("mean_risk")).alias("bug_probability"),
    )
    total = 0.25 * F.col("complexity_score") + 0.30 * F.col("dependency_score") + 0.25 * F.col("risk_score") + 0.20 * F.col("adversarial_score")
    rounded = ["complexity_score", "dependency_score", "risk_score", "adversarial_score", "bug_probability"]
    out = j.withColumn("score", F.round(total, 6)).withColumns({c: F.round(c, 6) for c in rounded})
    return out.withColumn("verdict", F.when(F.col("score") >= threshold, "APPROVED").otherwise("REJECTED"))


def audit_issues(risk: DataFrame, functions: DataFrame, findings: DataFrame, members: DataFrame, coupled: DataFrame, gods: DataFrame) -> DataFrame:
    """(repo, rank, severity, source, file, line): the gravest issues of each repository, from six sources.

    The limits of ISSUES and MOST_ISSUES are the report's. HIGH: cycles, files of high risk (worst first), findings of the
    security surface; MED: god modules, coupling (most importers first), functions of more than 100 lines. One issue for
    each file and severity. Each source is ranked within its repository before they are put together.
    """
    repo_of = risk.select("file_id", "repo")
    nothing = F.lit(None).cast("int")

    def top(df: DataFrame, source: str, severity: str, file: str, line: Column, *order) -> DataFrame:
        ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy("repo").orderBy(*order))).where(F.col("_n") <= ISSUES[source])
        return ranked.select("repo", F.lit(severity).alias("severity"), F.lit(list(ISSUES).index(source)).alias("_s"), F.lit(source).alias("source"), F.col(file).alias("file"), line.cast("int").alias("line"), "_n")

    security = findings.where("severity = 'HIGH' and surface <> 'quality'")
    large = functions.where(F.col("n_lines") > 100).select("file_id", "rel_path", "start_line").join(repo_of, "file_id")
    parts = [
        top(members.select("repo", "component").distinct(), "cycle", "HIGH", "component", nothing, "component"),
        top(risk.where("tier = 'high'"), "risk", "HIGH", "rel_path", nothing, F.desc("score"), "rel_path", "file_id"),
        top(security, "finding", "HIGH", "rel_path", F.col("line_no"), "rel_path", "file_id", "line_no", "rule"),
        top(gods, "god-module", "MED", "rel_path", nothing, "rel_path", "file_id"),
        top(coupled, "coupling", "MED", "module", nothing, F.desc("n"), "module"),
        top(large, "large-function", "MED", "rel_path", F.col("start_line"), "rel_path", "file_id", "start_line"),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    once = every.withColumn("_k", F.row_number().over(Window.partitionBy("repo", "file", "severity").orderBy("_s", "_n"))).where("_k = 1")
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.when(F.col("severity") == "HIGH", 0).otherwise(1), "_s", "_n"))
    return once.withColumn("rank", rank).where(F.col("rank") <= MOST_ISSUES).select("repo", "rank", "severity", "source", "file", "line")
