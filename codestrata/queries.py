"""Queries of the core; each takes (spark, data folder) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.functions.paths import corpus_fingerprint, relative_uri
from codestrata.operators import corpus, drift, findings, fixes, graph, nested, patterns, risk, rules, scoring, taint
from codestrata.plans.scan import Scan
from codestrata.session import checkpointed, read_table, spread
from codestrata.sources import config, manifests


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.changes(read_table(spark, sf, "result_files"))


def p3_runs(spark: SparkSession, sf: str) -> DataFrame:
    return drift.ingest(read_table(spark, sf, "result_files"))


def _children(spark: SparkSession, sf: str):
    reports = read_table(spark, sf, "reports")
    plan = nested.analyse(reports, "kind", "body")
    return nested.child_records(reports, "report_id", "kind", "body", plan), plan


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _children(spark, sf)[0].select("report_id", "child_path")


def _child_table(kind: str, node: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        records, plan = _children(spark, sf)
        return nested.child_table(records, plan, kind, node)

    return query


def p4_graph(spark: SparkSession, sf: str) -> DataFrame:
    return nested.schema_graph(read_table(spark, sf, "reports"), "kind", "body")


def _lined(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.with_lines(spread(corpus.scanned(read_table(spark, sf, "files")).select("file_id", "repo", "rel_path", "content")))


def loc_per_file(spark, sf):
    f = corpus.scanned(read_table(spark, sf, "files"))
    return f.select("file_id", corpus.language(F.col("rel_path")).alias("lang"), corpus.loc(F.col("content")).alias("n_lines"))


def language_loc(spark, sf):
    return loc_per_file(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_lines").alias("n_lines"))


def line_explode(spark, sf):
    lined = _lined(spark, sf)
    return lined.select("file_id", F.posexplode("lines").alias("pos", "line")).select("file_id", (F.col("pos") + 1).alias("line_no"), F.length("line").alias("n_chars"))


def extract_imports(spark, sf):
    return corpus.imports(_lined(spark, sf)).drop("repo")


def extract_classes(spark, sf):
    return corpus.classes(_lined(spark, sf))


def extract_todos(spark, sf):
    return corpus.todos(_lined(spark, sf))


def extract_functions(spark, sf):
    return corpus.functions(_lined(spark, sf))


def export_counts(spark, sf):
    return corpus.export_counts(_lined(spark, sf)).drop("repo")


def god_modules(spark, sf):
    return graph.god_modules(corpus.export_counts(_lined(spark, sf))).drop("repo")


def flagged_functions(spark, sf):
    return corpus.flagged(corpus.functions(_lined(spark, sf)))


def unsupported_files(spark, sf):
    return corpus.unsupported(corpus.scanned(read_table(spark, sf, "files")))


def scan_metrics(spark, sf):
    lined = _lined(spark, sf)
    return corpus.metrics(lined, corpus.functions(lined), corpus.todos(lined))


def pattern_findings(spark, sf):
    return patterns.line_findings(_lined(spark, sf)).select("file_id", "rule", "type", "severity", "line_no")


def findings_by_type(spark, sf):
    f = patterns.line_findings(_lined(spark, sf)).where(~F.col("rel_path").rlike(patterns.TEST_FILE))
    return f.groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_id").alias("n_files"))


def dedup_near_findings(spark, sf):
    return patterns.dedup_near(patterns.line_findings(_lined(spark, sf))).drop("repo", "rel_path", "surface")


def missing_guards(spark, sf):
    lined = _lined(spark, sf)
    scores = _risk(spark, sf)[0].where("tier <> 'low'")
    return patterns.guards(patterns.reported(patterns.gated(patterns.line_findings(lined), scores)))


def _edges(spark, sf):
    files = corpus.scanned(read_table(spark, sf, "files"))
    return graph.edges(files, corpus.imports(corpus.with_lines(files)))


def _packages(spark, sf):
    files = corpus.scanned(read_table(spark, sf, "files"))
    return graph.package_edges(files, corpus.imports(corpus.with_lines(files)))


def dep_edges(spark, sf):
    return _edges(spark, sf)


def package_edges(spark, sf):
    return _packages(spark, sf)


def package_in_degrees(spark, sf):
    return graph.in_degrees(_packages(spark, sf))


def package_importers(spark, sf):
    return graph.reverse(_packages(spark, sf)).select("repo", "module", F.array_join("imported_by", ",").alias("imported_by"), "n")


def import_counts(spark, sf):
    return graph.in_degrees(_edges(spark, sf))


def coupled_modules(spark, sf):
    return graph.coupling(_edges(spark, sf))


def cycle_members(spark, sf):
    return graph.cycle_members(_packages(spark, sf))


def reachability(spark, sf):
    e = checkpointed(_packages(spark, sf))  # read once a round
    return graph.reachable(e, e.select("repo", F.col("src").alias("module")))


def causal_chains(spark, sf):
    e = _packages(spark, sf)
    return graph.causal_chains(graph.cycle_members(e), graph.coupling(e), graph.god_modules(corpus.export_counts(_lined(spark, sf))))


def _event_edges(spark, sf):
    """Each user's steps from one type of event to another, as a graph that has cycles."""
    e = read_table(spark, sf, "events").select(F.col("user_id").cast("string").alias("repo"), "event_type", "ts", "event_id")
    step = F.lead("event_type").over(Window.partitionBy("repo").orderBy("ts", "event_id"))
    return e.select("repo", F.col("event_type").alias("src"), step.alias("dst")).where("src <> dst").distinct()


def event_cycle_members(spark, sf):
    return graph.cycle_members(checkpointed(_event_edges(spark, sf)))


def event_cycles(spark, sf):
    e = checkpointed(_event_edges(spark, sf))
    return graph.cycles(e, graph.cycle_members(e)).select("repo", "root", "n_modules", (F.size("path") - 1).alias("n_steps"))


def event_reachability(spark, sf):
    e = checkpointed(_event_edges(spark, sf))
    return graph.reachable(e, e.select("repo", F.col("src").alias("module")).distinct())


def _risk(spark, sf):
    lined = _lined(spark, sf)
    fns = corpus.functions(lined)
    return risk.risk_scores(lined, fns, corpus.todos(lined), graph.in_degrees(_edges(spark, sf)), graph.module(F.col("rel_path"))), lined, fns


def risk_scores(spark, sf):
    return _risk(spark, sf)[0].drop("repo", "rel_path")


def risk_tiers(spark, sf):
    return _risk(spark, sf)[0].groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def verdict(spark, sf):
    return Scan(read_table(spark, sf, "files")).verdict()


def audit_issues(spark, sf):
    return Scan(read_table(spark, sf, "files")).audit()


def _delivered(spark, sf):
    return findings.delivered(spread(read_table(spark, sf, "findings").select(*findings.DELIVERED)))


def finding_ids(spark, sf):
    return findings.classified(_delivered(spark, sf)).select("ord", "finding_id")


def cwe_primary(spark, sf):
    return findings.classified(_delivered(spark, sf)).select("ord", "cwe", "surface", "level")


def cwe_counts(spark, sf):
    c = findings.classified(_delivered(spark, sf))
    # an inner generator would push a filter on the array, and with it the whole ladder, below this projection
    return c.select(F.explode_outer("cwes").alias("cwe"), "repo").where("cwe is not null").groupBy("cwe").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("repo").alias("n_repos"))


def surface_split(spark, sf):
    c = findings.classified(_delivered(spark, sf))
    return c.groupBy("surface", "is_test", "severity").agg(F.count(F.lit(1)).alias("n"))


def dedup_first_wins(spark, sf):
    return findings.first_of(_delivered(spark, sf).select("scan_id", "file", "line", "type", "description", "ord"), ["scan_id", "file", "line", "type", "description"])


def merge_findings(spark, sf):
    d = _delivered(spark, sf).select("scan_id", "file", "line", "type", "description", "ord", "source")
    keys = ["scan_id", "file", "line", "type", "description"]
    return findings.merged(d.where("source = 'PULSAR'"), d.where("source <> 'PULSAR'"), keys).select("ord", "scan_id", "source")


def fix_diff(spark, sf):
    c = findings.classified(_delivered(spark, sf))
    before, after = (c.where(F.pmod("scan_id", F.lit(2)) == k) for k in (0, 1))
    return findings.difference(before, after)


def top_issues(spark, sf):
    return findings.top_issues(_delivered(spark, sf))


def sarif_results(spark, sf):
    return findings.sarif_results(findings.classified(_delivered(spark, sf)))


def sarif_rules(spark, sf):
    return findings.sarif_rules(findings.classified(_delivered(spark, sf)))


def weakness_candidates(spark, sf):
    return scoring.candidates(_delivered(spark, sf), read_table(spark, sf, "weaknesses"))


def band_match_candidates(spark, sf):
    """Every engine's findings against the first pattern finding of each file and type, as if that were labelled."""
    d = _delivered(spark, sf)
    labels = findings.first_of(d.where("source = 'PULSAR' and file is not null").select("repo", "file", "type", "line", "ord"), ["repo", "file", "type"])
    labels = labels.select(F.col("repo").alias("corpus"), "type", F.col("ord").cast("string").alias("id"), "file", "line", F.lit("file").alias("scope"))
    return scoring.candidates(d, labels)


def precision_recall(spark, sf):
    return scoring.scored(_delivered(spark, sf), read_table(spark, sf, "weaknesses"))


def harmonic_f1(spark, sf):
    return scoring.harmonic_f1(read_table(spark, sf, "scores"))


def leaderboard(spark, sf):
    return scoring.leaderboard(read_table(spark, sf, "scores"))


def run_variance(spark, sf):
    return scoring.run_variance(read_table(spark, sf, "runs"))


def taint_flows(spark, sf):
    f = taint.flows(corpus.scanned(read_table(spark, sf, "files")))
    return f.select("file_id", "line", "type", "danger", "source", "sink", F.size("flow").alias("n_steps"))


def taint_findings(spark, sf):
    return taint.as_findings(taint.flows(corpus.scanned(read_table(spark, sf, "files"))))


def taint_not_analysed(spark, sf):
    return taint.not_analysed(corpus.scanned(read_table(spark, sf, "files")))


def manifest_dependencies(spark, sf):
    return manifests.lock_wins(manifests.dependencies(read_table(spark, sf, "files").where("rel_path is not null")))


def rule_findings(spark, sf):
    return rules.as_findings(rule_hits(spark, sf))


def config_resources(spark, sf):
    return config.resources(read_table(spark, sf, "files")).select("file_id", "resource_type", "name", "start_line", F.size("attrs").alias("n_attrs"))


def rule_hits(spark, sf):
    return rules.hits(config.resources(read_table(spark, sf, "files")), rules.RULES)


#: Rules on the events table, one for each condition; SQL states each of them by itself.
EVENT_TESTS = {
    "missing": (), "present": (), "equals": ("7",), "not-equals": ("7",), "equals-or-missing": ("7",), "is-true": (), "is-false": (), "not-true": (), "contains": ("4",), "matches": ("^[1-3]$",),
    "not-matches": ("^[1-3]$",), "matches-any": ("^1", "9$"), "in": ("1", "2", "50"), "not-in": ("1", "2", "50"), "lte": ("20",), "gte": ("80",),
}


def rule_conditions(spark, sf):
    e = read_table(spark, sf, "events")
    attrs = F.from_json("props", "map<string,string>")
    fired = [F.struct(F.lit(c).alias("condition"), rules.holds(F.try_element_at(attrs, F.lit("k")), rules.Test("k", c, v)).alias("fires")) for c, v in EVENT_TESTS.items()]
    long = e.select("event_type", F.explode(F.array(*fired)).alias("c"))
    return long.groupBy("event_type", F.col("c.condition").alias("condition")).agg(F.count_if(F.col("c.fires")).alias("n"))


def fix_proposals(spark, sf):
    files = corpus.scanned(read_table(spark, sf, "files"))
    return fixes.proposals(patterns.line_findings(corpus.with_lines(files)), files)


def fingerprints(spark, sf):
    return corpus_fingerprint(read_table(spark, sf, "files"))


def relative_uris(spark, sf):
    f = read_table(spark, sf, "files")
    return f.select("file_id", relative_uri(F.col("path"), F.lit("/srv/checkout")).alias("uri"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [
        p3_found, p3_runs, p4_found, p4_graph, loc_per_file, language_loc, line_explode, extract_imports, extract_classes, extract_todos, extract_functions, export_counts, god_modules, flagged_functions, unsupported_files, scan_metrics, missing_guards, audit_issues, event_cycle_members, event_cycles, event_reachability,
        pattern_findings, findings_by_type, dedup_near_findings, dep_edges, package_edges, package_in_degrees, package_importers, import_counts, coupled_modules, cycle_members, reachability, causal_chains, risk_scores, risk_tiers, verdict,
        finding_ids, cwe_primary, cwe_counts, surface_split, dedup_first_wins, merge_findings, fix_diff, top_issues, sarif_results, sarif_rules, weakness_candidates, band_match_candidates, precision_recall,
        harmonic_f1, leaderboard, run_variance, taint_flows, taint_findings, taint_not_analysed, rule_findings, manifest_dependencies, config_resources, rule_hits, rule_conditions, fix_proposals, fingerprints, relative_uris,
    ]
    return {f.__name__: f for f in plain} | {
        "p4_targets": _child_table("receipts", "/*"),
        "p4_receipt_findings": _child_table("receipts", "/*/findings"),
        "p4_taint_findings": _child_table("taint", "/findings"),
        "p4_flow_steps": _child_table("taint", "/findings/flow"),
        "p4_tools": _child_table("leaderboard", "/tools"),
        "p4_scores": _child_table("leaderboard", "/tools/scores"),
        "p4_true_positives": _child_table("leaderboard", "/tools/scores/tpDetails"),
        "p4_false_positives": _child_table("leaderboard", "/tools/scores/fpDetails"),
        "p4_false_negatives": _child_table("leaderboard", "/tools/scores/fnDetails"),
    }
