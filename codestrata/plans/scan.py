"""The whole scan of a corpus as lazy tables; only what a caller asks for is computed."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators import corpus, graph, patterns, risk, rules, taint
from codestrata.session import checkpointed, ship, spread
from codestrata.sources import config, manifests


class Scan:
    """``Scan(files).verdict()`` and the like; files has file_id, repo, rel_path and content."""

    def __init__(self, files: DataFrame, rule_pack: tuple = rules.RULES, threshold: float = risk.THRESHOLD):
        ship(files.sparkSession)
        self.all_files, self.rule_pack, self.threshold = files, rule_pack, threshold
        self.files = corpus.scanned(corpus.unignored(files))

    @cached_property
    def lined(self) -> DataFrame:
        return corpus.with_lines(spread(self.files.select("file_id", "repo", "rel_path", "content")))

    # facts that several results need are written once, as narrow rows in the checkpoint folder
    @cached_property
    def imports(self) -> DataFrame:
        return checkpointed(corpus.imports(self.lined))

    @cached_property
    def functions(self) -> DataFrame:
        return checkpointed(corpus.functions(self.lined))

    @cached_property
    def edges(self) -> DataFrame:
        return checkpointed(graph.package_edges(self.files, self.imports))

    @cached_property
    def risk(self) -> DataFrame:
        modules = graph.in_degrees(graph.edges(self.files, self.imports))
        return checkpointed(risk.risk_scores(self.lined, self.functions, corpus.todos(self.lined), modules, graph.module(F.col("rel_path"))))

    def patterns(self) -> DataFrame:
        return patterns.line_findings(self.lined)

    def reported(self) -> DataFrame:
        """Pattern findings that a scan reports, gated by the risk scores."""
        return patterns.reported(patterns.gated(self.patterns(), self.risk.where("tier <> 'low'")))

    def flows(self) -> DataFrame:
        return taint.flows(self.files)

    def config_hits(self) -> DataFrame:
        return rules.hits(config.resources(self.all_files), self.rule_pack)

    def dependencies(self) -> DataFrame:
        return manifests.lock_wins(manifests.dependencies(self.all_files))

    def _parts(self) -> tuple[DataFrame, ...]:
        return self.risk, self.functions, self.reported(), graph.cycle_members(self.edges), graph.coupling(self.edges), graph.god_modules(corpus.export_counts(self.lined))

    def verdict(self) -> DataFrame:
        return risk.verdicts(*self._parts(), self.threshold)

    def audit(self) -> DataFrame:
        return risk.audit_issues(*self._parts())
