"""Declarative rules over resource rows: sixteen conditions, compounds, elements, absence, duplicates, neighbours."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.session import checkpointed, small_side


@dataclass(frozen=True)
class Test:
    path: str
    condition: str
    value: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    """Fires on a resource of one of ``types`` where the test holds, all of ``all_of`` hold, and a group of ``any_of`` holds.

    ``element``: the tests look at each element of that list and one must fulfil them. ``unless``: a test that
    exempts. ``unless_type``: a resource of that type in the same file exempts. ``absent``: fires once for each file
    that has none of ``types`` (and one of ``requires``, if given). ``repeat``: duplicate or consecutive instructions.
    """

    id: str
    severity: str
    types: tuple[str, ...]
    test: Test | None = None
    all_of: tuple[Test, ...] = ()
    any_of: tuple[tuple[Test, ...], ...] = ()
    element: str = ""
    unless: Test | None = None
    unless_type: str = ""
    absent: bool = False
    requires: str = ""
    repeat: str = ""


def holds(v: Column, t: Test) -> Column:
    """A condition of two values, never null: what a missing value means is part of each condition."""
    return _condition(v, F.lit(t.condition), F.array(*[F.lit(x) for x in t.value]) if t.value else F.array().cast("array<string>"))


def _condition(v: Column, condition: Column, many: Column) -> Column:
    """The same for conditions and values that are columns, as where the rules are a table."""
    one, number = F.get(many, F.lit(0)), lambda c: F.trim(c).try_cast("double")
    table = {
        "missing": v.isNull(),
        "present": v.isNotNull(),
        "equals": v == one,
        "not-equals": v != one,
        "equals-or-missing": v.isNull() | (v == one),
        "is-true": F.lower(v) == "true",
        "is-false": F.lower(v) == "false",
        "not-true": v.isNull() | (F.lower(v) != "true"),
        "contains": F.contains(v, one),
        "matches": F.regexp_like(v, one),
        "not-matches": v.isNull() | ~F.regexp_like(v, one),
        "matches-any": F.exists(many, lambda p: F.regexp_like(v, p)),
        "in": F.array_contains(many, v),
        "not-in": ~F.array_contains(many, v),
        "lte": number(v) <= number(one),
        "gte": number(v) >= number(one),
    }
    case = None
    for name, test in table.items():
        case = case.when(condition == name, test) if case is not None else F.when(condition == name, test)
    return F.coalesce(case, F.lit(False))


TEST = "struct<path:string,condition:string,value:array<string>>"
PACK = f"rule_id string, severity string, resource_type string, groups array<array<{TEST}>>, unless array<{TEST}>, element string, unless_type string"


def as_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """Rules on attributes as rows (PACK), one for each type they look at: a group of tests must hold as a whole, any of the groups."""
    test = lambda t: (t.path, t.condition, list(t.value))
    rows = []
    for r in (r for r in rules if not r.absent and not r.repeat):
        every = [test(t) for t in r.all_of]
        groups = [[*every, *map(test, g)] for g in r.any_of] or [every or ([test(r.test)] if r.test else [])]
        rows += [(r.id, r.severity, t, groups, [test(r.unless)] if r.unless else [], r.element, r.unless_type) for t in r.types]
    return spark.createDataFrame(rows, PACK)


def attribute_hits(resources: DataFrame, pack: DataFrame) -> DataFrame:
    """Hits of the rules of a pack (PACK) on the resources of their types, with ``unless_type`` for the caller.

    An equi-join on the type, with the pack broadcast if it is small by count; so a pack of any size, read from a file or table,
    costs no code and meets only the resources it is about.
    """

    def fires(attrs):
        test = lambda t: _condition(F.try_element_at(attrs, t["path"]), t["condition"], t["value"])
        return F.exists("groups", lambda g: F.forall(g, test)) & ~F.exists("unless", test)

    met = resources.join(small_side(pack), "resource_type")
    some = F.when(F.col("element") == "", fires(F.col("attrs"))).otherwise(F.exists("items", lambda x: (x["path"] == F.col("element")) & fires(x["attrs"])))
    return met.where(some).select("file_id", "repo", "rel_path", "resource_type", "name", "start_line", "rule_id", "severity", "unless_type")


def hits(resources: DataFrame, rules: tuple[Rule, ...], pack: DataFrame | None = None) -> DataFrame:
    """(file_id, repo, rel_path, rule_id, severity, resource_type, name, start_line) of every rule that fires.

    Rules on attributes, those given and those of ``pack``, meet the resources of their types (``attribute_hits``); those on
    types of a file are anti-joins on (file, type); repeats are windows within a file. Rows are parsed once and kept
    in the checkpoint folder, since several of these read them.
    """
    resources = checkpointed(resources)
    keep = ["file_id", "repo", "rel_path", "resource_type", "name", "start_line"]
    own = as_table(resources.sparkSession, rules)
    found = attribute_hits(resources, own if pack is None else own.unionByName(pack))
    have = resources.select("file_id", F.col("resource_type").alias("unless_type")).distinct()
    found = found.where("unless_type = ''").unionByName(found.where("unless_type <> ''").join(have, ["file_id", "unless_type"], "left_anti").select(found.columns)).drop("unless_type")
    per_file = resources.groupBy("file_id", "repo", "rel_path").agg(F.collect_set("resource_type").alias("have"))  # types of one file
    for r in (r for r in rules if r.absent):
        lacks = ~F.arrays_overlap("have", F.array(*[F.lit(t) for t in r.types]))
        if r.requires:
            lacks = lacks & F.array_contains("have", r.requires)
        found = found.unionByName(per_file.where(lacks).select("file_id", "repo", "rel_path", F.lit(r.types[0]).alias("resource_type"), F.lit("").alias("name"), F.lit(1).alias("start_line"), F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity")))
    for r in (r for r in rules if r.repeat):
        w = Window.partitionBy("file_id").orderBy("start_line")
        if r.repeat == "duplicate":
            mine = resources.where(F.col("resource_type").isin(*r.types)).withColumn("n", F.row_number().over(w)).where("n > 1")
        else:
            parts = F.size(F.split(F.col("attrs")["value"], r"&&|;"))
            rows = resources.where("resource_type <> 'dockerfile'").withColumn("short", parts <= 2)
            last = F.lag(F.struct("resource_type", "short")).over(w)
            mine = rows.withColumn("last", last).where(F.col("resource_type").isin(*r.types) & (F.col("last.resource_type") == F.col("resource_type")) & F.col("short") & F.col("last.short"))
        found = found.unionByName(mine.select(*keep, F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity")).select(found.columns))
    return found


def as_findings(hits: DataFrame, engine: str = "RULES") -> DataFrame:
    """Rule hits in the shape of findings: (file_id, repo, engine, file, line, type, severity, description)."""
    text = F.concat(F.lit(f"[{engine}] "), F.col("rule_id"), F.lit(": "), F.col("resource_type"), F.lit(" "), F.col("name"))
    return hits.select("file_id", "repo", F.lit(engine).alias("engine"), F.col("rel_path").alias("file"), F.col("start_line").alias("line"), F.lit("edge-case").alias("type"), "severity", text.alias("description"))


PUBLIC = ("0.0.0.0/0", "::/0")
# Rules after public hardening guides; the first ones fit the resources of the test corpus.
RULES = (
    Rule("bucket-unencrypted", "HIGH", ("acme_bucket", "aws_s3_bucket"), Test("encrypted", "not-true")),
    Rule("bucket-untagged-owner", "LOW", ("acme_bucket",), Test("tags.owner", "missing")),
    Rule("bucket-literal-tier", "LOW", ("acme_bucket",), Test("tags.tier", "not-matches", (r"\$\{var\.",))),
    Rule("firewall-low-port", "MED", ("acme_firewall",), Test("from_port", "lte", ("512",)), element="ingress"),
    Rule("firewall-private-only", "LOW", ("acme_firewall",), Test("cidrs", "contains", ("10.0.0.0/8",)), element="ingress"),
    Rule("firewall-public", "HIGH", ("acme_firewall", "aws_security_group"), Test("cidrs", "matches-any", (r"0\.0\.0\.0/0", "::/0")), element="ingress"),
    Rule("firewall-without-bucket", "LOW", ("acme_bucket",), absent=True, requires="acme_firewall"),
    Rule("bucket-beside-firewall", "LOW", ("acme_bucket",), Test("name", "present"), unless_type="acme_firewall"),
    Rule("db-public", "HIGH", ("aws_db_instance",), Test("publicly_accessible", "is-true")),
    Rule("volume-unencrypted", "HIGH", ("aws_ebs_volume",), Test("encrypted", "not-true"), unless=Test("kms_key_id", "present")),
    Rule("queue-retention", "LOW", ("aws_sqs_queue",), any_of=((Test("message_retention_seconds", "missing"),), (Test("message_retention_seconds", "lte", ("60",)), Test("fifo_queue", "equals", ("true",))))),
    Rule("docker-latest", "MED", ("docker_from",), Test("tag", "equals", ("latest",)), unless=Test("digest", "present")),
    Rule("docker-no-user", "MED", ("docker_user",), absent=True, requires="dockerfile"),
    Rule("docker-no-healthcheck", "LOW", ("docker_healthcheck",), absent=True, requires="dockerfile"),
    Rule("docker-root", "HIGH", ("docker_user",), Test("value", "in", ("root", "0"))),
    Rule("docker-add", "LOW", ("docker_add",), Test("value", "not-matches", (r"^https?://|\.tar",))),
    Rule("docker-ssh-port", "LOW", ("docker_expose",), Test("value", "matches", (r"(^|\s)22(/tcp)?(\s|$)",))),
    Rule("docker-second-cmd", "MED", ("docker_cmd",), repeat="duplicate"),
    Rule("docker-runs-apart", "LOW", ("docker_run",), repeat="consecutive"),
)
