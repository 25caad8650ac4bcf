"""Pattern findings: a table of line rules with context windows, compiled to expressions over lines and slices of their file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators import corpus


@dataclass(frozen=True)
class Rule:
    """A line matches ``has`` and not ``lacks``; the window of lines (from, to) around it holds none of ``no`` and one of ``some``.

    ``part``: what its first group captures (empty where it doesn't match) matches ``part_some`` and not ``part_no``, and its whole match not ``whole_no``.
    ``langs``: languages the rule is for, or with a leading minus those it isn't for. ``stage``: order of the detectors' groups.
    """

    name: str
    stage: int
    type: str
    severity: str
    tier: str
    surface: str
    has: str
    langs: str = ""
    lacks: str = ""
    window: tuple[int, int] = (0, 0)
    no: str = ""
    some: str = ""
    part: str = ""
    part_some: str = ""
    part_no: str = ""
    whole_no: str = ""


COMMENT = r"^\s*(//|\*)"
INPUT = r"(?i)req\.|process\.argv|params\.|query\.|body\.|input|user|payload|data"
EVAL = r"\beval\s*\(\s*(.{0,80})"
DECLARED = r"(?i)(?:^|[\s,(])(?:const|let|var|export\s+const)\s+\w*(?:secret|apikey|api_key|token|password|passwd|credential|hmac|signing)\w*\s*[=:]\s*['\"`]([^'\"`]{20,})['\"`]"
ASSIGNED = r"(?i)\b(?:secret|apikey|api_key|hmac_?secret|signing_?secret|jwt_?secret|session_?secret)\s*[:=]\s*['\"`]([^'\"`]{20,})['\"`]"
HEX = r"(?i)(?:^|[\s,(])(?:const|let|var|export\s+const)\s+\w*(?:secret|key|token|hash|salt|hmac|seed)\w*\s*=\s*['\"`]([0-9a-fA-F]{32,})['\"`]"
NO_SECRET = r"(?i)placeholder|changeme|your_key|example|XXXXXX|insert_|test_|<YOUR|TODO|FIXME|default_config_label|\(UUID:|providerToken|UuidFactory|^[0-9a-f]{8}-[0-9a-f]{4}-|^https?://|::|^[a-z0-9_.:-]+:[a-z0-9_.:-]+$|Max-Age=|HttpOnly|SameSite=|\$\{|\bencode\s*\("
NO_STORE = r"(?i)(STORAGE_KEY|_UID\b|_SCOPE\b|TOKEN_UID|TOKEN_SCOPE)"
CRYPTO = r"\.create(?:Hmac|Cipher|CipherIv|Sign|Verify)\s*\([^)]*,\s*['\"`]([^'\"`]{8,})['\"`]"
# Detectors; sec runs on all but test files, qual on files of medium or high risk.
RULES = (
    Rule("async-without-boundary", 0, "async-race", "HIGH", "qual", "quality", r"async\s+function|=\s*async\s*\(|=\s*async\s+\w+\s*=>|async\s+\w+\s*\(", window=(0, 29), no=r"try|\.catch\(|Result<", some=r"await |\.then\("),
    Rule("promise-without-catch", 0, "error-boundary", "MED", "qual", "quality", r"\.then\(", window=(0, 4), no=r"\.catch\("),
    Rule("force-unwrap", 1, "null-safety", "HIGH", "qual", "quality", r"\w+!\.\w+|\w+!\s*[,)\]\s]", "-typescript", lacks=r"^\s*//"),
    Rule("deep-access", 1, "null-safety", "LOW", "qual", "quality", r"\w+\.\w+\.\w+", "-typescript", lacks=r"\?\.|\|\||&&|^\s*//|^\s*\*", window=(0, 0), some=r"(?:const|let|var)\s+\w+\s*=|return\s+"),
    Rule("literal-index", 2, "edge-case", "LOW", "qual", "security", r"\[\s*\d+\s*\]", window=(-2, -1), no=r"\bguard\b|\bif\b"),
    Rule("division", 2, "edge-case", "LOW", "qual", "quality", r"\w\s*/\s*\w", lacks=r"typeof|length|^\s*//|^\s*\*", some=r"/\s*\w(\w|\s*($|[^\s=!<>]))"),
    Rule("bare-json-parse", 3, "error-boundary", "MED", "sec", "quality", r"JSON\.parse\(", "typescript javascript", window=(-3, 2), no=r"try"),
    Rule("throwing-call", 3, "error-boundary", "MED", "sec", "quality", r"\w+\(.*\)", "swift", lacks=r"try|//", window=(-1, -1), some=r"throws"),
    Rule("eval-of-input", 4, "injection", "HIGH", "sec", "security", r"\beval\s*\(", lacks=COMMENT, part=EVAL, part_some=INPUT),
    Rule("eval", 4, "injection", "MED", "sec", "security", r"\beval\s*\(", lacks=COMMENT, part=EVAL, part_no=INPUT),
    Rule("where-clause", 4, "injection", "HIGH", "sec", "security", r"\$where", lacks=COMMENT, some=r"`.*\$\{|\$\{.*`|['\"]\s*\+"),
    Rule("regexp-of-input", 4, "injection", "MED", "sec", "quality", r"new\s+RegExp\s*\(", lacks=COMMENT, part=r"new\s+RegExp\s*\(\s*(.{0,80})", part_no=r"^\s*['\"]"),
    Rule("private-key", 5, "hardcoded-secret", "HIGH", "sec", "security", r"-----BEGIN", lacks=COMMENT, some=r"PRIVATE KEY|RSA PRIVATE|EC PRIVATE|DSA PRIVATE"),
    Rule("cloud-key-id", 5, "hardcoded-secret", "HIGH", "sec", "security", r"AKIA[0-9A-Z]{16}", lacks=COMMENT),
    Rule("live-payment-key", 5, "hardcoded-secret", "HIGH", "sec", "security", r"sk_live_[a-zA-Z0-9]{20,}", lacks=COMMENT),
    Rule("named-secret", 5, "hardcoded-secret", "HIGH", "sec", "security", DECLARED, lacks=COMMENT, part=DECLARED, part_no=NO_SECRET, whole_no=NO_STORE),
    Rule("assigned-secret", 5, "hardcoded-secret", "HIGH", "sec", "security", ASSIGNED, lacks=COMMENT + "|" + DECLARED, part=ASSIGNED, part_no=NO_SECRET, whole_no=NO_STORE),
    Rule("hex-key", 5, "hardcoded-secret", "HIGH", "sec", "security", HEX, lacks=COMMENT + "|" + DECLARED + "|" + ASSIGNED),
    Rule("literal-crypto-key", 5, "hardcoded-secret", "HIGH", "sec", "security", CRYPTO, lacks=COMMENT, part=CRYPTO, part_no=r"(?i)placeholder|changeme|example|XXXXXX|test_"),
)
# Test files that security detectors skip; test and fixture paths whose findings are not reported.
TEST_FILE = r"\.(spec|test)\.[jt]sx?$|(^|/)(__tests__|e2e|cypress|tests?)/"
NOT_PRODUCT = r"(?i)(^|/)(test|tests|spec|specs|e2e|__tests__|__mocks__|fixtures?|benchmarks?|bench|stories)/|\.(spec|test|e2e)\.[cm]?[jt]sx?$|(^|/)(vitest|jest)[-.]setup\."
#: Languages without reliable extraction, and documentation, have no findings.
NOT_READ = tuple(g.name for g in corpus.LANGUAGES if not g.extracted and g.name != "dockerfile")


def applies(rule: Rule):
    """The rule's languages as a condition on ``lang``."""
    if not rule.langs:
        return F.lit(True)
    return F.col("lang") != rule.langs[1:] if rule.langs[0] == "-" else F.col("lang").isin(*rule.langs.split())


def _holds(rule: Rule):
    line = F.col("line")
    out = applies(rule) & line.rlike(rule.has)
    if rule.lacks:
        out = out & ~line.rlike(rule.lacks)
    if rule.no or rule.some:
        a, b = rule.window
        first = F.greatest(F.lit(1), F.col("line_no") + a)
        text = line if (a, b) == (0, 0) else F.array_join(F.slice("lines", first, F.greatest(F.lit(0), F.col("line_no") + b - first + 1)), "\n")
        if rule.no:
            out = out & ~text.rlike(rule.no)
        if rule.some:
            out = out & text.rlike(rule.some)
    if rule.part:
        part = F.regexp_extract(line, rule.part, 1)
        if rule.part_some:
            out = out & part.rlike(rule.part_some)
        if rule.part_no:
            out = out & ~part.rlike(rule.part_no)
        if rule.whole_no:
            out = out & ~F.regexp_extract(line, rule.part, 0).rlike(rule.whole_no)
    return out


def line_findings(lined: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(file_id, repo, rel_path, detector int, stage int, rule, type, severity, tier, surface, line_no) of every rule that a line matches.

    Lines become rows; those that no rule's ``has`` matches are dropped before any window is looked at, so windows are cut for
    few lines only. Nothing is shuffled. Markdown and languages that are not extracted give none. Test files are left
    to the caller.
    """
    some = F.lit(False)
    for r in rules:
        some = some | (applies(r) & F.col("line").rlike(r.has))
    read = lined.where(F.col("lang").isNotNull() & ~F.col("lang").isin(*NOT_READ))
    candidates = corpus.as_rows(read, "lines").where(some)
    hits = F.array(*[F.when(_holds(r), F.lit(k)) for k, r in enumerate(rules)])
    found = candidates.select("file_id", "repo", "rel_path", "line_no", F.explode_outer(F.array_compact(hits)).alias("detector")).where("detector is not null")
    table = F.array(*[F.struct(*[F.lit(getattr(r, c)).alias(c) for c in ("stage", "name", "type", "severity", "tier", "surface")]) for r in rules])
    row = F.element_at(table, F.col("detector") + 1)
    return found.select("file_id", "repo", "rel_path", "detector", row["stage"].alias("stage"), row["name"].alias("rule"), *[row[c].alias(c) for c in ("type", "severity", "tier", "surface")], "line_no")


def gated(findings: DataFrame, qualified: DataFrame) -> DataFrame:
    """Security findings of all but test files and quality findings of the qualified files (file_id) only."""
    sec = findings.where((F.col("tier") == "sec") & ~F.col("rel_path").rlike(TEST_FILE))
    return sec.unionByName(findings.where("tier = 'qual'").join(qualified.select("file_id"), "file_id", "left_semi"))


def dedup_near(findings: DataFrame) -> DataFrame:
    """The first finding of each file, type and block of three lines, in the order of stages, lines and detectors."""
    block = F.floor(F.col("line_no") / 3)
    first = findings.groupBy("file_id", "type", block.alias("block")).agg(F.min(F.struct("stage", "line_no", "detector", "repo", "rel_path", "rule", "severity", "surface")).alias("f"))
    return first.select("file_id", "f.repo", "f.rel_path", "type", "f.line_no", "f.rule", "f.severity", "f.surface")


def reported(findings: DataFrame) -> DataFrame:
    """What a scan reports of gated findings: the first of near ones, without those of test and fixture paths."""
    return dedup_near(findings).where(~F.col("rel_path").rlike(NOT_PRODUCT))


def guards(reported: DataFrame) -> DataFrame:
    """(repo, n_async, n_null, n_boundary, n_injection, n_secret, n_eval, n_where, n_regexp, n_unwrap, n_json): counts behind missing guards and recommendations."""
    of_type = {"n_async": "async-race", "n_null": "null-safety", "n_boundary": "error-boundary", "n_injection": "injection", "n_secret": "hardcoded-secret"}
    of_rule = {"n_eval": "eval-of-input", "n_where": "where-clause", "n_regexp": "regexp-of-input", "n_unwrap": "force-unwrap", "n_json": "bare-json-parse"}
    counts = [F.count_if(F.col("type") == v).alias(k) for k, v in of_type.items()] + [F.count_if(F.col("rule") == v).alias(k) for k, v in of_rule.items()]
    return reported.groupBy("repo").agg(*counts)
