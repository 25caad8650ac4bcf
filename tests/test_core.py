import random
import re

import pytest
from pyspark.sql import functions as F

from codestrata import queries
from codestrata.functions import paths
from codestrata.operators import corpus, findings, fixes, graph, patterns, risk, rules, scoring, taint, weakness
from codestrata.plans.scan import Scan
from codestrata.sources import config, manifests
from codestrata.sources.tree import read_tree
from codestrata.streaming import scan_stream

FILES = "file_id long, repo string, path string, rel_path string, content string"


def _files(spark, texts, repo="r"):
    return spark.createDataFrame([(i, repo, f"/x/{p}", p, t) for i, (p, t) in enumerate(texts.items())], FILES)


CORPUS = {
    "src/a.js": "import b from './b';\nimport { c } from './lib/index.js';\nexport async function f(x, y) {\n  // TODO: fix\n  if (x && y) { return JSON.parse(x); }\n  const k = eval(req.body.code);\n}\n",
    "src/b.js": "import a from './a';\nexport class B {}\nconst apiToken = 'abcdefghij0123456789xyz';\nfunction g() {\n  return fetch(u).then(r => r)\n}\n",
    "src/lib/index.js": "import up from '../other/q.js';\nexport const one = 1;\n",
    "src/other/q.js": "import l from '../lib/index.js';\n",
    "src/a_test.js": "import a from './a';\neval(req.body.x)\n",
    "node_modules/x/i.js": "eval(req.body.x)\n", "dist/w.min.js": "eval(1)", "e.py": "", "n.py": None, "doc.md": "# TODO\n", "Dockerfile": "FROM x\n",
}


def test_scan_extracts(spark):
    f = _files(spark, CORPUS)
    names = {r["rel_path"] for r in corpus.scanned(f, patterns=("src/other/",)).collect()}
    assert names == {"src/a.js", "src/b.js", "src/lib/index.js", "src/a_test.js", "e.py", "n.py", "doc.md", "Dockerfile"}
    lined = corpus.with_lines(corpus.scanned(f))
    assert {r["rel_path"]: r["n_lines"] for r in lined.collect()} == {"src/a.js": 7, "src/b.js": 6, "src/lib/index.js": 2, "src/other/q.js": 1, "src/a_test.js": 2, "e.py": 0, "n.py": 0, "doc.md": 1, "Dockerfile": 1}
    fn = {r["name"]: (r["start_line"], r["end_line"], r["complexity"], r["is_async"], r["n_params"]) for r in corpus.functions(lined).collect()}
    assert fn == {"f": (3, 7, 3, True, 2), "g": (4, 6, 1, False, 0)}
    assert sorted((r["rel_path"], r["kind"]) for r in corpus.todos(lined).collect()) == [("doc.md", "TODO"), ("src/a.js", "TODO")]
    assert [(r["kind"], r["name"]) for r in corpus.classes(lined).collect()] == [("class", "B")]
    e = {(r["src"], r["dst"]) for r in graph.edges(corpus.scanned(f), corpus.imports(lined)).collect()}
    assert e == {("src/a", "src/b"), ("src/b", "src/a"), ("src/a", "src/lib/index"), ("src/lib/index", "src/other/q"), ("src/other/q", "src/lib/index"), ("src/a_test", "src/a")}
    p = {(r["src"], r["dst"]) for r in graph.package_edges(corpus.scanned(f), corpus.imports(lined)).collect()}
    assert p == {("src", "src/lib"), ("src/lib", "src/other"), ("src/other", "src/lib")}


HEADS = {
    "a.ts": "export const add = async (a: number, b: number) => {\n  if (a) {\n    return b ? a : b;\n  }\n};\nclass C {\n  private run(x: string): void {\n    for (;;) {}\n  }\n  constructor(y) {\n  }\n}\n",
    "b.py": "def f(a):\n    return {a: 1}\n\nasync def g():\n    pass\n", "c.c": "static int f(int a) {\n  return a ? 1 : 2;\n}\nint g(int a)\n{\n}\n", "d.go": "func (s *T) Do(x int) error {\n\tif x > 1 || x < 0 {\n\t}\n}\n",
    "e.cpp": "int f(int a) {\n}\n", "long.js": "function open() {\n" + "a();\n" * 600 + "}\n",
}


def test_function_heads_and_ends(spark):
    got = {(r["rel_path"], r["name"], r["start_line"], r["end_line"], r["complexity"], r["n_params"]) for r in corpus.functions(corpus.with_lines(corpus.scanned(_files(spark, HEADS)))).collect()}
    assert got == {
        ("a.ts", "add", 1, 5, 3, 2), ("a.ts", "run", 7, 9, 2, 1), ("b.py", "f", 1, 2, 1, 1), ("b.py", "g", 4, 4, 1, 0), ("c.c", "f", 1, 3, 2, 1), ("d.go", "Do", 1, 4, 3, 1), ("long.js", "open", 1, 1, 1, 0),
    }


def test_content_is_split_once(spark):
    lined = corpus.with_lines(corpus.scanned(_files(spark, HEADS)))
    for df in (corpus.functions(lined), corpus.imports(lined), corpus.todos(lined), patterns.line_findings(lined)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("split(regexp_replace(coalesce(content") == 1


def test_ignore_files(spark):
    f = _files(spark, {".gitignore": "# c\n/gen/\n*.log\n\nskip.py\r\n", "gen/a.py": "", "x/gen/b.py": "", "generic.py": "", "x/skip.py": "", "keep.py": ""}).unionByName(_files(spark, {"gen/c.py": ""}, "other"))
    assert {(r["repo"], r["rel_path"]) for r in corpus.unignored(f).collect()} == {("r", ".gitignore"), ("r", "keep.py"), ("other", "gen/c.py")}


def test_counts_of_unsupported_files_and_flags(spark):
    f = corpus.scanned(_files(spark, {"a.cpp": "x\ny\n", "b.tf": "a\n", "Dockerfile": "FROM x\n", "c.py": "x\n", "d.md": "x\n"}))
    assert {(r["extension"], r["n_files"], r["n_lines"]) for r in corpus.unsupported(f).collect()} == {("cpp", 1, 2), ("tf", 1, 1), ("", 1, 1)}
    big = _files(spark, {"big.js": "function f() {\n" + "if (a) b();\n" * 101 + "}\n"})
    assert [(r["n_lines"], r["complexity"], r["is_large"], r["is_complex"]) for r in corpus.flagged(corpus.functions(corpus.with_lines(big))).collect()] == [(103, 102, True, True)]


CYCLES = {
    "line": ("ab bc cd", ""), "two": ("ab ba", "ab"), "three": ("ab bc ca", "abc"), "diamond": ("ab ac bd cd", ""), "embedded": ("xa ab bc cb cy", "bc"), "between": ("ab ba bm mc cd dc", "abcd"), "nothing": ("", ""), "figure": ("ab bc ca ad de ea", "abcde"),
}
PATHS = {"two": ["aba"], "three": ["abca"], "embedded": ["bcb"], "between": ["aba", "cdc"], "figure": ["abca"]}


@pytest.mark.parametrize("case", list(CYCLES))
def test_cycles(spark, case):
    text, want = CYCLES[case]
    e = spark.createDataFrame([("r", s[0], s[1]) for s in text.split()] + [(x, "p", "q") for x in text.split()[:1]], "repo string, src string, dst string")
    members = graph.cycle_members(e)
    assert {r["module"] for r in members.collect()} == set(want)
    assert sorted("".join(r["path"]) for r in graph.cycles(e, members).collect()) == PATHS.get(case, [])
    if not text:
        return
    far = {(r["start"], r["module"]): r["hops"] for r in graph.reachable(e, e.select("repo", F.col("src").alias("module"))).collect()}
    assert far[text[0], text[1]] == 1 and far[text[0], text[0]] == 0


def test_reachability_of_long_chains(spark, tmp_path):
    n = 15
    rows = [(i, "r", f"/r/p{i}/a.js", f"p{i}/a.js", "javascript", 1, f"import x from '../p{i + 1}/a.js'\n") for i in range(n)]
    rows.append((n, "r", f"/r/p{n}/a.js", f"p{n}/a.js", "javascript", 1, "const x = 1;\n"))
    files = spark.createDataFrame(rows, "file_id long, repo string, path string, rel_path string, language string, lines int, content string")
    files.write.parquet(str(tmp_path / "files.parquet"))
    got = {(r["start"], r["module"]): r["hops"] for r in queries.reachability(spark, str(tmp_path)).collect()}
    assert got == {(f"p{i}", f"p{j}"): j - i for i in range(n) for j in range(i, n + 1)}


@pytest.mark.parametrize(("lines", "exports", "want"), [(499, 9, 0), (500, 9, 0), (501, 8, 0), (501, 9, 1), (501, 50, 1)])
def test_god_modules(spark, lines, exports, want):
    df = spark.createDataFrame([(1, "a.ts", lines, exports)], "file_id long, rel_path string, n_lines int, n_exports int")
    assert graph.god_modules(df).count() == want


def test_patterns_and_gates(spark):
    lined = corpus.with_lines(corpus.scanned(_files(spark, CORPUS)))
    hit = patterns.line_findings(lined)
    got = {(r["rel_path"], r["rule"], r["line_no"]) for r in hit.collect()}
    assert got == {("src/a.js", "bare-json-parse", 5), ("src/a.js", "eval-of-input", 6), ("src/b.js", "named-secret", 3), ("src/b.js", "promise-without-catch", 5), ("src/a_test.js", "eval-of-input", 2)} | {
        ("src/a.js", "deep-access", 6), ("src/lib/index.js", "division", 1), ("src/other/q.js", "division", 1), ("src/a.js", "division", 2),
    }
    ids = lined.where("rel_path = 'src/a.js'")
    assert {r["rule"] for r in patterns.gated(hit, ids).collect()} == {"bare-json-parse", "eval-of-input", "named-secret", "deep-access", "division"}
    near = spark.createDataFrame([(1, "r", "a", 0, 5, "x", "t", "LOW", "sec", "security", n) for n in (3, 5, 6)], hit.schema)
    assert sorted(r["line_no"] for r in patterns.dedup_near(near).collect()) == [3, 6]


DETECTED = {
    "async-without-boundary": ("a.js", "const f = async x => {\n  await g(x);\n};\n", "const f = async x => {\n  try { await g(x); } finally {}\n};\n"), "promise-without-catch": ("a.ts", "a().then(b)\n", "a().then(b)\n  .catch(c)\n"),
    "force-unwrap": ("a.swift", "let x = y! + 1\n", "// y! + 1\n"), "deep-access": ("a.js", "const x = a.b.c;\n", "const x = a?.b.c;\nconst y = a.b;\n"), "literal-index": ("a.go", "x := y[0]\n", "if n > 0 {\n\tx := y[0]\n"),
    "division": ("a.py", "x = a / bc\n", "x = a / len(length)\n# x\n"), "bare-json-parse": ("a.js", "x = JSON.parse(y)\n", "try {\n  x = JSON.parse(y)\n"), "throwing-call": ("a.swift", "func f() throws {\nload(x)\n", "func f() throws {\ntry load(x)\n"),
    "eval-of-input": ("a.php", "eval($user);\n", "// eval($user);\n"), "eval": ("a.rb", "eval(x)\n", "evaluate(x)\n"), "where-clause": ("a.js", "f({ $where: `this.a == ${x}` })\n", "f({ $where: 'this.a' })\n"), "regexp-of-input": ("a.js", "new RegExp(x)\n", "new RegExp('x')\n"),
    "private-key": ("a.py", "k = '-----BEGIN RSA PRIVATE KEY-----'\n", "k = '-----BEGIN PUBLIC KEY-----'\n"), "named-secret": ("a.js", "const apiToken = 'abcdefghij0123456789xyz';\n", "const apiToken = 'placeholder0123456789xyz';\nconst TOKEN_UID = 'abcdefghij0123456789xyz';\n"),
    "assigned-secret": ("a.py", "jwt_secret = 'abcdefghij0123456789xyz'\n", "jwt_secret = 'api::thing0123456789xyz'\n"), "hex-key": ("a.js", "const hashSeed = '0123456789abcdef0123456789abcdef';\n", "const label = '0123456789abcdef0123456789abcdef';\n"),
    "literal-crypto-key": ("a.js", "crypto.createHmac('sha256', 'abcdefgh1')\n", "crypto.createHmac('sha256', key)\n"),
}


def test_detectors_fire_and_stay_silent(spark):
    rows = [(2 * n + k, "r", "p", path, texts[k]) for n, (path, *texts) in enumerate(DETECTED.values()) for k in (0, 1)]
    hit = patterns.line_findings(corpus.with_lines(spark.createDataFrame(rows, FILES)))
    got = {(r["file_id"], r["rule"]) for r in hit.collect()}
    for n, rule in enumerate(DETECTED):
        assert (2 * n, rule) in got and (2 * n + 1, rule) not in got, rule


def test_verdict_of_a_clean_and_a_bad_corpus(spark):
    files = _files(spark, CORPUS).unionByName(_files(spark, {"ok.py": "x = 1\n", "ok_test.py": "y = 1\n"}, "clean").withColumn("file_id", F.col("file_id") + 100))
    got = {r["repo"]: r for r in Scan(files).verdict().collect()}
    assert got["clean"]["verdict"] == "APPROVED" and got["clean"]["score"] > got["r"]["score"]
    assert got["r"]["n_cycles"] == 1 and (got["r"]["n_findings"], got["r"]["n_quality"]) == (4, 1)
    assert got["r"]["dependency_score"] == 0.85 and got["r"]["adversarial_score"] == round(1 - 3 * 0.08, 6)
    issues = [(r["severity"], r["source"], r["file"]) for r in Scan(files).audit().orderBy("repo", "rank").collect()]
    assert issues == [("HIGH", "cycle", "src/lib"), ("HIGH", "finding", "src/a.js"), ("HIGH", "finding", "src/a_test.js"), ("HIGH", "finding", "src/b.js")]
    assert Scan(files.where("false")).verdict().count() == 0


def test_finding_algebra(spark):
    schema = "ord long, scan_id long, repo string, source string, file string, line int, type string, severity string, description string, payload string"
    rows = [
        (1, 1, "r", "PULSAR", "/t/src/a.js", 3, "injection", "HIGH", "SQL injection in x", None), (2, 1, "r", "PULSAR", None, None, None, None, None, '{"file":"src/a.js","line":" 3 ","type":"injection","description":"SQL injection in x"}'),
        (3, 1, "r", "NOVA", "b.js", None, "null-safety", None, "cwe-77 thing", None), (4, 1, "r", "NOVA", "b.js", 0, "null-safety", None, "cwe-77 thing", None), (5, 1, "r", "NOVA", None, None, None, None, None, "{broken"),
        (6, 1, "r", "NOVA", "test/c.js", 1, "edge-case", "LOW", "Division by n", None),
    ]
    d = findings.delivered(spark.createDataFrame(rows, schema))
    c = {r["ord"]: r for r in findings.classified(d).collect()}
    assert c[1]["finding_id"] == c[2]["finding_id"] != c[3]["finding_id"] == c[4]["finding_id"]
    assert (c[1]["cwe"], c[1]["cwes"], c[1]["surface"], c[1]["level"]) == (89, [89, 345, 566], "security", "error")
    assert c[3]["cwe"] == 77 and c[5]["cwe"] is None and c[5]["cwes"] == [] and c[6]["is_test"] and c[6]["surface"] == "security"
    keys = ["file", "line", "type", "description"]
    m = findings.merged(d.where("source = 'PULSAR'"), d.where("source <> 'PULSAR'"), keys)
    assert sorted(r["ord"] for r in m.collect()) == [1, 2, 3, 5, 6]
    ids = findings.classified(d)
    states = {r["state"] for r in findings.difference(ids.where("ord < 4"), ids.where("ord > 2")).collect()}
    assert states == {"resolved", "remaining", "new"}
    assert findings.selected(ids, severity="HIGH", engine="pulsar", file_part="A.J").count() == 1 and findings.selected(ids).count() == 5
    assert '"startLine":1' in findings.sarif_results(ids).where("ord = 3").first()["result"]
    assert findings.top_issues(d).where("rank = 1").count() == 1


WEAKNESSES = [
    ("NoSQL injection via findOne", "injection", 943), ("sql injection in x", "injection", 89), ("use-after-free, CWE-416", "edge-case", 416), ("shell_escape missing — cmdi (CWE-78)", "injection", 78), ("referer_field_auth trusted (cwe-22)", "x", 293), ("eval() on user input", "injection", 95),
    ("via eval(string-literal) to db.query", "injection", 95), ("createHash.md5 used", "x", 328), ("nothing to say", "hardcoded-secret", 798), ("nothing to say", "My-SQL-thing", 89), ("nothing to say", "risk", None), (None, None, None), ("reads row.name", "x", 476), ("cwe-0 text", "xss", 79), ("new RegExp() of input", "injection", 1333),
]
SURFACED = [
    ("Division by zero of n", "edge-case", "a.js", "quality"), ("strchr result, null dereference", "null-safety", "a.c", "security"), ("x", "async-race", None, "quality"), ("x", "injection", "a.js", "security"), ("Math.random() used for security-sensitive value", "edge-case", "src/auth/a.js", "security"),
    ("Math.random() used for security-sensitive value", "edge-case", "src/jobs/a.js", "quality"), ("Tainted value from command-line arguments reaches fs.readFile", "injection", "bin/x.js", "quality"), ("Tainted value from express query reaches fs.readFile", "injection", "bin/x.js", "security"), (None, None, None, "security"),
    ("Tainted value from express body reaches console.log — password", "injection", "a.js", "security"), ("reaches console.log", "injection", "a.js", "quality"), ("hashed with weak algorithm md5", "injection", "src/node/core/a.js", "quality"),
]


def test_weakness_classes_and_surfaces(spark):
    df = spark.createDataFrame([(n, *r[:2]) for n, r in enumerate(WEAKNESSES)], "n int, d string, t string")
    assert [r[0] for r in df.orderBy("n").select(weakness.primary(weakness.lowered(F.col("d")), weakness.lowered(F.col("t")))).collect()] == [w for _, _, w in WEAKNESSES]
    df = spark.createDataFrame([(n, *r[:3]) for n, r in enumerate(SURFACED)], "n int, d string, t string, f string")
    assert [r[0] for r in df.orderBy("n").select(weakness.surface(weakness.lowered(F.col("d")), F.col("t"), weakness.lowered(F.col("f")))).collect()] == [w for *_, w in SURFACED]
    one = spark.range(1).select(weakness.classes(F.lit(328), F.lit("weak hash over http.get")).alias("a"), weakness.siblings(F.lit(9)).alias("b"), weakness.classes(F.lit(None).cast("int"), F.lit("html")).alias("c")).first()
    assert one["a"] == [328, 916, 759, 261, 319] and one["b"] == [9] and one["c"] == []


def test_plain_texts_of_patterns():
    every = [p for p, _ in (*weakness.EARLY, *weakness.WORDS)] + [x for has, lacks, _ in weakness.EXTRAS for x in (has, lacks) if x] + [x for _, has, lacks, _ in weakness.SURFACES for x in (has, lacks) if x]
    assert weakness._literal(r"https?\.get") == ("http", False) and weakness._literal(r"a\.b(c|d)") == ("a.b", False) and weakness._literal("ab") == ("ab", True)
    rnd = random.Random(2)
    words = sorted({w for p in every for b in weakness._branches(p) for w in (weakness._literal(b)[0], re.sub(r"\\(?=\W)|\\b", "", b))})
    for _ in range(3000):
        text = " ".join(rnd.sample(words, 3))
        for p in rnd.sample(every, 20):
            found = [weakness._literal(b) for b in weakness._branches(p)]
            if all(len(t) > 1 for t, _ in found):
                guess, real = any(t in text for t, _ in found), bool(re.search(p, text))
                assert guess == real if all(plain for _, plain in found) else guess or not real, (p, text)


def test_scoring_rules(spark):
    labels = spark.createDataFrame(
        [("r", "g1", "src/a.js", 10, "x", "file"), ("r", "g2", "src/a.js", 12, "x", "file"), ("r", "g3", "src/p.js", 1, "y", "project"), ("r", "g4", "rc/a.js", 10, "x", "file"), ("q", "h1", "z.js", 1, "x", "file")],
        "corpus string, id string, file string, line int, type string, scope string",
    )
    f = spark.createDataFrame(
        [(k, "E", "r", file, line, kind) for k, (file, line, kind) in enumerate([("/t/src/a.js", 10, "x"), ("src/a.js", 5, "x"), ("src/a.js", 4, "x"), ("src/p.js", 999, "y"), ("src/p.js", 5, "y"), ("other/src/a.js", 17, "x"), (None, 1, "x")])]
        + [(20, "E", "q", "w.js", 1, "x")],
        "ord long, source string, repo string, file string, line int, type string",
    )
    got = {(r["ord"], r["id"]) for r in scoring.claims(scoring.candidates(f, labels)).collect()}
    assert got == {(0, "g1"), (3, "g3"), (5, "g2")}
    s = {r["corpus"]: r for r in scoring.scored(f, labels).collect()}
    assert (s["r"]["tp"], s["r"]["fp"], s["r"]["fn"], s["q"]["precision_val"], s["q"]["f1"]) == (3, 4, 1, 0.0, 0.0)
    sc = spark.createDataFrame([("a", 0.5), ("a", 1.0), ("b", None), ("b", 1.0), ("c", 0.0), ("c", 1.0)], "tool string, f1 double")
    assert {r["tool"]: r["f1"] for r in scoring.harmonic_f1(sc).collect()} == {"a": round(2 / 3, 9), "b": None, "c": 0.0}


HCL = """
# c
resource "aws_db_instance" "a" {
  publicly_accessible = true
  tags = { "a.b" = "x", n = 1.0 }
  ingress {
    cidrs = ["0.0.0.0/0", var.x]
  }
  ingress {
    cidrs = []
  }
  policy = jsonencode({ Version = "1", S = [{ E = "Allow" }] })
  ids = [for x in var.y : x.id if x.on]
  doc = <<-EOT
    }{
  EOT
  f = merge(local.a, { b = 1 })
}
variable "v" { default = "${var.a["k"]}-x" }
resource "aws_ebs_volume" "b" { encrypted = "true" }
resource "broken" "c" {
"""


def test_hcl():
    blocks = config.parse_hcl(HCL)
    assert [b["type"] for b in blocks] == ["resource", "variable", "resource"] and blocks[0]["line"] == 3
    b = blocks[0]["body"]
    assert b["publicly_accessible"] is True and b["ids"] == [] and len(b["ingress"]) == 2 and b["doc"].strip() == "}{" and b["f"].startswith("merge (")
    flat = config.flattened(b)
    assert flat["policy.S.E"] == "Allow" and flat["ingress.cidrs"] == "0.0.0.0/0,var.x" and flat["tags.n"] == "1"
    assert config.parse_hcl(None) == [] and config.parse_hcl("}") == [] and config.parse_hcl('a "b" {' * 200) == []
    nested = 'resource "a" "b" {\n  x = ' + "[" * 70 + "]" * 70 + "\n}\n"
    too_deep = 'resource "a" "b" {\n  x = ' + "[" * 300 + "]" * 300 + "\n}\n"
    after = 'resource "c" "d" {\n  y = 1\n}\n'
    assert [b["labels"] for b in config.parse_hcl(nested + after)] == [["a", "b"], ["c", "d"]]
    assert [b["labels"] for b in config.parse_hcl(too_deep + after)] == [["c", "d"]] and [b["labels"] for b in config.parse_hcl('x "y" {\n  ???\n}\n' + after)] == [["c", "d"]]
    assert len(config.parse_hcl('resource "x" "y" {\n  a = 1\n}\n' * 2000)) == 2000


DOCKER = "FROM --platform=linux/amd64 reg:5000/img AS base\nRUN apt-get update \\\n  && apt-get -y install x\nRUN a\nRUN b\nUSER root\nEXPOSE 80 22\nCMD a\nCMD b\n# x\n"


def test_docker():
    rows = config.parse_dockerfile(DOCKER)
    assert [r["instruction"] for r in rows] == ["FROM", "RUN", "RUN", "RUN", "USER", "EXPOSE", "CMD", "CMD"]
    assert (rows[0]["image"], rows[0]["tag"], rows[0]["stage"], rows[0]["tag_omitted"], rows[0]["flags.platform"]) == ("reg:5000/img", "latest", "base", "true", "linux/amd64")
    assert rows[2]["line"] == 4 and config.parse_dockerfile("FROM a:1@sha256:x")[0]["digest"] == "sha256:x" and config.parse_dockerfile(None) == []


def test_rules_fire_and_stay_silent(spark):
    texts = {"a.tf": HCL, "Dockerfile": DOCKER, "b.tf": 'resource "acme_firewall" "f" {\n  ingress {\n    from_port = 22\n    cidrs = ["10.0.0.0/8"]\n  }\n}\nresource "aws_ebs_volume" "v" {\n  kms_key_id = "k"\n}\n', "safe/Dockerfile": "FROM a:1\nUSER me\nHEALTHCHECK CMD x\nCMD a\n"}
    got = {(r["rel_path"], r["rule_id"], r["start_line"]) for r in rules.hits(config.resources(_files(spark, texts)), rules.RULES).collect()}
    assert got == {
        ("a.tf", "db-public", 3), ("b.tf", "firewall-low-port", 1), ("b.tf", "firewall-private-only", 1), ("b.tf", "firewall-without-bucket", 1),
        ("Dockerfile", "docker-latest", 1), ("Dockerfile", "docker-no-healthcheck", 1), ("Dockerfile", "docker-root", 6), ("Dockerfile", "docker-ssh-port", 7), ("Dockerfile", "docker-second-cmd", 9), ("Dockerfile", "docker-runs-apart", 4), ("Dockerfile", "docker-runs-apart", 5),
    }


def test_rules_from_a_table(spark):
    f = config.resources(_files(spark, {"a.tf": 'resource "x_disk" "a" {\n  size = 5\n  tags = { k = "v" }\n}\nresource "x_disk" "b" {\n  encrypted = true\n  size = 50\n}\n'}))
    test = lambda path, condition, *value: (path, condition, list(value))
    pack = spark.createDataFrame([
        ("plain", "HIGH", "x_disk", [[test("encrypted", "not-true")]], [], "", ""), ("spared", "HIGH", "x_disk", [[test("encrypted", "not-true")]], [test("tags.k", "equals", "v")], "", ""),
        ("either", "LOW", "x_disk", [[test("size", "lte", "5"), test("tags.k", "present")], [test("size", "gte", "50")]], [], "", ""), ("other", "LOW", "y_disk", [[test("size", "missing")]], [], "", ""),
    ], rules.PACK)
    assert {(r["rule_id"], r["name"]) for r in rules.hits(f, (), pack).collect()} == {("plain", "x_disk.a"), ("either", "x_disk.a"), ("either", "x_disk.b")}


@pytest.mark.parametrize(("condition", "value", "fires"), [
    ("missing", (), "n"), ("present", (), "atw"), ("equals", ("a",), "a"), ("not-equals", ("a",), "tw"), ("equals-or-missing", ("a",), "an"), ("is-true", (), "t"), ("is-false", (), ""), ("not-true", (), "anw"),
    ("contains", ("7",), "w"), ("matches", ("^[a-z]$",), "a"), ("not-matches", ("^[a-z]$",), "tnw"), ("matches-any", ("7", "^a"), "aw"), ("in", ("a", "x"), "a"), ("not-in", ("a", "x"), "tw"), ("lte", ("17",), "w"), ("gte", ("18",), ""),
])
def test_conditions(spark, condition, value, fires):
    df = spark.createDataFrame([("a", "a"), ("t", "true"), ("n", None), ("w", " 17 ")], "k string, v string")
    assert "".join(r["k"] for r in df.where(rules.holds(F.col("v"), rules.Test("v", condition, value))).collect()) == fires


def test_manifests(spark):
    assert manifests.parse_manifest("package.json", '{"dependencies":{"a":"1.2.3","b":"^1.0.0","c":"git+x"},"optionalDependencies":{"a":"9.9.9","d":"=2.0.0"},"devDependencies":{"e":"1.0.0"}}') == [("a", "1.2.3"), ("d", "2.0.0")]
    lock = '{"lockfileVersion":3,"packages":{"":{"version":"0.0.1"},"node_modules/a":{"version":"1.2.4"},"node_modules/x/node_modules/@s/y":{"version":"3.0.0"},"node_modules/d":{"version":"1.0.0","dev":true}}}'
    assert manifests.parse_manifest("package-lock.json", lock) == [("a", "1.2.4"), ("@s/y", "3.0.0")]
    assert manifests.parse_manifest("requirements.txt", 'Flask_X[e]==1.0 ; python_version>"3"\nb>=2\n# c==1\nd==2.0 # n\n') == [("flask-x", "1.0"), ("d", "2.0")]
    assert manifests.parse_manifest("Pipfile.lock", '{"default":{"A":{"version":"==1.0"},"b":{"git":"x"}}}') == [("a", "1.0")]
    assert manifests.parse_manifest("package.json", "{broken") == manifests.parse_manifest("package.json", None) == []
    df = _files(spark, {"p/package.json": '{"dependencies":{"a":"1.2.3"}}', "p/package-lock.json": lock, "q.txt": "x"})
    won = manifests.lock_wins(manifests.dependencies(df))
    assert {(r["name"], r["version"]) for r in won.collect()} == {("a", "1.2.4"), ("@s/y", "3.0.0")}
    adv = spark.createDataFrame([("npm", "a", "1.2.4", ["X-1", "X-1"])], "ecosystem string, name string, version string, ids array<string>")
    assert [r["ids"] for r in manifests.vulnerable(won, adv).collect()] == [["X-1"]]


TAINTED = {
    "a.py": "def f():\n    x = request.args['q']\n    y = 'a' + x\n    eval(y)\n", "b.py": "def g(v):\n    os.system('ls ' + v)\ndef f():\n    g(input())\n", "c.py": "def f():\n    q = ''\n    for p in request.form:\n        q = q + p\n    db.execute(q)\n",
    "d.py": "@app.route('/')\ndef f(name):\n    return redirect(name)\n", "e.py": "def h(a):\n    return a.strip()\ndef f():\n    open(h(request.args.get('p')))\n",
    "a.php": "<?php\nfunction f($db) {\n  $id = $_GET['id'];\n  $q = \"select $id\" . $id;\n  return $db->query($q);\n}\n", "A.java": "class A {\n  void f(HttpServletRequest request) throws E {\n    String q = request.getParameter(\"q\");\n    stmt.executeQuery(\"select \" + q);\n  }\n}\n",
    "a.go": "package a\n\nfunc f(w http.ResponseWriter, r *http.Request) {\n\tq := r.FormValue(\"q\")\n\trows, err := db.Query(\"select \" + q)\n}\n", "a.c": "int main(int argc, char **argv)\n{\n    char b[9];\n    sprintf(b, \"ls %s\", argv[1]);\n    system(b);\n}\n",
    "a.rs": "fn f() {\n    let a = std::env::args();\n    Command::new(a);\n}\n", "a.rb": "def f\n  x = params[:q]\n  system \"ls #{x}\"\nend\n", "b.rb": "def f\n  User.where(\"a = #{params[:id]}\")\nend\n", "a.sh": "#!/bin/sh\nx=$1\neval \"$x\"\n",
    "a.js": "async function f(req, res) {\n  const id = req.query.id;\n  const rows = await db.all(`select * from t where id = ${id}`);\n}\n", "b.js": "const go = (req, res) => {\n  let u = 'x';\n  u += req.body.url;\n  res.redirect(u);\n};\n", "c.ts": "export function f(req) {\n  const c = req.body.c;\n  if (c) {\n    child_process.exec('ls ' + c);\n  }\n}\n",
}
CLEAN = {
    "a.py": "def f():\n    x = int(request.args['q'])\n    eval(str(x))\n", "b.py": "def f():\n    x = request.args['q']\n    if x not in ALLOWED:\n        return\n    os.system(x)\n", "c.py": "def f():\n    x = request.args['q']\n    x = 'safe'\n    eval(x)\n",
    "d.py": "def f():\n    db.execute('select ?', request.args['q'])\n", "e.py": "x = (", "a.php": "<?php\nfunction f($db) {\n  $id = intval($_GET['id']);\n  return $db->query('select ' . $id);\n}\n", "A.java": "class A {\n  void f(HttpServletRequest request) {\n    int q = Integer.parseInt(request.getParameter(\"q\"));\n    stmt.executeQuery(\"select \" + q);\n  }\n}\n",
    "a.go": "package a\n\nfunc f(r *http.Request) {\n\tq, err := strconv.Atoi(r.FormValue(\"q\"))\n\tdb.Query(\"select ?\", q)\n}\n", "a.c": "int main(int argc, char **argv)\n{\n    int n = atoi(argv[1]);\n    system(\"ls\");\n    return n;\n}\n", "a.rb": "def f\n  x = params[:q].to_i\n  system \"ls #{x}\"\nend\n", "a.sh": "x=$1\ny='a $x'\neval 'ls'\necho \"$x\"\n", "f.py": "def f(name):\n    return redirect(name)\n", "a.js": "function f(req) {\n  db.all(`select ${Number(req.query.id)}`);\n}\n", "b.js": "function f(req) {\n  const c = req.body.c;\n  if (!allowed.includes(c)) { return; }\n  child_process.exec(c);\n}\n",
}


@pytest.mark.parametrize("path", list(TAINTED))
def test_flow_found(path):
    assert taint.analyse(TAINTED[path], path)


@pytest.mark.parametrize("path", list(CLEAN))
def test_no_flow(path):
    assert taint.analyse(CLEAN[path], path) == []


def test_flow_through_a_long_loop():
    n = 30
    steps = "".join(f"        x{i} = x{i - 1}\n" for i in range(n, 0, -1))
    head = "def f(n):\n" + "".join(f"    x{i} = ''\n" for i in range(n + 1))
    text = head + f"    while n:\n{steps}        x0 = request.args['q']\n    eval(x{n})\n"
    assert [(r[0], r[2], r[3]) for r in taint.analyse(text, "a.py")] == [(text.count("\n"), "eval", "request.args")]


def test_flows_of_long_and_deep_texts(spark):
    steps = "".join(f"    x{i} = x{i - 1}\n" for i in range(1, 40))
    flow = taint.analyse(f"def f():\n    x0 = request.args['q']\n{steps}    eval(x39)\n", "a.py")
    assert len(flow) == 1 and len(flow[0][5]) == 40
    branches = "".join(f"    if a{i}:\n        x = x + y\n    else:\n        x = y + x\n" for i in range(60))
    assert len(taint.analyse(f"def f():\n    x = request.args['q']\n    y = request.form['q']\n{branches}    eval(x)\n", "a.py")) == 2
    deep = "x = " + "[" * 150 + "1" + "]" * 150 + "\n"
    many = "def f(x):\n    return " + "(".join("x.a" for _ in range(3000)) + ")" * 2999
    assert [r["rel_path"] for r in taint.not_analysed(_files(spark, {"a.py": deep, "b.js": "f();\n", "c.py": "x = " + "-" * 30000 + "1\n", "d.py": many})).collect()] in (["c.py"], ["c.py", "d.py"])


def test_flow_and_rule_findings(spark):
    f = taint.as_findings(taint.flows(_files(spark, {"a.py": TAINTED["a.py"], "d.py": TAINTED["d.py"]})))
    assert sorted((r["file"], r["type"], r["description"]) for r in f.collect()) == [("a.py", "injection", "[TAINT] Tainted value from request.args reaches eval"), ("d.py", "edge-case", "[TAINT] Tainted value from name reaches redirect")]
    hits = rules.as_findings(rules.hits(config.resources(_files(spark, {"safe/Dockerfile": "FROM a:latest\nUSER me\nHEALTHCHECK CMD x\n"})), rules.RULES))
    assert [(r["line"], r["type"], r["severity"]) for r in hits.collect()] == [(1, "edge-case", "MED")]


def test_flow_rows(spark):
    got = taint.flows(_files(spark, TAINTED | {"n.py": None, "m.py": ""})).collect()
    assert {r["rel_path"] for r in got} == set(TAINTED)
    r = next(r for r in got if r["rel_path"] == "a.py")
    assert (r["line"], r["type"], r["source"], r["sink"], [x["name"] for x in r["flow"]]) == (4, "injection", "request.args", "eval", ["request.args", "x", "y", "eval"])


def test_fixes(spark):
    assert fixes.optional_access("  return a.b.c + x;") == "  return a?.b?.c + x;" and fixes.optional_access("return a?.b.c") is None
    assert "try {" in fixes.guarded_parse("  const x = JSON.parse(t);") and fixes.guarded_parse("return JSON.parse(t)") is None
    assert fixes.secret_from_environment("const apiToken = 'abcdefgh1';") == "const apiToken = process.env.API_TOKEN;"
    f = _files(spark, {"a.js": "let a;\r\nconst x = JSON.parse(t);\r\n"})
    hit = spark.createDataFrame([(0, "a.js", 2, "error-boundary"), (0, "a.js", 99, "error-boundary"), (0, "a.js", 1, "null-safety")], "file_id long, rel_path string, line_no int, type string")
    out = fixes.proposals(hit, f).collect()
    assert len(out) == 1 and "-const x = JSON.parse(t);" in out[0]["diff"] and "+try {" in out[0]["diff"]


def test_paths_tree_and_stream(spark, tmp_path):
    df = spark.createDataFrame([("/r/a/b.js",), ("/x/c.js",), ("./d.js",), ("e\\f.js",)], "p string")
    assert [r[0] for r in df.select(paths.relative_uri(F.col("p"), F.lit("/r/"))).collect()] == ["a/b.js", "c.js", "d.js", "e/f.js"]
    (tmp_path / "t" / "src").mkdir(parents=True)
    (tmp_path / "t" / "src" / "a.js").write_text("eval(req.body.x)\n")
    tree = read_tree(spark, str(tmp_path / "t"), "r")
    row = tree.first()
    assert (row["rel_path"], row["language"], row["lines"]) == ("src/a.js", "javascript", 1)
    _files(spark, CORPUS).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FILES).parquet(str(tmp_path / "in"))
    scan_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9
    a, b = (paths.corpus_fingerprint(x).first()["fingerprint"] for x in (_files(spark, {"a": "1", "b": "2"}), _files(spark, {"b": "2", "a": "1"})))
    assert a == b != paths.corpus_fingerprint(_files(spark, {"a": "1", "b": "3"})).first()["fingerprint"]


def test_risk_steps(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (5.5,), (20.0,), (41.0,)], "v double")
    assert [r[0] for r in df.select(risk.step(F.col("v"), risk.COMPLEXITY)).collect()] == [0.0, 0.0, 0.3, 0.6, 1.0]
