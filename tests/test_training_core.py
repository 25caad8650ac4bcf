import datetime as dt
import json
import random

from pyspark.sql import functions as F

from codestrata.operators import drift, nested

RESULT = "file_id long, producer string, generated_at timestamp, body string, fields string, prior string"


def _file(fid, producer, day, *runs):
    at = dt.datetime(2025, 1, 1) + dt.timedelta(days=day)
    return (fid, producer, at, json.dumps({"results": [{"id": "r", "runs": list(runs)}]}) if runs != (None,) else None, "clash", "clash")


def test_changes_between_files(spark):
    rows = [
        _file(1, "a", 0, {"totalMs": 1.5, "fileCount": 3, "engineMs": {"NOVA": 1.0}, "peakRssBytes": 2**20, "x": None}, {"totalMs": None, "only": True}),
        _file(7, "a", 1, {"total_ms": 2, "fileCount": "3", "engines": {"NOVA": 1}, "peakRssMB": 1.0, "x": 1, "only": True}),
        _file(5, "a", 1, {"total_ms": 2, "fileCount": "3", "engines": {"NOVA": 1}, "peakRssMB": 1.0, "x": 1, "only": True}),
        _file(9, "a", 40, {"total_ms": 2, "fileCount": 3, "engines": {"NOVA": 1}, "peakRssMB": 1.0, "x": [1], "new": {"deep": 1}}),
        _file(2, "b", 0, {"totalMs": 1}),
        (3, "b", dt.datetime(2025, 2, 1), None, "", ""),
        (4, "b", dt.datetime(2025, 2, 2), "{broken", "", ""),
        (8, None, dt.datetime(2025, 2, 2), "{}", "", ""),
        (6, "b", None, "{}", "", ""),
    ]
    got = {tuple(r) for r in drift.changes(spark.createDataFrame(rows, RESULT)).collect()}
    assert got == {
        (5, "renamed", "totalMs", "total_ms"), (5, "type_changed", "fileCount", "fileCount"), (5, "renamed", "engineMs.NOVA", "engines.NOVA"), (5, "renamed", "peakRssBytes", "peakRssMB"),
        (9, "type_changed", "fileCount", "fileCount"), (9, "type_changed", "x", "x"), (9, "added", "new.deep", "new.deep"), (9, "removed", "only", "only"), (3, "removed", "totalMs", "totalMs"),
    }
    assert drift.changes(spark.createDataFrame([], RESULT)).count() == 0


def test_measures():
    assert drift.measure("godModules") == drift.measure("god_modules") != drift.measure("godModuleLimit")
    assert drift.measure("someNewField") == drift.measure("some_new_field_ms") != drift.measure("someOtherField")
    assert drift.compare({"a": "number", "b": ""}, {"a": "", "b": "text"}) == []


def test_ingest_promotes_and_rescues(spark):
    rows = [
        _file(1, "a", 0, {"totalMs": "47.5 ms", "score": "61.98%", "peakRssBytes": 3 * 2**20, "verdict": 1, "cycles": True, "odd": {"deep": [1]}, "nil": None}),
        _file(2, "a", 0, {"totalMs": 1}),
        _file(3, "b", 0, {"elapsedMs": 2, "aurora_score": 0.5, "files": 7}),
    ]
    got = {r["file_id"]: r for r in drift.ingest(spark.createDataFrame(rows, RESULT)).collect()}
    assert set(got) == {1, 3}
    r = got[1]
    assert (r["total_ms"], round(r["score"], 6), r["peak_rss_mb"], r["verdict"], r["circular_deps"]) == (47.5, 0.6198, 3.0, None, None)
    assert json.loads(r["rescued"]) == {"verdict": 1, "cycles": True, "odd.deep": [1]}
    assert (got[3]["total_ms"], got[3]["score"], got[3]["file_count"], got[3]["rescued"]) == (2.0, 0.5, 7, None)


def test_ingestion_loses_nothing():
    typed, rescued, origin = drift.enforced({"totalMs": 1, "elapsedMs": 9, "fileCount": 12.7, "peakRssMB": "512 bytes", "verdict": 'a"b', "score": None, "god_modules": 2**40, "cycles": "1,024"})
    assert typed == {"total_ms": 1.0, "peak_rss_mb": 512 / 2**20, "verdict": 'a"b', "circular_deps": 1024}
    assert rescued == {"elapsedMs": 9, "fileCount": 12.7, "god_modules": 2**40}
    assert origin == {"total_ms": "totalMs", "peak_rss_mb": "peakRssMB", "verdict": "verdict", "circular_deps": "cycles"}
    rnd = random.Random(3)
    paths = [p for _, ps in drift.APPROVED.values() for p in ps] + ["odd", "other.deep"]
    values = [None, True, 0, 1.5, -3, "7", "7 ms", "3 MB", "1e400", "x", "", [1], float("nan"), 2**70, "12%"]
    for _ in range(2000):
        record = {p: rnd.choice(values) for p in rnd.sample(paths, rnd.randint(0, 12))}
        typed, rescued, origin = drift.enforced(record)
        kept = set(rescued) | set(origin.values())
        assert kept == {k for k, v in record.items() if v is not None} and not set(rescued) & set(origin.values())
        assert all(rescued[k] is record[k] for k in rescued) and typed.keys() == origin.keys()


def test_previous_equals_one_window(spark):
    rows = [(g, i * 7 % 23, f"v{i}") for i in range(23) for g in ("a", "b") if (i + len(g)) % 3]
    df = spark.createDataFrame(rows, "g string, at int, v string")
    got = {(r["g"], r["at"]): r["prior"] for r in drift.previous(df, ["g"], "at", "v", [F.floor(F.col("at") / 3), F.floor(F.col("at") / 9)]).collect()}
    for g in ("a", "b"):
        mine = sorted((at, v) for x, at, v in rows if x == g)
        assert [got[g, at] for at, _ in mine] == [None, *[v for _, v in mine[:-1]]]


REPORT = "report_id long, kind string, body string, pos string, child_path string"
BODIES = [
    ("receipts", {"T": {"v": 1, "findings": [{"file": "a"}, None, {"file": "b"}]}, "U": {"v": 2, "findings": {"file": "c"}}, "W": {"v": 3, "findings": None}}, ["T", "T/findings/0", "T/findings/2", "U", "U/findings/0", "W"]),
    ("taint", {"n": 1, "findings": [{"x": 1, "flow": [{"s": 1, "location": {"file": "f", "line": 2}}, None]}, {"x": 2, "flow": json.dumps([{"s": 2, "location": {"file": "g", "line": 3}}])}]}, ["findings/0", "findings/0/flow/0", "findings/1", "findings/1/flow/0"]),
    ("board", {"v": 1, "tools": {"name": "t", "scores": [{"c": 1, "tp": [{"file": "a"}], "fp": []}]}}, ["tools/0", "tools/0/scores/0", "tools/0/scores/0/tp/0"]),
    ("board", {"v": 1, "tools": [{"name": "u"}, None]}, ["tools/0"]),
]


def test_children_of_nested_reports(spark):
    rows = [(i, k, json.dumps(b), "clash", "clash") for i, (k, b, _) in enumerate(BODIES)]
    rows += [(10, "taint", None, "", ""), (11, "taint", "", "", ""), (12, "taint", "{broken", "", ""), (13, None, "{}", "", ""), (1, "taint", rows[1][2], "", "")]
    df = spark.createDataFrame(rows, REPORT)
    plan = nested.analyse(df, "kind", "body")
    recs = nested.child_records(df, "report_id", "kind", "body", plan)
    got = sorted((r["report_id"], r["child_path"]) for r in recs.collect())
    want = [(i, p) for i, (_, _, ps) in enumerate(BODIES) for p in ps] + [(1, p) for p in BODIES[1][2]]
    assert got == sorted(want)
    flow = {(r["child_path"], r["parent_path"], r["location_file"], r["location_line"]) for r in nested.child_table(recs, plan, "taint", "/findings/flow").collect()}
    assert flow == {("findings/0/flow/0", "findings/0", "f", "2"), ("findings/1/flow/0", "findings/1", "g", "3")}
    assert nested.child_records(df.where("false"), "report_id", "kind", "body", plan).count() == 0


def test_recursive_elements_get_tables():
    plan = nested.plan_inlining([("k", "", "node", "object"), ("k", "/node", "node", "object"), ("k", "/node", "v", "scalar")])
    assert plan.tables == {("k", "/node"): {"node"}} and plan.inlined == {("k", ""): {"node"}}


def test_one_odd_document_hides_no_children(spark):
    bodies = [
        ("receipts", {"T": {"v": 1, "findings": [{"f": 1}]}, "U": {"v": 2}}, ["T", "T/findings/0", "U"]),
        ("receipts", {"V": None, "X": {"findings": [{"f": 1}]}}, ["X", "X/findings/0"]),
        ("receipts", {"at": "2025", "Y": {"findings": [{"f": 1}]}, "more": [{"m": 1}]}, ["Y", "Y/findings/0", "more/0"]),
        ("receipts", {"Z": {"findings": [{"f": 1}], "deep": {"list": [{"d": 1}]}}}, ["Z", "Z/findings/0", "Z/deep/list/0"]),
        ("taint", {"findings": {"flow": [{"s": 1}], "only": {"here": [{"h": 1}]}}}, ["findings/0", "findings/0/flow/0", "findings/0/only/here/0"]),
        ("taint", {"n": 1, "findings": [{"x": 1, "flow": [{"s": 1}]}]}, ["findings/0", "findings/0/flow/0"]),
        ("taint", {"n": 2, "findings": []}, []),
    ]
    df = spark.createDataFrame([(i, k, json.dumps(b), "", "") for i, (k, b, _) in enumerate(bodies)], REPORT)
    plan = nested.analyse(df, "kind", "body")
    assert plan.maps == {("receipts", "")}
    recs = nested.child_records(df, "report_id", "kind", "body", plan)
    assert sorted((r["report_id"], r["child_path"]) for r in recs.collect()) == sorted((i, p) for i, (_, _, ps) in enumerate(bodies) for p in ps)
    targets = {(r["child_path"], r["pos"], r["v"]) for r in nested.child_table(recs, plan, "receipts", "/*").collect()}
    assert targets == {("T", 0, "1"), ("U", 1, "2"), ("X", 1, None), ("Y", 1, None), ("Z", 0, None)}


def test_list_roots_and_shared_elements(spark):
    owner = {"name": "n", "mail": "m"}
    bodies = [[{"findings": [{"v": 1}]}, None, {"findings": {"v": 2}}], {"findings": [{"v": 3, "owner": owner}], "owner": owner, "meta": {"author": {"a": 1}}, "parts": {"left": {"x": 1}, "right": {"y": 2}}}]
    rows = [(n, "k", json.dumps(b), "", "") for n, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, REPORT)
    plan = nested.analyse(df, "kind", "body")
    records = nested.child_records(df, "report_id", "kind", "body", plan)
    got = {(r["report_id"], r["child_path"], r["parent_path"]) for r in records.collect()}
    assert got == {(0, "0/findings/0", "0"), (0, "2/findings/0", "2"), (1, "findings/0", ""), (1, "findings/0/owner/0", "findings/0"), (1, "owner/0", "")}
    owners = nested.child_table(records, plan, "k", "/owner")
    assert sorted((r["parent_path"], r["name"], r["mail"]) for r in owners.collect()) == [("", "n", "m"), ("findings/0", "n", "m")]
    assert plan.nodes("k", "/findings/owner") == ("/findings/owner", "/owner")
