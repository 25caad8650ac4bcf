import math
import random
import struct

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codestrata.llm import fingerprints, quantiles, tokens

FINDING = "ord long, scan_id long, source string, file string, line int, type string, description string, payload string, h1 string"
FIELDS = ["scan_id", "source", "file", "line", "type", "description"]


def test_copies_of_one_finding(spark):
    rows = [
        (5, 1, "A", "src/x.js", None, "edge-case", "Naïve  compare", None, "clash"),
        (2, 1, "A", None, None, None, None, '{"type":"EDGE CASE","line":" 0 ","file":"SRC/x.js","description":"naïve compare!"}', None),
        (9, 1, "A", "src/x.js", 0, "edge-case", "Naïve compare", None, None),
        (9, 1, "A", "src/x.js", 0, "edge-case", "Naïve compare", None, None),
        (7, 1, "A", "src/x.js", 3, "edge-case", "Naïve compare", None, None),
        (8, 2, "A", "src/x.js", 0, "edge-case", "Naïve compare", None, None),
        (10, None, None, None, None, None, None, None, None),
        (11, None, None, None, None, None, None, "{broken", None),
    ]
    df = fingerprints.finding_fields(spark.createDataFrame(rows, FINDING))
    got = sorted((r["first"], r["other"]) for r in fingerprints.copies(df, "ord", FIELDS).collect())
    assert got == [(2, 5), (2, 9), (2, 9), (10, 11)]
    counts = {r["first"]: r["n_copies"] for r in fingerprints.distinct_records(df, "ord", FIELDS).collect()}
    assert counts == {2: 4, 7: 1, 8: 1, 10: 2}


def test_copies_survive_hash_collisions(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "multiset_hash", lambda fields, lane: F.lit(1).cast("long"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "b"), (5, "c")], "id long, v string")
    got = sorted((r["first"], r["other"]) for r in fingerprints.copies(df, "id", ["v"]).collect())
    assert got == [(1, 3), (2, 4)]


def test_hot_fingerprints_are_salted(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"v{i % 7}") for i in range(400)], "id long, v string")
    want = sorted((r["first"], r["other"]) for r in fingerprints.copies(df, "id", ["v"]).collect())
    got = sorted((r["first"], r["other"]) for r in fingerprints.copies(df, "id", ["v"], hot=10).collect())
    assert got == want and len(got) == 400 - 8
    plan = fingerprints.copies(df, "id", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "ShuffledHashJoin" in plan


def test_copies_of_nothing(spark):
    df = fingerprints.finding_fields(spark.createDataFrame([], FINDING))
    assert fingerprints.copies(df, "ord", FIELDS).count() == 0


def test_keys_keep_order_and_value(spark):
    rnd = random.Random(3)
    vs = [0.0, -0.0, 1.0, -1.0, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 0.1, 4.0, 3.9999999999999996]
    vs += [struct.unpack("d", struct.pack("q", rnd.getrandbits(63)))[0] for _ in range(2000)]
    vs = [v * rnd.choice([1, -1]) for v in vs if math.isfinite(v)]
    df = spark.createDataFrame([(v,) for v in vs], "v double").select("v", quantiles.ordered_key(F.col("v")).alias("k"))
    rows = df.select("v", "k", quantiles.value_of_key(F.col("k")).alias("back")).collect()
    assert all(r["v"] == r["back"] for r in rows)
    ks = [r["k"] for r in sorted(rows, key=lambda r: r["v"])]
    assert ks == sorted(ks)


def test_percentiles_against_sorting(spark):
    rnd = random.Random(5)
    rows = [("a", d, rnd.lognormvariate(3, 2)) for d in ("2025-01-01", "2025-01-02") for _ in range(500)]
    rows += [("a", "2025-01-01", x) for x in (None, float("nan"), -1.0, 0.0, float("inf"))] + [("b", "2025-01-01", 7.0)] * 3 + [("c", None, None)]
    df = spark.createDataFrame(rows, "g string, d string, v double")
    m = quantiles.measurements(df, ["g"], {"v": F.col("v")}, F.col("d"))
    real = sorted(v for g, _, v in rows if g == "a" and v is not None and math.isfinite(v) and v > 0)
    for digits in (1, 2, 4):
        got = {(r["g"], r["p"]): r for r in quantiles.radix_percentiles(m, ["g"], [0.0, 0.5, 0.9, 0.99, 1.0], digits=digits).collect()}
        assert len(got) == 10
        for p in (0.0, 0.5, 0.9, 0.99, 1.0):
            want, r = real[max(1, math.ceil(round(p * len(real), 9))) - 1], got["a", p]
            assert r["value"] == want and r["error_bound"] == 0
            assert got["b", p]["value"] == 7.0
    one, two = (quantiles.daily_histograms(m.where(F.col("day") == d), ["g"]) for d in ("2025-01-01", "2025-01-02"))
    both = {tuple(r)[:-1]: r["n"] for r in quantiles.combine(one, two).collect()}
    assert both == {tuple(r)[:-1]: r["n"] for r in quantiles.combine(quantiles.daily_histograms(m, ["g"])).collect()}


def test_percentiles_of_days_against_exact(spark):
    rnd = random.Random(6)
    rows = [(g, f"2025-01-{d:02d}", rnd.lognormvariate(3, 2)) for g in "ab" for d in range(1, 6) for _ in range(200)] + [("z", "2025-01-01", 0.0), ("z", "2025-01-02", 5.0), ("c", None, None)]
    m = quantiles.measurements(spark.createDataFrame(rows, "g string, d string, v double"), ["g"], {"v": F.col("v")}, F.col("d"), positive=False)
    ps = [0.0, 0.5, 0.9, 0.99, 1.0]
    exact = {(r["g"], r["p"]): r for r in quantiles.radix_percentiles(m, ["g"], ps).collect()}
    for digits in (1, 2, 3):
        got = {(r["g"], r["p"]): r for r in quantiles.percentiles(quantiles.daily_histograms(m, ["g"], digits), ["g"], ps, digits).collect()}
        assert got.keys() == exact.keys()
        for k, r in got.items():
            assert r["n"] == exact[k]["n"] and r["value"] <= exact[k]["value"] <= r["value"] + r["error_bound"]
            assert digits < 2 or exact[k]["value"] == 0 or r["error_bound"] <= 2**-20 * exact[k]["value"]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab c\n\t'sltreกข中!1 😀"), max_size=300), st.integers(1, 40), st.integers(1, 9))
def test_joined_halves_are_the_whole(text, size, window):
    enc = tokens.encoder(tokens.RANKS)
    parts = [(p, enc.encode_ordinary(p)) for p in tokens.halves(text, size)]
    assert "".join(p for p, _ in parts) == text
    while len(parts) > 1:
        parts = [tokens.joined(*parts[i : i + 2], tokens.RANKS, window, 4) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    assert parts[0][1] == enc.encode_ordinary(text)


def test_long_unsplit_pieces():
    enc = tokens.encoder(tokens.RANKS)
    rnd = random.Random(5)
    for text in ("a" * 9000, " " * 9001 + "x", "\n" * 7000, "".join(rnd.choice("abcdefghij") for _ in range(9000)), "กขคงจฉ" * 2000, "=-" * 5000, "12" * 4500 + " 'll" * 900):
        assert tokens.tree_joined([(p, enc.encode_ordinary(p)) for p in tokens.halves(text)], tokens.RANKS) == enc.encode_ordinary(text)


def test_token_ids_of_rows(spark):
    enc = tokens.encoder(tokens.RANKS)
    texts = {1: None, 2: "", 3: "plain <|endoftext|> text", 4: "กขคงจฉ" * 400, 5: "word " * 500 + "\n\n\n" + "x" * 900}
    df = spark.createDataFrame([(k, v, "clash") for k, v in texts.items()] + [(1, "again", "x")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in tokens.token_ids(df, leaf=50, spread_above=1000).collect())
    assert got == sorted((k, enc.encode_ordinary(v or "")) for k, v in [*texts.items(), (1, "again")])
    assert tokens.token_ids(df.where("false")).count() == 0
