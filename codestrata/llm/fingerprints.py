"""Copies of one record hidden by formatting: commutative multiset hashing of normalised fields."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.session import checkpointed

#: Fields that a delivered record holds either as columns or in its JSON payload.
PAYLOAD_SCHEMA = "file string, line string, type string, description string"


def letters_and_digits(text: Column) -> Column:
    """Lower-cased text without every character that is no letter or digit; null becomes the empty text."""
    return F.coalesce(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", F.lit("")), F.lit(""))


def finding_fields(findings: DataFrame) -> DataFrame:
    """ord and the normalised fields of each finding, whether they stand in columns or in ``payload``.

    A null line, a line that is no number and line 0 are the same; a broken payload gives empty fields.
    """
    pick = {c: F.col(c) for c in ("ord", "scan_id", "source", "file", "line", "type", "description", "payload")}
    base = findings.select(*[v.alias(k) for k, v in pick.items()])
    # from_json runs only where it is needed; an expression in a projection is not evaluated for the other branch
    p = F.when(F.col("payload").isNotNull(), F.from_json("payload", PAYLOAD_SCHEMA))
    base = base.withColumn("p", p)
    whole = lambda c: F.expr(f"try_cast(trim({c}) as int)")
    return base.select(
        "ord",
        F.coalesce(F.col("scan_id").cast("string"), F.lit("")).alias("scan_id"),
        F.coalesce("source", F.lit("")).alias("source"),
        letters_and_digits(F.coalesce("file", "p.file")).alias("file"),
        F.coalesce(F.col("line"), whole("p.line"), F.lit(0)).cast("string").alias("line"),
        letters_and_digits(F.coalesce("type", "p.type")).alias("type"),
        letters_and_digits(F.coalesce("description", "p.description")).alias("description"),
    )


def multiset_hash(fields: Mapping[str, Column], lane: int) -> Column:
    """60-bit sum of the hashes of (name, value) pairs.

    A sum commutes, so the order of fields can't matter, and unlike exclusive or it counts equal pairs. Each term
    keeps 59 of its 64 bits, so up to 16 fields add up without overflow, which ANSI mode would raise.
    """
    if len(fields) > 16:
        raise ValueError("at most 16 fields fit without overflow")
    terms = [F.shiftrightunsigned(F.xxhash64(F.lit(lane), F.lit(n), v), 5) for n, v in fields.items()]
    return reduce(lambda a, b: a + b, terms)


#: Rows of one fingerprint above which its rows are salted. Groups beyond it number at most (all rows) / HOT, which
#: bounds what is broadcast of them: 3,000 small rows for 300 million.
HOT = 100_000


def copies(records: DataFrame, id_col: str, fields: list[str], hot: int = HOT) -> DataFrame:
    """(first, other) for each row that equals an earlier one in all ``fields``; ``first`` is the smallest id.

    1. Two lanes of the multiset hash make a 118-bit fingerprint.
    2. One hash aggregate of fixed width keeps, for each fingerprint, the smallest id, the number of rows and the
       extremes of two check hashes over all field names, lengths and values. A group that holds a third of all rows shrinks
       to one row per map task before the shuffle. Groups of one row are dropped, the others stand in a checkpoint.
    3. A group whose check hashes do not vary is verified; its rows meet their first row by a hash join on the
       fingerprint. No row carries texts through a shuffle, and nothing is sorted. Rows of a group of more than ``hot`` rows are
       salted, so that no task gets more than about ``hot`` of them.
    4. Groups whose check hashes vary hold different records of one fingerprint. Their rows are grouped by the fields
       themselves.

    Nulls equal nulls. Repeated ids give repeated rows. Extra columns are ignored. An empty table gives no row.
    """
    named = {f: F.coalesce(F.col(f).cast("string"), F.lit("\0null")) for f in fields}
    return _verified(
        records,
        F.col(id_col),
        multiset_hash(named, 1),
        multiset_hash(named, 2),
        F.struct(*[v.alias(k) for k, v in named.items()]),
        hot,
    )


def _check(fields: Column, lane: int) -> Column:
    return F.xxhash64(F.lit(lane), fields)


def _verified(records: DataFrame, key: Column, h1: Column, h2: Column, fields: Column, hot: int) -> DataFrame:
    rows = records.select(key.alias("id"), h1.alias("h1"), h2.alias("h2"))
    checked = records.select(key.alias("id"), h1.alias("h1"), h2.alias("h2"), _check(fields, 3).alias("c"), _check(fields, 4).alias("d"))
    extremes = [f(c).alias(f"{n}_{c}") for c in "cd" for n, f in (("lo", F.min), ("hi", F.max))]
    groups = checked.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), *extremes).where("n > 1")
    groups = checkpointed(groups.select("h1", "h2", "first", "n", ((F.col("lo_c") == F.col("hi_c")) & (F.col("lo_d") == F.col("hi_d"))).alias("same")))
    firsts = groups.where("same").select("h1", "h2", "first", F.ceil(F.col("n") / F.lit(hot)).cast("int").alias("salts"))
    salted = firsts.select("h1", "h2", "first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    spread_keys = F.broadcast(firsts.where("salts > 1").select("h1", "h2", "salts"))
    salt = F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")
    probe = rows.join(spread_keys, ["h1", "h2"], "left").select("h1", "h2", "id", salt)
    found = probe.join(salted.hint("shuffle_hash"), ["h1", "h2", "salt"]).where("id <> first").select("first", F.col("id").alias("other"))
    mixed = groups.where("not same").select("h1", "h2")
    if mixed.isEmpty():
        return found
    # records of other fields under one fingerprint: the fields are the key
    rest = records.select(key.alias("id"), h1.alias("h1"), h2.alias("h2"), fields.alias("fields")).join(mixed.hint("shuffle_hash"), ["h1", "h2"], "left_semi")
    by_fields = rest.groupBy("fields").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("fields", "first")
    return found.unionByName(rest.join(by_fields, "fields").where("id <> first").select("first", F.col("id").alias("other")))


def distinct_records(records: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """One row for each distinct record: first id, number of copies, normalised fields.

    The fingerprint groups first; the fields are part of the key, so equality is exact, and as the fingerprint
    stands first in it, most comparisons end there.
    """
    named = {f: F.coalesce(F.col(f).cast("string"), F.lit("\0null")) for f in fields}
    rows = records.select(F.col(id_col).alias("id"), multiset_hash(named, 1).alias("h1"), multiset_hash(named, 2).alias("h2"), *fields)
    out = rows.groupBy("h1", "h2", *fields).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n_copies"))
    return out.select("first", "n_copies", *fields)
