"""Schemas that drift between files: rescue-column ingestion and a list of every change."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.operators.nested import loads
from codestrata.session import checkpointed, spread

# The target schema with the spellings approved for each measure (path, factor to the target's unit).
APPROVED = {
    "run_index": ("int", {"runIndex": 1, "runIdx": 1, "run_no": 1}),
    "total_ms": ("double", {"totalMs": 1, "total_ms": 1, "elapsedMs": 1, "wallMs": 1}),
    "meteor_ms": ("double", {"engineMs.METEOR": 1, "engines.METEOR": 1, "engine_ms_meteor": 1}),
    "nova_ms": ("double", {"engineMs.NOVA": 1, "engines.NOVA": 1, "engine_ms_nova": 1}),
    "eclipse_ms": ("double", {"engineMs.ECLIPSE": 1, "engines.ECLIPSE": 1, "engine_ms_eclipse": 1}),
    "pulsar_ms": ("double", {"engineMs.PULSAR": 1, "engines.PULSAR": 1, "engine_ms_pulsar": 1}),
    "aurora_ms": ("double", {"engineMs.AURORA": 1, "engines.AURORA": 1, "engine_ms_aurora": 1}),
    "peak_rss_mb": ("double", {"peakRssMB": 1, "rssPeakMb": 1, "peakRssBytes": 2**-20, "peak_rss_bytes": 2**-20}),
    "baseline_rss_bytes": ("bigint", {"baselineRssBytes": 1, "baseline_rss_bytes": 1, "baseRss": 1}),
    "score": ("double", {"score": 1, "auroraScore": 1, "aurora_score": 1, "finalScore": 1}),
    "verdict": ("string", {"verdict": 1, "auroraVerdict": 1, "outcome": 1}),
    "file_count": ("int", {"fileCount": 1, "files": 1, "nFiles": 1}),
    "loc_count": ("int", {"locCount": 1, "loc": 1, "linesOfCode": 1}),
    "function_count": ("int", {"functionCount": 1, "functions": 1, "fnCount": 1}),
    "circular_deps": ("int", {"circularDeps": 1, "circular_deps": 1, "cycles": 1}),
    "god_modules": ("int", {"godModules": 1, "god_modules": 1}),
    "issues_high": ("int", {"issuesBySeverity.HIGH": 1, "issues.HIGH": 1, "issuesHigh": 1}),
    "issues_med": ("int", {"issuesBySeverity.MED": 1, "issues.MED": 1, "issuesMed": 1}),
}
UNITS = {"bytes", "byte", "b", "kb", "mb", "gb", "ms", "s", "sec", "seconds", "count", "n", "num", "no"}
_SPELLING = {path: name for name, (_, paths) in APPROVED.items() for path in paths}


def measure(path: str) -> str:
    """The measure a field holds: the approved one, else its words without case, order, separators and unit."""
    if path in _SPELLING:
        return _SPELLING[path]
    words = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", path)
    return "~" + " ".join(sorted({w.lower() for w in words} - UNITS) or [path])


def kind_of(value) -> str | None:
    """number, text, boolean or list; null has none."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int | float):
        return "number"
    if isinstance(value, str):
        return "text"
    return "list" if isinstance(value, list) else None


def flat(obj: dict, prefix: str = "") -> dict:
    """Dotted paths of all values that are no objects."""
    out = {}
    for k, v in obj.items():
        if isinstance(v, dict):
            out |= flat(v, f"{prefix}{k}.")
        else:
            out[prefix + k] = v
    return out


def records_of(body: str | None) -> list[tuple[str | None, dict]]:
    """(result id, flat run record) of a result file; null and broken bodies and records that are no objects give none."""
    root = loads(body)
    results = root.get("results") if isinstance(root, dict) else None
    out = []
    for result in results if isinstance(results, list) else [results]:
        if isinstance(result, dict):
            runs = result.get("runs")
            out += [(_text(result.get("id")), flat(r)) for r in (runs if isinstance(runs, list) else [runs]) if isinstance(r, dict)]
    return out


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


NUMBER = re.compile(r"\s*([-+]?[0-9][0-9,_]*(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)\s*(%|[A-Za-z]+)?\s*")
#: Units that a text may carry, by the measure's own unit, with the factor to it.
CARRIED = {
    "ms": {"ms": 1.0, "s": 1000.0, "sec": 1000.0, "seconds": 1000.0},
    "mb": {"mb": 1.0, "bytes": 2**-20, "b": 2**-20, "kb": 2**-10, "gb": 2.0**10},
    "bytes": {"bytes": 1.0, "b": 1.0, "kb": 2.0**10, "mb": 2.0**20, "gb": 2.0**30},
}
SIZES = {"int": 31, "bigint": 63}


def cast(value, column: str, kind: str, factor: float):
    """A delivered value as the column's type, in its unit; None where it doesn't cast without loss.

    Texts may carry a unit or a percent sign, which count. Integers take whole numbers in range only; truth values, lists
    and numbers that are not finite cast to nothing.
    """
    if kind == "string":
        return value if isinstance(value, str) else None
    if isinstance(value, str):
        m = NUMBER.fullmatch(value)
        if not m:
            return None
        unit = (m.group(2) or "").lower()
        number = float(re.sub("[,_]", "", m.group(1)))
        if unit == "%":
            number /= 100.0
        elif unit:
            known = CARRIED.get(column.rsplit("_", 1)[-1], {})
            if unit not in known:
                return None
            number, factor = number * known[unit], 1
        number *= factor
    elif isinstance(value, int | float) and not isinstance(value, bool):
        if kind != "double" and factor == 1 and isinstance(value, int):
            return value if abs(value) < 2 ** SIZES[kind] else None
        try:
            number = float(value) * factor
        except OverflowError:
            return None
    else:
        return None
    if not math.isfinite(number):
        return None
    if kind == "double":
        return number
    return int(number) if number == int(number) and abs(number) < 2 ** SIZES[kind] else None


def enforced(record: dict, approved: dict = APPROVED) -> tuple[dict, dict, dict]:
    """(typed, rescued, origin) of one flat record under the target schema.

    1. Enforce: every path the target doesn't know goes to ``rescued``, and so does every spelling of a column beside its first.
    2. Promote: approved spellings that were rescued are replayed into their typed columns, in the order they are
       approved, in the column's unit. What casts without loss leaves ``rescued``, one value for each column; every
       other delivered value stays there, nulls excepted.
    ``origin`` tells for each typed column which path filled it.
    """
    typed, rescued, origin = {}, {}, {}
    target = {next(iter(paths)): name for name, (_, paths) in approved.items()}
    for path, value in record.items():
        name = target.get(path)
        done = cast(value, name, approved[name][0], approved[name][1][path]) if name else None
        if done is None:
            rescued[path] = value
        else:
            typed[name], origin[name] = done, path
    for name, (kind, paths) in approved.items():
        for path, factor in paths.items():
            if name in typed:
                break
            if rescued.get(path) is not None and (done := cast(rescued[path], name, kind, factor)) is not None:
                typed[name], origin[name] = done, path
                del rescued[path]
    return typed, {k: v for k, v in rescued.items() if v is not None}, origin


def ingest(files: DataFrame, approved: dict = APPROVED) -> DataFrame:
    """Run records under the target schema: (file_id, producer, generated_at, result_id, run_pos, typed..., rescued).

    One Arrow pass parses, enforces, rescues and promotes (``enforced``). ``rescued`` holds, as JSON by path, each delivered value
    that is in no typed column. Files with the same producer and generated_at are one file; its records come from
    the smallest file_id. Null bodies give no rows. Extra columns are dropped.
    """

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for fid, producer, at, body in zip(pdf["file_id"], pdf["producer"], pdf["generated_at"], pdf["body"], strict=True):
                for pos, (rid, record) in enumerate(records_of(body)):
                    typed, rescued, _ = enforced(record, approved)
                    rest = json.dumps(rescued, ensure_ascii=False, sort_keys=True) if rescued else None
                    out.append((fid, producer, at, rid, pos, *[typed.get(c) for c in approved], rest))
            frame = pd.DataFrame(out, columns=[*head, *approved, "rescued"])
            yield frame.astype({c: "Int64" for c, (kind, _) in approved.items() if kind != "double" and kind != "string"})

    head = ["file_id", "producer", "generated_at", "result_id", "run_pos"]
    types = ["file_id long", "producer string", "generated_at timestamp", "result_id string", "run_pos int"]
    schema = ", ".join([*types, *[f"{c} {kind}" for c, (kind, _) in approved.items()], "rescued string"])
    return spread(first_deliveries(files)).mapInPandas(parse, schema)


def first_deliveries(files: DataFrame) -> DataFrame:
    """One row for each (producer, generated_at): that of the smallest file_id. Bodies stay out of the aggregate."""
    firsts = files.groupBy("producer", "generated_at").agg(F.min("file_id").alias("file_id"))
    return files.select("file_id", "body").join(firsts, "file_id")


def inventories(files: DataFrame) -> DataFrame:
    """(producer, generated_at, file_id, fields): what ingestion made of each file's fields, with their types.

    Each record is enforced as in ``ingest``; its fields are the paths that filled typed columns, the rescued ones and
    those that held null only. Copies are one file with the smallest file_id; a field is there if any record of any
    copy has it. The type is empty where only null was seen; several types within one file stand in order, separated by
    commas.
    """

    def fields(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for fid, producer, at, body in zip(pdf["file_id"], pdf["producer"], pdf["generated_at"], pdf["body"], strict=True):
                seen: dict[str, set] = {}
                for _, record in records_of(body):
                    _, rescued, origin = enforced(record)
                    for path in (*origin.values(), *rescued):
                        seen.setdefault(path, set()).add(kind_of(record[path]))
                    for path in record.keys() - seen.keys():
                        seen[path] = set()
                out.append((producer, at, fid, {p: ",".join(sorted(filter(None, k))) for p, k in seen.items()}))
            yield pd.DataFrame(out, columns=["producer", "generated_at", "file_id", "fields"])

    src = spread(files.select("file_id", "producer", "generated_at", "body"))
    raw = src.mapInPandas(fields, "producer string, generated_at timestamp, file_id long, fields map<string,string>")
    # equal inventories of one file melt into one before the shuffle: the set grows with its formats, not its copies
    merged = raw.groupBy("producer", "generated_at").agg(F.min("file_id").alias("file_id"), F.collect_set(F.array_sort(F.map_entries("fields"))).alias("all"))
    entries = F.array_sort(F.array_distinct(F.flatten("all")))
    return merged.select("producer", "generated_at", "file_id", entries.alias("fields"))


def previous(rows: DataFrame, group: list[str], order: str, value: str, buckets: list) -> DataFrame:
    """``rows`` with ``prior``: the value of the row before, within the group, by ``order``.

    A window over the whole group would put a group with a third of all rows into one task. So the window runs
    within (group, first of ``buckets``); the first row of a bucket takes the last value of the latest earlier bucket. Those
    come from one row for each bucket, among which the same is done with the next, wider bucket.
    """
    if not buckets:
        return rows.withColumn("prior", F.lag(value).over(Window.partitionBy(*group).orderBy(order)))
    here = f"_bucket{len(buckets)}"
    cut = rows.withColumn(here, buckets[0])
    inner = Window.partitionBy(*group, here).orderBy(order)
    marked = cut.withColumn("_rn", F.row_number().over(inner)).withColumn("_in", F.lag(value).over(inner))
    lasts = cut.groupBy(*group, here).agg(F.max(order).alias(order), F.max_by(value, order).alias(value))
    carried = previous(lasts, group, order, value, buckets[1:]).select(*group, here, F.col("prior").alias("_carried"))
    joined = marked.join(carried, [*group, here], "left")
    prior = F.when(F.col("_rn") == 1, F.col("_carried")).otherwise(F.col("_in"))
    return joined.withColumn("prior", prior).drop(here, "_rn", "_in", "_carried")


def compare(before: dict[str, str], after: dict[str, str]) -> list[tuple[str, str, str]]:
    """(change_kind, field_before, field_after) between two inventories (field to types).

    A removed and an added field of one measure are a rename; of several candidates the first by name pairs.
    """
    out = []
    gone, new = sorted(set(before) - set(after)), sorted(set(after) - set(before))
    by_measure: dict[str, list[str]] = {}
    for f in new:
        by_measure.setdefault(measure(f), []).append(f)
    for f in gone:
        pairs = by_measure.get(measure(f))
        if pairs:
            out.append(("renamed", f, pairs.pop(0)))
        else:
            out.append(("removed", f, f))
    out += [("added", f, f) for fs in by_measure.values() for f in fs]
    out += [("type_changed", f, f) for f in sorted(set(before) & set(after)) if before[f] and after[f] and before[f] != after[f]]
    return out


def _merge(entries) -> dict[str, str]:
    out: dict[str, set] = {}
    for e in entries:
        out.setdefault(e["key"], set()).update(filter(None, e["value"].split(",")))
    return {k: ",".join(sorted(v)) for k, v in out.items()}


def changes(files: DataFrame) -> DataFrame:
    """(file_id, change_kind, field_before, field_after) of every field that differs from the producer's previous file.

    Both files are seen as ingestion saw them: the fields that it promoted, rescued or found null. A rename is one column
    filled from another path, or one rescued measure under another.

    Files without records count as files without fields. Producer null is a producer of its own. A file whose
    ``generated_at`` is null has no place in the order and is compared with none. Equal neighbours are dropped in
    the JVM; only pairs that differ reach Python.
    """
    inv = checkpointed(inventories(files).where(F.col("generated_at").isNotNull()))  # one narrow row a file, read for each width of bucket
    seq = previous(inv.withColumn("producer", F.coalesce("producer", F.lit("\0"))), ["producer"], "generated_at", "fields", [F.date_trunc("hour", "generated_at"), F.date_trunc("month", "generated_at")])
    differing = seq.where(F.col("prior").isNotNull() & (F.col("prior") != F.col("fields"))).select("file_id", "prior", "fields")

    def rows(batches):
        import pandas as pd

        for pdf in batches:
            out = [(fid, *c) for fid, b, a in zip(pdf["file_id"], pdf["prior"], pdf["fields"], strict=True) for c in compare(_merge(b), _merge(a))]
            yield pd.DataFrame(out, columns=["file_id", "change_kind", "field_before", "field_after"])

    return differing.mapInPandas(rows, "file_id long, change_kind string, field_before string, field_after string")
