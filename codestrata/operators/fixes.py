"""Patches for findings: optional access, guarded parsing, secrets from the environment; as unified diffs."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTEXT = 3


def optional_access(line: str) -> str | None:
    """a.b.c read as a?.b?.c; targets of assignments, imports and lines that do so already stay."""
    if "?." in line or re.match(r"\s*(?:import|export|//|\*)", line):
        return None
    head, eq, tail = line.partition("=") if re.match(r"\s*(?:const|let|var)\s", line) else ("", "", line)
    fixed = re.sub(r"(?<![\w.'\"`])([A-Za-z_$][\w$]*)((?:\.[A-Za-z_$][\w$]*){2,})(?!\s*=[^=])", lambda m: m.group(1) + m.group(2).replace(".", "?."), tail)
    return head + eq + fixed if fixed != tail else None


def guarded_parse(line: str) -> str | None:
    """const x = JSON.parse(e); as a declaration and a try block that throws with its cause."""
    m = re.match(r"(\s*)(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(JSON\.parse\(.*\));?\s*\Z", line)
    if not m:
        return None
    pad, name, call = m.groups()
    return f"{pad}let {name};\n{pad}try {{\n{pad}  {name} = {call};\n{pad}}} catch (err) {{\n{pad}  throw new Error('invalid JSON', {{ cause: err }});\n{pad}}}"


def secret_from_environment(line: str) -> str | None:
    """A named literal secret read from the environment instead."""
    m = re.match(r"(.*?\b([A-Za-z_]\w*)\s*(?::\s*string\s*)?=\s*)(['\"`])[^'\"`]{8,}\3(.*)\Z", line)
    if not m or not re.search(r"(?i)secret|token|passw|key", m.group(2)):
        return None
    name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", m.group(2)).upper()
    return f"{m.group(1)}process.env.{name}{m.group(4)}"


TEMPLATES = {"null-safety": optional_access, "error-boundary": guarded_parse, "hardcoded-secret": secret_from_environment}


def unified_diff(before: str, after: str, path: str) -> str:
    return "".join(difflib.unified_diff(before.splitlines(True), after.splitlines(True), f"a/{path}", f"b/{path}", n=CONTEXT))


def patched(content: str | None, line_no: int, kind: str) -> str | None:
    """The text with the finding's line fixed; null where no template applies."""
    lines = (content or "").split("\n")
    if kind not in TEMPLATES or not 1 <= line_no <= len(lines):
        return None
    old = lines[line_no - 1]
    end = "\r" if old.endswith("\r") else ""
    new = TEMPLATES[kind](old.removesuffix("\r"))
    if new is None:
        return None
    lines[line_no - 1] = new.replace("\n", end + "\n") + end
    return "\n".join(lines)


def proposals(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, rel_path, line_no, type, diff) of each finding that a template fixes.

    The findings of a file are put together first, no more than it has lines and types, so its content meets them once.
    """

    def make(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for fid, rel, hits, text in zip(pdf["file_id"], pdf["rel_path"], pdf["hits"], pdf["content"], strict=True):
                for hit in hits:
                    after = patched(text, hit["line_no"], hit["type"])
                    if after is not None:
                        out.append((fid, rel, hit["line_no"], hit["type"], unified_diff(text, after, rel)))
            yield pd.DataFrame(out, columns=["file_id", "rel_path", "line_no", "type", "diff"])

    js = findings.where(F.col("rel_path").rlike(r"\.(js|ts|jsx|tsx|mjs)$") & F.col("type").isin(*TEMPLATES))
    of_file = js.groupBy("file_id", "rel_path").agg(F.sort_array(F.collect_set(F.struct("line_no", "type"))).alias("hits"))
    both = of_file.join(files.select("file_id", "content"), "file_id")
    return both.mapInPandas(make, "file_id long, rel_path string, line_no int, type string, diff string")
