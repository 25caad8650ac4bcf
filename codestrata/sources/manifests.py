"""Pinned dependencies of manifests and lock files, and their advisories."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = {"package.json": "npm", "package-lock.json": "npm", "requirements.txt": "pypi", "Pipfile.lock": "pypi"}
PIN = re.compile(r"[=v]?(\d+\.\d+\.\d+(?:[-+][\w.-]+)?)\Z")
REQUIREMENT = re.compile(r"\s*([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]]*\])?\s*==\s*([\w.!+-]+)\s*(?:;.*|#.*)?\Z")
DEPS = "file_id long, repo string, rel_path string, ecosystem string, kind string, name string, version string, n int"


def pinned(version) -> str | None:
    """A concrete version; ranges, tags, addresses and aliases are none."""
    m = PIN.match(version.strip()) if isinstance(version, str) else None
    return m.group(1) if m else None


def parse_manifest(name: str, text: str | None) -> list[tuple[str, str]]:
    """(package, version) of each concrete pin in order; the first of a name wins; broken texts give none."""
    out: dict[str, str] = {}
    try:
        if name == "requirements.txt":
            for line in (text or "").splitlines():
                if m := REQUIREMENT.match(line):
                    out.setdefault(m.group(1).lower().replace("_", "-"), m.group(2))
            return list(out.items())
        root = json.loads(text or "")
        if name == "package.json":
            for section in ("dependencies", "optionalDependencies"):
                for k, v in (root.get(section) or {}).items():
                    if p := pinned(v):
                        out.setdefault(k, p)
        elif name == "package-lock.json" and root.get("lockfileVersion") in (2, 3):
            for k, v in (root.get("packages") or {}).items():
                if "node_modules/" in k and not v.get("dev") and not v.get("devOptional") and (p := pinned(v.get("version"))):
                    out.setdefault(k.rpartition("node_modules/")[2], p)
        elif name == "Pipfile.lock":
            for k, v in (root.get("default") or {}).items():
                if isinstance(v, dict) and str(v.get("version", "")).startswith("=="):
                    out.setdefault(k.lower(), v["version"][2:])
    except (ValueError, AttributeError):
        return []
    return list(out.items())


def dependencies(files: DataFrame) -> DataFrame:
    """Pins of every manifest: (file_id, repo, rel_path, ecosystem, kind, name, version, n); other files give none."""
    name = F.regexp_extract("rel_path", r"([^/]+)$", 1)

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for fid, repo, rel, text in zip(pdf["file_id"], pdf["repo"], pdf["rel_path"], pdf["content"], strict=True):
                kind = rel.rsplit("/", 1)[-1]
                out += [(fid, repo, rel, NAMES[kind], kind, k, v, n) for n, (k, v) in enumerate(parse_manifest(kind, text))]
            yield pd.DataFrame(out, columns=["file_id", "repo", "rel_path", "ecosystem", "kind", "name", "version", "n"])

    return files.where(name.isin(*NAMES)).select("file_id", "repo", "rel_path", "content").mapInPandas(parse, DEPS)


def lock_wins(deps: DataFrame) -> DataFrame:
    """One version of each package, folder and ecosystem: a lock file's before a manifest's, then the first."""
    folder = F.regexp_replace("rel_path", r"[^/]*$", "")
    order = F.struct((~F.col("kind").contains("lock")).alias("a"), "rel_path", "n")
    g = deps.withColumn("folder", folder).groupBy("repo", "folder", "ecosystem", "name")
    return g.agg(F.min_by(F.struct("version", "kind", "rel_path"), order).alias("d")).select("repo", "folder", "ecosystem", "name", "d.version", "d.kind", "d.rel_path")


def vulnerable(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies with the ids of their advisories (ecosystem, name, version, ids array<string>)."""
    return deps.join(advisories, ["ecosystem", "name", "version"]).select(*deps.columns, F.array_distinct("ids").alias("ids"))
