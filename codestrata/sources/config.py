"""Infrastructure texts as resource rows: HCL blocks and Dockerfile instructions."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import spread

RESOURCES = "file_id long, repo string, rel_path string, resource_type string, name string, start_line int, attrs map<string,string>, items array<struct<path:string,pos:int,attrs:map<string,string>>>"
#: Fixed value: levels of nesting up to which a block is read.
MOST_DEPTH = 256
_TOKEN = re.compile(
    r"""(?P<skip>[ \t\r]+|\#[^\n]*|//[^\n]*|/\*[\s\S]*?\*/)|(?P<nl>\n)|(?P<here><<[-~]?(?P<tag>[A-Za-z_]\w*)[^\n]*\n[\s\S]*?^[ \t]*(?P=tag)[ \t]*\r?$)
    |(?P<str>"(?:[^"\\$]|\\.|\$(?!\{)|\$\{(?:[^{}"]|"[^"]*"|\{[^{}]*\})*\})*")|(?P<num>-?\d+(?:\.\d+)?)|(?P<id>[A-Za-z_][\w.-]*(?:\[[^\]\n]*\])*)|(?P<op>=>|==|!=|<=|>=|&&|\|\||[\s\S])""",
    re.X | re.M,
)


class _Stop(Exception):
    pass


def parse_hcl(text: str | None) -> list[dict]:
    """Blocks as {type, labels, line, body}; a block that does not parse is left out, reading goes on behind it.

    Values are strings, numbers, booleans, null, lists and objects; expressions stay as text, for-expressions give
    an empty list or object. Every token is read once, so the work is linear in the text.
    """
    toks: list[tuple[str, str, int]] = []
    at, line = 0, 1
    while at < len(text or ""):
        m = _TOKEN.match(text, at)
        if m.lastgroup != "skip" and not (m.group("skip")):
            kind = "here" if m.group("here") else next(k for k in ("nl", "str", "num", "id", "op") if m.group(k) is not None)
            toks.append((kind, m.group(), line))
        line += m.group().count("\n")
        at = m.end()
    blocks: list[dict] = []
    pos = 0

    def body(i: int, depth: int, closed: bool) -> tuple[dict, int]:
        if depth > MOST_DEPTH:
            raise _Stop
        out: dict = {}
        while i < len(toks):
            kind, word, _ = toks[i]
            if kind == "nl" or word == ",":
                i += 1
            elif word == "}":
                return out, i + 1
            elif kind in ("id", "str"):
                name = word.strip('"')
                if i + 1 < len(toks) and toks[i + 1][1] in ("=", ":"):
                    out[name], i = value(i + 2, depth + 1)
                else:
                    j = i + 1
                    while j < len(toks) and toks[j][0] in ("str", "id"):
                        j += 1
                    if j >= len(toks) or toks[j][1] != "{":
                        raise _Stop
                    child, i = body(j + 1, depth + 1, True)
                    have = out.get(name)
                    out[name] = child if have is None else [*have, child] if isinstance(have, list) else [have, child]
            else:
                raise _Stop
        if closed:
            raise _Stop
        return out, i

    def value(i: int, depth: int):
        if depth > MOST_DEPTH:
            raise _Stop
        while i < len(toks) and toks[i][0] == "nl":
            i += 1
        if i >= len(toks):
            raise _Stop
        start, (kind, word, _) = i, toks[i]
        if word in ("[", "{") and i + 1 < len(toks) and toks[i + 1][1] == "for":
            return ([] if word == "[" else {}), skip(i)
        if word == "{":
            return body(i + 1, depth + 1, True)
        if word == "[":
            out, i = [], i + 1
            while i < len(toks) and toks[i][1] != "]":
                if toks[i][0] == "nl" or toks[i][1] == ",":
                    i += 1
                    continue
                v, i = value(i, depth + 1)
                out.append(v)
            if i >= len(toks):
                raise _Stop
            return out, i + 1
        if word == "jsonencode" and i + 1 < len(toks) and toks[i + 1][1] == "(":
            v, i = value(i + 2, depth + 1)
            while i < len(toks) and toks[i][1] != ")":
                i += 1
            return v, i + 1
        end = i
        depth_in = 0
        while end < len(toks) and (depth_in or (toks[end][0] != "nl" and toks[end][1] not in (",", "]", "}", ")"))):
            depth_in += (toks[end][1] in "([{") - (toks[end][1] in ")]}") if toks[end][0] == "op" else 0
            end += 1
        part = toks[start:end]
        if len(part) == 1:
            if kind == "str":
                return word[1:-1].replace('\\"', '"'), end
            if kind == "here":
                return "\n".join(word.split("\n")[1:-1]), end
            if kind == "num":
                return (float(word) if "." in word else int(word)), end
            if word in ("true", "false", "null"):
                return {"true": True, "false": False, "null": None}[word], end
        return " ".join(t[1] for t in part), max(end, start + 1)

    def skip(i: int) -> int:
        depth_in = 0
        while i < len(toks):
            depth_in += (toks[i][1] in "([{") - (toks[i][1] in ")]}") if toks[i][0] == "op" else 0
            i += 1
            if not depth_in:
                return i
        raise _Stop

    while pos < len(toks):
        if toks[pos][0] == "nl":
            pos += 1
            continue
        start = pos
        labels = []
        while pos < len(toks) and toks[pos][0] in ("id", "str"):
            labels.append(toks[pos][1].strip('"'))
            pos += 1
        if pos >= len(toks):
            break
        try:
            if labels and toks[pos][1] == "=":  # an assignment at the top, as in variable files
                _, pos = value(pos + 1, 0)
            elif labels and toks[pos][1] == "{":
                content, end = body(pos + 1, 0, True)
                blocks.append({"type": labels[0], "labels": labels[1:], "line": toks[start][2], "body": content})
                pos = end
            else:
                raise _Stop
        except _Stop:
            try:  # behind the block's closing brace; one that never closes ends the text
                pos = skip(pos) if toks[pos][1] == "{" else pos + 1
            except _Stop:
                break
            while pos < len(toks) and toks[pos][0] != "nl":
                pos += 1
    return blocks


INSTRUCTIONS = frozenset("FROM RUN CMD LABEL MAINTAINER EXPOSE ENV ADD COPY ENTRYPOINT VOLUME USER WORKDIR ARG ONBUILD STOPSIGNAL HEALTHCHECK SHELL".split())


def parse_dockerfile(text: str | None) -> list[dict]:
    """Instructions as {instruction, line, value, flags, image, tag, digest, stage, tag_omitted}; continuations are joined."""
    out = []
    lines = (text or "").replace("\r", "").split("\n")
    i = 0
    while i < len(lines):
        first, whole = i, lines[i]
        while whole.rstrip().endswith("\\") and i + 1 < len(lines):
            i += 1
            whole = whole.rstrip()[:-1] + " " + ("" if lines[i].lstrip().startswith("#") else lines[i].strip())
        i += 1
        word, _, rest = whole.strip().partition(" ")
        if word.upper() not in INSTRUCTIONS or whole.lstrip().startswith("#"):
            continue
        flags = dict(re.findall(r"--([\w-]+)(?:=(\S+))?", re.match(r"(?:--\S+\s+)*", rest).group()))
        row = {"instruction": word.upper(), "line": first + 1, "value": re.sub(r"^(?:--\S+\s+)*", "", rest).strip(), **{f"flags.{k}": v or "true" for k, v in flags.items()}}
        if word.upper() == "FROM":
            ref, _, stage = re.sub(r"\s+[aA][sS]\s+", "\0", row["value"], count=1).partition("\0")
            image, _, digest = ref.strip().partition("@")
            name, colon, tag = image.rpartition(":")
            tagged = bool(colon) and "/" not in tag
            row |= {"image": name if tagged else image, "tag": tag if tagged else "latest", "digest": digest or None, "stage": stage.strip() or None, "tag_omitted": str(not tagged and not digest).lower()}
        out.append(row)
    return out


def text_of(value) -> str | None:
    """A value as rules compare it: booleans in lower case, whole numbers without a point, lists joined by commas."""
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    if isinstance(value, list):
        return ",".join(text_of(v) or "" for v in value)
    return json.dumps(value) if isinstance(value, dict) else str(value)


def flattened(obj: dict, prefix: str = "") -> dict[str, str | None]:
    """Dotted path to text; a list is stepped into by its first element, and texts that hold JSON are opened."""
    out: dict[str, str | None] = {}
    for k, v in obj.items():
        path = prefix + k
        if isinstance(v, str) and v.lstrip()[:1] in ("{", "["):
            try:
                v = json.loads(v)
            except ValueError:
                pass
        out[path] = text_of(v)
        first = v[0] if isinstance(v, list) and v else v
        if isinstance(first, dict):
            out |= flattened(first, path + ".")
    return out


def items(obj: dict) -> list[dict]:
    """Elements of every list of a resource, scalars as {value}; one object counts as a list of one."""
    out = []
    for k, v in obj.items():
        for n, x in enumerate(v if isinstance(v, list) else [v] if isinstance(v, dict) else []):
            out.append({"path": k, "pos": n, "attrs": flattened(x) if isinstance(x, dict) else {"value": text_of(x)}})
    return out


# Folders in which no configuration is looked for.
SKIPPED = ("node_modules", ".git", "dist", "build", ".next", "__pycache__", ".DS_Store", "Pods", ".build", "vendor", "coverage", ".scannerwork", ".venv", "venv", ".mypy_cache", ".pytest_cache", ".tox")


def resources(files: DataFrame) -> DataFrame:
    """Resource rows of all HCL files and Dockerfiles outside of SKIPPED folders; blocks that do not parse give none."""
    name = F.lower(F.regexp_extract("rel_path", r"([^/]+)$", 1))
    wanted = name.rlike(r"\.(tf|tfvars|dockerfile)$") | name.isin("dockerfile", "containerfile")
    wanted = wanted & ~F.arrays_overlap(F.split("rel_path", "/"), F.array(*[F.lit(x) for x in SKIPPED]))

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for fid, repo, rel, text in zip(pdf["file_id"], pdf["repo"], pdf["rel_path"], pdf["content"], strict=True):
                if rel.lower().endswith((".tf", ".tfvars")):
                    for b in parse_hcl(text):
                        if b["type"] == "resource" and b["labels"]:
                            out.append((fid, repo, rel, b["labels"][0], ".".join(b["labels"]), b["line"], flattened(b["body"]), items(b["body"])))
                else:
                    rows = parse_dockerfile(text)
                    for r in rows:
                        out.append((fid, repo, rel, "docker_" + r["instruction"].lower(), r["instruction"], r["line"], {k: text_of(v) for k, v in r.items()}, []))
                    if rows:
                        out.append((fid, repo, rel, "dockerfile", "dockerfile", 1, {"instructions": ",".join(r["instruction"] for r in rows)}, []))
            yield pd.DataFrame(out, columns=["file_id", "repo", "rel_path", "resource_type", "name", "start_line", "attrs", "items"])

    return spread(files.where(wanted & F.col("content").isNotNull()).select("file_id", "repo", "rel_path", "content")).mapInPandas(parse, RESOURCES)
