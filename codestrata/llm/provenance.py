"""Files that nobody wrote by hand: generated, minified, bundled, vendored or data.

Attribute files of a repository say so for its paths; where a repository declares nothing, equivalent patterns do:
globs of the same grammar, mined from declared repositories, and what the head and the texture of the content show.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import checkpointed, small_side, spread

# Globs that public repositories declare in their attribute files, mined beforehand (class, glob).
KNOWN_GLOBS = (
    ("generated", "*_pb2.py"), ("generated", "*_pb2_grpc.py"), ("generated", "*.pb.go"), ("generated", "*.pb.cc"), ("generated", "*.pb.h"),
    ("generated", "*_gen.go"), ("generated", "*_mock.go"), ("generated", "*_string.go"), ("generated", "zz_generated.*"), ("generated", "*_generated.*"),
    ("generated", "*_Generated.*"), ("generated", "*OuterClass.java"), ("generated", "*.generated.*"), ("generated", "*.g.ts"), ("generated", "*.g.dart"),
    ("generated", "*.designer.cs"), ("generated", "package-lock.json"), ("generated", "yarn.lock"), ("generated", "__generated__/"),
    ("minified", "*.min.js"), ("minified", "*-min.js"), ("minified", "*.min.css"), ("minified", "*.bundle.js"), ("minified", "*.chunk.js"),
    ("minified", "*.[0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f].js"),
    ("vendored", "node_modules/"), ("vendored", "vendor/"), ("vendored", "third_party/"), ("vendored", "third-party/"), ("vendored", "external/"),
    ("vendored", "deps/"), ("vendored", "bower_components/"), ("vendored", "Godeps/"), ("vendored", "site-packages/"),
)
# What generators write at the head of their files.
BANNER = re.compile(
    r"""^[\s/#*;<!"'-]*(?:code[ ]generated[ ]by[ ].{1,80}do[ ]not[ ]edit|auto-?[ ]?generated\b(?!.*\bbanner)|<auto-generated>|@generated\b
    |(?:this[ ]file[ ]|file[ ])?(?:was[ ]|is[ ])?(?:auto(?:matically)?[ -]?generated|generated[ ]automatically)[ ](?:by|from|file)\b
    |this[ ]file[ ]was[ ]generated\b|generated[ ](?:from|by)[ ]\S+.{0,60}(?:using|with|v?\d|do[ ]not)|produced[ ]by[ ]running[ ].+|machine[ -](?:written|generated)\b
    |diese[ ]datei[ ]wurde[ ]automatisch|erzeugt[ ]durch[ ].+nicht|automatisch[ ]erzeugt|fichier[ ]g[ée]n[ée]r[ée]|archivo[ ]generado|do[ ]not[ ]edit[ ](?:by[ ]hand|manually)?.{0,30}generated)""",
    re.I | re.X | re.M,
)
# How copies of third-party projects begin.
UPSTREAM = re.compile(
    r"""^[\s/#*;<!"'-]*(?:released[ ]under[ ]the[ ].{2,30}licen[sc]e[ ]by[ ]the[ ].+contributors|\S+[ ]-[ ].{2,60}library,[ ]version[ ]\d[\w.]*,[ ]https?://
    |upstream:[ ]\S+[ ]v?\d[\w.]*|copyright[ ]\(c\)[ ].{0,40}\bthe[ ]\S+[ ](?:project|authors|contributors)\b.{0,20}permission[ ]is[ ]granted|vendored[ ]from[ ]|copied[ ]verbatim[ ]from[ ])""",
    re.I | re.X | re.M,
)
#: Lines of the head in which banners stand; a longer block of comments at the beginning counts whole.
HEAD = 12
COMMENTS = re.compile(r"(?:[ \t]*(?:(?://|\#|--|;|%|<!--|\*|'|\"\"\")[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/[^\n]*|<\?php[ \t]*)?\r?\n)*")
#: Share of a text that literal data takes up for the file to be data, and the number of values it needs.
DATA_SHARE, DATA_VALUES = 0.55, 30
#: Bytes of unbroken encoded text that make a blob.
BLOB = 64
#: Share of white space below which a script is minified, and length of the average line above which it is.
DENSE, LONG_LINE, SCRIPT = 0.11, 200, 100

_NUMBERS = re.compile(r"(?:[-+]?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)[fFL]?[\s,;\[\]{}()]+){6,}")
_BLOB = re.compile(rf"(?:[A-Za-z0-9+/=]{{40,}}[\s\"'`+,.\\]*){{1,}}")
#: A key or a picture that somebody put into a text makes no data of it.
_EMBEDDED = re.compile(r"-----BEGIN [A-Z0-9 ]+-----[\s\S]*?-----END [A-Z0-9 ]+-----|(?<=[\"'`(])data:[\w/+.-]+;base64,[A-Za-z0-9+/=]*")


@lru_cache(maxsize=4096)
def glob_pattern(glob: str):
    """An attribute glob as a pattern over a path below the attribute file's folder."""
    g = glob.rstrip("/") + "/**" if glob.endswith("/") else glob
    anchored = "/" in glob.rstrip("/")
    g = g.lstrip("/")
    out, i = "", 0
    while i < len(g):
        if g.startswith("**/", i):
            out, i = out + r"(?:[^/]+/)*", i + 3
        elif g.startswith("**", i):
            out, i = out + r".*", i + 2
        elif g[i] == "*":
            out, i = out + r"[^/]*", i + 1
        elif g[i] == "?":
            out, i = out + r"[^/]", i + 1
        elif g[i] == "[" and "]" in g[i + 1 :]:
            j = g.index("]", i + 1)
            body = g[i + 1 : j]
            out, i = out + "[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]", j + 1
        else:
            out, i = out + re.escape(g[i]), i + 1
    if glob.endswith("/") and "/" not in glob.rstrip("/"):
        anchored = False
    return re.compile(("" if anchored else r"(?:.*/)?") + out + r"\Z")


_ATTRIBUTES = {"linguist-generated": "generated", "linguist-vendored": "vendored", "gitlab-generated": "generated", "linguist-documentation": None, "linguist-detectable": None}


def parse_attributes(content: str | None) -> list[tuple[str, str, bool]]:
    """(glob, class, set) of each mark in an attribute file, in order; macros, comments and other attributes give none."""
    out = []
    for line in (content or "").splitlines():
        line = line.strip()
        if not line or line.startswith(("#", "[")):
            continue
        m = re.match(r'"((?:[^"\\]|\\.)*)"|(\S+)', line)
        glob = m.group(1) or m.group(2) or ""
        for mark in line[m.end() :].split():
            on = not mark.startswith(("-", "!"))
            name, _, value = mark.lstrip("-!").partition("=")
            kind = _ATTRIBUTES.get(name)
            if kind and glob:
                out.append((glob, kind, on and value.lower() not in ("false", "0", "no")))
    return out


def declared(rel_path: str, rules: list[tuple[str, list[tuple[str, str, bool]]]]) -> dict[str, bool]:
    """class -> whether it is set, of a path under the attribute files (folder, marks): deeper folders and later lines win."""
    out: dict[str, bool] = {}
    for folder, marks in sorted(rules, key=lambda r: r[0].count("/") + bool(r[0])):
        if folder and not rel_path.startswith(folder + "/"):
            continue
        below = rel_path[len(folder) + 1 :] if folder else rel_path
        for glob, kind, on in marks:
            if glob_pattern(glob).match(below):
                out[kind] = on
    return out


@lru_cache(maxsize=1)
def _known():
    return [(kind, glob_pattern(g)) for kind, g in KNOWN_GLOBS]


def by_path(rel_path: str, mined=()) -> str | None:
    for kind, pattern in [*_known(), *mined]:
        if pattern.match(rel_path):
            return kind
    return None


def by_content(text: str, rel_path: str) -> str | None:
    """Class that the head or the texture of a text shows: generated, vendored, minified, data or none."""
    head = "\n".join(text[: max(COMMENTS.match(text).end(), _after_lines(text, HEAD))].splitlines())
    if BANNER.search(head):
        return "generated"
    if UPSTREAM.search(head):
        return "vendored"
    n = len(text)
    name = rel_path.rsplit("/", 1)[-1].lower()
    if name.endswith((".js", ".mjs", ".cjs", ".css", ".ts")) and n >= SCRIPT:
        lines = [x for x in text.splitlines() if x.strip()]
        blank = sum(map(len, re.findall(r"\s+", text)))
        if blank / n < DENSE and (n / max(1, len(lines)) > LONG_LINE or _short_names(text)):
            return "data" if _data(text, n) else "minified"
    if not name.startswith(".env") and not name.endswith((".env", ".md", ".yml", ".yaml", ".local")) and _data(text, n):
        return "data"
    return None


def _after_lines(text: str, n: int) -> int:
    at = 0
    for _ in range(n):
        at = text.find("\n", at) + 1
        if not at:
            return len(text)
    return at


def _short_names(text: str) -> bool:
    """Whether most names of the whole text have at most three letters, as renaming leaves them."""
    n = short = 0
    for m in re.finditer(r"(?<![\w\"'.])[A-Za-z_$][\w$]*", text):
        n += 1
        short += m.end() - m.start() <= 3
    return n >= 40 and short / n > 0.6


def _data(text: str, n: int) -> bool:
    numbers = [m.span() for m in _NUMBERS.finditer(text)]
    size = sum(b - a for a, b in numbers)
    if n and size / n >= DATA_SHARE and sum(len(re.findall(r"\d+(?:\.\d+)?", text[a:b])) for a, b in numbers) >= DATA_VALUES:
        return True
    blob = sum(b - a for a, b in (m.span() for m in _BLOB.finditer(_EMBEDDED.sub("", text))) if b - a >= BLOB)
    return n >= BLOB and blob / n >= DATA_SHARE


def _shapes(path: str) -> set[str]:
    parts = path.split("/")
    name = parts[-1]
    out = {p + "/" for p in parts[:-1]}
    for sep in "._-":
        if sep in name[1:]:
            tail = name[name.index(sep, 1) :]
            if len(tail) > 4 and tail.count(".") + tail.count("_") + tail.count("-") > 1:
                out.add("*" + tail)
    return out


#: Paths that a mined glob matches in declared repositories at least, and how many marked ones each unmarked one needs.
LEAST_MARKED, PURITY = 5, 20
#: Parts of a hot repository whose paths meet its attribute rules in a shuffled join.
SALTS = 32
MARK = "repo string, folder string, seq int, glob string, class string, on boolean"


def attribute_marks(files: DataFrame) -> DataFrame:
    """(repo, folder, seq, glob, class, on): each mark of each attribute file, in order of its lines.

    Only what the parser keeps travels, no content. Of several deliveries of one attribute file all marks count, by file_id.
    """

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for repo, path, text in zip(pdf["repo"], pdf["rel_path"], pdf["content"], strict=True):
                out += [(repo, path.rpartition("/")[0], n, *mark) for n, mark in enumerate(parse_attributes(text))]
            yield pd.DataFrame(out, columns=["repo", "folder", "seq", "glob", "class", "on"])

    attrs = files.where(F.col("rel_path").rlike(r"(^|/)\.gitattributes$") & F.col("content").isNotNull())
    return attrs.select(_repo(), "rel_path", "content").mapInPandas(parse, MARK)


def _repo():
    return F.coalesce("repo", F.lit("\0")).alias("repo")


def resolved_marks(files: DataFrame, marks: DataFrame) -> DataFrame:
    """(file_id, repo, rel_path, said, denied) of each path that a mark matches: the class it is set to, or that marks deny one.

    Each path meets the marks of its own folder and those above, by equi-joins on (repo, folder); deeper folders and
    later lines win, class by class. The marks are broadcast if they are few, by count, else their join is salted, since one
    repository may hold a third of all paths.
    """
    parts = F.split("rel_path", "/")
    depths = F.sequence(F.lit(0), F.size(parts) - 1)
    paths = files.where(F.col("rel_path").isNotNull()).select("file_id", _repo(), "rel_path", F.explode(depths).alias("depth"))
    paths = paths.withColumn("folder", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/")).withColumn("salt", F.pmod(F.xxhash64("rel_path"), F.lit(SALTS)).cast("int"))
    of_folder = marks.groupBy("repo", "folder").agg(F.sort_array(F.collect_list(F.struct("seq", "glob", "class", "on"))).alias("marks"))  # one attribute file's
    few = small_side(of_folder)
    if few is of_folder:
        met = paths.join(of_folder.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["repo", "folder", "salt"])
    else:
        met = paths.join(few, ["repo", "folder"])

    def match(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for fid, repo, path, depth, folder, rows in zip(pdf["file_id"], pdf["repo"], pdf["rel_path"], pdf["depth"], pdf["folder"], pdf["marks"], strict=True):
                below = path[len(folder) + 1 :] if folder else path
                last = {r["class"]: r["on"] for r in rows if glob_pattern(r["glob"]).match(below)}
                out += [(fid, repo, path, depth, kind, on) for kind, on in last.items()]
            yield pd.DataFrame(out, columns=["file_id", "repo", "rel_path", "depth", "class", "on"])

    hits = met.select("file_id", "repo", "rel_path", "depth", "folder", "marks").mapInPandas(match, "file_id long, repo string, rel_path string, depth int, class string, on boolean")
    of_class = hits.groupBy("file_id", "repo", "rel_path", "class").agg(F.max_by("on", "depth").alias("on"))
    return of_class.groupBy("file_id", "repo", "rel_path").agg(F.min(F.when(F.col("on"), F.col("class"))).alias("said")).withColumn("denied", F.col("said").isNull())


def mined_globs(files: DataFrame, marks: DataFrame, said: DataFrame, least: int = LEAST_MARKED) -> DataFrame:
    """(glob, class): shapes of paths (endings of names, folders) that nearly only marked paths of declared repositories have.

    Counts are added per glob in the cluster; a glob counts if at least ``least`` marked paths have it and PURITY times as
    many marked as unmarked.
    """
    declared = files.where(F.col("rel_path").isNotNull()).select("file_id", _repo(), "rel_path").join(marks.select("repo").distinct(), "repo", "left_semi")
    known = declared.join(said.select("file_id", F.col("said").alias("class")), "file_id", "left")
    counted = _with_shapes(known.select("file_id", "rel_path", "class")).groupBy("glob", "class").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy("glob").agg(F.sum(F.when(F.col("class").isNull(), F.col("n")).otherwise(0)).alias("bad"), F.max(F.when(F.col("class").isNotNull(), F.struct("n", "class"))).alias("best"))
    return totals.where((F.col("best.n") >= least) & (F.col("bad") * PURITY <= F.col("best.n"))).select("glob", "best.class")


def _with_shapes(paths: DataFrame) -> DataFrame:
    def shapes(batches):
        import pandas as pd

        for pdf in batches:
            out = [(i, kind, g) for i, path, kind in zip(pdf["file_id"], pdf["rel_path"], pdf["class"], strict=True) for g in sorted(_shapes(path))]
            yield pd.DataFrame(out, columns=["file_id", "class", "glob"])

    return paths.mapInPandas(shapes, "file_id long, class string, glob string")


def not_hand_written(files: DataFrame) -> DataFrame:
    """(file_id, repo, rel_path, class, evidence) of every file that nobody wrote by hand.

    1. Attribute files (.gitattributes) mark the paths of their repository, by the precedence of folders and lines.
    2. From what they mark, equivalent globs are mined and applied to the repositories that declare nothing.
    3. One narrow pass over all files applies KNOWN_GLOBS, globs mined beforehand from public repositories, and looks
       at head and texture of the content.
    A declaration wins over what the content shows, either way; then path, mined glob and content in this order. Null paths
    and contents give what the other shows; null in both gives no row; a null repo is a repository of its own. Repeated
    deliveries are files of their own. Without attribute files neither paths nor contents are shuffled.
    """
    base = files.select("file_id", "repo", "rel_path", "content")

    def look(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for fid, repo, path, text in zip(pdf["file_id"], pdf["repo"], pdf["rel_path"], pdf["content"], strict=True):
                kind = by_path(path) if path else None
                evidence = "path" if kind else None
                if not kind and text:
                    kind = by_content(text, path or "")
                    evidence = "content" if kind else None
                out.append((fid, repo, path, kind, evidence))
            yield pd.DataFrame(out, columns=["file_id", "repo", "rel_path", "class", "evidence"])

    seen = spread(base).mapInPandas(look, "file_id long, repo string, rel_path string, class string, evidence string")
    marks = checkpointed(attribute_marks(base))
    if marks.isEmpty():
        return seen.where(F.col("class").isNotNull())
    said = checkpointed(resolved_marks(base, marks).select("file_id", "said", "denied"))
    mined = small_side(checkpointed(mined_globs(base, marks, said)))
    undeclared = base.where(F.col("rel_path").isNotNull()).select("file_id", _repo(), "rel_path", F.lit(None).cast("string").alias("class")).join(marks.select("repo").distinct(), "repo", "left_anti")
    alike = _with_shapes(undeclared.select("file_id", "rel_path", "class")).drop("class").join(mined, "glob").groupBy("file_id").agg(F.min("class").alias("mined"))
    both = seen.join(said, "file_id", "left").join(alike, "file_id", "left")
    kind = F.when(F.col("denied"), F.lit(None)).otherwise(F.coalesce("said", F.when(F.col("evidence") == "path", F.col("class")), "mined", "class"))
    evidence = F.when(F.col("said").isNotNull(), "declared").when(F.col("evidence") == "path", "path").when(F.col("mined").isNotNull(), "mined").otherwise(F.col("evidence"))
    return both.select("file_id", "repo", "rel_path", kind.alias("class"), evidence.alias("evidence")).where(F.col("class").isNotNull())
