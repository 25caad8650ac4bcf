"""The corpus as tables: languages, lines, functions, imports, classes, to-do notes and their counts.

Content is split once into an array of lines; lines become rows by a generator, and what a row needs of its neighbours is a
slice of that array. Nothing is shuffled. The generators are outer ones: an inner one would add a filter on the array, and
pushing that down would split the content twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.session import small_side


@dataclass(frozen=True)
class Language:
    """A language, its extensions, whether it is extracted, and its patterns; the first that matches a line counts."""

    name: str
    extensions: str
    extracted: bool = True
    functions: tuple[str, ...] = ()
    imports: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    branches: str = ""
    tests: str = ""


_JS_FUNCTIONS = (r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(", r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\(?[^)]*\)?\s*=>")
_JS_METHOD = r"^\s+(?:async\s+)?(?:public\s+|private\s+|protected\s+|static\s+)*(\w+)\s*\([^)]*\)\s*"
_JS_IMPORTS = (r"import\s+.*?from\s+['\"]([^'\"]+)['\"]", r"require\(['\"]([^'\"]+)['\"]\)")
_JS_BRANCHES = r"\bif\b|\bfor\b|\bwhile\b|\bswitch\b|\bcase\b|\bcatch\b|\?|&&|\|\|"
# Languages in the order in which an extension is looked up, with the patterns of their lines.
LANGUAGES = (
    Language("typescript", "ts tsx", True, (*_JS_FUNCTIONS, _JS_METHOD + r"(?::\s*\S+)?\s*\{"), _JS_IMPORTS,
             (r"(?:export\s+)?(?:abstract\s+)?class\s+(\w+)", r"(?:export\s+)?interface\s+(\w+)", r"(?:export\s+)?enum\s+(\w+)", r"(?:export\s+)?type\s+(\w+)\s*="), _JS_BRANCHES, ".test.ts .spec.ts .test.tsx .spec.tsx"),
    Language("javascript", "js jsx mjs cjs", True, (*_JS_FUNCTIONS, _JS_METHOD + r"\{"), _JS_IMPORTS, (r"(?:export\s+)?(?:abstract\s+)?class\s+(\w+)", r"(?:export\s+)?enum\s+(\w+)"), _JS_BRANCHES, ".test.js .spec.js .test.jsx .spec.jsx"),
    Language("python", "py pyw", True, (r"^\s*(?:async\s+)?def\s+(\w+)\s*\(",), (r"^import\s+(\S+)", r"^from\s+(\S+)\s+import"), (r"^class\s+(\w+)",), r"\bif\b|\belif\b|\belse\b|\bfor\b|\bwhile\b|\btry\b|\bexcept\b|\bwith\b|\band\b|\bor\b", "_test.py"),
    Language("swift", "swift", True, (r"\bfunc\s+(\w+)\s*\(",), (r"^import\s+(\w+)",), (r"\bclass\s+(\w+)", r"\bstruct\s+(\w+)", r"\benum\s+(\w+)", r"\bprotocol\s+(\w+)", r"\bextension\s+(\w+)"), r"\bif\b|\bguard\b|\bfor\b|\bwhile\b|\bswitch\b|\bcase\b|\bcatch\b|&&|\|\||\?", "Tests.swift Spec.swift"),
    Language("go", "go", True, (r"^func\s+(\w+)\s*\(", r"^func\s+\(\s*\w+\s+\*?\w+\s*\)\s+(\w+)\s*\("), (r"import\s+\"([^\"]+)\"",), (r"type\s+(\w+)\s+struct", r"type\s+(\w+)\s+interface"), r"\bif\b|\belse\b|\bfor\b|\bswitch\b|\bcase\b|\bselect\b|\bfallthrough\b|&&|\|\|", "_test.go"),
    Language("rust", "rs", True, (r"(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*\(",), (r"^use\s+(\S+)", r"^extern\s+crate\s+(\w+)"), (r"\bstruct\s+(\w+)", r"\benum\s+(\w+)", r"\btrait\s+(\w+)", r"\bimpl\s+(?:\w+\s+for\s+)?(\w+)", r"\btype\s+(\w+)\s*="), r"\bif\b|\belse\b|\bmatch\b|\bfor\b|\bwhile\b|\bloop\b|&&|\|\||\?"),
    Language("c", "c h", True, (r"(?:static\s+|extern\s+|inline\s+)?[\w\s\*]+\b(\w+)\s*\([^;]*\)\s*\{",), (r"^#\s*include\s+[<\"]([^>\"]+)[>\"]",), (r"\bstruct\s+(\w+)", r"\benum\s+(\w+)"), r"\bif\b|\belse\b|\bfor\b|\bwhile\b|\bswitch\b|\bcase\b|&&|\|\||\?"),
    Language("java", "java", True, (r"(?:public|private|protected|static|final|abstract|synchronized)[\w\s<>\[\]]*\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+\w+(?:,\s*\w+)*)?\s*\{",), (r"^import\s+([\w.]+(?:\.\*)?)",),
             (r"\bclass\s+(\w+)", r"\binterface\s+(\w+)", r"\benum\s+(\w+)", r"\brecord\s+(\w+)"), r"\bif\b|\bfor\b|\bwhile\b|\bswitch\b|\bcase\b|\bcatch\b|&&|\|\||\?", "Test.java Tests.java Spec.java IT.java"),
    Language("kotlin", "kt kts", True, (r"(?:suspend\s+)?fun\s+(\w+)\s*\(",), (r"^import\s+([\w.]+(?:\.\*)?)",), (r"\bclass\s+(\w+)", r"\binterface\s+(\w+)", r"\bobject\s+(\w+)"), r"\bif\b|\belse\b|\bwhen\b|\bfor\b|\bwhile\b|\bcatch\b|&&|\|\||\?", "Test.kt Tests.kt Spec.kt"),
    Language("ruby", "rb", True, (r"^\s*def\s+(?:self\.)?(\w+)",), (r"^require\s+['\"]([^'\"]+)['\"]", r"^require_relative\s+['\"]([^'\"]+)['\"]", r"^include\s+(\w+)", r"^extend\s+(\w+)"), (r"\bclass\s+(\w+)", r"\bmodule\s+(\w+)"),
             r"\bif\b|\belsif\b|\bunless\b|\bwhile\b|\buntil\b|\bfor\b|\bcase\b|\bwhen\b|\brescue\b|&&|\|\|", "_test.rb _spec.rb"),
    Language("cpp", "cpp cc cxx hpp hxx", False, tests="_test.cpp _test.cc Test.cpp _unittest.cc"),
    Language("csharp", "cs", True, (r"(?:public|private|protected|internal|static|async|override|virtual)[\w\s<>\[\]]*\s+(\w+)\s*\([^)]*\)\s*\{", r"\w+\s+(\w+)\s*\([^)]*\)\s*\{"), (r"^using\s+([\w.]+)",),
             (r"\bclass\s+(\w+)", r"\binterface\s+(\w+)", r"\bstruct\s+(\w+)", r"\benum\s+(\w+)", r"\brecord\s+(\w+)", r"\bdelegate\s+\w+\s+(\w+)"), r"\bif\b|\bfor\b|\bforeach\b|\bwhile\b|\bswitch\b|\bcase\b|\bcatch\b|&&|\|\||\?", "Test.cs Tests.cs Spec.cs"),
    Language("php", "php phtml", True, (r"function\s+(\w+)\s*\(",), (r"\brequire_once\s+['\"]([^'\"]+)['\"]", r"\brequire\s+['\"]([^'\"]+)['\"]", r"\binclude_once\s+['\"]([^'\"]+)['\"]", r"\binclude\s+['\"]([^'\"]+)['\"]", r"^use\s+([\w\\]+)"),
             (r"\bclass\s+(\w+)", r"\binterface\s+(\w+)", r"\btrait\s+(\w+)", r"\benum\s+(\w+)"), r"\bif\b|\belseif\b|\belse\b|\bforeach\b|\bfor\b|\bwhile\b|\bswitch\b|\bcase\b|\bcatch\b|&&|\|\|", "Test.php Tests.php"),
    Language("scala", "scala sc", True, (r"\bdef\s+(\w+)\s*\(", r"\bval\s+(\w+)\s*=\s*.*=>", r"\bvar\s+(\w+)\s*=\s*.*=>"), (r"^import\s+([\w.]+(?:\._)?)",), (r"\bclass\s+(\w+)", r"\bobject\s+(\w+)", r"\btrait\s+(\w+)", r"\benum\s+(\w+)"),
             r"\bif\b|\belse\b|\bmatch\b|\bcase\b|\bfor\b|\bwhile\b|\bcatch\b|&&|\|\|", "Test.scala Tests.scala Spec.scala Suite.scala"),
    Language("shell", "sh bash zsh fish", True, (r"\bfunction\s+(\w+)\s*\{", r"^(\w+)\s*\(\s*\)\s*\{"), (r"^source\s+['\"]?([^\s'\"]+)['\"]?", r"^\.\s+['\"]?([^\s'\"]+)['\"]?"), (), r"\bif\b|\belif\b|\belse\b|\bfor\b|\bwhile\b|\buntil\b|\bcase\b|\[\[|&&|\|\|", "_test.sh .bats"),
    Language("terraform", "tf tfvars", False),
    Language("dockerfile", "dockerfile", False),
    Language("markdown", "md mdx markdown", False),
)
FILE_NAMES = {"dockerfile": "dockerfile", "containerfile": "dockerfile"}
# Folders that no scan enters, endings of minified scripts, words that name no function, bounds of a function.
IGNORED = ("node_modules", ".git", "dist", "build", ".next", "__pycache__", ".DS_Store", "Pods", ".build", "vendor")
MINIFIED = r"(?i)(\.min\.js|\.min\.ts)$|-min\.js[^/]*$"
NO_NAMES = ("if", "else", "for", "while", "switch", "catch", "constructor", "do", "try")
MOST_LINES, LARGE, COMPLEX = 500, 100, 15
TODO = r"\b(TODO|FIXME|HACK|XXX)\b"
HANDLES = r"try|catch|Result<|throws|guard |except|rescue|Err\(|unwrap_or"
KINDS = ("interface", "struct", "enum", "protocol")
EXTRACTED = tuple(x for x in LANGUAGES if x.extracted)


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the file's name; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path: Column) -> Column:
    """Language by file name first, then by extension; null if unknown."""
    name = F.lower(F.regexp_extract(path, r"([^/]+)$", 1))
    by_name = F.create_map(*[F.lit(x) for kv in FILE_NAMES.items() for x in kv])
    by_ext = F.create_map(*[F.lit(x) for g in LANGUAGES for e in g.extensions.split() for x in (e, g.name)])
    return F.coalesce(F.try_element_at(by_name, name), F.try_element_at(by_ext, extension(path)))


def ignore_lines(content: Column) -> Column:
    """The patterns of an ignore file: its lines without comments, blanks and slashes at either end."""
    lines = F.transform(F.split(F.coalesce(content, F.lit("")), "\n", -1), lambda x: F.trim(F.regexp_replace(x, "\r", "")))
    kept = F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))
    return F.transform(kept, lambda x: F.regexp_replace(F.regexp_replace(x, "^/", ""), "/$", ""))


def _matched(patterns: Column) -> Column:
    """Whether a pattern matches the path as a prefix, as one of its parts, or as the whole."""
    return F.exists(patterns, lambda p: F.startswith("rel_path", p) | F.array_contains(F.split("rel_path", "/"), p))


def scanned(files: DataFrame, ignored: tuple[str, ...] = IGNORED, patterns: tuple[str, ...] = ()) -> DataFrame:
    """Files a scan reads: of a known language, outside ignored folders, not minified, not matched by ignore lines.

    An ignore line matches as a prefix of the path, as one of its parts, or as the whole. Null paths are dropped.
    """
    parts = F.split("rel_path", "/")
    keep = ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in ignored])) & ~F.col("rel_path").rlike(MINIFIED) & language(F.col("rel_path")).isNotNull()
    if patterns:
        keep = keep & ~_matched(F.array(*[F.lit(p.strip("/")) for p in patterns]))
    return files.where(keep)


def unignored(files: DataFrame) -> DataFrame:
    """Files that the ignore file at the root of their repository does not match; repositories without one keep all."""
    rules = files.where("rel_path = '.gitignore' and content is not null").groupBy("repo").agg(F.flatten(F.collect_set(ignore_lines(F.col("content")))).alias("_ignore"))
    return files.join(small_side(rules), "repo", "left").where(F.col("_ignore").isNull() | ~_matched(F.col("_ignore"))).drop("_ignore")


def lines_of(content: Column) -> Column:
    """A file's lines without carriage returns; a last empty line stays, null content has none."""
    return F.split(F.regexp_replace(F.coalesce(content, F.lit("")), "\r", ""), "\n", -1)


def loc(content: Column) -> Column:
    """Number of lines; the empty part after a last line feed is none."""
    n = F.size(F.split(content, "\n", -1))
    return F.when(content.isNull(), F.lit(0)).otherwise(n - F.when((content == "") | content.endswith("\n"), 1).otherwise(0))


def with_lines(files: DataFrame) -> DataFrame:
    """(file_id, repo, rel_path, lang, lines, n_lines) of the scanned files."""
    return files.select("file_id", "repo", "rel_path", language(F.col("rel_path")).alias("lang"), lines_of(F.col("content")).alias("lines"), loc(F.col("content")).alias("n_lines"))


def as_rows(lined: DataFrame, *more: str) -> DataFrame:
    """One row a line: file_id, repo, rel_path, lang, ``more``, line_no from 1, line."""
    rows = lined.select("file_id", "repo", "rel_path", "lang", *more, F.posexplode_outer("lines").alias("pos", "line"))
    return rows.select("file_id", "repo", "rel_path", "lang", *more, (F.col("pos") + 1).alias("line_no"), "line")


def first_name(line: Column, patterns: tuple[str, ...], skip: tuple[str, ...] = ()) -> Column:
    """What the first pattern with a name captures; null if none does."""
    names = [F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*[F.when(~n.isin(*skip), n) if skip else n for n in names], F.lit(None).cast("string"))


def by_language(value) -> Column:
    """A column that depends on the row's language, which decides before any pattern runs; one flat CASE, as nested ones take long to plan."""
    case = None
    for g in EXTRACTED:
        case = case.when(F.col("lang") == g.name, value(g)) if case is not None else F.when(F.col("lang") == g.name, value(g))
    return case


def imports(lined: DataFrame) -> DataFrame:
    """(file_id, repo, rel_path, line_no, source, is_relative) of each import line of an extracted language."""
    source = by_language(lambda g: first_name(F.regexp_replace("line", r"^[ \t]+", ""), g.imports))
    hit = as_rows(lined).withColumn("source", source).where("source is not null")
    return hit.select("file_id", "repo", "rel_path", "line_no", "source", F.col("source").startswith(".").alias("is_relative"))


def classes(lined: DataFrame) -> DataFrame:
    """(file_id, rel_path, line_no, kind, name) of each class, interface, struct, enum or protocol; the line's words tell the kind."""
    hit = as_rows(lined).withColumn("name", by_language(lambda g: first_name(F.col("line"), g.classes))).where("name is not null")
    kind = F.lit("class")
    for k in reversed(KINDS):
        kind = F.when(F.contains(F.lower("line"), F.lit(k)), k).otherwise(kind)
    return hit.select("file_id", "rel_path", "line_no", kind.alias("kind"), "name")


def todos(lined: DataFrame) -> DataFrame:
    """(file_id, rel_path, line_no, kind) of the first mark in a line, in any case."""
    hit = as_rows(lined).where(F.col("line").rlike("(?i)" + TODO))
    return hit.select("file_id", "rel_path", "line_no", F.upper(F.regexp_extract("line", "(?i)" + TODO, 1)).alias("kind"))


def _closes(braces: Column) -> Column:
    """Lines until the braces opened since the first line are closed again; 1 where they never are."""
    zero = F.struct(F.lit(0).alias("k"), F.lit(0).alias("depth"), F.lit(False).alias("open"), F.lit(0).alias("end"))

    def step(acc, x):
        depth, opened, k = acc["depth"] + x["up"] - x["down"], acc["open"] | (x["up"] > 0), acc["k"] + 1
        end = F.when(acc["end"] > 0, acc["end"]).when(opened & (depth <= 0), k).otherwise(F.lit(0))
        return F.struct(k.alias("k"), depth.alias("depth"), opened.alias("open"), end.alias("end"))

    return F.greatest(F.aggregate(braces, zero, step)["end"], F.lit(1))


def functions(lined: DataFrame) -> DataFrame:
    """(file_id, rel_path, lang, name, start_line, end_line, n_lines, complexity, is_async, has_error_handling, n_params).

    A function ends on the line where the running depth of braces, from its head on, is back at zero, looked for in
    MOST_LINES lines; else it is its head alone. Complexity is one more than the number of branching words in its text.
    """
    braces = F.transform("lines", lambda x: F.struct((F.length(x) - F.length(F.replace(x, F.lit("{"), F.lit("")))).alias("up"), (F.length(x) - F.length(F.replace(x, F.lit("}"), F.lit("")))).alias("down")))
    able = lined.where(F.col("lang").isin(*[g.name for g in EXTRACTED])).withColumn("braces", braces)
    heads = as_rows(able, "lines", "braces").withColumn("name", by_language(lambda g: first_name(F.col("line"), g.functions, NO_NAMES))).where("name is not null")
    ahead = heads.select("file_id", "rel_path", "lang", "name", "line_no", "line", F.slice("lines", F.col("line_no"), F.lit(MOST_LINES)).alias("ahead"), _closes(F.slice("braces", F.col("line_no"), F.lit(MOST_LINES))).alias("n"))
    texts = ahead.select("*", F.array_join(F.slice("ahead", F.lit(1), F.col("n")), "\n").alias("body"))
    count = by_language(lambda g: F.regexp_count("body", F.lit(g.branches)))
    params = F.filter(F.split(F.regexp_extract("line", r"\(([^)]*)\)", 1), ","), lambda p: F.trim(p) != "")
    return texts.select(
        "file_id", "rel_path", "lang", "name", F.col("line_no").alias("start_line"), (F.col("line_no") + F.col("n") - 1).alias("end_line"), F.col("n").alias("n_lines"), (count + 1).alias("complexity"),
        F.contains("line", F.lit("async")).alias("is_async"), F.col("body").rlike(HANDLES).alias("has_error_handling"), F.size(params).alias("n_params"),
    )


def flagged(functions: DataFrame) -> DataFrame:
    """Functions of more than LARGE lines or with a complexity above COMPLEX, and which of both."""
    marks = functions.withColumns({"is_large": F.col("n_lines") > LARGE, "is_complex": F.col("complexity") > COMPLEX})
    return marks.where("is_large or is_complex").select("file_id", "rel_path", "name", "start_line", "n_lines", "complexity", "is_large", "is_complex")


def export_counts(lined: DataFrame) -> DataFrame:
    """(file_id, repo, rel_path, n_lines, n_exports): how often the word export stands in a file."""
    return lined.select("file_id", "repo", "rel_path", "n_lines", F.regexp_count(F.array_join("lines", "\n"), F.lit(r"\bexport\b")).alias("n_exports"))


def unsupported(files: DataFrame) -> DataFrame:
    """(repo, extension, n_files, n_lines) of scanned files whose language is counted but not extracted, documentation aside."""
    out = tuple(g.name for g in LANGUAGES if not g.extracted and g.name != "markdown")
    mine = files.where(language(F.col("rel_path")).isin(*out))
    return mine.groupBy("repo", extension(F.col("rel_path")).alias("extension")).agg(F.count(F.lit(1)).alias("n_files"), F.sum(loc(F.col("content"))).alias("n_lines"))


def metrics(lined: DataFrame, functions: DataFrame, todos: DataFrame) -> DataFrame:
    """(repo, n_files, n_lines, n_functions, total_complexity, n_todos, n_large, n_complex); aggregates by file meet by file_id."""
    f = functions.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_functions"), F.sum("complexity").alias("total_complexity"), F.count_if(F.col("n_lines") > LARGE).alias("n_large"), F.count_if(F.col("complexity") > COMPLEX).alias("n_complex")
    )
    t = todos.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_todos"))
    j = lined.select("file_id", "repo", "n_lines").join(f, "file_id", "left").join(t, "file_id", "left")
    totals = ("n_functions", "total_complexity", "n_todos", "n_large", "n_complex")
    return j.groupBy("repo").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_lines").alias("n_lines"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in totals])
