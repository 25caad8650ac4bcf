"""Dependency graph: edges from relative imports, reversal, coupling, god modules, reachability, cycles, causal chains."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.operators.corpus import LANGUAGES
from codestrata.session import checkpointed

STRIP = r"\.(" + "|".join(e for g in LANGUAGES for e in g.extensions.split()) + r")$"
COUPLED, STRONGLY, GOD_LINES, GOD_EXPORTS = 4, 8, 500, 8


def module(path: Column) -> Column:
    """A path without the extension of a known language."""
    return F.regexp_replace(path, STRIP, "")


def resolved(importer: Column, source: Column) -> Column:
    """Module that a relative import names: the importer's folder joined with it, '.' and '..' resolved."""
    folder = F.regexp_replace(importer, r"[^/]*$", "")
    parts = F.split(F.concat(folder, source), "/")
    # a step up drops the last part kept so far
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    return module(F.array_join(kept, "/"))


def edges(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(repo, src, dst) of distinct module dependencies within a repository.

    A target is a known module of that name or, where there is none, its index module. Equi-joins only: both names
    are keys, so no path is searched by its ending. Unknown targets and imports of itself are dropped.
    """
    known = files.select("repo", module(F.col("rel_path")).alias("dst")).distinct()
    wanted = imports.where("is_relative").select("repo", module(F.col("rel_path")).alias("src"), resolved(F.col("rel_path"), F.col("source")).alias("want"))
    options = wanted.select("repo", "src", F.explode(F.array("want", F.concat("want", F.lit("/index")))).alias("dst")).distinct()
    return options.join(known, ["repo", "dst"]).where("src <> dst").select("repo", "src", "dst").distinct()


def package(path: Column) -> Column:
    """Folder of a path, without the last slash; empty at the root."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), "/$", "")


def package_edges(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(repo, src, dst) of distinct dependencies between folders of a repository.

    A relative import names a folder's index, the folder itself, or a module in it; the first of these that is a
    known folder is the target. Imports within one folder are dropped.
    """
    known = files.select("repo", package(F.col("rel_path")).alias("dst")).distinct()
    want = resolved(F.col("rel_path"), F.col("source"))
    wanted = imports.where("is_relative").select("repo", package(F.col("rel_path")).alias("src"), F.regexp_replace(want, "/index$", "").alias("want"))
    options = wanted.distinct().select("repo", "src", "want", F.posexplode(F.array("want", package(F.col("want")))).alias("k", "dst"))
    first = options.join(known, ["repo", "dst"]).groupBy("repo", "src", "want").agg(F.min_by("dst", "k").alias("dst"))
    return first.where("src <> dst").select("repo", "src", "dst").distinct()


def reverse(edges: DataFrame) -> DataFrame:
    """(repo, module, imported_by, n): distinct importers of each module."""
    return edges.groupBy("repo", F.col("dst").alias("module")).agg(F.sort_array(F.collect_set("src")).alias("imported_by"), F.count(F.lit(1)).alias("n"))


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("repo", F.col("dst").alias("module")).agg(F.count(F.lit(1)).alias("n"))


def coupling(edges: DataFrame) -> DataFrame:
    """Modules with more than COUPLED importers."""
    return in_degrees(edges).where(F.col("n") > COUPLED)


def god_modules(exports: DataFrame) -> DataFrame:
    """Files with more than GOD_LINES lines and more than GOD_EXPORTS exports, both strictly."""
    return exports.where((F.col("n_lines") > GOD_LINES) & (F.col("n_exports") > GOD_EXPORTS))


def _peeled(edges: DataFrame) -> DataFrame:
    """The edges left when modules without importers or imports are taken away until none is: those on or between cycles."""
    live = checkpointed(edges.select("repo", "src", "dst"))
    n = live.count()
    while n:
        ins = live.select("repo", F.col("dst").alias("src")).distinct()
        outs = live.select("repo", F.col("src").alias("dst")).distinct()
        nxt = checkpointed(live.join(ins, ["repo", "src"], "left_semi").join(outs, ["repo", "dst"], "left_semi").select("repo", "src", "dst"))
        m = nxt.count()
        if m == n:
            break
        live, n = nxt, m
    return live


def _spread_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(repo, module, label): each module's smallest label, its own or one that an edge path brings; until none changes."""
    while True:
        brought = edges.join(labels.withColumnRenamed("module", "src"), ["repo", "src"]).groupBy("repo", F.col("dst").alias("module")).agg(F.min("label").alias("brought"))
        step = labels.join(brought, ["repo", "module"], "left")
        nxt = checkpointed(step.select("repo", "module", F.least("label", "brought").alias("label"), (F.col("brought") < F.col("label")).alias("fell")))
        labels = nxt.drop("fell")
        if nxt.where("fell").isEmpty():
            return labels


def cycle_members(edges: DataFrame) -> DataFrame:
    """(repo, component, module) of modules on cycles; ``component`` is the smallest module of a strongly connected component.

    Modules off all cycles are peeled first. Then, by colours: each module takes the smallest module that reaches it;
    within one colour, the modules that reach the colour's own module are its component. Components are taken away and
    the rest, modules between cycles, is peeled and coloured again. Each step is an equi-join or an aggregate by module,
    with its lineage cut in the shared folder; no component is ever gathered.
    """
    found = None
    live = _peeled(edges)
    while not live.isEmpty():
        modules = live.select("repo", F.col("src").alias("module")).unionByName(live.select("repo", F.col("dst").alias("module"))).distinct()
        colours = _spread_labels(live, modules.withColumn("label", F.col("module")))
        a = colours.select("repo", F.col("module").alias("src"), F.col("label").alias("component"))
        b = colours.select("repo", F.col("module").alias("dst"), F.col("label").alias("component"))
        within = checkpointed(live.join(a, ["repo", "src"]).join(b, ["repo", "dst", "component"]))
        backward = within.select(F.struct("repo", "component").alias("repo"), F.col("dst").alias("src"), F.col("src").alias("dst"))
        # 0 starts at the colour's own module, 1 everywhere else; what 0 reaches backwards is the component
        seeds = colours.select(F.struct("repo", F.col("label").alias("component")).alias("repo"), "module", F.when(F.col("module") == F.col("label"), 0).otherwise(1).alias("label"))
        reached = _spread_labels(backward, seeds).where("label = 0").select("repo.repo", "repo.component", "module")
        found = reached if found is None else found.unionByName(reached)
        gone = reached.select("repo", "module")
        rest = live.join(gone.withColumnRenamed("module", "src"), ["repo", "src"], "left_anti").join(gone.withColumnRenamed("module", "dst"), ["repo", "dst"], "left_anti")
        live = _peeled(rest)
    if found is None:
        return edges.select("repo", F.col("src").alias("component"), F.col("src").alias("module")).where("false")
    size = found.groupBy("repo", "component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return checkpointed(found.join(size, ["repo", "component"], "left_semi"))


def cycles(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(repo, root, n_modules, path): one row for each component of ``cycle_members``, with a shortest cycle through its smallest module.

    Of several shortest ones the first by name. Rounds end when every component's cycle is closed, at most as many as the
    longest of them has modules; a module is gone through once, by its first path.
    """
    names = members.select("repo", F.col("module").alias("src"), "component"), members.select("repo", F.col("module").alias("dst"), "component")
    inner = checkpointed(edges.join(names[0], ["repo", "src"]).join(names[1], ["repo", "dst", "component"]).select("repo", "component", "src", "dst"))
    sizes = checkpointed(members.groupBy("repo", "component").agg(F.count(F.lit(1)).alias("n_modules")))
    front = sizes.select("repo", "component", F.col("component").alias("module"), F.array("component").alias("path"))
    seen, closed = front, None
    while True:
        step = front.join(inner.withColumnRenamed("src", "module"), ["repo", "component", "module"]).select("repo", "component", F.col("dst").alias("module"), F.concat("path", F.array("dst")).alias("path"))
        first = checkpointed(step.groupBy("repo", "component", "module").agg(F.min("path").alias("path")))
        done = first.where("module = component")
        closed = done if closed is None else closed.unionByName(done)
        front = checkpointed(first.join(done, ["repo", "component"], "left_anti").join(seen, ["repo", "component", "module"], "left_anti"))
        if front.isEmpty():
            return closed.join(sizes, ["repo", "component"]).select("repo", F.col("component").alias("root"), "n_modules", "path")
        seen = seen.unionByName(front)


def reachable(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(repo, start, module, hops): modules that the start modules (repo, module) reach, by the shortest way.

    Rounds end when one finds no new module, at most as many as the longest shortest way; ``depth`` ends them earlier.
    """
    seen = checkpointed(starts.select("repo", F.col("module").alias("start"), "module", F.lit(0).alias("hops")).distinct())
    front = seen
    for hop in count(1) if depth is None else range(1, depth + 1):
        step = front.join(edges.withColumnRenamed("src", "module"), ["repo", "module"]).select("repo", "start", F.col("dst").alias("module")).distinct()
        front = checkpointed(step.join(seen, ["repo", "start", "module"], "left_anti").withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            break
        seen = checkpointed(seen.unionByName(front))
    return seen


def causal_chains(members: DataFrame, coupled: DataFrame, gods: DataFrame) -> DataFrame:
    """(kind, repo, root, severity): cycles HIGH, one for each component; coupling HIGH beyond STRONGLY importers else MED; god modules MED."""
    a = members.select(F.lit("cycle").alias("kind"), "repo", F.col("component").alias("root"), F.lit("HIGH").alias("severity")).distinct()
    b = coupled.select(F.lit("coupling").alias("kind"), "repo", F.col("module").alias("root"), F.when(F.col("n") > STRONGLY, "HIGH").otherwise("MED").alias("severity"))
    c = gods.select(F.lit("god-module").alias("kind"), "repo", F.col("rel_path").alias("root"), F.lit("MED").alias("severity"))
    return a.unionByName(b).unionByName(c)
