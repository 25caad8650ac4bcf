"""Deeply nested records as related flat tables: shared inlining over an analysed schema graph."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import checkpointed, spread

#: Nodes of one schema graph that may come to the driver. Keys that are data (map-like objects) are one node, so
#: the graph grows with the formats, not with the rows; beyond this bound the analysis stops with an error.
MAX_NODES = 5000
GRAPH = "kind string, node string, child string, form string, n long"
ROWS = "id long, kind string, node string, child_path string, parent_path string, pos int, fields map<string,string>"


def loads(body: str | None):
    """The value of a JSON text; null, empty and broken texts are None."""
    try:
        return json.loads(body) if body else None
    except ValueError:
        return None


def as_list(value):
    """A list in any of its delivered forms (list, one object, text holding either) as a list; else None."""
    if isinstance(value, str) and value.lstrip()[:1] in ("[", "{"):
        value = loads(value)
    if isinstance(value, dict):
        return [value]
    return value if isinstance(value, list) else None


def is_map(obj: dict) -> bool:
    """An object whose values are objects, null ones aside: its keys are data, such as names of targets."""
    return any(isinstance(v, dict) for v in obj.values()) and all(v is None or isinstance(v, dict) for v in obj.values())


def _vote(obj: dict) -> str:
    """What one object says of its node.

    map: several objects of one form, null values aside; single: one object, whose name may be data or not; mixed: objects
    of one form and other values, as in a map that has more; record: anything else.
    """
    inner = [v for v in obj.values() if isinstance(v, dict)]
    if is_map(obj) and len(inner) == 1:
        return "single"
    full = [set(v) for v in inner if v]
    alike = len(inner) > 1 and (not full or set.intersection(*full))
    if not alike:
        return "record"
    return "map" if is_map(obj) else "mixed" if 2 * len(inner) > sum(v is not None for v in obj.values()) else "record"


def _edges(obj: dict, node: str, fixed: dict[str, bool]) -> Iterator[tuple[str, str, str]]:
    """(node, child, form) of one record and all below it; form: scalar, object, list (of objects), map.

    Each object that isn't empty also gives its vote as (node, "", "?map", "?mixed" or "?record"), or with its name as child and
    "?single". ``fixed``: nodes known to be maps or records, whatever the single object looks like.
    """
    vote = _vote(obj)
    if obj:
        yield node, next(k for k, v in obj.items() if isinstance(v, dict)) if vote == "single" else "", f"?{vote}"
    as_map = fixed.get(node, vote in ("map", "single"))
    for name, v in obj.items():
        if isinstance(v, dict):
            child, form = ("*", "map") if as_map else (name, "object")
            yield node, child, form
            yield from _edges(v, f"{node}/{child}", fixed)
        elif (items := as_list(v)) is not None and any(isinstance(x, dict) for x in items):
            yield node, name, "list"
            for x in items:
                if isinstance(x, dict):
                    yield from _edges(x, f"{node}/{name}", fixed)
        elif v is not None:
            yield node, name, "scalar"


def _counted(docs: DataFrame, kind_col: str, body_col: str, fixed: dict[tuple[str, str], bool]) -> DataFrame:
    of_kind: dict[str, dict[str, bool]] = {}
    for (kind, node), as_map in fixed.items():
        of_kind.setdefault(kind, {})[node] = as_map

    def count(batches):
        import collections

        import pandas as pd

        seen: collections.Counter = collections.Counter()
        for pdf in batches:
            for kind, body in zip(pdf["kind"], pdf["body"], strict=True):
                root = loads(body)
                for r in root if isinstance(root, list) else [root]:
                    if isinstance(r, dict):
                        seen.update((kind, *e) for e in _edges(r, "", of_kind.get(kind, {})))
        yield pd.DataFrame([(*k, v) for k, v in seen.items()], columns=["kind", "node", "child", "form", "n"])

    rows = spread(docs.select(F.col(kind_col).alias("kind"), F.col(body_col).alias("body")))
    return rows.mapInPandas(count, GRAPH).groupBy("kind", "node", "child", "form").agg(F.sum("n").alias("n"))


def schema_graph(docs: DataFrame, kind_col: str, body_col: str) -> DataFrame:
    """(kind, node, child, form, n): every edge of the schema graph with how often it occurs in which form.

    Counts are made per batch in Python and added up before the shuffle; the result is as small as the formats.
    """
    return decided(docs, kind_col, body_col).where(~F.col("form").startswith("?"))


def decided(docs: DataFrame, kind_col: str, body_col: str) -> DataFrame:
    """The counted graph, with one decision for each node on whether it is a map.

    A node whose objects disagree is a map if at least half of them, single ones aside, are maps or hold more besides objects
    of one form; so a value of another kind in some documents makes no record of it. A node whose objects all hold one
    object under the same name is a record, under changing names a map. A decision names children anew, so the bodies are
    read again for the nodes below, from the root downwards; where nothing is to be decided, they are read once.
    """
    fixed: dict[tuple[str, str], bool] = {}
    while True:
        graph = checkpointed(_counted(docs, kind_col, body_col, fixed))
        votes = [F.sum(F.when(F.col("form") == f"?{v}", F.col("n")).otherwise(0)).alias(v) for v in ("map", "mixed", "record", "single")]
        named = F.count_if(F.col("form") == "?single").alias("names")
        split = graph.where(F.col("form").startswith("?")).groupBy("kind", "node").agg(*votes, named)
        split = split.where("(map + single > 0 and mixed + record > 0) or (map + mixed + record = 0 and names = 1)")
        rows = split.limit(MAX_NODES + 1).collect()
        open_ = {(r["kind"], r["node"]): r["map"] + r["mixed"] >= max(1, r["record"]) for r in rows if (r["kind"], r["node"]) not in fixed}
        if not open_:
            return graph
        fixed |= {k: v for k, v in open_.items() if not any(k[0] == o[0] and k[1] != o[1] and k[1].startswith(o[1] + "/") for o in open_)}


@dataclass
class Inlining:
    """What becomes of each node. ``tables``: children with a table of their own, by (kind, node); ``shared``: for each place of an element with several parents all its places."""

    tables: dict[tuple[str, str], set[str]] = field(default_factory=dict)
    inlined: dict[tuple[str, str], set[str]] = field(default_factory=dict)
    maps: set[tuple[str, str]] = field(default_factory=set)
    columns: dict[tuple[str, str], list[str]] = field(default_factory=dict)
    shared: dict[tuple[str, str], tuple[str, ...]] = field(default_factory=dict)

    def nodes(self, kind: str, node: str) -> tuple[str, ...]:
        """The nodes whose records one table holds: all places of a shared element, else the node itself."""
        return self.shared.get((kind, node), (node,))


def plan_inlining(edges: list[tuple[str, str, str, str]]) -> Inlining:
    """Shared inlining: repeated, shared and recursive elements get tables, singleton descendants are inlined.

    A child is repeated if it was ever a list of objects, and a map's values are. It is recursive if its name
    stands among its ancestors' names. It is shared if elements of its name and form stand under several parents; these
    have one table, whatever their parents. One object in place of a list is the list's only element.
    """
    if len(edges) > MAX_NODES:
        raise ValueError(f"the schema graph has more than {MAX_NODES} edges; name the keys that are data")
    forms: dict[tuple[str, str], dict[str, set[str]]] = {}
    for kind, node, child, form in edges:
        forms.setdefault((kind, node), {}).setdefault(child, set()).add(form)
    plan = Inlining()
    for key, children in forms.items():
        if "*" in children:
            plan.maps.add(key)
        for child, seen in children.items():
            recursive = child in key[1].split("/")
            if "list" in seen or (recursive and "object" in seen):
                plan.tables.setdefault(key, set()).add(child)
            elif "object" in seen:
                plan.inlined.setdefault(key, set()).add(child)
    _share(plan, forms)
    for key in forms:
        plan.columns[key] = sorted(_columns(plan, forms, key, ""))
    for (kind, node), places in plan.shared.items():
        plan.columns[kind, node] = sorted({c for place in places for c in plan.columns.get((kind, place), ())})
    return plan


def _share(plan: Inlining, forms: dict) -> None:
    """Give elements of one name and form that have several parents a table, and note all their places."""
    places: dict[tuple[str, str], list[tuple[str, frozenset]]] = {}
    for (kind, node), children in forms.items():
        for child, seen in children.items():
            below = f"{node}/{child}"
            if child not in ("", "*") and seen & {"object", "list"} and (kind, below) in forms and child not in node.split("/"):
                places.setdefault((kind, child), []).append((below, frozenset(forms[kind, below]) - {""}))
    for (kind, child), found in places.items():
        while found:
            first = found[0][1]
            alike = [p for p in found if 2 * len(p[1] & first) >= len(p[1] | first)]
            found = [p for p in found if p not in alike]
            if len(alike) > 1:
                every = tuple(sorted(node for node, _ in alike))
                for node in every:
                    parent = (kind, node.rpartition("/")[0])
                    plan.shared[kind, node] = every
                    plan.tables.setdefault(parent, set()).add(child)
                    plan.inlined.get(parent, set()).discard(child)


def _columns(plan: Inlining, forms: dict, key: tuple[str, str], prefix: str) -> Iterator[str]:
    for child, seen in forms.get(key, {}).items():
        if child in plan.tables.get(key, ()) or child == "*":
            continue
        if child in plan.inlined.get(key, ()):
            yield from _columns(plan, forms, (key[0], f"{key[1]}/{child}"), f"{prefix}{child}.")
        if "scalar" in seen:
            yield prefix + child


def analyse(docs: DataFrame, kind_col: str, body_col: str) -> Inlining:
    """The inlining plan of a corpus; the schema graph that comes to the driver is bounded by ``MAX_NODES``."""
    rows = schema_graph(docs, kind_col, body_col).select("kind", "node", "child", "form").limit(MAX_NODES + 1).collect()
    return plan_inlining([tuple(r) for r in rows])


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def _fields(obj: dict, plan: Inlining, key: tuple[str, str], prefix: str, out: dict) -> dict:
    tables, inlined = plan.tables.get(key, ()), plan.inlined.get(key, ())
    for name, v in obj.items():
        if name in tables:
            continue
        if name in inlined and isinstance(v, dict):
            _fields(v, plan, (key[0], f"{key[1]}/{name}"), f"{prefix}{name}.", out)
        else:
            out[prefix + name] = _text(v)
    return out


def shred(obj: dict, plan: Inlining, kind: str, node: str, path: str) -> Iterator[tuple[str, str, str, int, dict]]:
    """(node, child_path, parent_path, pos, fields) of every child record below ``obj``."""
    key = (kind, node)
    join = f"{path}/" if path else ""
    as_map = key in plan.maps
    for at, (name, value) in enumerate(obj.items()):
        child = f"{node}/{name}"
        if as_map and isinstance(value, dict):
            yield f"{node}/*", join + name, path, at, _fields(value, plan, (kind, f"{node}/*"), "", {})
            yield from shred(value, plan, kind, f"{node}/*", join + name)
        elif name in plan.tables.get(key, ()):
            for pos, v in enumerate(as_list(value) or ()):
                if isinstance(v, dict):
                    here = f"{join}{name}/{pos}"
                    yield child, here, path, pos, _fields(v, plan, (kind, child), "", {})
                    yield from shred(v, plan, kind, child, here)
        elif name in plan.inlined.get(key, ()) and isinstance(value, dict):
            yield from shred(value, plan, kind, child, join + name)


def child_records(docs: DataFrame, id_col: str, kind_col: str, body_col: str, plan: Inlining | None = None) -> DataFrame:
    """Every child record of every document, linked to its parent: (id, kind, node, child_path, parent_path, pos, fields).

    ``parent_path`` is empty where the parent is the document itself; where a document is a list of objects, each of them is a
    document whose paths begin with its position. Null and broken bodies give no row; null
    elements and null values of a map count as positions but are no records; a list held as text or replaced by its only object is read
    as the list. Repeated documents give their rows each. Two passes over the bodies: the graph, the rows.
    """
    plan = plan or analyse(docs, kind_col, body_col)

    def rows(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for i, kind, body in zip(pdf["id"], pdf["kind"], pdf["body"], strict=True):
                root = loads(body)
                for pos, r in enumerate(root if isinstance(root, list) else [root]):
                    if isinstance(r, dict):
                        out += [(i, kind, n, c, p, k, f) for n, c, p, k, f in shred(r, plan, kind, "", str(pos) if isinstance(root, list) else "")]
            yield pd.DataFrame(out, columns=["id", "kind", "node", "child_path", "parent_path", "pos", "fields"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(kind_col).alias("kind"), F.col(body_col).alias("body"))
    return spread(src.where(F.col("body").isNotNull())).mapInPandas(rows, ROWS).withColumnRenamed("id", id_col)


def child_table(records: DataFrame, plan: Inlining, kind: str, node: str) -> DataFrame:
    """The flat table of one kind of child; dots of inlined names become underscores, a clash gets a number.

    The table of a shared element holds its records under all parents, whichever of its nodes is named.
    """
    columns, names = plan.columns.get((kind, node), []), {}
    taken = set(records.columns)
    for c in columns:
        name, n = c.replace(".", "_"), 2
        while name in taken:
            name, n = f"{c.replace('.', '_')}_{n}", n + 1
        taken.add(name)
        names[c] = name
    keep = [c for c in records.columns if c not in ("kind", "node", "fields")]
    mine = records.where((F.col("kind") == kind) & F.col("node").isin(*plan.nodes(kind, node)))
    return mine.select(*keep, *[F.col("fields")[c].alias(n) for c, n in names.items()])
