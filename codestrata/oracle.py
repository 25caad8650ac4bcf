"""DuckDB SQL of the core's queries. Rule and word tables are shared with the operators; the engine and the plan are not."""

from __future__ import annotations

from codestrata.operators import corpus, findings, graph, patterns, risk, weakness


def _q(text: str) -> str:
    return text.replace("'", "''")


def _map(pairs) -> str:
    return "map {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs) + "}"


_LANGS = _map((e, g.name) for g in corpus.LANGUAGES for e in g.extensions.split())
_NAMES = _map(corpus.FILE_NAMES.items())
_LANGUAGE = f"coalesce({_NAMES}[lower(regexp_extract(rel_path, '([^/]+)$', 1))], {_LANGS}[lower(regexp_extract(rel_path, '\\.([^./]+)$', 1))])"
_IGNORED = ", ".join(f"'{x}'" for x in corpus.IGNORED)
SCANNED = f"""with s as (select * from files where not list_has_any(string_split(rel_path, '/'), [{_IGNORED}])
  and not regexp_matches(rel_path, '{corpus.MINIFIED}') and {_LANGUAGE} is not null),
l as (select file_id, repo, rel_path, {_LANGUAGE} as lang, string_split(replace(coalesce(content, ''), chr(13), ''), chr(10)) as lines,
  cast(case when content is null then 0 else len(string_split(content, chr(10))) - case when content = '' or content like '%' || chr(10) then 1 else 0 end end as integer) as n_lines from s),
x as (select file_id, repo, rel_path, lang, unnest(lines) as line, generate_subscripts(lines, 1)::integer as line_no from l)
"""


def _by_lang(value) -> str:
    return "case lang " + " ".join(f"when '{g.name}' then {value(g)}" for g in corpus.LANGUAGES if g.extracted) + " end"


def _name(line: str, patterns: tuple[str, ...], skip: tuple[str, ...] = ()) -> str:
    """What the first pattern captures that captures something but the words to skip."""
    words = ", ".join(f"'{w}'" for w in ("", *skip))
    return "coalesce(" + ", ".join(f"(select n from (select regexp_extract({line}, '{_q(p)}', 1) as n) where n not in ({words}))" for p in patterns) + ", null)" if patterns else "null"


_TODO = "(?i)" + corpus.TODO
IMPORTS = f""", i as (select * from (select file_id, repo, rel_path, line_no, {_by_lang(lambda g: _name("regexp_replace(line, '^[ \\t]+', '')", g.imports))} as source from x) where source is not null)
"""
PACKAGES = """, w as (select repo, regexp_replace(regexp_replace(rel_path, '[^/]*$', ''), '/$', '') as src,
  regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(rel_path, '[^/]*$', '') || source, '[^/]+/[.][.]/', '', 'g'), './', ''), '{strip}', ''), '/index$', ''), '^/', '') as want
  from i where starts_with(source, '.')),
k as (select distinct repo, regexp_replace(regexp_replace(rel_path, '[^/]*$', ''), '/$', '') as folder from s),
o as (select distinct w.repo, src, case when exists (select 1 from k where k.repo = w.repo and folder = want) then want
  when exists (select 1 from k where k.repo = w.repo and folder = regexp_replace(regexp_replace(want, '[^/]*$', ''), '/$', '')) then regexp_replace(regexp_replace(want, '[^/]*$', ''), '/$', '') end as dst from w),
e as (select distinct repo, src, dst from o where src <> dst)
""".replace("{strip}", graph.STRIP)
#: Modules on cycles with the smallest module that reaches them and that they reach, over edges e; needs a recursive WITH.
COMPONENTS = """, re as (select repo, src, dst from e union select re.repo, re.src, e.dst from re join e on e.repo = re.repo and e.src = re.dst),
cy as (select a.repo, a.src as module, least(a.src, min(a.dst)) as component from re a join re b on b.repo = a.repo and b.src = a.dst and b.dst = a.src where a.src <> a.dst group by a.repo, a.src)
"""
EXPORTS = r", ge as (select file_id, repo, rel_path, n_lines, len(regexp_extract_all(array_to_string(lines, chr(10)), '\bexport\b'))::integer as n_exports from l)" + "\n"
GODS = f"n_lines > {graph.GOD_LINES} and n_exports > {graph.GOD_EXPORTS}"


def _function_sql() -> str:
    """Heads, the lines ahead of each with running sums of its braces, and the first line where they are closed."""
    return rf""", h as (select * from (select *, {_by_lang(lambda g: _name("line", g.functions, corpus.NO_NAMES))} as name from x) where name is not null),
    rb as (select h.file_id, h.line_no as s, x.line_no as j, sum(length(x.line) - length(replace(x.line, '{{', ''))) over w as up, sum(length(replace(x.line, '}}', '')) - length(replace(x.line, '{{', ''))) over w as depth
      from h join x on x.file_id = h.file_id and x.line_no between h.line_no and h.line_no + {corpus.MOST_LINES - 1} window w as (partition by h.file_id, h.line_no order by x.line_no)),
    ends as (select file_id, s, coalesce(min(j) filter (where up > 0 and depth <= 0), s)::integer as e from rb group by file_id, s),
    fb as (select h.*, e, array_to_string(list_slice(l.lines, h.line_no, e), chr(10)) as body from h join ends on ends.file_id = h.file_id and ends.s = h.line_no join l on l.file_id = h.file_id),
    fn as (select file_id, repo, rel_path, lang, name, line_no as start_line, e as end_line, (e - line_no + 1)::integer as n_lines,
      (1 + len(regexp_extract_all(body, {_by_lang(lambda g: f"'{_q(g.branches)}'")})))::integer as complexity, contains(line, 'async') as is_async, regexp_matches(body, '{_q(corpus.HANDLES)}') as has_error_handling,
      len(list_filter(string_split(regexp_extract(line, '\(([^)]*)\)', 1), ','), lambda p: trim(p) <> ''))::integer as n_params from fb)
    """


def _steps(value: str, table: tuple) -> str:
    return "case " + " ".join(f"when {value} <= {b} then {r}::double" for b, r in table[0]) + f" else {table[1]}::double end"


def _risk() -> str:
    """Scores of files: the same factors by correlated aggregates over the extracted tables."""
    density = "case when d = 0 then 0.0::double " + " ".join(f"when d < {b} then {r}::double" for b, r in risk.DENSITY) + " else 0.8::double end"
    total = " + ".join(f"{w}::double * {k}" for k, w in risk.WEIGHTS.items())
    strip = _q(graph.STRIP)
    folders = " or ".join(f"contains(rel_path, '{f}')" for f in risk.TEST_FOLDERS)
    suffixes = ", ".join(f"'{x}'" for x in risk.TEST_SUFFIXES)
    return (
        SCANNED
        + IMPORTS
        + _function_sql()
        + rf""", wm as (select distinct repo, regexp_replace(rel_path, '{strip}', '') as src, regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(rel_path, '[^/]*$', '') || source, '[^/]+/[.][.]/', '', 'g'), './', ''), '{strip}', ''), '^/', '') as want
      from i where starts_with(source, '.')),
    me as (select distinct repo, src, dst from (select repo, src, unnest([want, want || '/index']) as dst from wm) q where src <> dst and exists (select 1 from s where s.repo = q.repo and regexp_replace(s.rel_path, '{strip}', '') = dst)),
    md as (select repo, dst as module, count(*) as n from me group by all),
    fa as (select file_id, avg(complexity) as avg_c, max(n_lines) as max_l from fn group by 1),
    ta as (select file_id, count(*) as n_todo from x where regexp_matches(line, '{_TODO}') group by 1),
    nm as (select *, regexp_extract(rel_path, '([^/]+)$', 1) as name from l),
    tr as (select distinct repo from l where {folders}),
    st as (select distinct repo, left(name, length(name) - length(u)) as stem from nm, unnest([{suffixes}]) q(u) where ends_with(name, u)
      union select repo, regexp_extract(name, '^test_(.*)[.]pyw?$', 1) from nm where regexp_matches(name, '^test_.*[.]pyw?$')),
    rb2 as (select *, case when position('.' in substr(name, 2)) > 0 then regexp_replace(name, '[.][^.]*$', '') else name end as stem, regexp_replace(rel_path, '{strip}', '') as module from nm where lang is not null and lang <> 'markdown'),
    rf as (select r.file_id, r.repo, r.rel_path, coalesce(avg_c, 1.0) as c, coalesce(n, 0) as k, (exists (select 1 from st where st.repo = r.repo and st.stem = r.stem) or exists (select 1 from tr where tr.repo = r.repo)) as has_test,
      coalesce(n_todo, 0)::double / greatest(n_lines, 1) as d, coalesce(max_l, 0) as m
      from rb2 r left join fa using (file_id) left join ta using (file_id) left join md on md.repo = r.repo and md.module = r.module),
    rs as (select file_id, repo, rel_path, {_steps('c', risk.COMPLEXITY)} as complexity, {_steps('k', risk.COUPLING)} as coupling, case when has_test then 0.0::double else 0.5::double end as untested, {density} as density, {_steps('m', risk.SIZE)} as size from rf),
    rk as (select *, round(least(1.0::double, {total}), 9) as score from rs),
    rt as (select *, case when score >= {risk.HIGH} then 'high' when score >= {risk.MEDIUM} then 'medium' else 'low' end as tier from rk)
    """
    )


def _recursive(sql: str) -> str:
    return sql.replace("with s as", "with recursive s as", 1)


def _audit() -> str:
    """Everything a verdict is made of: scores, cycles, coupling, god modules, and the findings that are reported."""
    return _recursive(_risk()) + PACKAGES + COMPONENTS + EXPORTS + _pattern_rows() + _REPORTED + f", cp as (select repo, dst as module, count(*) as n from e group by all having count(*) > {graph.COUPLED})\n"


def _verdict() -> str:
    weight = "case when surface = 'quality' then 0.0 else case severity " + " ".join(f"when '{s}' then case tier when 'high' then {h}::double when 'medium' then {m}::double else {o}::double end" for s, (h, m, o) in risk.PENALTY.items()) + " else 0.0::double end end"
    return (
        _audit()
        + f""", rr as (select repo, count(*) as n_files, avg(score) as mean_risk, count(*) filter (where tier = 'high') as n_high, count(*) filter (where tier = 'medium') as n_medium from rt group by 1),
    v as (select rr.repo, n_files, n_high, n_medium,
      (select count(*) from kept where kept.repo = rr.repo) as n_findings, (select count(*) from kept where kept.repo = rr.repo and surface = 'quality') as n_quality,
      (select count(distinct component) from cy where cy.repo = rr.repo) as n_cycles, (select count(*) from cp where cp.repo = rr.repo) as n_coupled, (select count(*) from ge where ge.repo = rr.repo and {GODS}) as n_god,
      coalesce((select avg(fn.complexity) from fn join rt using (file_id) where rt.repo = rr.repo), 1.0) as avg_c, coalesce((select sum({weight}) from kept join rt using (file_id) where kept.repo = rr.repo), 0.0) as penalty, mean_risk from rr),
    z as (select *, greatest(0.0, 1 - least(1.0, (avg_c - 1) / 30)) as a, greatest(0.0, 1 - least(1.0, 0.15 * n_cycles) - least(0.3, 0.05 * n_coupled) - least(0.2, 0.05 * n_god))::double as b, 1 - mean_risk as c, 1 - least(1.0, penalty) as d from v)
    select repo, n_files, n_high, n_medium, n_findings, n_quality, n_cycles, n_coupled, n_god, round(a, 6) as complexity_score, round(b, 6) as dependency_score, round(c, 6) as risk_score, round(d, 6) as adversarial_score,
      round(least(0.99, 1.5 * mean_risk), 6) as bug_probability, round(0.25 * a + 0.30 * b + 0.25 * c + 0.20 * d, 6) as score,
      case when round(0.25 * a + 0.30 * b + 0.25 * c + 0.20 * d, 6) >= {risk.THRESHOLD} then 'APPROVED' else 'REJECTED' end as verdict from z"""
    )


def _issues() -> str:
    sources = {
        "cycle": ("select distinct repo, 'HIGH' as severity, component as file, null::integer as line, component as o1, 0 as o2, 0 as o3, '' as o4 from cy"),
        "risk": ("select repo, 'HIGH', rel_path, null, '', -score, file_id, rel_path from rt where tier = 'high'"),
        "finding": ("select repo, 'HIGH', rel_path, line_no, rel_path, file_id, line_no, rule from kept where severity = 'HIGH' and surface <> 'quality'"),
        "god-module": (f"select repo, 'MED', rel_path, null, rel_path, file_id, 0, '' from ge where {GODS}"),
        "coupling": ("select repo, 'MED', module, null, '', -n, 0, module from cp"),
        "large-function": ("select rt.repo, 'MED', fn.rel_path, start_line, fn.rel_path, fn.file_id, start_line, '' from fn join rt using (file_id) where n_lines > 100"),
    }
    order = {"risk": "o2, o4, o3", "coupling": "o2, o4"}
    parts = [
        f"select *, row_number() over (partition by repo order by {order.get(k, 'o1, o2, o3, o4')}) as n, {i} as s, '{k}' as source from (select q.* from ({sql}) q(repo, severity, file, line, o1, o2, o3, o4)) qualify n <= {risk.ISSUES[k]}"
        for i, (k, sql) in enumerate(sources.items())
    ]
    return (
        _audit()
        + ", every as ("
        + " union all ".join(f"({x})" for x in parts)
        + f"""), once as (select * from every qualify row_number() over (partition by repo, file, severity order by s, n) = 1)
    select repo, row_number() over (partition by repo order by case severity when 'HIGH' then 0 else 1 end, s, n)::integer as rank, severity, source, file, line from once qualify rank <= {risk.MOST_ISSUES}"""
    )


def _condition(r: patterns.Rule) -> str:
    """A rule as a predicate of the line number i over the array ``lines``."""
    hit = lambda text, pattern: f"regexp_matches({text}, '{_q(pattern)}')"
    parts = [hit("lines[i]", r.has)]
    if r.lacks:
        parts.append("not " + hit("lines[i]", r.lacks))
    a, b = r.window
    text = f"(case when i + ({b}) < 1 then '' else array_to_string(list_slice(lines, greatest(1, i + ({a})), i + ({b})), chr(10)) end)"
    if r.no:
        parts.append("not " + hit(text, r.no))
    if r.some:
        parts.append(hit(text, r.some))
    part = f"regexp_extract(lines[i], '{_q(r.part)}', 1)"
    if r.part_some:
        parts.append(hit(part, r.part_some))
    if r.part_no:
        parts.append("not " + hit(part, r.part_no))
    if r.whole_no:
        parts.append("not " + hit(f"regexp_extract(lines[i], '{_q(r.part)}')", r.whole_no))
    return " and ".join(parts)


def _pattern_rows() -> str:
    unread = ", ".join(f"'{x}'" for x in patterns.NOT_READ)
    parts = []
    for k, r in enumerate(patterns.RULES):
        names = ", ".join(f"'{x}'" for x in r.langs.lstrip("-").split())
        langs = "true" if not r.langs else f"lang {'not ' if r.langs[0] == '-' else ''}in ({names})"
        parts.append(
            f"select file_id, repo, rel_path, {k} as detector, {r.stage} as stage, '{r.name}' as rule, '{r.type}' as type, '{r.severity}' as severity, '{r.tier}' as tier_of, '{r.surface}' as surface, "
            f"unnest(list_filter(range(1, len(lines) + 1), lambda i: {_condition(r)}))::integer as line_no from l where lang not in ({unread}) and {langs}"
        )
    return ", p as (" + " union all ".join(parts) + ")\n"


_NEAR = "row_number() over (partition by file_id, type, line_no // 3 order by stage, line_no, detector)"
_REPORTED = f""", gt as (select p.* from p where tier_of = 'sec' and not regexp_matches(rel_path, '{patterns.TEST_FILE}') union all select p.* from p where tier_of = 'qual' and file_id in (select file_id from rt where tier <> 'low')),
kept as (select * from (select *, {_NEAR} as near from gt) where near = 1 and not regexp_matches(rel_path, '{patterns.NOT_PRODUCT}'))
"""


DELIVERED = """with d as (
  select ord, scan_id, repo, source, coalesce(file, json_extract_string(payload, '$.file')) as file,
    greatest(coalesce(line, try_cast(trim(json_extract_string(payload, '$.line')) as integer), 0), 0)::integer as line,
    coalesce(type, json_extract_string(payload, '$.type')) as type, coalesce(severity, 'LOW') as severity,
    coalesce(description, json_extract_string(payload, '$.description')) as description
  from findings)
"""
_ANCHOR = "case when regexp_extract(f, '(?:^|/)((?:src|app|lib|routes|packages)/(?s:.*))$', 1) <> '' then regexp_extract(f, '(?:^|/)((?:src|app|lib|routes|packages)/(?s:.*))$', 1) else regexp_extract(f, '([^/]+)$', 1) end"


def _cases(text: str, rungs) -> str:
    return " ".join(f"when regexp_matches({text}, '{_q(p)}') then {c}" for p, c in rungs)


def _cwe() -> str:
    """Rungs as one flat CASE: early ones, names, the class a text names, words, the type and parts of it."""
    d, t = "lower(coalesce(description, ''))", "lower(coalesce(type, ''))"
    named = " ".join(f"when contains({d}, '{_q(n)}') then {c}" for n, c in weakness.NAMED)
    types = " ".join(f"when {t} = '{k}' then {v}" for k, v in weakness.OF_TYPE.items())
    tag = f"regexp_extract({d}, 'cwe-([0-9]+)', 1)"
    return f"(case {_cases(d, weakness.EARLY)} {named} when length({tag}) between 1 and 5 and {tag} <> '0' then {tag}::integer {_cases(d, weakness.WORDS)} {types} {_cases(t, weakness.OF_TYPE_PART)} end)::integer"


def _extras() -> str:
    """Classes that a description adds, as one list."""
    d = "lower(coalesce(description, ''))"
    lists = []
    for has, lacks, cs in weakness.EXTRAS:
        test = f"regexp_matches({d}, '{_q(has)}')" + (f" and not regexp_matches({d}, '{_q(lacks)}')" if lacks else "")
        lists.append(f"case when {test} then [{', '.join(map(str, cs))}] else [] end")
    return "flatten([" + ", ".join(lists) + "])"


def _surface() -> str:
    d, f = "lower(coalesce(description, ''))", "lower(coalesce(file, ''))"
    cases = []
    for name, has, lacks, where in weakness.SURFACES:
        test = f"regexp_matches({d}, '{_q(has)}')" + (f" and not regexp_matches({d}, '{_q(lacks)}')" if lacks else "") + (f" and regexp_matches({f}, '{_q(where)}')" if where else "")
        cases.append(f"when {test} then '{name}'")
    quality = ", ".join(f"'{t}'" for t in weakness.QUALITY_TYPES)
    return f"case {' '.join(cases)} when type in ({quality}) then 'quality' else 'security' end"


def _classified() -> str:
    levels = " ".join(f"when '{k}' then '{v}'" for k, v in findings.SEVERITY_LEVEL.items())
    return (
        DELIVERED
        + f""", c as (select *, {_cwe()} as cwe, {_surface()} as surface, case upper(severity) {levels} else 'warning' end as level, coalesce(regexp_matches(file, '{patterns.NOT_PRODUCT}'), false) as is_test from d)
    """
    )


_IDS = f""", n as (select *, coalesce(file, '') as f from c), k as (select *, lower(source) || '_' || substr(sha1(concat_ws('|', source, {_ANCHOR}, line::varchar, coalesce(type, ''), coalesce(description, ''))), 1, 12) as finding_id from n)
"""


def _aliases() -> str:
    return " ".join(f"when {k} then [{', '.join(map(str, v))}]" for k, v in weakness.ALIASES.items())


_CONDITIONS = {
    "missing": "v is null", "present": "v is not null", "equals": "v = '7'", "not-equals": "v <> '7'", "equals-or-missing": "v is null or v = '7'", "is-true": "lower(v) = 'true'", "is-false": "lower(v) = 'false'",
    "not-true": "v is null or lower(v) <> 'true'", "contains": "contains(v, '4')", "matches": "regexp_matches(v, '^[1-3]$')", "not-matches": "v is null or not regexp_matches(v, '^[1-3]$')",
    "matches-any": "regexp_matches(v, '^1') or regexp_matches(v, '9$')", "in": "v in ('1', '2', '50')", "not-in": "v not in ('1', '2', '50')", "lte": "try_cast(v as double) <= 20", "gte": "try_cast(v as double) >= 80",
}


def _conditions() -> str:
    rows = " union all ".join(f"select event_type, '{c}' as condition, count(*) filter (where coalesce({sql}, false)) as n from e group by event_type" for c, sql in _CONDITIONS.items())
    return "with e as (select event_type, json_extract_string(props, '$.k') as v from events) " + rows


#: Steps of each user from one type of event to another.
_EVENTS = """with recursive e as (select distinct repo, src, dst from (select user_id::varchar as repo, event_type as src, lead(event_type) over (partition by user_id order by ts, event_id) as dst from events) where src <> dst)
"""
_RATIOS = "case when tp + fp = 0 then null else tp / (tp + fp) end as precision_val, case when tp + fn = 0 then null else tp / (tp + fn) end as recall"


def _items(value: str) -> str:
    """A list in any of its delivered forms as a list of JSON values: a list, one object, or a text that holds either."""
    inner = f"json_extract_string({value}, '$')"
    held = f"(case when json_type({value}) = 'VARCHAR' and regexp_matches({inner}, '^\\s*[\\[{{]') and json_valid({inner}) then {inner}::json else {value} end)"
    return f"(case json_type({held}) when 'ARRAY' then cast({held} as json[]) when 'OBJECT' then [{held}] else []::json[] end)"


#: Child records of reports by kind: the table of each level, its parent's, and the field that holds its list.
_LEVELS = (("r2", "r1", "findings"), ("t1", "t0", "findings"), ("t2", "t1", "flow"), ("b1", "b0", "tools"), ("b2", "b1", "scores"), ("b3", "b2", "tpDetails"), ("b4", "b2", "fpDetails"), ("b5", "b2", "fnDetails"))
_DETAILS = "file line type"
#: Tables of children with their level and their fields.
_CHILD_TABLES = {
    "p4_targets": ("r1", "description files scorePct verdict"), "p4_receipt_findings": ("r2", "description file line severity source type"), "p4_taint_findings": ("t1", "description file line severity sink source testCase type"),
    "p4_flow_steps": ("t2", "location.col location.file location.line statementId variable"), "p4_tools": ("b1", "name rank version"), "p4_scores": ("b2", "corpus durationMs f1 fp tp"),
    "p4_true_positives": ("b3", _DETAILS), "p4_false_positives": ("b4", _DETAILS), "p4_false_negatives": ("b5", _DETAILS),
}


def _children() -> str:
    """Each level unnests the lists of the one above; positions count every element, only objects are records."""

    def below(name: str, of: str, field: str) -> str:
        vs = _items(f"json_extract(v, '$.{field}')")
        item = f"select report_id, path as parent, path || '/{field}/' as head, {vs} as vs from {of}"
        return f"{name} as (select report_id, parent, i - 1 as pos, ltrim(head, '/') || (i - 1) as path, vs[i] as v from (select *, unnest(range(1, len(vs) + 1)) as i from ({item})) where json_type(vs[i]) = 'OBJECT')"

    root = "{} as (select report_id, '' as path, body::json as v from reports where kind = '{}' and json_valid(body) and json_type(body::json) = 'OBJECT')"
    roots = [root.format(*x) for x in (("r0", "receipts"), ("t0", "taint"), ("b0", "leaderboard"))]
    value = "json_extract(v, '$.\"' || k || '\"')"
    names = "select report_id, v, unnest(json_keys(v)) as k, generate_subscripts(json_keys(v), 1) as i from r0"
    targets = f"r1 as (select report_id, '' as parent, i - 1 as pos, k as path, {value} as v from ({names}) where json_type({value}) = 'OBJECT')"
    return "with " + ", ".join([*roots, targets, *[below(*x) for x in _LEVELS]]) + " "


def _child_sql() -> dict[str, str]:
    out = {"p4_found": _children() + " union all ".join(f"select report_id, path as child_path from {t}" for t, _ in _CHILD_TABLES.values())}
    for name, (level, fields) in _CHILD_TABLES.items():
        columns = ", ".join(f"json_extract_string(v, '$.{f}') as \"{f.replace('.', '_')}\"" for f in fields.split())
        out[name] = _children() + f"select report_id, path as child_path, parent as parent_path, pos::integer as pos, {columns} from {level}"
    return out


def oracle_sql() -> dict[str, str]:
    rank = " ".join(f"when '{k}' then {v}" for k, v in findings.SEVERITY_RANK.items())
    c = _classified()
    return _child_sql() | {
        "loc_per_file": SCANNED + "select file_id, lang, n_lines from l",
        "language_loc": SCANNED + "select lang, count(*) as n_files, sum(n_lines)::bigint as n_lines from l group by lang",
        "line_explode": SCANNED + "select file_id, line_no, length(line)::integer as n_chars from x",
        "extract_imports": SCANNED + IMPORTS + "select file_id, rel_path, line_no, source, starts_with(source, '.') as is_relative from i",
        "extract_classes": SCANNED
        + f"""select * from (select file_id, rel_path, line_no, case when contains(lower(line), 'interface') then 'interface' when contains(lower(line), 'struct') then 'struct' when contains(lower(line), 'enum') then 'enum'
          when contains(lower(line), 'protocol') then 'protocol' else 'class' end as kind, {_by_lang(lambda g: _name("line", g.classes))} as name from x) where name is not null""",
        "extract_todos": SCANNED + f"select file_id, rel_path, line_no, upper(regexp_extract(line, '{_TODO}', 1)) as kind from x where regexp_matches(line, '{_TODO}')",
        "extract_functions": SCANNED + _function_sql() + "select * exclude (repo) from fn",
        "flagged_functions": SCANNED
        + _function_sql()
        + "select file_id, rel_path, name, start_line, n_lines, complexity, n_lines > 100 as is_large, complexity > 15 as is_complex from fn where n_lines > 100 or complexity > 15",
        "unsupported_files": SCANNED
        + r"select repo, lower(regexp_extract(rel_path, '[.]([^./]+)$', 1)) as extension, count(*) as n_files, sum(n_lines)::bigint as n_lines from l where lang in ('cpp', 'terraform', 'dockerfile') group by all",
        "scan_metrics": SCANNED
        + _function_sql()
        + f""", t as (select repo, count(*) as n from x where regexp_matches(line, '{_TODO}') group by repo)
        select repo, count(*) as n_files, sum(n_lines)::bigint as n_lines, coalesce((select count(*) from fn where fn.repo = l.repo), 0) as n_functions, coalesce((select sum(complexity) from fn where fn.repo = l.repo), 0)::bigint as total_complexity,
          coalesce((select n from t where t.repo = l.repo), 0) as n_todos, (select count(*) from fn where fn.repo = l.repo and n_lines > 100) as n_large, (select count(*) from fn where fn.repo = l.repo and complexity > 15) as n_complex from l group by repo""",
        "export_counts": SCANNED + EXPORTS + "select file_id, rel_path, n_lines, n_exports from ge",
        "pattern_findings": SCANNED + _pattern_rows() + "select file_id, rule, type, severity, line_no from p",
        "findings_by_type": SCANNED + _pattern_rows() + f"select type, severity, count(*) as n, count(distinct file_id) as n_files from p where not regexp_matches(rel_path, '{patterns.TEST_FILE}') group by type, severity",
        "dedup_near_findings": SCANNED + _pattern_rows() + f"select file_id, type, line_no, rule, severity from (select *, {_NEAR} as rn from p) where rn = 1",
        "missing_guards": _risk()
        + _pattern_rows()
        + _REPORTED
        + """select repo, count(*) filter (where type = 'async-race') as n_async, count(*) filter (where type = 'null-safety') as n_null, count(*) filter (where type = 'error-boundary') as n_boundary,
          count(*) filter (where type = 'injection') as n_injection, count(*) filter (where type = 'hardcoded-secret') as n_secret, count(*) filter (where rule = 'eval-of-input') as n_eval, count(*) filter (where rule = 'where-clause') as n_where,
          count(*) filter (where rule = 'regexp-of-input') as n_regexp, count(*) filter (where rule = 'force-unwrap') as n_unwrap, count(*) filter (where rule = 'bare-json-parse') as n_json from kept group by repo""",
        "risk_scores": _risk() + "select file_id, complexity, coupling, untested, density, size, score, tier from rt",
        "risk_tiers": _risk() + "select tier, count(*) as n, round(avg(score), 6) as mean_score from rt group by tier",
        "verdict": _verdict(),
        "audit_issues": _issues(),
        "god_modules": SCANNED + EXPORTS + f"select file_id, rel_path, n_lines, n_exports from ge where {GODS}",
        "dep_edges": _risk() + "select repo, src, dst from me",
        "import_counts": _risk() + "select repo, module, n from md",
        "coupled_modules": _risk() + f"select repo, module, n from md where n > {graph.COUPLED}",
        "cycle_members": _recursive(SCANNED) + IMPORTS + PACKAGES + COMPONENTS + "select repo, component, module from cy",
        "causal_chains": _recursive(SCANNED)
        + IMPORTS
        + PACKAGES
        + COMPONENTS
        + EXPORTS
        + f"""select distinct 'cycle' as kind, repo, component as root, 'HIGH' as severity from cy union all select 'god-module', repo, rel_path, 'MED' from ge where {GODS}
          union all select 'coupling', repo, dst, case when count(*) > {graph.STRONGLY} then 'HIGH' else 'MED' end from e group by repo, dst having count(*) > {graph.COUPLED}""",
        "event_cycle_members": _EVENTS + COMPONENTS + "select repo, component, module from cy",
        "event_cycles": _EVENTS
        + COMPONENTS
        + """, walk as (select distinct cy.repo, component, module as here, 0 as n from cy where module = component union select walk.repo, walk.component, e.dst, n + 1 from walk join e on e.repo = walk.repo and e.src = walk.here
            join cy on cy.repo = e.repo and cy.module = e.dst and cy.component = walk.component where n < (select count(*) from cy c2 where c2.repo = walk.repo and c2.component = walk.component))
          select repo, component as root, (select count(*) from cy where cy.repo = walk.repo and cy.component = walk.component) as n_modules, min(n)::integer as n_steps from walk where n > 0 and here = component group by repo, component""",
        "event_reachability": _EVENTS
        + """, r as (select distinct repo, src as start, src as module, 0 as hops from e union select r.repo, r.start, e.dst, r.hops + 1 from r join e on e.repo = r.repo and e.src = r.module where r.hops < (select count(distinct event_type) from events))
        select repo, start, module, min(hops)::integer as hops from r group by all""",
        "finding_ids": c + _IDS + "select ord, finding_id from k",
        "cwe_primary": c + "select ord, cwe, surface, level from c",
        "cwe_counts": c
        + f", s as (select unnest(list_distinct(list_concat(case cwe {_aliases()} else [cwe] end, {_extras()}))) as cwe, repo, ord from c where cwe is not null) select cwe, count(*) as n, count(distinct repo) as n_repos from s group by cwe",
        "surface_split": c + "select surface, is_test, severity, count(*) as n from c group by all",
        "dedup_first_wins": DELIVERED + "select scan_id, file, line, type, description, min(ord) as ord from d group by all",
        "merge_findings": DELIVERED
        + """, o as (select *, row_number() over (partition by scan_id, file, line, type, description order by ord) as rn from d where source <> 'PULSAR'
          and not exists (select 1 from d b where b.source = 'PULSAR' and b.scan_id is not distinct from d.scan_id and b.file is not distinct from d.file and b.line is not distinct from d.line
            and b.type is not distinct from d.type and b.description is not distinct from d.description))
        select ord, scan_id, source from d where source = 'PULSAR' union all select ord, scan_id, source from o where rn = 1""",
        "fix_diff": c
        + _IDS
        + """, b as (select distinct finding_id from k where scan_id % 2 = 0), a as (select distinct finding_id from k where scan_id % 2 = 1)
        select coalesce(b.finding_id, a.finding_id) as finding_id, case when a.finding_id is null then 'resolved' when b.finding_id is null then 'new' else 'remaining' end as state
        from b full join a on b.finding_id = a.finding_id""",
        "top_issues": DELIVERED
        + f""", f as (select *, row_number() over (partition by repo, file, severity order by ord) as k from d where file is not null),
        r as (select *, row_number() over (partition by repo order by case severity {rank} else 3 end, ord)::integer as rank from f where k = 1)
        select repo, rank, file, severity, type, ord from r where rank <= 10""",
        "sarif_rules": c
        + "select rule_id, type, cwe, description, ord from (select concat_ws('/', type, 'CWE-' || cwe) as rule_id, *, row_number() over (partition by concat_ws('/', type, 'CWE-' || cwe) order by ord) as rn from c) where rn = 1",
        "sarif_results": c
        + """select repo, ord, concat_ws('/', type, 'CWE-' || cwe) as rule_id, json_object('ruleId', concat_ws('/', type, 'CWE-' || cwe), 'level', level, 'message', case when description is null then json_object() else json_object('text', description) end,
          'locations', json_array(json_object('physicalLocation', json_object('artifactLocation', json_object('uri', replace(coalesce(file, 'unknown'), chr(92), '/')), 'region', json_object('startLine', greatest(line, 1))))))::varchar as result from c""",
        "relative_uris": "select file_id, case when starts_with(path, '/srv/checkout/') then substr(path, 15) when starts_with(path, '/') then regexp_extract(path, '([^/]+)$', 1) else regexp_replace(path, '^[.]/', '') end as uri from files",
        "rule_conditions": _conditions(),
        "weakness_candidates": DELIVERED
        + """select d.source, w.corpus, d.ord, w.id from d join weaknesses w on d.repo = w.corpus and d.type = w.type
        where (d.file = w.file or ends_with(d.file, '/' || w.file) or ends_with(w.file, '/' || d.file)) and (w.scope = 'project' or abs(d.line - w.line) <= 5)""",
        "band_match_candidates": DELIVERED
        + """, w as (select repo, file, type, min(ord)::varchar as id, arg_min(line, ord) as line from d where source = 'PULSAR' and file is not null group by all)
        select d.source, w.repo as corpus, d.ord, w.id from d join w on d.repo = w.repo and d.type = w.type
        where (d.file = w.file or ends_with(d.file, '/' || w.file) or ends_with(w.file, '/' || d.file)) and abs(d.line - w.line) <= 5""",
        "package_edges": SCANNED + IMPORTS + PACKAGES + "select repo, src, dst from e",
        "package_in_degrees": SCANNED + IMPORTS + PACKAGES + "select repo, dst as module, count(*) as n from e group by all",
        "package_importers": SCANNED + IMPORTS + PACKAGES + "select repo, dst as module, string_agg(src, ',' order by src) as imported_by, count(*) as n from e group by all",
        "reachability": _recursive(SCANNED)
        + IMPORTS
        + PACKAGES
        + """, r as (select distinct repo, src as start, src as module, 0 as hops from e union
          select r.repo, r.start, e.dst, r.hops + 1 from r join e on e.repo = r.repo and e.src = r.module where r.hops < (select count(*) from e))
        select repo, start, module, min(hops)::integer as hops from r group by all""",
        "harmonic_f1": "select tool, count(*) as n, case when bool_or(f1 is null) then null when bool_or(f1 = 0) then 0.0 else round(count(*) / sum(1.0 / nullif(f1, 0)), 9) end as f1 from scores group by tool",
        "leaderboard": f"""with t as (select tool, count(distinct corpus) as n_corpora, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from scores group by tool),
          r as (select *, {_RATIOS} from t),
          f as (select *, case when precision_val is null or recall is null then null when precision_val + recall = 0 then 0.0 else 2 * precision_val * recall / (precision_val + recall) end as f1 from r)
        select tool, n_corpora, tp, fp, fn, round(precision_val, 9) as precision_val, round(recall, 9) as recall, round(f1, 9) as f1,
          row_number() over (order by round(f1, 9) desc nulls last, tool)::integer as rank from f""",
        "run_variance": """select corpus, stage, count(*) as n, round(median(total_ms) + 1e-9, 6) as median_ms,
          round(100 * greatest(max(total_ms) - median(total_ms), median(total_ms) - min(total_ms)) / median(total_ms) + 1e-9, 6) as variance_pct
        from runs where total_ms > 0 and not isnan(total_ms) group by corpus, stage""",
    }


