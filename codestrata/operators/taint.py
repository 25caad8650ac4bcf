"""Source-to-sink flows: an abstract interpreter over a small intermediate form, one module a task row.

Frontends lower to it: Python by its own grammar; JavaScript, TypeScript, PHP, Java, Go, C and Rust by tokens
(statements in order, branches and loops joined, no types); Ruby and shell line by line. Labels are joined where paths meet; loops run to a fixed point; calls of the
module's own functions go through summaries.
"""

from __future__ import annotations

import ast
import re
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import spread

# Where input comes from, where it does harm (call, dangerous argument or None for any, danger), what makes it safe.
SOURCES = (
    "request.args", "request.form", "request.json", "request.values", "request.cookies", "request.headers", "request.data", "request.GET", "request.POST", "request.get_json", "input", "sys.argv",
    "request.getParameter", "request.getHeader", "request.getQueryString", "$_GET", "$_POST", "$_REQUEST", "$_COOKIE", "$_SERVER", "r.URL.Query", "r.FormValue", "r.PostFormValue", "c.Query", "c.Param", "getenv", "argv",
    "env.args", "std.env.args", "params", "ARGV", "cookies", "$1", "$2", "$3", "$@", "$*", "$QUERY_STRING", "req.query", "req.body", "req.params", "req.headers", "req.cookies", "ctx.query", "ctx.request.body", "process.argv", "location.search", "location.hash",
)
SINKS = {
    "eval": "code", "exec": "code", "compile": "code", "Function": "code", "os.system": "command", "os.popen": "command", "subprocess.run": "command", "subprocess.call": "command", "subprocess.Popen": "command",
    "subprocess.check_output": "command", "child_process.exec": "command", "exec_sync": "command", "execSync": "command", "*.execute": "sql", "*.executemany": "sql", "*.raw": "sql", "db.all": "sql", "db.query": "sql", "db.get": "sql",
    "db.run": "sql", "pool.query": "sql", "connection.query": "sql", "open": "path", "send_file": "path", "fs.readFile": "path", "fs.readFileSync": "path", "fs.writeFile": "path", "res.sendFile": "path", "redirect": "redirect",
    "res.redirect": "redirect", "requests.get": "ssrf", "requests.post": "ssrf", "urllib.request.urlopen": "ssrf", "fetch": "ssrf", "axios.get": "ssrf", "render_template_string": "template", "res.send": "html", "pickle.loads": "code", "yaml.load": "code",
    "*.executeQuery": "sql", "*.executeUpdate": "sql", "*.createQuery": "sql", "response.sendRedirect": "redirect", "URL": "ssrf", "File": "path", "FileInputStream": "path", "Runtime.exec": "command", "ProcessBuilder": "command",
    "mysqli_query": "sql", "pg_query": "sql", "*.query": "sql", "shell_exec": "command", "system": "command", "passthru": "command", "popen": "command", "file_get_contents": "path", "include": "path", "require": "path", "header": "redirect",
    "unserialize": "code", "echo": "html", "print": "html", "*.Query": "sql", "*.Exec": "sql", "*.QueryRow": "sql", "exec.Command": "command", "os.Open": "path", "os.ReadFile": "path", "http.Get": "ssrf", "http.Redirect": "redirect",
    "strcpy": "memory", "strcat": "memory", "gets": "memory", "execl": "command", "fopen": "path", "Command.new": "command", "sqlx.query": "sql", "fs.read_to_string": "path", "File.open": "path", "File.read": "path",
    "*.find_by_sql": "sql", "*.where": "sql", "redirect_to": "redirect", "Net.HTTP.get": "ssrf", "Marshal.load": "code", "sh": "command", "bash": "command", "curl": "ssrf", "mysql": "sql",
}
#: Argument that does harm, of sinks where it isn't the first.
SINK_ARG = {"mysqli_query": 1, "pg_query": 1, "http.Redirect": 2, "strcpy": 1, "strcat": 1}
SANITIZERS = frozenset(
    """int float bool len Number parseInt parseFloat Boolean escape html.escape markupsafe.escape shlex.quote quote urllib.parse.quote encodeURIComponent os.path.basename path.basename
    secure_filename uuid.UUID hash hashlib.sha256 sanitize validator.escape Math.floor re.escape
    Integer.parseInt Long.parseLong Encode.forHtml ESAPI.encoder intval htmlspecialchars htmlentities escapeshellarg mysqli_real_escape_string filter_var strconv.Atoi strconv.ParseInt filepath.Base html.EscapeString
    url.QueryEscape atoi strtol strlen sizeof Integer Shellwords.escape CGI.escapeHTML ERB.Util.html_escape File.basename""".split()
)
DANGER_TYPE = {"code": "injection", "command": "injection", "sql": "injection", "template": "injection", "html": "injection", "path": "path-traversal", "redirect": "open-redirect", "ssrf": "ssrf", "memory": "memory-safety"}
# Last parts of a path after which a value is harmless.
HARMLESS = frozenset("to_i to_f length size isdigit parse is_empty hashCode".split())
FOUND = "file_id long, repo string, rel_path string, line int, type string, danger string, source string, sink string, flow array<struct<line:int,name:string>>"

# Labels of a value: (source, first line) -> path, the shortest that was found; source "@k" stands for parameter k.
# A path is None or (length, path before, (line, name)), so that a step costs the same however long it is.
Labels = dict


def pushed(path, step: tuple):
    return ((path[0] if path else 0) + 1, path, step)


def steps(path) -> list[tuple]:
    out = []
    while path:
        out.append(path[2])
        path = path[1]
    return out[::-1]


def merged(*many: Labels) -> Labels:
    """All labels, each with its shortest path; the first of several."""
    out: Labels = {}
    for labels in many:
        for k, path in labels.items():
            if k not in out or (path[0] if path else 0) < (out[k][0] if out[k] else 0):
                out[k] = path
    return out


@dataclass
class Call:
    path: str
    args: list
    line: int


@dataclass
class Node:
    """assign(name, value), expr(value), return(value), if(test, then, else), loop(body), guard(name)"""

    kind: str
    line: int
    name: str = ""
    value: object = None
    then: list = field(default_factory=list)
    other: list = field(default_factory=list)


@dataclass
class Function:
    name: str
    params: list[str]
    body: list[Node]
    tainted: bool = False


@dataclass
class Join:
    """A value made of others: names, dotted paths, calls and literals."""

    parts: list


class Interpreter:
    """Analyses one module: its top level and every function as an entry."""

    def __init__(self, functions: list[Function]):
        self.functions = {f.name: f for f in functions}
        self.memo: dict[str, tuple[Labels, list]] = {}
        self.active: set[str] = set()
        self.found: dict[tuple, tuple] = {}

    def run(self) -> list[tuple]:
        for f in self.functions.values():
            env = {p: {(p, 0): None} for p in f.params} if f.tainted else {}
            self.block(f.body, env, {})
        return [(*v[:5], steps(v[5])) for _, v in sorted(self.found.items(), key=lambda kv: (kv[1][0], str(kv[0])))]

    def summary(self, f: Function) -> tuple[Labels, list]:
        """Labels a call returns, with parameters as @k, and the sinks that parameters reach."""
        if f.name in self.memo:
            return self.memo[f.name]
        if f.name in self.active:
            return {}, []
        self.active.add(f.name)
        returns: Labels = {}
        held, self.found = self.found, {}
        self.block(f.body, {p: {(f"@{k}", 0): None} for k, p in enumerate(f.params)}, returns)
        sinks = [v for v in self.found.values() if v[3].startswith("@")]
        self.found = held
        self.active.discard(f.name)
        self.memo[f.name] = (returns, sinks)
        return returns, sinks

    def block(self, body: list[Node], env: dict, returns: Labels) -> bool:
        """Runs statements; True if the end cannot be reached."""
        for n in body:
            if n.kind == "assign":
                env[n.name] = {k: pushed(path, (n.line, n.name)) for k, path in self.value(n.value, env).items()}
                for k in [k for k in env if k.startswith(n.name + ".")]:
                    del env[k]
            elif n.kind == "expr":
                self.value(n.value, env)
            elif n.kind == "return":
                returns.update(merged(returns, self.value(n.value, env)))
                return True
            elif n.kind == "exit":
                return True
            elif n.kind == "if":
                self.value(n.value, env)
                a, b = dict(env), dict(env)
                for name in n.name.split():  # names that the test restricts to known values
                    (a if not name.startswith("!") else b)[name.lstrip("!")] = {}
                ends_a, ends_b = self.block(n.then, a, returns), self.block(n.other, b, returns)
                joined = [x for x, e in ((a, ends_a), (b, ends_b)) if not e]
                if not joined:
                    return True
                env.clear()
                for x in joined:
                    for k, v in x.items():
                        env[k] = merged(env[k], v) if k in env else v
            elif n.kind == "loop":
                while True:  # labels are finite and only added; a label that is there keeps its path
                    inner = dict(env)
                    self.block(n.then, inner, returns)
                    grown = False
                    for k, v in inner.items():
                        new = {x: path for x, path in v.items() if x not in env.get(k, {})}
                        if new or k not in env:
                            grown = grown or bool(new)
                            env[k] = env.get(k, {}) | new
                    if not grown:
                        break
        return False

    def value(self, v, env: dict) -> Labels:
        if v is None:
            return {}
        if isinstance(v, Join):
            return merged(*[self.value(p, env) for p in v.parts])
        if isinstance(v, Call):
            return self.call(v, env)
        path, line = v
        if path.rpartition(".")[2] in HARMLESS:
            return {}
        for s in SOURCES:
            if (path == s and s not in ("input",)) or path.startswith(s + "."):
                return {(s, line): None}
        while path:
            if path in env:
                return env[path]
            path = path.rpartition(".")[0]
        return {}

    def call(self, c: Call, env: dict) -> Labels:
        args = [self.value(a, env) for a in c.args]
        every = merged(*args)
        if c.path in SANITIZERS or c.path.rpartition(".")[2] in HARMLESS | {"isalnum", "test"}:
            return {}
        if c.path in SOURCES or any(c.path.startswith(s + ".") for s in SOURCES):
            return {(next(s for s in SOURCES if c.path == s or c.path.startswith(s + ".")), c.line): None}
        danger = SINKS.get(c.path) or SINKS.get("*." + c.path.rpartition(".")[2] if "." in c.path else "")
        if danger:
            k = SINK_ARG.get(c.path, 0)
            risky = (args[k] if len(args) > k else {}) if danger in ("sql", "path", "redirect", "ssrf", "memory") else every
            for (source, at), path in risky.items():
                self.report(c.line, danger, c.path, source, at, path)
        local = self.functions.get(c.path)
        if local:
            returns, sinks = self.summary(local)
            through = [{k: path for k, path in returns.items() if not k[0].startswith("@")}]
            for (s, _), path in returns.items():
                if s.startswith("@") and int(s[1:]) < len(args):
                    through.append({k: self.after(p, steps(path)) for k, p in args[int(s[1:])].items()})
            for line, dang, sink, s, _, path in sinks:
                if int(s[1:]) < len(args):
                    for (t, a), p in args[int(s[1:])].items():
                        self.report(line, dang, sink, t, a, self.after(p, [(c.line, c.path), *steps(path)]))
            return merged(*through)
        owner = c.path.rpartition(".")[0]
        return merged(every, self.value((owner, c.line), env)) if owner else every

    @staticmethod
    def after(path, more: list[tuple]):
        for step in more:
            path = pushed(path, step)
        return path

    def report(self, line: int, danger: str, sink: str, source: str, at: int, path) -> None:
        self.found.setdefault((line, danger, sink, source), (line, danger, sink, source, at, path))


# ---------------------------------------------------------------- Python


def _dotted(e) -> str:
    if isinstance(e, ast.Name):
        return e.id
    if isinstance(e, ast.Attribute):
        base = _dotted(e.value)
        return f"{base}.{e.attr}" if base else ""
    if isinstance(e, ast.Subscript):
        return _dotted(e.value)
    return ""


def _py_value(e):
    if e is None or isinstance(e, ast.Constant | ast.Lambda):
        return Join([])
    if isinstance(e, ast.Await):
        return _py_value(e.value)
    if isinstance(e, ast.Call):
        path = _dotted(e.func)
        args = [_py_value(a.value if isinstance(a, ast.Starred) else a) for a in e.args] + [_py_value(k.value) for k in e.keywords]
        if not path and isinstance(e.func, ast.Attribute):
            return Join([_py_value(e.func.value), Call("?." + e.func.attr, args, e.lineno)])
        return Call(path or "?", args, e.lineno)
    if (path := _dotted(e)) and isinstance(e, ast.Name | ast.Attribute | ast.Subscript):
        return (path, e.lineno)
    return Join([_py_value(c) for c in ast.iter_child_nodes(e) if isinstance(c, ast.expr | ast.FormattedValue | ast.comprehension)])


def _py_guard(test) -> str:
    """Names that a membership or digit test restricts; with ! where it does so in the other branch."""
    if isinstance(test, ast.UnaryOp) and isinstance(test.op, ast.Not):
        return " ".join(x[1:] if x.startswith("!") else "!" + x for x in _py_guard(test.operand).split())
    if isinstance(test, ast.Compare) and len(test.ops) == 1 and isinstance(test.left, ast.Name) and isinstance(test.ops[0], ast.In | ast.NotIn | ast.Eq | ast.NotEq):
        literal = isinstance(test.comparators[0], ast.Name | ast.Constant | ast.List | ast.Set | ast.Tuple | ast.Dict) and not (isinstance(test.comparators[0], ast.Name) and isinstance(test.ops[0], ast.Eq | ast.NotEq))
        if literal:
            return test.left.id if isinstance(test.ops[0], ast.In | ast.Eq) else "!" + test.left.id
    if isinstance(test, ast.Call) and isinstance(test.func, ast.Attribute) and test.func.attr in ("isdigit", "isalnum", "isalpha") and isinstance(test.func.value, ast.Name):
        return test.func.value.id
    return ""


def _py_block(body) -> list[Node]:
    out: list[Node] = []
    for s in body:
        line = getattr(s, "lineno", 0)
        if isinstance(s, ast.Assign):
            for t in s.targets:
                for name in t.elts if isinstance(t, ast.Tuple | ast.List) else [t]:
                    if d := _dotted(name):
                        out.append(Node("assign", line, d, _py_value(s.value)))
        elif isinstance(s, ast.AnnAssign | ast.AugAssign) and (d := _dotted(s.target)):
            more = [(d, line)] if isinstance(s, ast.AugAssign) else []
            out.append(Node("assign", line, d, Join([_py_value(s.value), *more])))
        elif isinstance(s, ast.Return):
            out.append(Node("return", line, value=_py_value(s.value)))
        elif isinstance(s, ast.Raise):
            out += [Node("expr", line, value=_py_value(s.exc)), Node("exit", line)]
        elif isinstance(s, ast.If):
            out.append(Node("if", line, _py_guard(s.test), _py_value(s.test), _py_block(s.body), _py_block(s.orelse)))
        elif isinstance(s, ast.For | ast.AsyncFor):
            head = [Node("assign", line, _dotted(s.target), _py_value(s.iter))] if _dotted(s.target) else []
            out += [Node("loop", line, then=head + _py_block(s.body)), *_py_block(s.orelse)]
        elif isinstance(s, ast.While):
            out.append(Node("loop", line, then=[Node("expr", line, value=_py_value(s.test)), *_py_block(s.body)]))
        elif isinstance(s, ast.Try):
            handlers = [x for h in s.handlers for x in _py_block(h.body)]
            out += [Node("if", line, value=Join([]), then=_py_block(s.body) + _py_block(s.orelse), other=_py_block(s.body)[:0] + handlers), *_py_block(s.finalbody)]
        elif isinstance(s, ast.With | ast.AsyncWith):
            for i in s.items:
                d = _dotted(i.optional_vars) if i.optional_vars else ""
                out.append(Node("assign" if d else "expr", line, d, _py_value(i.context_expr)))
            out += _py_block(s.body)
        elif isinstance(s, ast.Expr):
            v = s.value
            if isinstance(v, ast.Call) and isinstance(v.func, ast.Attribute) and v.func.attr in ("append", "add", "extend", "insert", "update") and (d := _dotted(v.func.value)):
                out.append(Node("assign", line, d, Join([(d, line), *[_py_value(a) for a in v.args]])))
            else:
                out.append(Node("expr", line, value=_py_value(v)))
    return out


def lower_python(text: str) -> list[Function]:
    """Functions of a module, its top level as one of them; texts that do not parse give none."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    out = [Function("<top>", [], _py_block(tree.body))]
    for n in ast.walk(tree):
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            routed = any(isinstance(d, ast.Call) and _dotted(d.func).rpartition(".")[2] in ("route", "get", "post", "put", "delete", "patch") for d in n.decorator_list)
            out.append(Function(n.name, [a.arg for a in n.args.args], _py_block(n.body), routed))
    return out


# ---------------------------------------------------------------- JavaScript and TypeScript

_JS = re.compile(r"(?P<com>//[^\n]*|/\*[\s\S]*?\*/)|(?P<str>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<tpl>`(?:[^`\\]|\\[\s\S])*`)|(?P<id>[A-Za-z_$][\w$]*(?:\s*\??\.\s*[A-Za-z_$][\w$]*)*)|(?P<num>\d[\w.]*)|(?P<nl>\n)|(?P<op>=>|[=!]==?|[\s\S])")
_SKIP = frozenset("const let var return await async function new if else for of in while typeof throw try catch finally class extends export default import from this true false null undefined".split())


def _js_tokens(text: str) -> list[tuple[str, str, int]]:
    out, line = [], 1
    for m in _JS.finditer(text):
        kind, word = m.lastgroup, m.group()
        if kind not in ("com", "nl") and not (kind == "op" and word.isspace()):
            out.append((kind, re.sub(r"\s|\?", "", word) if kind == "id" else word, line))
        line += word.count("\n")
    return out


def _js_value(toks: list[tuple[str, str, int]]):
    parts, i = [], 0
    while i < len(toks):
        kind, word, line = toks[i]
        if kind == "tpl":
            for x in re.findall(r"\$\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}", word):
                parts.append(_js_value([(k, w, line) for k, w, _ in _js_tokens(x)]))
        elif kind == "id" and word not in _SKIP:
            if i + 1 < len(toks) and toks[i + 1][1] == "(":
                j = _js_close(toks, i + 1)
                args, depth, start = [], 0, i + 2
                for k in range(i + 2, j):
                    w = toks[k][1]
                    depth += (w in "([{") - (w in ")]}") if toks[k][0] == "op" else 0
                    if w == "," and not depth:
                        args.append(_js_value(toks[start:k]))
                        start = k + 1
                args.append(_js_value(toks[start:j]))
                parts.append(Call(word, args, line))
                i = j
            else:
                parts.append((word, line))
        i += 1
    return Join(parts)


def _js_close(toks, i: int) -> int:
    depth = 0
    for k in range(i, len(toks)):
        if toks[k][0] == "op":
            depth += (toks[k][1] in "([{") - (toks[k][1] in ")]}")
            if not depth:
                return k
    return len(toks)


def _js_block(toks: list[tuple[str, str, int]]) -> list[Node]:
    out: list[Node] = []
    i = 0
    while i < len(toks):
        kind, word, line = toks[i]
        if word in ("if", "for", "while", "switch", "catch") and i + 1 < len(toks) and toks[i + 1][1] == "(":
            j = _js_close(toks, i + 1)
            head = toks[i + 2 : j]
            k = j + 1
            if k < len(toks) and toks[k][1] == "{":
                e = _js_close(toks, k)
                body, i = _js_block(toks[k + 1 : e]), e + 1
            else:
                e = next((x for x in range(k, len(toks)) if toks[x][1] == ";"), len(toks))
                body, i = _js_block(toks[k : e + 1]), e + 1
            if word in ("for", "while"):
                of = next((x for x, t in enumerate(head) if t[1] in ("of", "in")), None)
                first = [Node("assign", line, head[of - 1][1], _js_value(head[of + 1 :]))] if of else []
                out.append(Node("loop", line, then=first + body))
            else:
                guard = ""
                m = [t[1] for t in head]
                if len(m) >= 4 and m[-2] == head[-2][1] and re.search(r"\.(includes|has|test)$", m[1 if m[0] == "!" else 0]) and m[-1] == ")":
                    guard = ("!" if m[0] == "!" else "") + m[-2]
                other: list[Node] = []
                if i < len(toks) and toks[i][1] == "else" and i + 1 < len(toks) and toks[i + 1][1] == "{":
                    e = _js_close(toks, i + 1)
                    other, i = _js_block(toks[i + 2 : e]), e + 1
                out.append(Node("if", line, guard, _js_value(head), body, other))
            continue
        if word in ("try", "else", "finally") and i + 1 < len(toks) and toks[i + 1][1] == "{":
            e = _js_close(toks, i + 1)
            out += _js_block(toks[i + 2 : e])
            i = e + 1
            continue
        if word in ("{", "}", ";"):
            i += 1
            continue
        e, depth = i, 0
        while e < len(toks):
            w, op = toks[e][1], toks[e][0] == "op"
            if op and not depth and w in (";", "}"):
                break
            if e > i and not depth and toks[e][2] > toks[e - 1][2] and toks[e - 1][1] not in ("=", "+", ",", "(", "=>", "&", "|", "?", ":") and toks[e][1] not in ("+", ".", "?", ":", ")", "]", "&", "|", "{"):
                break
            depth += (w in "([{") - (w in ")]}") if op else 0
            e += 1
        part = toks[i:e]
        i = max(e, i + 1)
        if not part:
            continue
        if part[0][1] == "return":
            out.append(Node("return", line, value=_js_value(part[1:])))
        elif part[0][1] == "throw":
            out += [Node("expr", line, value=_js_value(part[1:])), Node("exit", line)]
        else:
            eq = next((k for k, t in enumerate(part) if t[1] == "=" and t[0] == "op"), None)
            if eq:
                names = [t[1] for t in part[:eq] if t[0] == "id" and t[1] not in _SKIP]
                plus = part[eq - 1][1] == "+"
                for n in names:
                    v = _js_value(part[eq + 1 :])
                    out.append(Node("assign", line, n, Join([v, (n, line)]) if plus else v))
            else:
                out.append(Node("expr", line, value=_js_value(part)))
    return out


def lower_javascript(text: str) -> list[Function]:
    """Named functions, methods and arrow functions of a module, and its whole text as the top level."""
    toks = _js_tokens(text)
    out: list[Function] = []
    top: list = []
    i = 0
    while i < len(toks):
        kind, word, _ = toks[i]
        name = None
        if word == "function" and i + 2 < len(toks) and toks[i + 1][0] == "id":
            name, o = toks[i + 1][1], i + 2
        elif kind == "id" and word not in _SKIP and i + 1 < len(toks) and toks[i + 1][1] == "(" and (c := _js_close(toks, i + 1)) + 1 < len(toks) and toks[c + 1][1] == "{":
            name, o = word, i + 1
        elif word in ("const", "let", "var") and i + 3 < len(toks) and toks[i + 2][1] == "=" and toks[i + 3 + (toks[i + 3][1] == "async")][1:2] == ("(",):
            o = i + 3 + (toks[i + 3][1] == "async")
            c = _js_close(toks, o)
            name = toks[i + 1][1] if c + 1 < len(toks) and toks[c + 1][1] == "=>" else None
        if name:
            c = _js_close(toks, o)
            b = next((k for k in range(c + 1, min(len(toks), c + 14)) if toks[k][1] == "{"), None)
            if b is not None:
                e = _js_close(toks, b)
                params, depth, fresh = [], 0, True
                for t in toks[o + 1 : c]:
                    if t[0] == "op":
                        depth += (t[1] in "([{<") - (t[1] in ")]}>")
                        fresh = t[1] == "," and not depth
                    elif fresh and t[0] == "id":
                        params.append(t[1])
                        fresh = False
                out.append(Function(name, params, _js_block(toks[b + 1 : e])))
                i = e + 1
                continue
        top.append(toks[i])
        i += 1
    return [Function("<top>", [], _js_block(top)), *out]


# ---------------------------------------------------------------- other languages with braces

#: What is rewritten before the tokens are read, so that one lowering serves all: access, declaration and assignment.
_REWRITE = {
    "php": ((r"<\?(?:php|=)?|\?>", ""), (r"->|::", "."), (r"(?m)#[^\n]*$", ""), (r"\b(echo|print|include|require)\s+([^;(][^;]*);", r"\1(\2);"), (r"\[['\"]?\w+['\"]?\]", "")),
    "java": ((r"\)\s*throws[^{;]*\{", ") {"), (r"\bfinal\s+|\bnew\s+", ""), (r"\(\)\s*\.\s*(?=exec\b)", "."), (r"Runtime\.getRuntime\.exec", "Runtime.exec"), (r"<[\w<>?, ]*>", "")),
    "go": ((r":=", "="), (r"\bvar\s+(\w+)\s+[\w.*\[\]]+\s*=", r"\1 ="), (r"\b(\w++)\s*,\s*(?:_|err|ok)\s*=", r"\1 ="), (r"\bif\s+([^({\n][^{\n]*)\{", r"if (\1) {"), (r"\bfor\s+([^({\n][^{\n]*)\{", r"for (\1) {"), (r"\)\s*(?:\([^()]*\)|[\w.*\[\]]+)\s*\{", ") {"), (r"\bfunc\s*\([^)]*\)\s*", "func ")),
    "c": ((r"(?m)^[ \t]*#[^\n]*", ""), (r"->", "."), (r"\[[^\]]*\]", ""), (r"\b(?:sprintf|snprintf|strcpy|strcat|strncpy)\s*\(\s*(\w+)\s*,([^;]*)\);", lambda m: m.group().rstrip(";") + f"; {m.group(1)} = copy({m.group(2)});"), (r"\bfgets\s*\(\s*(\w+)\s*,[^;]*;", r"\1 = getenv(0);")),
    "rs": ((r"::", "."), (r"\blet\s+mut\s+", "let "), (r"&(?:mut\s+)?", ""), (r"!\(", "("), (r"\bif\s+([^({\n][^{\n]*)\{", r"if (\1) {"), (r"\)\s*->\s*[^{;]+\{", ") {"), (r"\?;", ";")),
}


def lower_braces(text: str, lang: str) -> list[Function]:
    """Functions of PHP, Java, Go, C and Rust by the token lowering; parameters by their last (Java, C) or first word."""
    for pattern, by in _REWRITE[lang]:
        text = re.sub(pattern, by, text)
    out = lower_javascript(text)
    if lang in ("java", "c"):
        for f in out:
            m = re.search(rf"\b{re.escape(f.name)}\s*\(([^()]*)\)", text)
            if m and f.params:
                f.params = [x.split()[-1].lstrip("*&") for x in m.group(1).split(",") if x.split()]
    return out


# ---------------------------------------------------------------- Ruby and shell, line by line

_RB_TEXT = re.compile(r"\"(?:[^\"\\]|\\.)*\"|`[^`]*`")


def _rb_value(text: str, line: int) -> Join:
    inserts = [x for q in _RB_TEXT.findall(text) for x in re.findall(r"#\{([^{}]*)\}", q)]
    plain = _RB_TEXT.sub('""', text)
    plain = re.sub(r"^([A-Za-z_][\w.:]*[?!]?)\s+(?=[\"':A-Za-z_@\[])(?!(?:if|unless|and|or|do|then)\b)([^=].*)$", r"\1(\2)", plain)
    plain = re.sub(r"\[[:'\"\w]+\]", "", plain).replace("::", ".")
    toks = [(k, w, line) for k, w, _ in _js_tokens(plain)]
    v = _js_value(toks)
    if inserts:
        inner = Join([_rb_value(x, line) for x in inserts])
        calls = [p for p in v.parts if isinstance(p, Call)]
        if calls:
            calls[0].args = [Join([*calls[0].args, inner])]
        else:
            v.parts.append(Call("system", [inner], line) if "`" in text else inner)
    return v


def lower_ruby(text: str) -> list[Function]:
    """Methods and the top level as straight lines: branches are joined by keeping what either could have left."""
    out, current, depth = [Function("<top>", [], [])], None, 0
    for no, raw in enumerate(text.replace("\r", "").split("\n"), 1):
        s = re.sub(r"(?<![\"'\w])#(?!\{).*$", "", raw).strip()
        m = re.match(r"def\s+(?:self\.)?(\w+[?!]?)\s*\(?([^)]*)\)?", s)
        if m:
            current = Function(m.group(1), [p.split("=")[0].strip().lstrip("*&") for p in m.group(2).split(",") if p.strip()], [])
            out.append(current)
            depth = 1
            continue
        if current is not None:
            depth += bool(re.match(r"(?:if|unless|while|until|case|begin|for|class|module)\b", s)) + bool(re.search(r"\bdo\b(?:\s*\|[^|]*\|)?$", s)) - (s == "end" or s.startswith("end."))
            if depth <= 0:
                current = None
                continue
        body = (current or out[0]).body
        a = re.match(r"([a-z_@]\w*)\s*(\|\||\+)?=(?![=~>])\s*(.*)$", s)
        if a:
            v = _rb_value(a.group(3), no)
            body.append(Node("assign", no, a.group(1), Join([v, (a.group(1), no)]) if a.group(2) else v))
        elif s.startswith("return "):
            body.append(Node("return", no, value=_rb_value(s[7:], no)))
        elif s and s not in ("end", "else", "begin"):
            body.append(Node("expr", no, value=_rb_value(re.sub(r"^(?:if|unless|elsif|while|raise)\s+", "", s), no)))
    return out


def lower_shell(text: str) -> list[Function]:
    """A script's lines in order: assignments, reads and commands with their expansions."""
    body: list[Node] = []
    for no, raw in enumerate(text.replace("\r", "").split("\n"), 1):
        s = re.sub(r"(?:^|\s)#.*$", "", raw).strip()
        s = re.sub(r"^(?:if|while|then|do|else|elif)\s+", "", s)
        names = [("$" + (x or y), no) for x, y in re.findall(r"\$(?:\{(\w+|[@*])[^}]*\}|(\w+|[@*]))", re.sub(r"'[^']*'", "", s))]
        names = [] if "printf %q" in s or "printf '%q'" in s else names
        a = re.match(r"(?:export\s+|local\s+|readonly\s+)?([A-Za-z_]\w*)=(.*)$", s)
        r = re.match(r"read\s+(?:-\w+\s+)*([A-Za-z_]\w*)", s)
        if a:
            body.append(Node("assign", no, "$" + a.group(1), Join(names)))
        elif r:
            body.append(Node("assign", no, "$" + r.group(1), ("$1", no)))
        elif s:
            for part in re.split(r"\||&&|;", s):
                words = part.split()
                mine = [n for n in names if n[0][1:] in part]
                runs = words and (words[0] in ("eval", "curl") or (words[0] in ("sh", "bash") and "-c" in words) or (words[0] == "mysql" and "-e" in words))
                if runs and mine:
                    body.append(Node("expr", no, value=Call(words[0], [Join(mine)], no)))
    return [Function("<top>", [], body)]


def _braces(lang: str):
    return lambda text: lower_braces(text, lang)


LOWER = {"php": _braces("php"), "java": _braces("java"), "go": _braces("go"), "c": _braces("c"), "h": _braces("c"), "rs": _braces("rs"), "rb": lower_ruby, "sh": lower_shell, "bash": lower_shell, "py": lower_python, "js": lower_javascript, "mjs": lower_javascript, "ts": lower_javascript, "tsx": lower_javascript, "jsx": lower_javascript}


def analyse(text: str | None, rel_path: str) -> list[tuple] | None:
    """(line, danger, sink, source, source line, flow) of a file's flows; null, empty and broken texts give none.

    None where the text is nested too deeply for the analysis, which ``not_analysed`` lists.
    """
    lower = LOWER.get(rel_path.rsplit(".", 1)[-1].lower())
    if not text or not lower:
        return []
    try:
        return Interpreter(lower(text)).run()
    except (RecursionError, MemoryError):
        return None


def _wanted(files: DataFrame) -> DataFrame:
    wanted = F.col("rel_path").rlike(r"\.(" + "|".join(LOWER) + ")$") & ~F.col("rel_path").rlike(r"\.d\.ts$|[.-]min\.js$|\.bundle\.js$") & F.col("content").isNotNull()
    return spread(files.where(wanted).select("file_id", "repo", "rel_path", "content"))


def not_analysed(files: DataFrame) -> DataFrame:
    """(file_id, repo, rel_path) of files that ``flows`` would read but that are nested too deeply for it."""

    def look(batches):
        for pdf in batches:
            deep = [analyse(text, rel) is None for rel, text in zip(pdf["rel_path"], pdf["content"], strict=True)]
            yield pdf.loc[deep, ["file_id", "repo", "rel_path"]]

    return _wanted(files).mapInPandas(look, "file_id long, repo string, rel_path string")


def flows(files: DataFrame) -> DataFrame:
    """Every source-to-sink flow of files in the languages of ``LOWER``; declaration files and minified scripts are left out."""

    def look(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for fid, repo, rel, text in zip(pdf["file_id"], pdf["repo"], pdf["rel_path"], pdf["content"], strict=True):
                for line, danger, sink, source, at, path in analyse(text, rel) or ():
                    flow = [{"line": at, "name": source}, *[{"line": a, "name": n} for a, n in path], {"line": line, "name": sink}]
                    out.append((fid, repo, rel, line, DANGER_TYPE[danger], danger, source, sink, flow))
            yield pd.DataFrame(out, columns=["file_id", "repo", "rel_path", "line", "type", "danger", "source", "sink", "flow"])

    return _wanted(files).mapInPandas(look, FOUND)


def as_findings(flows: DataFrame, engine: str = "TAINT") -> DataFrame:
    """Flows in the shape of findings: (file_id, repo, source, file, line, type, severity, description); the description names the engine."""
    kind = F.when(F.col("type").isin("open-redirect", "ssrf"), "edge-case").otherwise("injection")
    text = F.concat(F.lit(f"[{engine}] Tainted value from "), F.col("source"), F.lit(" reaches "), F.col("sink"))
    return flows.select("file_id", "repo", F.lit(engine).alias("engine"), F.col("rel_path").alias("file"), "line", kind.alias("type"), F.lit("HIGH").alias("severity"), text.alias("description"))
