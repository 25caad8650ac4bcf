"""Source files that do not parse: lexers with a pushdown stack, one for each language.

Each lexer splits a text into tokens, keeps open brackets, blocks and strings on a stack and reports what no valid
text of its language has: conflict markers, unterminated literals and comments, unbalanced delimiters, premature
ends, and tokens that cannot stand side by side (as where a file holds another language than its name says).
What they find in Python is then confirmed by an exact parse.
"""

from __future__ import annotations

import ast
import re
import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import spread

EXTENSIONS = {
    "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "java": "java", "go": "go", "c": "c", "h": "c",
    "rb": "ruby", "php": "php", "sh": "shell", "bash": "shell", "tf": "terraform", "yml": "yaml", "yaml": "yaml", "json": "json",
}
CONFLICT = re.compile(r"^(?:<{7}(?: .*)?|\|{7}(?: .*)?|>{7} .*|={7})\r?$", re.M)
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}

Problem = tuple[str, int, str]  # kind, offset, detail


@dataclass(slots=True)
class Token:
    kind: str  # id, num, str, op, nl, bad
    text: str
    at: int


class Broken(Exception):
    """The first thing that no valid text has."""

    def __init__(self, kind: str, at: int, detail: str = ""):
        super().__init__(kind)
        self.problem: Problem = (kind, at, detail)


def _set(text: str) -> frozenset[str]:
    return frozenset(text.split())


# ---------------------------------------------------------------- languages with braces

_STRING = r'"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"'
_CHAR = r"'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'"
_ID = r"[^\W\d][\w$]*"
_NUM = r"\.?\d(?:[eEpP][+-]|[\w.])*"
_C_COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"

_LEX = {
    "javascript": (r"[ \t\r\f\v\xa0﻿]+", rf"{_C_COMMENT}", rf"(?P<str>{_STRING}|{_CHAR})|(?P<id>[#@]?[$_a-zA-Z\x80-￿][\w$]*)|(?P<num>{_NUM})|(?P<op>=>|\?\.(?!\d)|\?\?=?|\.\.\.|[-+*/%&|^<>=!]=*|&&|\|\||[\s\S])"),
    "java": (r"[ \t\r\f]+", rf"{_C_COMMENT}", rf"(?P<str>\"\"\"[\s\S]*?\"\"\"|{_STRING}|'(?:[^'\\\n]|\\u+[0-9a-fA-F]{{4}}|\\[0-7]{{1,3}}|\\.)')|(?P<id>@?[$_a-zA-Z\x80-￿][\w$]*)|(?P<num>{_NUM})|(?P<op>->|::|\.\.\.|[\s\S])"),
    "c": (r"(?:[ \t\r\f]|\\\r?\n)+", rf"{_C_COMMENT}", rf"(?P<str>(?:u8|[LuU])?{_STRING}|[LuU]?'(?:[^'\\\n]|\\.){{1,4}}')|(?P<id>[$_a-zA-Z\x80-￿][\w$]*)|(?P<num>{_NUM})|(?P<op>->|\.\.\.|[\s\S])"),
    "go": (r"[ \t\r\f]+", rf"{_C_COMMENT}", rf"(?P<str>{_STRING}|`[^`]*`|'(?:[^'\\\n]|\\[0-7]{{3}}|\\x..|\\u.{{4}}|\\U.{{8}}|\\.)')|(?P<id>[_a-zA-Z\x80-￿]\w*)|(?P<num>{_NUM})|(?P<op>:=|<-|\.\.\.|\+\+|--|&&|\|\||[-+*/%&|^<>=!]=+|[\s\S])"),
    "php": (r"[ \t\r\f]+", rf"{_C_COMMENT}|\#(?!\[)[^\n]*", rf"(?P<str>\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\]|\\[\s\S])*')|(?P<id>\$*[_a-zA-Z\x80-￿\\][\w\\]*)|(?P<num>{_NUM})|(?P<op>=>|->|\?->|::|\?\?=?|\.\.\.|[\s\S])"),
    "terraform": (r"[ \t\r\f]+", rf"{_C_COMMENT}|\#[^\n]*", rf"(?P<id>[_a-zA-Z\x80-￿][\w-]*)|(?P<num>\d[\d.]*(?:[eE][+-]?\d+)?)|(?P<op>=>|==|!=|<=|>=|&&|\|\||\.\.\.|[\s\S])"),
}
# white space and comments stand before a token
_LEX = {k: re.compile(rf"(?:{ws}|{com})*+(?:(?P<nl>\n)|{rest}|\Z)") for k, (ws, com, rest) in _LEX.items()}

_JS_NUM = re.compile(r"0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*)?\.?\d[\d_]*(?:\.?(?:[eE][+-]?\d+)?)n?|\d+\.(?:[eE][+-]?\d+)?")
# Words after which an operand may stand on the same line.
_JS_WORDS = _set(
    """await async break case catch class const continue debugger default delete do else export extends finally for from function get if import in instanceof
    let new of return set static super switch this throw try typeof var void while with yield as"""
)
_TS_WORDS = _JS_WORDS | _set(
    """abstract any asserts assert declare enum global implements infer interface is keyof module namespace never override private protected public readonly
    require satisfies type unique out accessor"""
)
_JS_VALUES = _set("this super null true false")
_JS_PARENS = _set("if for while switch catch with")


def _scan_template(text: str, at: int, close: str, mark: str) -> tuple[int, bool]:
    """End of a template's plain part from ``at``: (position after ``close`` or ``mark``, whether it is closed)."""
    n = len(text)
    while at < n:
        c = text[at]
        if c == "\\":
            at += 2
        elif c == close:
            return at + 1, True
        elif text.startswith(mark, at):
            return at + len(mark), False
        else:
            at += 1
    raise Broken("unterminated literal", n, close)


_JS_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_HEREDOC = re.compile(r"<<[-~]?([A-Za-z_]\w*)[^\n]*\n")


def tokens(text: str, lang: str) -> list[Token]:
    """Tokens without white space and comments; a template's or HCL string's inserts are tokens between its parts."""
    lex = _LEX["javascript" if lang == "typescript" else lang].match
    js, hcl = lang in ("javascript", "typescript"), lang == "terraform"
    out: list[Token] = []
    inserts: list[int] = []  # depth of braces at which an insert ends
    depth, at, n = 0, 0, len(text)
    if js and text.startswith("#!"):
        at = text.find("\n") if "\n" in text else n
    while at < n:
        m = lex(text, at)
        kind = m.lastgroup
        if kind is None:
            break
        part, at = m.group(kind), m.start(kind)
        if kind == "op":
            c = part[0]
            if c == "/" and text.startswith("/*", at):
                raise Broken("unterminated comment", at)
            if js and c == "/" and _regex_may_start(out):
                r = _JS_REGEX.match(text, at)
                if r:
                    out.append(Token("str", r.group(), at))
                    at = r.end()
                    continue
            if (js and c == "`") or (hcl and c == '"'):
                at2, closed = _scan_template(text, at + 1, c, "${")
                if hcl and "\n" in text[at:at2] and closed:
                    raise Broken("unterminated literal", at)
                out.append(Token("str", text[at:at2], at))
                if not closed:
                    inserts.append(depth)
                    out.append(Token("op", "${", at2 - 2))
                    depth += 1
                at = at2
                continue
            if hcl and c == "<" and (h := _HEREDOC.match(text, at)):
                end = re.compile(rf"^[ \t]*{h.group(1)}\r?$", re.M).search(text, h.end())
                if not end:
                    raise Broken("unterminated literal", at, "heredoc")
                out.append(Token("str", "<<", at))
                at = end.end()
                continue
            if lang == "php" and text.startswith("<<<", at):
                h = re.compile(r"<<<[ \t]*['\"]?(\w+)['\"]?\r?\n").match(text, at)
                end = h and re.compile(rf"^[ \t]*{h.group(1)}\b", re.M).search(text, h.end())
                if not end:
                    raise Broken("unterminated literal", at, "heredoc")
                out.append(Token("str", "<<<", at))
                at = end.end()
                continue
            if lang == "php" and text.startswith("?>", at):
                nxt = re.compile(r"<\?(?:php\b|=)").search(text, at)
                out.append(Token("op", ";", at))
                at = nxt.end() if nxt else n
                continue
            if c in "\"'" or (c == "`" and lang == "go"):
                raise Broken("unterminated literal", at, c)
            if c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if inserts and depth == inserts[-1]:
                    inserts.pop()
                    out.append(Token("op", "}$", at))
                    close = "`" if js else '"'
                    at2, closed = _scan_template(text, at + 1, close, "${")
                    out.append(Token("part", text[at:at2], at))
                    if not closed:
                        inserts.append(depth)
                        out.append(Token("op", "${", at2 - 2))
                        depth += 1
                    at = at2
                    continue
        out.append(Token(kind, part, at))
        at = m.end()
    if inserts:
        raise Broken("unterminated literal", n, "insert")
    return out


def _regex_may_start(out: list[Token]) -> bool:
    for t in reversed(out):
        if t.kind == "nl":
            continue
        if t.kind in ("num", "str", "part"):
            return False
        if t.kind == "id":
            return t.text in _JS_WORDS and t.text not in _JS_VALUES
        return t.text not in (")", "]", "}")
    return True


def balanced(toks: list[Token]) -> list[int]:
    """Index of the partner of each bracket (or -1); the pushdown stack of all languages with braces."""
    stack: list[int] = []
    partner = [-1] * len(toks)
    for i, t in enumerate(toks):
        if t.kind != "op":
            continue
        c = "{" if t.text == "${" else "}" if t.text == "}$" else t.text
        if c in OPEN:
            stack.append(i)
        elif c in CLOSE:
            if not stack:
                raise Broken("unbalanced delimiter", t.at, c)
            o = stack.pop()
            have = "{" if toks[o].text == "${" else toks[o].text
            if have != CLOSE[c]:
                raise Broken("unbalanced delimiter", t.at, f"{have} {c}")
            partner[o], partner[i] = i, o
    if stack:
        raise Broken("premature end", toks[stack[-1]].at, toks[stack[-1]].text)
    return partner


_NEEDS_MORE = _set("= + - * / % & | ^ < > ! ? : , . => && || == === != !== <= >= += -= *= /= ?? ?. :: -> := <- ...")


_JS_ASKS = _JS_PARENS | _set("enum interface import")
_JS_HEADERS = _set("class interface enum namespace module extends implements declare global")
_JS_TYPED = _set(": | & is => keyof")


def check_js(text: str, lang: str) -> None:
    toks = tokens(text, lang)
    partner = balanced(toks)
    ts = lang == "typescript"
    known = _TS_WORDS if ts else _JS_WORDS
    prev, at_prev = None, -1  # last token that is no newline
    broke = False  # newline since
    in_case = headed = False  # since the statement began: case, default or ?; a word that opens a class or the like
    typed = [False]  # for each open bracket, whether its statement has an annotation so far
    block_like: dict[int, bool] = {}  # opening brace -> block, not object
    enclosing: list[int] = []
    header_end: set[int] = set()
    for i, t in enumerate(toks):
        if t.kind == "nl":
            broke, in_case, headed = True, False, headed and ts
            continue
        p = prev
        if t.kind == "num" and not _JS_NUM.fullmatch(t.text):
            raise Broken("foreign token", t.at, t.text)
        if t.kind == "op" and t.text in ("#", "@", "\\") or (t.kind == "id" and t.text[0] == "#" and not (p and p.text in (".", "?.", "in", "{", "}", ";", "static", "get", "set", "async", "*", "readonly", "private") or (broke and enclosing))):
            raise Broken("foreign token", t.at, t.text)
        operand = t.kind in ("num", "str") or (t.kind == "id" and t.text not in known) or (t.kind == "id" and t.text in _JS_VALUES)
        if p is not None and not broke and operand:
            before = p.kind in ("num", "str", "part") or (p.kind == "id" and (p.text not in known or p.text in _JS_VALUES)) or p.text == "]"
            if p.text == ")" and partner[at_prev] not in header_end:
                before = before or t.kind != "id" or not ts
            if before and not (t.kind == "str" and t.text[0] == "`"):
                if not (ts and p.kind == "id" and p.text in known):
                    raise Broken("foreign token", t.at, f"{p.text[:20]} {t.text[:20]}")
        if t.kind == "id":
            following = _next(toks, i) if t.text in _JS_ASKS else -1
            nxt = toks[following] if following >= 0 else None
            if t.text in _JS_PARENS and not (p and p.text in (".", "?.")) and nxt is not None:
                ok = nxt.text == "(" or nxt.text in (":", ",", "=", "}", ";", ")", "?") or (t.text == "for" and nxt.text == "await") or (t.text == "catch" and nxt.text == "{")
                if not ok:
                    raise Broken("foreign token", t.at, t.text)
                if nxt.text == "(":
                    header_end.add(following)
            if not ts and t.text in ("enum", "interface") and nxt is not None and nxt.kind == "id":
                raise Broken("foreign token", t.at, t.text)
            if t.text == "import" and not enclosing and not (p and p.text in (".", "?.")) and (p is None or broke or p.text == ";") and nxt is not None:
                if nxt.kind == "id":
                    k = _next(toks, following)
                    after = toks[k] if k >= 0 else None
                    if not ts and nxt.text == "type" and after and after.text == "{":
                        raise Broken("foreign token", t.at, "import type")
                    if after is None or after.text not in ("from", ",", "=", "{", "*") and after.kind != "id":
                        raise Broken("foreign token" if after else "premature end", t.at, "import")
                elif nxt.kind != "str" and nxt.text not in ("{", "*", "(", "."):
                    raise Broken("foreign token", t.at, "import")
        if t.kind == "op":
            if t.text == "{":
                block = p is None or p.text in (")", "{", "}", ";", "=>", "else", "try", "finally", "do", "static") or (p.kind == "id" and not broke and p.text not in known)
                if p is not None and p.text in ("=>", "(", "[", ",", "=", ":", "?", "return", "default", "&&", "||", "??", "...", "in", "of", "await"):
                    block = p.text == "=>"
                if p is not None and p.text == ":" and enclosing and block_like.get(enclosing[-1]):
                    block = False
                block_like[i] = block
                if p is not None and p.kind == "id" and not broke and p.text not in known and not (headed or (ts and any(typed[-1:]))):
                    raise Broken("foreign token", t.at, p.text + " {")
                enclosing.append(i)
            elif t.text in ("(", "[", "${"):
                enclosing.append(i)
            elif t.text in (")", "]", "}", "}$"):
                enclosing.pop()
            elif t.text == ":" and not ts and p is not None and p.kind == "str" and enclosing and block_like.get(enclosing[-1]) and not in_case:
                raise Broken("foreign token", t.at, "key in block")
            elif t.text == ":" and not ts and p is not None and _annotates(toks, partner, i, enclosing, in_case):
                raise Broken("foreign token", t.at, "type annotation")
            elif t.text in ("<", ">", "*", "%", "=", "==", "===", "=>", ",", ".", "&&", "||", ")") and (p is None or (p.kind == "op" and p.text in (";", "{"))) and not (t.text == ")" or (p and p.text == "{" and t.text in ("*", "<"))):
                raise Broken("foreign token", t.at, t.text)
        if t.kind == "op":
            if t.text in (";", "{", "}", "="):
                headed = False
            if t.text in (";", "{", "}"):
                in_case = False
            in_case = in_case or t.text == "?"
            if t.text in ("(", "[", "{", "${"):
                typed.append(False)
            elif t.text in (")", "]", "}", "}$"):
                typed.pop()
                typed[-1] = typed[-1] and t.text != "}"
            elif t.text == ";":
                typed[-1] = False
            elif t.text in _JS_TYPED:
                typed[-1] = True
        elif t.kind == "id":
            headed = headed or t.text in _JS_HEADERS
            in_case = in_case or t.text in ("case", "default")
            typed[-1] = typed[-1] or t.text in _JS_TYPED
        prev, at_prev, broke = t, i, False
    if prev is not None and ((prev.kind == "op" and prev.text in _NEEDS_MORE) or (prev.kind == "id" and prev.text in ("const", "let", "var", "function", "class", "new", "import", "export", "from", "extends", "typeof", "async") and (len(toks) > 1))):
        raise Broken("premature end", prev.at, prev.text)
    _js_tail(toks)


def _js_tail(toks: list[Token]) -> None:
    """A declaration that the end of the text cuts off between its words."""
    last = [t for t in toks if t.kind != "nl"][-3:]
    words = [t.text for t in last]
    if len(words) >= 2 and words[-2] in ("function", "class", "const", "import", "interface", "enum") and last[-1].kind == "id":
        raise Broken("premature end", last[-1].at, words[-1])
    if len(words) >= 3 and words[-3] in ("function",) and words[-1] == ")":
        raise Broken("premature end", last[-1].at, words[-1])
    if len(words) >= 2 and words[-1] == ")" and _is_function_header(toks):
        raise Broken("premature end", last[-1].at, "function header")


def _is_function_header(toks: list[Token]) -> bool:
    real = [t for t in toks if t.kind != "nl"]
    depth = 0
    for i in range(len(real) - 1, -1, -1):
        x = real[i].text
        depth += (x in ")]}") - (x in "([{" and real[i].kind == "op") if real[i].kind == "op" else 0
        if depth == 0:
            return i > 1 and real[i - 1].kind == "id" and (real[i - 2].text == "function" or (i > 0 and real[i - 1].text in ("if", "while", "for", "switch")))
    return False


def _next(toks: list[Token], i: int) -> int:
    """Index of the next token that is no newline, or -1."""
    for j in range(i + 1, len(toks)):
        if toks[j].kind != "nl":
            return j
    return -1


def _annotates(toks: list[Token], partner: list[int], i: int, enclosing: list[int], in_case: bool) -> bool:
    """Whether the colon at i annotates a parameter or a result with a type, which plain scripts lack."""
    p = toks[i - 1]
    if p.text == ")" and partner[i - 1] > 0:
        o = partner[i - 1]
        named = toks[o - 1].kind == "id" and o > 1 and toks[o - 2].text in ("function", "async", "*")
        return named and not in_case
    if enclosing and toks[enclosing[-1]].text == "(" and p.kind == "id":
        o = enclosing[-1]
        return o > 1 and toks[o - 1].kind == "id" and toks[o - 2].text == "function" and toks[i - 2].text in ("(", ",")
    return False


_JAVA_TOP = _set("package import public final abstract class interface enum record sealed non strictfp static @interface module open protected private ;")


def check_java(text: str, lang: str) -> None:
    toks = [t for t in tokens(text, lang) if t.kind != "nl"]
    partner = balanced(toks)
    if any(t.kind == "op" and t.text in ("`", "#", "\\", "$") for t in toks):
        raise Broken("foreign token", 0, "character")
    i, n = 0, len(toks)
    while i < n:  # top level: packages, imports and types only
        t = toks[i]
        if t.text == ";":
            i += 1
            continue
        if t.kind != "id" or (t.text not in _JAVA_TOP and t.text[0] != "@"):
            raise Broken("foreign token", t.at, t.text[:30])
        if t.text in ("package", "import"):
            j = i + 1
            while j < n and (toks[j].kind == "id" or toks[j].text in (".", "*")):
                if toks[j].kind == "id" and toks[j - 1].kind == "id" and toks[j - 1].text not in ("import", "package", "static"):
                    raise Broken("foreign token", toks[j].at, toks[j].text)
                j += 1
            if j >= n or toks[j].text != ";":
                raise Broken("premature end" if j >= n else "foreign token", t.at, t.text)
            i = j + 1
            continue
        j = i
        seen = False
        while j < n and toks[j].text not in ("{", ";"):
            seen = seen or toks[j].text in ("class", "interface", "enum", "record", "@interface")
            j = partner[j] + 1 if toks[j].text in ("(", "[") else j + 1
        if j >= n:
            raise Broken("premature end", t.at, t.text)
        if not seen or toks[j].text == ";":
            raise Broken("foreign token", t.at, t.text)
        i = partner[j] + 1
    _operands(toks, partner, _JAVA_WORDS, lang)


_JAVA_WORDS = _set(
    """abstract assert boolean break byte case catch char class continue default do double else enum extends final finally float for if implements import
    instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws
    transient try void volatile while var record sealed permits non yield when"""
)
_C_WORDS = _set(
    """auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof
    static struct switch typedef union unsigned void volatile while _Bool bool __attribute__ __inline size_t"""
)
_GO_WORDS = _set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")


def _operands(toks: list[Token], partner: list[int], words: frozenset[str], lang: str) -> None:
    """No operand may follow another: three names in a row, or a literal beside a name or literal."""
    for a, b, c in zip(toks, toks[1:], [*toks[2:], Token("op", "", 0)], strict=False):
        plain_a, plain_b = a.kind == "id" and a.text not in words and a.text[0] != "@", b.kind == "id" and b.text not in words and b.text[0] != "@"
        if plain_a and plain_b and c.kind == "id" and c.text not in words and c.text[0] != "@":
            raise Broken("foreign token", b.at, f"{a.text} {b.text} {c.text}"[:60])
        if b.kind in ("num", "str") and (a.kind in ("num",) or plain_a or a.text in ("]",)):
            raise Broken("foreign token", b.at, f"{a.text} {b.text}"[:40])
        if a.kind in ("num", "str") and (plain_b or b.kind == "num" or (b.kind == "str" and a.kind == "str" and lang == "java")):
            raise Broken("foreign token", b.at, f"{a.text} {b.text}"[:40])
        if a.text == ")" and b.text == ":" and lang == "java" and c.text in ("if", "for", "return", "while", "raise", "with"):
            raise Broken("foreign token", b.at, "block by colon")
        if a.text == "=" and b.text == ">" and b.at == a.at + 1:
            raise Broken("foreign token", a.at, "=>")
        if plain_b and c.text == "}" and a.text in (";", "{", "}") and lang == "java":
            raise Broken("foreign token", b.at, b.text)


_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(?:(?:include|define|undef|if|ifdef|ifndef|elif|else|endif|error|warning|pragma|line)\b(?:[^\n\\]|\\.|\\\r?\n)*)?(?=\n|$)")


def check_c(text: str, lang: str) -> None:
    # a preprocessor line may hold anything; what starts with # and is none does not occur in C
    out, at, depth = [], 0, 0
    lines = re.split(r"(?<!\\)(?<!\\\r)\n", _without_comments(text))
    for line in lines:
        if line.lstrip().startswith("#"):
            m = _DIRECTIVE.match(line)
            if not m or m.end() < len(line.rstrip("\r")):
                raise Broken("foreign token", at, line.strip()[:30])
            word = line.lstrip(" \t#").split(" ")[0].split("(")[0].strip()
            depth += (word in ("if", "ifdef", "ifndef")) - (word == "endif")
            if depth < 0:
                raise Broken("unbalanced delimiter", at, "#endif")
            out.append("")
        else:
            out.append(line)
        at += len(line) + 1
    if depth:
        raise Broken("premature end", len(text), "#if")
    toks = [t for t in tokens("\n".join(out), lang) if t.kind != "nl"]
    partner = balanced(toks)
    if any(t.kind == "op" and t.text in ("`", "#", "@", "\\", "$") for t in toks):
        raise Broken("foreign token", 0, "character")
    i, n = 0, len(toks)
    while i < n:  # top level: declarations and definitions
        start = i
        equals = called = False
        while i < n and toks[i].text != ";":
            t = toks[i]
            if t.kind == "op" and t.text in OPEN:
                i = partner[i]
                if t.text == "{" and not equals and (called or toks[start].text in ("extern",)) and toks[start].text != "typedef":
                    break
                called = called or t.text == "("
                i += 1
                continue
            if not equals and (t.kind in ("num", "str") and toks[start].text not in ("extern", "asm", "_Static_assert") or (t.kind == "op" and t.text not in ("*", "=", ",", ":"))):
                raise Broken("foreign token", t.at, t.text[:20])
            equals = equals or t.text == "="
            i += 1
        if i >= n:
            raise Broken("premature end", toks[start].at, toks[start].text)
        if toks[start].kind != "id" and toks[start].text != ";":
            raise Broken("foreign token", toks[start].at, toks[start].text)
        if toks[start].text in ("import", "package", "class", "def", "function", "let", "from", "func", "public", "private", "export", "require", "namespace", "using", "interface"):
            raise Broken("foreign token", toks[start].at, toks[start].text)
        i += 1
    _operands(toks, partner, _C_WORDS, lang)


def _without_comments(text: str) -> str:
    """Comments become as many spaces and line ends, so offsets stay."""
    blank = lambda m: m.group() if m.group()[0] in "\"'" else re.sub(r"[^\n]", " ", m.group())
    # an open comment is closed, so that the search for its end runs once
    closed = text + "*/" if text.rfind("/*") > text.rfind("*/") - 1 else text
    return re.sub(rf"{_STRING}|{_CHAR}|{_C_COMMENT}", blank, closed)[: len(text)]


def check_go(text: str, lang: str) -> None:
    toks = tokens(text, lang)
    partner = balanced(toks)
    real = [i for i, t in enumerate(toks) if t.kind != "nl"]
    if not real:
        raise Broken("premature end", len(text), "package")
    if toks[real[0]].text != "package" or len(real) < 2 or toks[real[1]].kind != "id" or (real[1] + 1 < len(toks) and toks[real[1] + 1].kind != "nl" and toks[real[1] + 1].text != ";"):
        raise Broken("foreign token" if len(real) > 1 else "premature end", toks[real[0]].at, "package")
    if any(t.kind == "op" and t.text in ("#", "@", "\\", "$", "?") for t in toks):
        raise Broken("foreign token", 0, "character")
    depth, fresh = 0, False
    for i, t in enumerate(toks[real[1] + 1 :], real[1] + 1):
        if t.kind == "nl" or t.text == ";":
            fresh = depth == 0
            continue
        if fresh and depth == 0:
            if t.text not in ("import", "const", "var", "type", "func"):
                raise Broken("foreign token", t.at, t.text[:30])
            nxt = toks[i + 1] if i + 1 < len(toks) else None
            if nxt is None:
                raise Broken("premature end", t.at, t.text)
            if t.text == "import" and nxt.kind != "str" and nxt.text not in ("(", ".", "_") and not (nxt.kind == "id" and i + 2 < len(toks) and toks[i + 2].kind == "str"):
                raise Broken("foreign token", t.at, "import")
        fresh = False
        if t.kind == "op":
            depth += (t.text in OPEN) - (t.text in CLOSE)
    last = toks[real[-1]]
    if last.kind == "op" and last.text not in ("}", ")", "]", ";", "++", "--"):
        raise Broken("premature end", last.at, last.text)
    tail = [toks[i] for i in real[-8:]]
    if tail[-1].text != "}" or len(real) < 8:
        _go_tail(toks, real, partner)
    same_line = [t for t in toks]
    for a, b in zip(same_line, same_line[1:], strict=False):
        if a.kind in ("num", "str") and b.kind in ("id", "num") and b.text not in _GO_WORDS:
            raise Broken("foreign token", b.at, f"{a.text} {b.text}"[:40])


def _go_tail(toks: list[Token], real: list[int], partner: list[int]) -> None:
    """A last declaration without a body: func header, type name, import or var without its rest."""
    start = None
    depth = 0
    fresh = True
    for i in real:
        t = toks[i]
        if depth == 0 and t.text in ("import", "const", "var", "type", "func"):
            start = i
        if t.kind == "op":
            depth += (t.text in OPEN) - (t.text in CLOSE)
    if start is None:
        return
    part = [toks[i] for i in real if i >= start]
    if part[0].text == "func" and not any(t.text == "{" for t in part):
        raise Broken("premature end", part[0].at, "func")
    if part[0].text in ("type", "var", "const", "import") and len(part) < (2 if part[0].text == "import" else 3):
        raise Broken("premature end", part[0].at, part[0].text)
    _ = fresh


def check_php(text: str, lang: str) -> None:
    m = re.match(r"(?:#![^\n]*\n)?\s*<\?(?:php\b|=)", text)
    first = m or re.search(r"<\?(?:php\b|=)", text)
    if not first:
        return  # text outside the tags is output, whatever it says
    toks = [t for t in tokens(text[first.end() :], lang) if t.kind != "nl"]
    partner = balanced(toks)
    if any(t.kind == "op" and t.text == "`" for t in toks) and sum(t.text == "`" for t in toks) % 2:
        raise Broken("unterminated literal", 0, "`")
    for a, b, c in zip(toks, toks[1:], [*toks[2:], Token("op", "", 0)], strict=False):
        if a.kind in ("num", "str") and (b.kind in ("num", "str") or (b.kind == "id" and b.text not in ("as", "and", "or", "xor", "instanceof", "insteadof"))):
            raise Broken("foreign token", b.at, f"{a.text} {b.text}"[:40])
        if a.kind == "id" and a.text[0] == "$" and (b.kind in ("num", "str") or (b.kind == "id" and b.text not in ("as", "and", "or", "xor", "instanceof", "insteadof", "extends", "implements"))):
            raise Broken("foreign token", b.at, f"{a.text} {b.text}"[:40])
        if a.kind == "id" and b.kind == "id" and c.kind == "id" and not {a.text, b.text, c.text} & _PHP_WORDS and b.text[0] != "$" and a.text[0] != "$":
            raise Broken("foreign token", b.at, f"{a.text} {b.text} {c.text}"[:60])
    i, n = 0, len(toks)
    while i < n:  # statements end with ; or a block
        j = i
        while j < n and toks[j].text not in (";", "{", "}"):
            j = partner[j] + 1 if toks[j].text in ("(", "[") else j + 1
        if j >= n:
            raise Broken("premature end", toks[i].at, toks[i].text)
        i = j + 1


_PHP_WORDS = _set(
    """abstract and array as break callable case catch class clone const continue declare default do echo else elseif enddeclare endfor endforeach endif
    endswitch endwhile enum extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface match
    namespace new or print private protected public readonly require require_once return static switch throw trait try unset use var while xor yield"""
)


def check_hcl(text: str, lang: str) -> None:
    toks = tokens(text, lang)
    partner = balanced(toks)
    if any(t.kind == "op" and t.text in ("'", "`", "#", "@", "\\", "$", ";") for t in toks):
        raise Broken("foreign token", 0, "character")
    i, n = 0, len(toks)
    body: list[int] = []
    while i < n:  # a body line is: name = expression, or name labels {
        t = toks[i]
        if t.kind == "nl":
            i += 1
            continue
        if t.text == "}" and body:
            body.pop()
            i += 1
            if i < n and toks[i].kind != "nl" and toks[i].text != "}":
                raise Broken("foreign token", toks[i].at, toks[i].text[:20])
            continue
        if t.kind != "id":
            raise Broken("foreign token", t.at, t.text[:20])
        j = i + 1
        if j < n and toks[j].text == "=":
            start = j
            j += 1
            while j < n and toks[j].kind != "nl" and not (toks[j].text == "}" and body and partner[j] == body[-1]):
                j = partner[j] + 1 if toks[j].text in ("(", "[", "{", "${") else j + 1
            if j == start + 1:
                raise Broken("premature end" if j >= n else "foreign token", t.at, t.text)
            expr = [x for x in toks[start + 1 : j] if x.kind != "nl"]
            for a, b in zip(expr, expr[1:], strict=False):
                if a.kind in ("id", "num", "str") and b.kind in ("id", "num", "str") and not ({a.text, b.text} & {"for", "in", "if"}) and _same_line(text, a, b):
                    raise Broken("foreign token", b.at, f"{a.text} {b.text}"[:40])
            if expr[-1].kind == "op" and expr[-1].text in _NEEDS_MORE:
                raise Broken("premature end", expr[-1].at, expr[-1].text)
            i = j
            continue
        while j < n and toks[j].kind in ("id", "str"):
            j += 1
        if j >= n or toks[j].text != "{":
            raise Broken("premature end" if j >= n else "foreign token", t.at, t.text)
        body.append(j)
        i = j + 1


def _same_line(text: str, a: Token, b: Token) -> bool:
    return "\n" not in text[a.at + len(a.text) : b.at]


# ---------------------------------------------------------------- languages without braces


_PY = re.compile(
    r"""(?:[ \t\r\f]|\\\r?\n)*+(?:(\n)|(\#[^\n]*)
    |([rRbBuUfFtT]{0,2}(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|"(?!"")(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"|'(?!'')(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'))
    |([^\W\d]\w*)|(\.?\d(?:[eE][+-]|[\w.])*)|(:=|->|\*\*=?|//=?|<<=?|>>=?|[-+*/%&|^<>=!@]=|\.\.\.|[\s\S]))""",
    re.X,
)
_PY_NL, _PY_COMMENT, _PY_STR, _PY_ID, _PY_NUMBER, _PY_OP = range(1, 7)
_PY_NUM = re.compile(r"0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?:[eE][+-]?\d+)?[jJ]?|\d+\.(?:[eE][+-]?\d+)?[jJ]?")
_PY_WORDS = _set("and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield")
_PY_SOFT = _set("match case type")
_PY_OPENERS = _set("class def elif else except finally for if try while with async")
_PY_HEADS = _set("( [ { - + ~ @ * ...")
_PY_BINARY = _set("/ // % | & ^ << >> < > == != <= >= = += -= *= /= //= %= &= |= ^= <<= >>= **= @= ->")
_PY_WANTS = _set("= + - * / % & | ^ < > == != <= >= << >> ** // ( [ { , += -= *= /=")
_PY_DANGLING = _set("= + - * / . % @ -> and or import from in not is lambda def class")


def check_python(text: str, lang: str) -> None:
    """Brackets on one stack, indentation on another; of each logical line what may stand side by side, and its ends."""
    stack: list[tuple[str, int]] = []
    indents, opened = [0], False
    first = prev = ""  # texts of the line's first and last token; empty where it has none
    first_at = prev_at = prev_kind = 0
    colon = False
    for m in _PY.finditer(text):
        kind = m.lastindex
        if kind == _PY_COMMENT:
            continue
        if kind == _PY_NL:
            if first and not stack:
                opened = _python_line(text, indents, opened, first, first_at, prev, prev_kind, prev_at, colon)
                first = prev = ""
                prev_kind, colon = 0, False
            continue
        part, at = m.group(kind), m.start(kind)
        operand = False
        if kind == _PY_OP:
            if part in "\"'":
                raise Broken("unterminated literal", at)
            if part in "$?`\\!" or part == "\0":
                raise Broken("foreign token", at, part)
            if part in OPEN:
                stack.append((part, at))
            elif part in CLOSE:
                if not stack:
                    raise Broken("unbalanced delimiter", at, part)
                if stack.pop()[0] != CLOSE[part]:
                    raise Broken("unbalanced delimiter", at, part)
            elif part == ":":
                colon = True
            if not first and part not in _PY_HEADS:
                raise Broken("foreign token", at, part)
            if part in _PY_BINARY and prev_kind == _PY_OP and prev in _PY_WANTS and not (part == "/" and prev in "(,"):
                raise Broken("foreign token", at, f"{prev} {part}")
        elif kind == _PY_NUMBER:
            if not _PY_NUM.fullmatch(part):
                raise Broken("foreign token", at, part)
            operand = True
        elif kind == _PY_STR:
            operand = prev_kind != _PY_STR
        else:
            operand = part not in _PY_WORDS
        if operand and prev_kind and (prev in ")]}" if prev_kind == _PY_OP else prev_kind != _PY_ID or not (prev in _PY_WORDS or (prev in _PY_SOFT and prev_at == first_at))):
            raise Broken("foreign token", at, f"{prev[:20]} {part[:20]}")
        if not first:
            first, first_at = part, at
        prev, prev_kind, prev_at = part, kind, at
    if stack:
        raise Broken("premature end", stack[-1][1], stack[-1][0])
    if first:
        opened = _python_line(text, indents, opened, first, first_at, prev, prev_kind, prev_at, colon)
    if opened:
        raise Broken("premature end", len(text), "block without body")


def _python_line(text: str, indents: list[int], opened: bool, first: str, first_at: int, last: str, last_kind: int, last_at: int, colon: bool) -> bool:
    """Fits one logical line into the open blocks; whether it opens a block itself."""
    width = len(text[text.rfind("\n", 0, first_at) + 1 : first_at].expandtabs(8))
    if opened:
        if width <= indents[-1]:
            raise Broken("premature end", first_at, "block without body")
        indents.append(width)
    elif width > indents[-1]:
        raise Broken("unbalanced delimiter", first_at, "unexpected indent")
    else:
        while width < indents[-1]:
            indents.pop()
        if width != indents[-1]:
            raise Broken("unbalanced delimiter", first_at, "indent matches no block")
    if first in _PY_OPENERS and not colon:
        raise Broken("premature end", last_at, first)
    if last_kind in (_PY_OP, _PY_ID) and last in _PY_DANGLING:
        raise Broken("premature end", last_at, last)
    return last == ":" and (first in _PY_OPENERS or first in _PY_SOFT)


def refuted_python(text: str) -> bool:
    """Whether the platform's parser takes a text; what ends at one of its limits is not refuted."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


_JSON = re.compile(r'[ \t\r\n]*+(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|((?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)(?![\w.]))|([\[\]{},:]))')


def check_json(text: str, lang: str) -> None:
    """The grammar of JSON as a pushdown automaton: what may come next is the state, open lists and objects the stack."""
    at, stack, want = 0, [], "value"
    while True:
        m = _JSON.match(text, at)
        if not m:
            rest = text[at:].lstrip(" \t\r\n")
            at = len(text) - len(rest)
            if rest:
                raise Broken("unterminated literal" if rest[0] == '"' else "foreign token", at, rest[:20])
            break
        kind, at = m.lastindex, m.end()
        c = m.group(kind)
        if kind == 1 and want in ("key", "key or }"):
            want = ":"
        elif kind != 3 and want in ("value", "value or ]"):
            want = ", or close" if stack else "end"
        elif c in OPEN and want in ("value", "value or ]") and c != "(":
            stack.append(c)
            want = "value or ]" if c == "[" else "key or }"
        elif c in CLOSE and stack and stack[-1] == CLOSE[c] and want in (", or close", "value or ]", "key or }"):
            stack.pop()
            want = ", or close" if stack else "end"
        elif c == ":" and want == ":":
            want = "value"
        elif c == "," and want == ", or close":
            want = "value" if stack[-1] == "[" else "key"
        else:
            raise Broken("unbalanced delimiter" if c in CLOSE else "foreign token", m.start(kind), f"{c[:20]} for {want}")
    if want != "end":
        raise Broken("premature end", at, want)


_YAML_KEY = re.compile(r"""(?:[^\s#&*!|>'"%@`\[\]{},-][^#\n]*?|-[^\s][^\n#]*?|"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|\?)[ \t]*:(?=\s|$)""")


def check_yaml(text: str, lang: str) -> None:
    """Block mappings and sequences by indentation; quoted and flow values by a stack; block scalars by indentation."""
    stack: list[tuple[int, str]] = []  # (indent, map | seq)
    scalar = -1  # lines deeper than this belong to a block scalar
    plain = -1  # lines deeper than this go on with a plain scalar
    flow = ""
    at = 0
    for raw in text.split("\n"):
        line, start = raw.rstrip("\r"), at
        at += len(raw) + 1
        if flow:
            flow = _yaml_flow(flow + "\n" + line, start)
            continue
        if not line.strip() or line.lstrip().startswith("#") and scalar < 0:
            continue
        indent = len(line) - len(line.lstrip(" "))
        if scalar >= 0:
            if indent > scalar:
                continue
            scalar = -1
        if re.match(r"(?:---|\.\.\.)(?:\s|$)|%\w", line):
            stack, plain = [], -1
            continue
        if line[indent] == "\t":
            raise Broken("foreign token", start, "tab")
        rest, col = line[indent:], indent
        if plain >= 0 and indent > plain and not _YAML_KEY.match(rest) and not rest.startswith("- "):
            continue
        if plain >= 0 and indent > plain:
            raise Broken("foreign token", start, "mapping below a value")
        plain = -1
        while stack and stack[-1][0] > col:
            stack.pop()
        top = True
        while rest.startswith("- ") or rest == "-":
            if stack and stack[-1] == (col, "map") and top and len(stack) > 1 and stack[-2][0] == col:
                stack.pop()
            _yaml_enter(stack, col, "seq", start, top)
            step = len(rest) - len(rest[1:].lstrip(" ")) if rest != "-" else 1
            rest, col, top = rest[step:], col + step, False
        if not rest or rest.startswith("#"):
            continue
        m = _YAML_KEY.match(rest)
        if m:
            _yaml_enter(stack, col, "map", start, top)
            value = rest[m.end() :].strip()
        else:
            if top and stack and not (rest[0] in "\"'[{&*!" and not stack):
                raise Broken("premature end" if at > len(text) else "foreign token", start, rest[:30])
            value = rest.strip()
        value = re.sub(r"^(?:[&!][^\s]*\s*)+", "", value)
        if not value or value.startswith("#"):
            continue
        if re.match(r"[|>][-+\d]*\s*(?:#.*)?$", value):
            scalar = indent
        elif value[0] in "\"'[{":
            flow = _yaml_flow(value, start)
        elif value[0] in "%@`":
            raise Broken("foreign token", start, value[:20])
        elif re.search(r":(?:\s|$)", re.sub(r"\s#.*", "", value)) and m:
            raise Broken("foreign token", start, value[:30])
        else:
            plain = col if m else indent
            if not m and not stack:
                plain = -1 if indent == 0 else indent - 1
                stack.append((0, "scalar"))
    if flow:
        raise Broken("unterminated literal", len(text), flow[:20])


def _yaml_enter(stack: list, col: int, kind: str, at: int, top: bool) -> None:
    if stack and stack[-1][1] == "scalar":
        raise Broken("foreign token", at, "mapping after a value")
    if not stack or stack[-1][0] < col:
        stack.append((col, kind))
    elif stack[-1][0] == col and stack[-1][1] != kind:
        if kind == "seq":
            stack.append((col, kind))
        else:
            stack.pop()
            if not stack or stack[-1] != (col, "map"):
                raise Broken("foreign token", at, "mixed list and mapping")
    if len(stack) == 1 and stack[0][0] > col:
        raise Broken("unbalanced delimiter", at, "indent")


def _yaml_flow(value: str, at: int) -> str:
    """The rest of a quoted or flow value that is still open, or empty where it is closed."""
    if value[0] == '"':
        m = re.match(r'"(?:[^"\\]|\\[\s\S])*"', value)
    elif value[0] == "'":
        m = re.match(r"'(?:[^']|'')*'", value)
    else:
        depth = []
        for t in re.finditer(r'"(?:[^"\\]|\\[\s\S])*"|\'(?:[^\']|\'\')*\'|[\[\]{}]', value):
            c = t.group()
            if c in OPEN:
                depth.append(c)
            elif c in CLOSE:
                if not depth or depth.pop() != CLOSE[c]:
                    raise Broken("unbalanced delimiter", at, c)
                if not depth:
                    m = t
                    break
        else:
            return value
        rest = value[m.end() :].strip()
        if rest and not rest.startswith("#"):
            raise Broken("foreign token", at, rest[:20])
        return ""
    if not m:
        return value
    rest = value[m.end() :].strip()
    if rest and not rest.startswith(("#", ":")):
        raise Broken("foreign token", at, rest[:20])
    return ""


_RB = re.compile(
    r"""(?P<ws>[ \t\r\f]+|\\\r?\n)|(?P<com>\#[^\n]*|^=begin[\s\S]*?^=end[^\n]*|^__END__[\s\S]*)|(?P<nl>\n|;)
    |(?P<str>"(?:[^"\\]|\\[\s\S])*"|'(?:[^'\\]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`|%[wWiIqQ]?(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\})|:"[^"]*")
    |(?P<sym>:[A-Za-z_]\w*[?!=]?(?!:))|(?P<id>[@$]{0,2}[^\W\d]\w*[?!]?(?::(?!:))?)|(?P<num>\d[\w.]*)|(?P<op>=>|->|&&|\|\||::|&\.|\*\*|[-+*/%&|^<>=!~]=+|<<|\.\.\.?|[\s\S])""",
    re.X | re.M,
)
_RB_OPEN = _set("def class module begin case")
_RB_MOD = _set("if unless while until")
_RB_REGEX = re.compile(r"/(?:[^/\\\n]|\\.)+/[imxounse]*")
_RB_FOREIGN = re.compile(
    r"""^[ \t]*(?:(?:public|private|protected|static|export|final|abstract)\ +(?:static|final|class|void|interface|enum|async|function|const|[A-Z]\w*<|synchronized)\b|package\ [\w.]+;?\s*$|import\ .+
    |func\ |function\ \w|(?:const|let|var)\ \w+\ *=|\#include\b|<\?php|<!DOCTYPE|<\w+>|from\ \S+\ import|@\w+$|\}\ *else\b|(?:async\ )?def\ .*:\s*$|(?:if|for|while|class|try|except|with|else|elif)\b.*:\s*$|//|use\ strict)""",
    re.M | re.X,
)


def check_ruby(text: str, lang: str) -> None:
    plain = re.sub(r"^=begin[\s\S]*?^=end[^\n]*", lambda m: "\n" * m.group().count("\n"), text, flags=re.M)
    toks: list[Token] = []
    at, n = 0, len(plain)
    pending: list[tuple[str, bool]] = []
    foreign_ok: list[tuple[int, int]] = []
    while at < n:
        m = _RB.match(plain, at)
        kind, part = m.lastgroup, m.group()
        if kind == "op" and part == "<<":
            h = re.compile(r"<<([-~]?)(['\"]?)([A-Z_]\w*)\2").match(plain, at)
            if h and not (toks and toks[-1].kind in ("num",)) and (h.group(1) or not (toks and toks[-1].kind == "id" and plain[at - 1] == " " and plain[at + 2] == " ")):
                pending.append((h.group(3), bool(h.group(1))))
                toks.append(Token("str", h.group(), at))
                at = h.end()
                continue
        if kind == "op" and part == "/" or (kind == "op" and part == "/="):
            p = toks[-1] if toks else None
            if p is None or p.kind in ("nl", "op") and p.text not in (")", "]", "}") or (p.kind == "id" and (p.text in ("if", "unless", "when", "and", "or", "not", "return", "then", "elsif") or (plain[at - 1] == " " and plain[at + 1 : at + 2] not in (" ", "=")))):
                r = _RB_REGEX.match(plain, at)
                if r:
                    toks.append(Token("str", r.group(), at))
                    at = r.end()
                    continue
        if kind == "op" and part == "?" and re.match(r"\?\w(?!\w)", plain[at : at + 3]) and toks and toks[-1].kind == "op" and toks[-1].text not in (")", "]"):
            toks.append(Token("str", plain[at : at + 2], at))
            at += 2
            continue
        if kind == "op" and part in ('"', "'", "`"):
            raise Broken("unterminated literal", at, part)
        if kind == "str":
            foreign_ok.append((at, m.end()))
        if kind not in ("ws", "com"):
            toks.append(Token(kind, part, at))
        at = m.end()
        if kind == "nl" and part == "\n" and pending:
            for name, loose in pending:
                end = re.compile(rf"^{'[ \t]*' if loose else ''}{name}\r?$", re.M).search(plain, at)
                if not end:
                    raise Broken("unterminated literal", at, "heredoc")
                foreign_ok.append((at, end.end()))
                at = end.end()
            pending = []
    balanced([t for t in toks if t.kind != "nl"])
    stack: list[Token] = []
    loops = 0
    fresh = True  # at the start of a statement
    prev: Token | None = None
    for i, t in enumerate(toks):
        if t.kind == "nl":
            fresh, loops, prev = True, 0, t
            continue
        method = prev is not None and prev.text in (".", "&.", "def", "::")
        if t.kind == "id" and not method:
            w = t.text
            nxt = toks[i + 1] if i + 1 < len(toks) else None
            if w in _RB_OPEN and not (w == "class" and nxt and nxt.text == "<<" and False):
                if w == "def" and _endless(toks, i):
                    pass
                elif w in ("def", "class", "module") and (nxt is None or nxt.kind == "nl"):
                    raise Broken("premature end", t.at, w)
                else:
                    if w == "class" and nxt is not None and nxt.kind == "id":
                        after = toks[i + 2] if i + 2 < len(toks) else None
                        if not nxt.text[0].isupper() or (after is not None and after.kind != "nl" and after.text not in ("<", "::")):
                            raise Broken("foreign token", t.at, f"class {nxt.text}")
                    stack.append(t)
            elif w in _RB_MOD and (fresh or (prev and (prev.text in ("=", "(", "+=", "||=", "[", ",", "=>", "&&", "||", "then", "else", "do", "return", "{", "|") and prev.kind == "op" or prev.text in ("then", "else", "do")))):
                stack.append(t)
                loops += w in ("while", "until")
            elif w == "for" and fresh:
                stack.append(t)
                loops += 1
            elif w == "do":
                if loops:
                    loops -= 1
                else:
                    stack.append(t)
            elif w == "end":
                if not stack:
                    raise Broken("unbalanced delimiter", t.at, "end")
                stack.pop()
            elif w in ("elsif", "when", "rescue", "ensure") and fresh and not stack:
                raise Broken("unbalanced delimiter", t.at, w)
        fresh = t.kind == "id" and t.text in ("then", "else", "do", "begin", "ensure") or (t.kind == "op" and t.text in ("{", "("))
        prev = t
    if stack:
        raise Broken("premature end", stack[-1].at, stack[-1].text)
    last = next((t for t in reversed(toks) if t.kind != "nl"), None)
    if last is not None and (last.kind == "op" and last.text in _NEEDS_MORE):
        raise Broken("premature end", last.at, last.text)
    for m in _RB_FOREIGN.finditer(plain):
        if not any(a <= m.start() < b for a, b in foreign_ok):
            raise Broken("foreign token", m.start(), m.group().strip()[:40])


def _endless(toks: list[Token], i: int) -> bool:
    depth = 0
    for j in range(i + 1, len(toks)):
        t = toks[j]
        if t.kind == "nl":
            return False
        if t.kind == "op":
            depth += (t.text in OPEN) - (t.text in CLOSE)
            if depth == 0 and t.text == "=" and t.at > toks[i + 1].at + len(toks[i + 1].text):
                return True
    return False


_SH_WORD = re.compile(r"[^\s;&|()<>'\"`$\\#]+")


def check_shell(text: str, lang: str) -> None:
    """Quotes, expansions and here-documents by scanning; if, case, loops and groups on the stack."""
    stack: list[str] = []
    at, n = 0, len(text)
    command = True  # a word here is a command or reserved word
    words_in_case: list[int] = []  # 0: before in; 1: pattern; 2: commands
    pending: list[tuple[str, bool]] = []
    after = ""
    word_at = -1
    while at < n:
        c = text[at]
        if c == "\n":
            if after in ("<", ">"):
                raise Broken("foreign token", at, after)
            at += 1
            command, after = True, ""
            for name, dash in pending:
                end = re.compile(rf"^{'\t*' if dash else ''}{re.escape(name)}\r?$", re.M).search(text, at)
                if not end:
                    raise Broken("unterminated literal", at, "heredoc")
                at = end.end()
            pending = []
            continue
        if c in " \t\r":
            at += 1
            continue
        if c == "\\":
            at += 2
            command = command and text[at - 1 : at] == "\n"
            continue
        if c == "#" and (at == 0 or text[at - 1] in " \t\n;|&()"):
            at = text.find("\n", at) if "\n" in text[at:] else n
            continue
        in_pattern = bool(words_in_case) and words_in_case[-1] == 1 and stack and stack[-1] == "case"
        if c == "'":
            e = text.find("'", at + 1)
            if e < 0:
                raise Broken("unterminated literal", at, "'")
            at, command, after = e + 1, False, "w"
            continue
        if c == '"':
            at = _sh_double(text, at + 1)
            command, after = False, "w"
            continue
        if c == "`":
            e = text.find("`", at + 1)
            if e < 0:
                raise Broken("unterminated literal", at, "`")
            at, command, after = e + 1, False, "w"
            continue
        if c == "$":
            at = _sh_dollar(text, at)
            command, after = False, "w"
            continue
        if c in ";&|":
            if text.startswith(";;", at):
                if not (stack and stack[-1] == "case"):
                    raise Broken("unbalanced delimiter", at, ";;")
                words_in_case[-1] = 1
                at += 2
            else:
                if after == "" and c in ";|" and command and not in_pattern:
                    raise Broken("foreign token", at, c)
                at += 2 if text[at : at + 2] in ("&&", "||", "|&", "&>") else 1
            command, after = True, "" if not in_pattern else after
            continue
        if c == "(":
            if in_pattern:
                at += 1
                continue
            if text.startswith("((", at) and command:
                e = text.find("))", at)
                if e < 0:
                    raise Broken("premature end", at, "((")
                at, command, after = e + 2, False, "w"
                continue
            if re.match(r"\(\s*\)", text[at : at + 8]) and after == "w":
                at = text.index(")", at) + 1
                command, after = True, ""
                continue
            if command or (at and text[at - 1] == "=") or after == "=":
                stack.append("(")
                at += 1
                command, after = True, ""
                continue
            raise Broken("foreign token", at, "(")
        if c == ")":
            if in_pattern:
                words_in_case[-1] = 2
                at += 1
                command, after = True, ""
                continue
            if not stack or stack[-1] != "(":
                raise Broken("unbalanced delimiter", at, ")")
            stack.pop()
            at += 1
            command, after = False, "w"
            continue
        if c in "<>":
            h = re.compile(r"<<(-?)[ \t]*(['\"]?)([\w.]+)\2").match(text, at)
            if h and not text.startswith("<<<", at):
                pending.append((h.group(3), bool(h.group(1))))
                at = h.end()
                after = "w"
                continue
            m = re.compile(r"<<<|<>|>>|>\||<&|>&|&>|[<>]").match(text, at)
            if text[m.end() : m.end() + 1] == "(":
                stack.append("(")
                at = m.end() + 1
                command, after = True, ""
                continue
            if after in ("<", ">"):
                raise Broken("foreign token", at, c)
            at = m.end()
            after = c
            continue
        m = _SH_WORD.match(text, at)
        if not m:
            at += 1
            continue
        w = m.group()
        word_at = at
        at = m.end()
        whole = (word_at == 0 or text[word_at - 1] in " \t\n;&|()`") and (at >= n or text[at] in " \t\r\n;&|()<>")
        if in_pattern:
            if w == "esac" and whole:
                stack.pop()
                words_in_case.pop()
                command, after = False, "w"
            continue
        if command and whole:
            if w in ("if", "while", "until", "for", "select"):
                stack.append("if" if w == "if" else "loop?")
                command = w not in ("for", "select")
                after = "" if command else "w"
                continue
            if w == "case":
                stack.append("case")
                words_in_case.append(0)
                command, after = False, "w"
                continue
            if w == "then":
                if not stack or stack[-1] != "if":
                    raise Broken("unbalanced delimiter", word_at, w)
                stack[-1] = "then"
                continue
            if w in ("else", "elif"):
                if not stack or stack[-1] != "then":
                    raise Broken("unbalanced delimiter", word_at, w)
                if w == "elif":
                    stack[-1] = "if"
                continue
            if w == "fi":
                if not stack or stack[-1] != "then":
                    raise Broken("unbalanced delimiter", word_at, w)
                stack.pop()
                command, after = False, "w"
                continue
            if w == "do":
                if not stack or stack[-1] != "loop?":
                    raise Broken("unbalanced delimiter", word_at, w)
                stack[-1] = "do"
                continue
            if w == "done":
                if not stack or stack[-1] != "do":
                    raise Broken("unbalanced delimiter", word_at, w)
                stack.pop()
                command, after = False, "w"
                continue
            if w == "esac":
                if not stack or stack[-1] != "case":
                    raise Broken("unbalanced delimiter", word_at, w)
                stack.pop()
                words_in_case.pop()
                command, after = False, "w"
                continue
            if w == "{":
                stack.append("{")
                continue
            if w == "}":
                if not stack or stack[-1] != "{":
                    raise Broken("unbalanced delimiter", word_at, w)
                stack.pop()
                command, after = False, "w"
                continue
            if w in ("!", "time"):
                continue
        if stack and stack[-1] == "case" and words_in_case[-1] == 0 and w == "in" and whole:
            words_in_case[-1] = 1
            command, after = True, ""
            continue
        assign = command and re.fullmatch(r"[A-Za-z_]\w*(?:\[.*\])?\+?=.*", w)
        command, after = bool(assign) and False, "=" if w.endswith("=") else "w"
    if pending:
        raise Broken("unterminated literal", n, "heredoc")
    if stack:
        raise Broken("premature end", n, stack[-1])
    if after in ("<", ">"):
        raise Broken("premature end", n, after)


def _sh_double(text: str, at: int) -> int:
    return _sh_nested(text, at, '"')


def _sh_dollar(text: str, at: int) -> int:
    """End of an expansion: $name, ${...}, $(...), $((...)), $'...'."""
    nxt = text[at + 1 : at + 2]
    if nxt == "'":
        m = re.compile(r"\$'(?:[^'\\]|\\.)*'", re.S).match(text, at)
        if not m:
            raise Broken("unterminated literal", at, "$'")
        return m.end()
    if nxt not in ("{", "("):
        return re.compile(r"\$(?:\w+|[@*#?$!-])?").match(text, at).end()
    return _sh_nested(text, at + 2, nxt)


def _sh_nested(text: str, at: int, what: str) -> int:
    """End of a double-quoted text, ${...} or $(...) whose inside begins at ``at``; what nests in it goes on a stack."""
    stack = [[what, 1, at]]
    i, n = at, len(text)
    while stack:
        top = stack[-1]
        if i >= n:
            raise Broken("unterminated literal", n, '"') if top[0] == '"' else Broken("premature end", top[2], "$" + top[0])
        c, quoted = text[i], top[0] == '"'
        if c == "\\":
            i += 2
        elif c == "$" and text[i + 1 : i + 2] in ("{", "("):
            stack.append([text[i + 1], 1, i])
            i += 2
        elif c == "$" and quoted:
            i = _sh_dollar(text, i)
        elif c == '"':
            if quoted:
                stack.pop()
            else:
                stack.append(['"', 1, i])
            i += 1
        elif (c == "`" and quoted) or (c == "'" and top[0] == "("):
            e = text.find(c, i + 1)
            if e < 0:
                raise Broken("unterminated literal", i, c)
            i = e + 1
        else:
            if not quoted:
                top[1] += (c == top[0]) - (c == ("}" if top[0] == "{" else ")"))
                if not top[1]:
                    stack.pop()
            i += 1
    return i


CHECKS = {
    "python": check_python, "javascript": check_js, "typescript": check_js, "java": check_java, "go": check_go, "c": check_c, "ruby": check_ruby, "php": check_php,
    "shell": check_shell, "terraform": check_hcl, "yaml": check_yaml, "json": check_json,
}


def _marker(text: str, lang: str) -> Problem | None:
    """A conflict: its opening marker, the divider and the closing marker in order, at the start of lines.

    In a string or comment they would be text; whether they are is left to the lexer where the language is exact.
    """
    marks = [(m.group()[0], m.start()) for m in CONFLICT.finditer(text)]
    kinds = "".join(k for k, _ in marks)
    if "<" in kinds and "=" in kinds[kinds.index("<") :]:
        return ("conflict marker", marks[kinds.index("<")][1], "")
    if "<" in kinds or ">" in kinds:
        return ("conflict marker", marks[0][1], "")
    return None


def language_of(path: str | None) -> str | None:
    """Language of the extension, or None for those that have no syntax here."""
    return EXTENSIONS.get(path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()) if path and "." in path.rsplit("/", 1)[-1] else None


def first_problem(text: str | None, path: str | None) -> Problem | None:
    """What makes a text no valid text of the language of its path; None for valid, null and empty texts and other files.

    The lexers find every problem. For Python, whose parser is at hand, what they found is checked by it afterwards
    and dropped where it parses.
    """
    lang = language_of(path)
    if not text or not text.strip() or lang is None:
        return None
    text = text.removeprefix("\ufeff")
    found = None
    try:
        CHECKS[lang](text, lang)
    except Broken as e:
        found = e.problem
    if lang == "python" and found and refuted_python(text):
        return None
    marker = _marker(text, lang)
    if marker and (found or (lang not in ("python", "json") and not _quoted(text, marker[1], lang))):
        return marker
    return found


def _quoted(text: str, at: int, lang: str) -> bool:
    """Whether the offset lies within a comment or a string that may span lines."""
    if lang in ("javascript", "typescript", "java", "c", "go", "php", "terraform"):
        for m in re.finditer(rf"/\*[\s\S]*?\*/|`(?:[^`\\]|\\[\s\S])*`|\"\"\"[\s\S]*?\"\"\"|{_STRING}|{_CHAR}|//[^\n]*|<<<?[-~]?['\"]?(\w+)['\"]?\r?\n[\s\S]*?^[ \t]*\1\b", text, re.M):
            if m.start() < at < m.end():
                return True
            if m.start() > at:
                return False
    if lang in ("ruby", "shell"):
        for m in re.finditer(r"<<[-~]?['\"]?(\w+)['\"]?[^\n]*\n[\s\S]*?^[ \t]*\1\r?$|^=begin[\s\S]*?^=end", text, re.M):
            if m.start() < at < m.end():
                return True
    return lang == "yaml" and False


def invalid_files(files: DataFrame) -> DataFrame:
    """(file_id, repo, language, kind, line_no int, detail) of every file that does not parse; one narrow pass.

    ``language`` is that of the extension. Null and empty content and files without a known extension give no
    row. Repeated deliveries are files of their own. Extra columns are ignored.
    """

    def look(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for fid, repo, path, text in zip(pdf["file_id"], pdf["repo"], pdf["path"], pdf["content"], strict=True):
                p = first_problem(text, path)
                if p:
                    out.append((fid, repo, language_of(path), p[0], text.count("\n", 0, p[1]) + 1, p[2]))
            yield pd.DataFrame(out, columns=["file_id", "repo", "language", "kind", "line_no", "detail"])

    src = spread(files.select("file_id", "repo", "path", "content").where(F.col("content").isNotNull() & F.col("path").isNotNull()))
    return src.mapInPandas(look, "file_id long, repo string, language string, kind string, line_no int, detail string")


def rates(files: DataFrame) -> DataFrame:
    """(repo, language, n_files, n_invalid, rate) over all files with content in a language that is checked."""
    ext = F.lower(F.element_at(F.split(F.element_at(F.split("path", "/"), -1), r"\."), -1))
    names = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    known = files.select("file_id", "repo", names[ext].alias("language"), "content").where("language is not null and content is not null and trim(content) <> ''")
    total = known.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n_files"))
    bad = invalid_files(files).groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n_invalid"))
    bad = bad.withColumnsRenamed({"repo": "r", "language": "l"})
    joined = total.join(bad, F.col("repo").eqNullSafe(F.col("r")) & (F.col("language") == F.col("l")), "left")
    n = F.coalesce("n_invalid", F.lit(0))
    return joined.select("repo", "language", "n_files", n.alias("n_invalid"), (n / F.col("n_files")).alias("rate"))
