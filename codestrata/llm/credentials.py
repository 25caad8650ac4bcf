"""Credentials in source and configuration: found by one automaton of anchors and their grammars, and redacted.

An Aho-Corasick automaton (deterministic, one pass for all anchors) runs over overlapping chunks of each text.
Each hit names a grammar (token format, key armor, connection string, authorisation header, variable with a default, named or
joined literal, unquoted value) that is matched at its absolute offset. Spans found twice where chunks overlap are
one; placeholders are spliced in. Only formats that nobody listed, which have no anchor, are looked for by their shape.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import spread

#: Chunk length and overlap in code points. The overlap only has to exceed the longest anchor, since grammars
#: are matched on the whole text.
CHUNK, OVERLAP = 1 << 12, 64
#: Placeholder put in place of a credential; it holds no quote, backslash, dollar or line end of any language.
PLACEHOLDER = "REDACTED_{kind}"

Span = tuple[int, int, str]  # start, end, kind

# Token formats (anchor, grammar).
TOKENS = {
    "AKIA": r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "ASIA": r"ASIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "sk_live_": r"sk_live_[0-9A-Za-z]{12,}",
    "rk_live_": r"rk_live_[0-9A-Za-z]{12,}",
    "ghp_": r"ghp_[0-9A-Za-z]{20,}",
    "gho_": r"gho_[0-9A-Za-z]{20,}",
    "ghs_": r"ghs_[0-9A-Za-z]{20,}",
    "github_pat_": r"github_pat_[0-9A-Za-z_]{20,}",
    "glpat-": r"glpat-[0-9A-Za-z_-]{16,}",
    "xoxb-": r"xoxb-[0-9A-Za-z-]{16,}",
    "xoxp-": r"xoxp-[0-9A-Za-z-]{16,}",
    "npm_": r"npm_[0-9A-Za-z]{24,}",
    "AIza": r"AIza[0-9A-Za-z_-]{30,}",
    "SG.": r"SG\.[0-9A-Za-z_-]{16,}\.[0-9A-Za-z_-]{16,}",
    "hf_": r"hf_[0-9A-Za-z]{24,}",
    "eyJ": r"eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
}
TOKENS = {k: re.compile(r"(?<![0-9A-Za-z_])" + v) for k, v in TOKENS.items()}
#: Formats nobody listed: a short lower-case prefix, a separator and a long run of mixed letters and digits.
PREFIXED = re.compile(r"(?<![0-9A-Za-z_./+-])[a-z]{2,5}(?:_[a-z]{2,5})?[._-][0-9A-Za-z]{18,}(?![0-9A-Za-z_/+=])")
ARMOR = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----")
ARMOR_END = re.compile(r"-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----")
#: What lies between two lines of armor: line ends, as they are or escaped, with a comment mark, or joined literals.
_BETWEEN = r"""(?:\\+[nr]|[ \t]*\r?\n[ \t]*(?:[*\#>|]|//)?[ \t]*|["'`][ \t]*[+.,\\]?[ \t\r\n]*[+.]?[ \t]*[fbru]?["'`])"""
#: What follows a BEGIN whose END is cut off: headers, lines of base64, and a shorter last line of it.
ARMOR_BODY = re.compile(
    rf"""(?:{_BETWEEN}++[A-Z][A-Za-z-]{{2,20}}:[ ](?:(?!\\+[nr])[^\n"'`])*+)*+
    (?:(?:{_BETWEEN}|[ \t])*+(?=[a-z0-9+/]*[A-Z])(?=[A-Za-z]*[0-9+/])[A-Za-z0-9+/]{{16,}}+={{0,2}})*+
    (?:{_BETWEEN}++(?:(?=[A-Za-z]*[0-9+/])[A-Za-z0-9+/]{{1,63}}+={{0,2}}|[A-Za-z]{{1,63}}={{1,2}})(?=[ \t]*(?:\r?\n|\Z|["'`]|\\+[nr])))?""",
    re.X,
)
#: The rest of a line and the next one.
REST = re.compile(r"[^\n]*\n?[^\n]*")
CONNECTION = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,20}://(?P<user>[^\s:/@'\"`<>${}]*):(?P<value>[^\s/@'\"`<>]+)@[^\s'\"`]")
HEADER = re.compile(r"(?P<scheme>Basic|Bearer)\s+(?P<value>[0-9A-Za-z+/._~=-]{8,})")

# Last words of names that hold credentials, alone or after a qualifying word.
SECRET_WORDS = frozenset("password passwd passphrase pwd pass pw secret secrets token apikey credential credentials cred creds".split())
KEY_WORDS = frozenset("api access private secret signing sign hmac encryption crypt aes auth deploy host tls ssl ssh cloud master session client service license account storage".split())
# What calls itself no credential.
PLACEHOLDERS = re.compile(
    r"""^$|^[<{\[(%$*#@&]|[<>{}]|\$\{|%\(|^[xX*.•_-]+$|example|sample|placeholder|changeme|replace|change[-_ ]?me|dummy|fake|insert|redacted|your[-_ ]|^my[-_](?=(?-i:[a-z0-9_-]*)$)|^(?:none|null|nil|true|false|undefined|todo|tbd|n/?a|secret|password|passwd|token|test|default|empty)\b
    |goes[-_]here|^(?:env|vault|ssm|secret|secretsmanager|file|ref|op|arn)[:.]|^process\.|^os\.|getenv|environ|^(?:data|sha\d+|sha\d+-|md5)[:-]|^https?://[^@]*$""",
    re.I | re.X,
)
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
COMMENT = re.compile(r"^\s*(?://|#|\*|/\*|--|;|<!--)")
#: Files whose values need no quotes.
BARE = re.compile(r"(?:^|/)\.env[^/]*$|\.(?:env|local|ya?ml|sh|bash|properties|ini|cfg|conf|toml)$")
LITERAL = r"(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)"
#: A name, what binds it, and one literal or more that are joined.
NAMED = re.compile(
    rf"""(?<![\w.])(?<![\w.]-)(?P<name>[A-Za-z_][\w.-]*+)["'`]?\]?
    (?:[ \t]*(?::[ \t]*(?:string|str|String|any|const[ ]char[ ]?\*)|[ \t]string|\[\])?[ \t]*(?:=>|:=|=|:|(?<=["'\]]),)|[ \t]+(?:is[ \t]+)?(?=["'`]))
    [ \t]*(?:\([ \t\r\n]*)?[fbruRBU@]{{0,2}}(?P<value>{LITERAL}(?:[ \t]*[+.\\]?[ \t]*\r?\n[ \t]*[+.]?[ \t]*[fbru]?{LITERAL})*)""",
    re.X,
)
#: A header in a quoted text, as commands send them.
SENT = re.compile(r"""["'](?:X-[\w-]*(?:Auth|Token|Key|Secret)[\w-]*|[\w-]*Api-Key|Private-Token|Authorization):[ \t]*(?P<value>[^\s"']{12,})["']""", re.I)
VARIABLE = re.compile(r'variable\s+"(?P<name>[\w-]+)"\s*\{(?:[^{}"]|"[^"\n]*")*?\bdefault\s*=\s*(?P<value>"(?:[^"\\\n]|\\.)*")')
#: An unquoted value as far as it goes, and what may stand behind it.
RUN = re.compile(r"[ \t]*+([^\s\"'`,;(){}\[\]]+)")
BEHIND = re.compile(r"[ \t]*+(?:;[ \t]*+)?(?:(?=\r?$|\*/|-->)|(?<=[ \t])(?=#))", re.M)
BINDER = re.compile(r"(?<![\w.-])(?P<name>[A-Za-z_][\w.-]*+)[ \t]*+[:=]")
PART = re.compile(LITERAL)


# Words that names of credentials hold, and beginnings of headers that carry one.
NAME_ANCHORS = ("passw", "passphrase", "pwd", "pass", "pw", "secret", "token", "key", "cred")
HEADER_ANCHORS = ("x-", "api-key", "private-token", "authorization")
#: A literal that another one follows on the next line, and the ends by which the automaton finds it.
JOIN = re.compile(r"""["'`][ \t]*[+.\\]?[ \t]*\r?\n[ \t]*[+.]?[ \t]*[fbru]?["'`]""")
JOIN_ANCHORS = tuple(q + gap + end for q in "\"'`" for gap in ("", " ", "\t") for end in ("+", ".", "\\", "\n", "\r"))
NAME = re.compile(r"(?<![\w.])(?<![\w.]-)[A-Za-z_][\w.-]*+")
FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@lru_cache(maxsize=1)
def automaton():
    """Anchors of all grammars in one Aho-Corasick automaton over folded text: end of a hit gives (kind, anchor) of each."""
    import ahocorasick

    words: dict[str, list[tuple[str, str]]] = {}
    for kind, anchors_of in (
        ("token", TOKENS), ("armor", ("-----BEGIN ",)), ("connection", ("://",)), ("header", ("Basic ", "Bearer ")), ("variable", ('variable "',)),
        ("sent", HEADER_ANCHORS), ("join", JOIN_ANCHORS), ("name", NAME_ANCHORS),
    ):
        for anchor in anchors_of:
            words.setdefault(folded(anchor), []).append((kind, anchor))
    a = ahocorasick.Automaton()
    for word, what in words.items():
        a.add_word(word, tuple(what))
    a.make_automaton()
    return a


def folded(text: str) -> str:
    """Text with small letters at the same offsets; where lower-casing would move them, only A to Z are."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(FOLD)


def anchors(text: str, machine) -> list[tuple[int, str, str]]:
    """(absolute end, kind, anchor) of each hit, from chunks that overlap; what two chunks both see is one."""
    seen = set()
    low = folded(text)
    step = CHUNK - OVERLAP
    for at in range(0, max(1, len(text)), step):
        for end, what in machine.iter(low[at : at + CHUNK]):
            for kind, anchor in what:
                seen.add((at + end + 1, kind, anchor))
        if at + CHUNK >= len(text):
            break
    return sorted(seen)


def sensitive(name: str) -> bool:
    """Whether a name's last word holds a credential, not a label, address or id of one."""
    words = [w.lower() for w in WORDS.findall(name)]
    while words and words[-1].isdigit():
        words.pop()
    if not words:
        return False
    last = words[-1]
    if last in SECRET_WORDS:
        return True
    if last == "key" and len(words) > 1:
        return words[-2] in KEY_WORDS
    return len(words) == 1 and last in ("apikey", "authkey", "secretkey", "privatekey")


def mixed(value: str) -> bool:
    """Letters with digits, or digits and punctuation: what words and paths lack."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def drawn(letters: str) -> bool:
    """Letters drawn at random rather than words: many of either case, no word of small letters among them."""
    n = len(letters)
    upper, lower = sum(map(str.isupper, letters)), sum(map(str.islower, letters))
    return n >= 16 and letters.isalpha() and letters.isascii() and 5 * min(upper, lower) >= n and not re.search("[a-z]{12}", letters)


def literal_credential(name: str, value: str) -> bool:
    """Whether a sensitive name's value is a usable literal."""
    v = value.strip()
    if len(v) < 8 or PLACEHOLDERS.search(v) or UUID.fullmatch(v) or "PUBLIC KEY" in v or any(c.isspace() for c in v):
        return False
    if not mixed(v):
        return drawn(re.split(r"[._-]", v)[-1])
    return len(set(v)) >= 5


def token_credential(value: str) -> bool:
    """Whether a value of any name has a known token format or a prefix with a long random run."""
    if PLACEHOLDERS.search(value):
        return False
    if any(p.fullmatch(value) for p in TOKENS.values()):
        return True
    tail = re.split(r"[._-]", value)[-1]
    if not PREFIXED.fullmatch(value):
        return False
    return drawn(tail) or (any(c.isdigit() for c in tail) and any(c.isupper() for c in tail) and any(c.islower() for c in tail))


def header_credential(scheme: str, value: str) -> bool:
    if PLACEHOLDERS.search(value):
        return False
    if scheme == "Basic":
        try:
            plain = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode()
        except (binascii.Error, ValueError, UnicodeDecodeError):
            return False
        user, colon, word = plain.partition(":")
        return bool(colon and user and word) and plain.isprintable() and not PLACEHOLDERS.search(word)
    return len(value) >= 16 and mixed(value) and len(set(value)) >= 8


def spans(text: str | None, rel_path: str | None) -> list[Span]:
    """Credentials of a text, in order, none within another."""
    if not text:
        return []
    found: list[Span] = []
    lines: dict[int, bool] = {}  # beginnings of lines with a name or a joined literal; whether a name stands there
    bound = (-1, -1)
    for end, kind, anchor in anchors(text, automaton()):
        start = end - len(anchor)
        if kind in ("name", "join"):
            if kind == "join" and not JOIN.match(text, start):
                continue
            if not bound[0] <= start < bound[1]:
                bound = _line(text, start)
            lines[bound[0]] = lines.get(bound[0], False) or kind == "name"
            if kind == "join":
                # the name of a literal in brackets stands before the bracket
                before = text[: bound[0]].rstrip() if text[bound[0] : start].lstrip()[:2].strip("fbruRBU@")[:1] in "\"'`" else ""
                if before.endswith("("):
                    lines.setdefault(_line(text, len(before) - 1)[0], False)
        elif kind == "token":
            m = TOKENS[anchor].match(text, start)
            if m and not PLACEHOLDERS.search(m.group()):
                found.append((start, m.end(), "TOKEN"))
        elif kind == "armor":
            if m := ARMOR.match(text, start):
                found += _armored(text, start, m.end())
        elif kind == "connection":
            a = start
            while a and (text[a - 1].isalnum() or text[a - 1] in "+.-") and start - a < 21:
                a -= 1
            m = CONNECTION.match(text, a)
            if m and len(m["value"]) >= 4 and not PLACEHOLDERS.search(m["value"]) and m["value"].lower() not in ("pass", "pwd", "user", m["user"].lower()):
                found.append((*m.span("value"), "PASSWORD"))
        elif kind == "header":
            m = HEADER.match(text, start)
            if m and header_credential(m["scheme"], m["value"]):
                found.append((*m.span("value"), "AUTHORIZATION"))
        elif kind == "variable":
            if m := VARIABLE.match(text, start):
                value = m["value"][1:-1]
                if (sensitive(m["name"]) and "://" not in value and literal_credential(m["name"], value)) or token_credential(value):
                    found.append((m.start("value") + 1, m.end("value") - 1, "SECRET"))
        else:
            while start and (text[start - 1].isalnum() or text[start - 1] in "_-"):
                start -= 1
            m = SENT.match(text, start - 1) if start else None
            if m and literal_credential("", m["value"]):
                found.append((*m.span("value"), "AUTHORIZATION"))
    found += _named(text, lines, bool(BARE.search(rel_path or "")))
    for m in PREFIXED.finditer(text):
        if token_credential(m.group()):
            found.append((*m.span(), "TOKEN"))
    found.sort(key=lambda s: (s[0], -s[1]))
    out: list[Span] = []
    for s in found:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def _line(text: str, at: int) -> tuple[int, int]:
    """Beginning of the line of an offset and of the next line."""
    hi = text.find("\n", at)
    return text.rfind("\n", 0, at) + 1, len(text) if hi < 0 else hi + 1


def _armored(text: str, start: int, body_at: int) -> list[Span]:
    """A key ends at its END, before the next BEGIN, or where its END is cut off with its last base64 line."""
    nxt = text.find("-----BEGIN ", body_at)
    nxt = len(text) if nxt < 0 else nxt
    e = ARMOR_END.search(text, body_at, nxt)
    cut = body_at if e else ARMOR_BODY.match(text, body_at, nxt).end()
    body = text[body_at : e.start() if e else cut]
    near = body if e else text[body_at : REST.match(text, cut, nxt).end()]
    if re.search(r"[A-Za-z0-9+/]{20,}", body) and not re.search(r"(?i)example|placeholder|your[-_ ]key|\.\.\.", near):
        return [(start, e.end() if e else cut, "PRIVATE_KEY")]
    return []


def _named(text: str, lines: dict[int, bool], bare: bool) -> list[Span]:
    """Named literals and unquoted values that begin on the given lines; each line is read once, however long."""
    out: list[Span] = []
    done = -1
    for lo in sorted(lines):
        hi = _line(text, lo)[1]
        for name in NAME.finditer(text, lo, hi):
            m = NAMED.match(text, name.start()) if name.start() >= done else None
            if not m:
                continue
            done = m.end()
            parts = list(PART.finditer(text, *m.span("value")))
            value = "".join(p.group()[1:-1] for p in parts)
            a, b = parts[0].start() + 1, parts[-1].end() - 1
            if len(parts) > 1 or PREFIXED.fullmatch(value):
                h = HEADER.fullmatch(value)
                c = CONNECTION.match(value)
                if token_credential(value) or (h and header_credential(h["scheme"], h["value"])) or (c and not PLACEHOLDERS.search(c["value"])):
                    out.append((a, b, "TOKEN"))
                    continue
            if sensitive(m["name"]) and not HEADER.fullmatch(value) and "://" not in value and literal_credential(m["name"], value):
                out.append((a, b, "SECRET"))
        if lines[lo]:
            # an unquoted value counts in configuration and in comments only
            out += _unquoted(text, lo, hi - (text[hi - 1] == "\n"), bare)
    return list(dict.fromkeys(out))


def _unquoted(text: str, lo: int, hi: int, bare: bool) -> list[Span]:
    comment = COMMENT.match(text[lo:hi])
    if not (bare or comment):
        return []
    out = []
    run_end = whole = closer = -1
    for name in BINDER.finditer(text, lo, hi):
        m = RUN.match(text, name.end(), hi) if name.end() >= run_end else None
        if m:
            # what ends the run is the same for every name within it
            run_end = m.end()
            whole = bool(BEHIND.match(text, run_end, hi))
            closer = max(text.rfind("*/", m.start(1), run_end), text.rfind("-->", m.start(1), run_end))
        a = m.start(1) if m else name.end()
        if a >= run_end or not sensitive(name["name"]):
            continue
        b = run_end if whole else closer
        if b <= a:
            continue
        value = text[a:b]
        if "://" not in value and literal_credential(name["name"], value) and (bare or _inside(text, lo, a, comment)):
            out.append((a, b, "SECRET"))
    return out


def _inside(text: str, lo: int, at: int, comment: re.Match) -> bool:
    """Whether the comment that opens a line, or another of its kind, is still open at ``at``."""
    mark = comment.group().strip()
    if mark == "<!--":
        return text.rfind("-->", lo, at) <= text.rfind("<!--", lo, at)
    return mark not in ("/*", "*") or text.rfind("*/", lo, at) <= text.rfind("/*", lo, at)


def redacted(text: str, found: list[Span]) -> str:
    """The text with a placeholder in place of each credential; quotes, other lines and line ends stay as they are."""
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], PLACEHOLDER.format(kind=kind)]
        inner = text[a:b]
        if "\n" in inner and kind in ("TOKEN", "SECRET"):
            # joined literals: the later ones stay, empty, so the expression around them stays valid
            quotes = re.findall(r"[\"'`][ \t]*[+.\\]?[ \t]*\r?\n[ \t]*[+.]?[ \t]*[fbru]?[\"'`]", inner)
            out.append("".join(quotes))
        at = b
    out.append(text[at:])
    return "".join(out)


def scan(files: DataFrame) -> DataFrame:
    """(file_id, repo, n, lines array<int>, kinds array<string>, redacted) of every file with a credential; one narrow pass.

    Lines count from 1 and end at a line feed. Null and empty content give no row. Repeated deliveries are files of
    their own. Extra columns are ignored.
    """

    def look(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for fid, repo, rel, text in zip(pdf["file_id"], pdf["repo"], pdf["rel_path"], pdf["content"], strict=True):
                found = spans(text, rel)
                if found:
                    ends = [m.start() for m in re.finditer("\n", text)]
                    lines = [bisect.bisect_left(ends, a) + 1 for a, _, _ in found]
                    out.append((fid, repo, len(found), lines, [k for _, _, k in found], redacted(text, found)))
            yield pd.DataFrame(out, columns=["file_id", "repo", "n", "lines", "kinds", "redacted"])

    src = spread(files.select("file_id", "repo", "rel_path", "content").where(F.col("content").isNotNull()))
    return src.mapInPandas(look, "file_id long, repo string, n int, lines array<int>, kinds array<string>, redacted string")


def found_lines(files: DataFrame) -> DataFrame:
    """(file_id, line_no) of every line on which a credential begins, once."""
    return scan(files).select("file_id", F.explode(F.array_distinct("lines")).alias("line_no"))
