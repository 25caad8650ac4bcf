"""Sentence units of texts in many languages and scripts, as offsets in code points."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import spread

# Terminators and closing marks after the sentence-break property of Unicode Annex 29.
ASCII_TERMS = ".!?"
ELLIPSIS = "…"
WIDE_TERMS = "。！？．｡﹒﹖﹗︒︕︖"
#: The rest of STerm in all scripts, and U+2024, the rest of ATerm.
_RANGES = """
0589 061D-061F 06D4 0700-0702 07F9 0837 0839 083D-083E 0964-0965 104A-104B 1362 1367-1368 166E 1735-1736 17D4-17D5 1803 1809
1944-1945 1AA8-1AAB 1B4E-1B4F 1B5A-1B5B 1B5E-1B5F 1B7D-1B7F 1C3B-1C3C 1C7E-1C7F 203C-203D 2047-2049 2CF9-2CFB 2E2E 2E3C 2E53-2E54 2E60-2E61
A4FF A60E-A60F A6F3 A6F7 A876-A877 A8CE-A8CF A92F A9C8-A9C9 AA5D-AA5F AAF0-AAF1 ABEB 10A56-10A57 10F55-10F59 10F86-10F89
11047-11048 110BE-110C1 11141-11143 111C5-111C6 111CD 111DE-111DF 11238-11239 1123B-1123C 112A9 113D4-113D5 1144B-1144C 115C2-115C3
115C9-115D7 11641-11642 1173C-1173E 11944 11946 11A42-11A43 11A9B-11A9C 11C41-11C42 11EF7-11EF8 11F43-11F44 16A6E-16A6F 16AF5
16B37-16B38 16B44 16D6E-16D6F 16E98 1BC9F 1DA88
"""
OTHER_TERMS = frozenset(chr(x) for r in _RANGES.split() for x in range(int(r[:5].partition("-")[0], 16), int(r.rpartition("-")[2], 16) + 1))
DOT_LEADER = "\u2024"
TERMS = frozenset(ASCII_TERMS + ELLIPSIS + WIDE_TERMS + DOT_LEADER) | OTHER_TERMS
PAIRS = {"“": "”“", "„": "“”", "«": "»", "»": "«", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "‘": "’", "《": "》"}
CLOSERS = ")]}”’」』»›）》"

# Abbreviations after which a sentence goes on, whatever follows.
NEVER_ENDS = set(
    """
    dr mr mrs ms prof st hr fr mme mlle sr sra srta dra d dña vs cf i.e e.g viz al ca approx bzw z.b d.h u.a.m o.ä p.ex c.-à-d env
    p.ej ej ex т.е т.к т.н см ср напр dept gen col lt sgt rev hon gov u.s u.k ee uu ee.uu मि.से डॉ د
    """.split()
)
#: Of these, those that are words or word ends of other languages: where the text is in none of these languages, a
#: capital letter after them begins a sentence.
ONLY_IN = {
    "env": {"fr"}, "ca": {"de"}, "d": {"de", "es"}, "hr": {"de"}, "fr": {"de"}, "sr": {"es", "en"}, "ex": {"fr", "es"}, "ee": {"es"}, "uu": {"es"},
    "mme": {"fr"}, "mlle": {"fr"}, "sra": {"es"}, "srta": {"es"}, "dra": {"es"}, "col": {"en"}, "gen": {"en"}, "rev": {"en"}, "hon": {"en"}, "gov": {"en"}, "dept": {"en"}, "mrs": {"en"},
}
#: Of these, those that also end a sentence: a capital word that opens sentences and is no name decides.
OPENED = frozenset("st gov dept col gen u.s u.k".split())
OPENERS = frozenset("the this that these those then there it its we they he she you i but and so if when while after before now please see however as at for in on our no not why how what".split())
# Frequent words of the languages that share a script.
LANGUAGE_WORDS = {
    "en": frozenset("the and is of to in that it for was with are not this".split()),
    "de": frozenset("der die das und ist nicht ein eine mit für auf den von zu im wird".split()),
    "fr": frozenset("le la les des et est une un dans pour pas que du sur avec".split()),
    "es": frozenset("el la los las y es una un en para no que del con se por".split()),
}
# Abbreviations that go on where a number follows.
BEFORE_NUMBER = set(
    """
    no nos nr fig figs sec secs ch vol pp p pg art eq tab abb abschn kap bd s nº n° pág págs núm cap fig рис табл п пп гл стр с ч разд art
    approx ca env v ver abs z hal bl
    """.split()
)
# Abbreviations that may end a sentence; the case of what follows decides.
MAY_END = set("etc usw usf u.a a.m p.m et inc ltd co corp jr др пр т.д т.п и.т.д и.т.п h min sek std al v.chr n.chr д г гг вв".split())
# Words that carry on a sentence after a quotation, an ellipsis or a bracket.
GOES_ON = set(
    """
    and or but nor so was is are were be been has had have did does do said says asked wrote then while when which that as at by for from in into of on to with
    und oder aber denn dass fragte sagte schrieb war ist sind wird als in im mit von zu
    et ou mais puis dit demande est sont a dans de du pour par qui que
    y o pero e que dijo es son en de del para por con
    и а но или что сказал спросил был это в на с к по за
    और या तथा व कि लेकिन पर में से को का की के
    و ثم أو لكن في من على إلى أن
    """.split()
)
ZH_GOES_ON = ("然后", "然後", "并", "而", "但", "接着", "随后", "之后", "于是", "所以", "因此", "的")
# Thai words that carry on a sentence after a space, and words that end one.
TH_GOES_ON = ("ต่อ", "และ", "หรือ", "ที่", "ของ", "แต่", "เพราะ", "ซึ่ง", "โดย", "เพื่อ", "เป็น", "ก่อน", "หลัง", "ใน", "จาก", "กับ", "ว่า", "ให้", "แล้ว", "จึง", "ถึง", "ไม่", "มี", "อ่าน", "ยัง")
TH_ENDS = ("แล้ว", "ครับ", "ค่ะ", "คะ", "เท่านั้น", "อยู่", "กว่า", "เสร็จ", "ดูแล", "ครั้ง")
MONTHS = set(
    """
    januar jänner februar märz april mai juni juli august september oktober november dezember
    jan feb mär apr jun jul aug sep okt nov dez
    """.split()
)
FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})")
HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]|\r?$)")
ITEM = re.compile(r"[ \t]*(?:[-*+•‣·]|\d{1,9}[.)])[ \t]+(?=\S)")
QUOTE_LINE = re.compile(r"[ \t]*(?:>[ \t]?)+")
CANDIDATE = re.compile(f"[{re.escape(''.join(sorted(TERMS)))}]+")
#: The same for texts without a character beyond the first plane; classes of these alone are one table.
NEAR_CANDIDATE = re.compile(f"[{re.escape(''.join(sorted(c for c in TERMS if ord(c) < 0x10000)))}]+")
FAR = re.compile(r"[\U00010000-\U0010ffff]")
THAI_SPACE = re.compile(r"(?<=[฀-๿])[ \t ]*(?:\r?\n)?[ \t ]*(?<=\s)(?=[฀-๿A-Za-z0-9])")
LINE_MARK = re.compile(r"(?:[ \t]*(?:>|//|#|\*)[ \t]*)")
WORD = re.compile(r"[^\W\d_]+")


def blocks(text: str) -> list[tuple[int, int, int]]:
    """(start, end, body) of each block: a paragraph, list item, heading or fenced code.

    ``body`` is where sentences may end: after the mark of an item, at the end for headings and code.
    """
    out: list[tuple[int, int, int]] = []
    start = body = None
    fence = ""
    pos, end = 0, 0
    for line in text.split("\n"):
        nxt = pos + len(line) + 1
        stop = pos + len(line)
        if fence:
            end = stop
            if line.strip().startswith(fence) and not line.strip().strip(fence[0]):
                out.append((start, end, end))
                start, fence = None, ""
            pos = nxt
            continue
        m = FENCE.match(line)
        quote = QUOTE_LINE.match(line)
        bare = not line[quote.end() if quote else 0 :].strip()
        item = ITEM.match(line)
        if m or bare or item or HEADING.match(line):
            if start is not None:
                out.append((start, end, body))
                start = None
        if m:
            start, body, fence = pos, stop, m.group(1)
        elif HEADING.match(line):
            out.append((pos, stop, stop))
        elif not bare:
            if start is None:
                start, body = pos, pos + (item.end() if item else 0)
        end = stop
        pos = nxt
    if start is not None:
        out.append((start, end, end if fence else body))
    return out


def quotations(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """(open, close) positions of outermost quotations and brackets within [a, b); those never closed are none."""
    out: list[tuple[int, int]] = []
    i = a
    absent: set[str] = set()  # closing marks that stand nowhere further on; looked for once
    partner: dict[int, int] = {}  # of each bracket that is closed, where; one pass with a stack for each kind
    for kind in (r"[()]", r"[\[\]]"):
        stack: list[int] = []
        for m in re.compile(kind).finditer(text, a, b):
            if m.group() in "([":
                stack.append(m.start())
            elif stack:
                partner[stack.pop()] = m.start()

    def find(mark: str, at: int) -> int:
        if mark in absent:
            return -1
        j = text.find(mark, at, b)
        if j < 0:
            absent.add(mark)
        return j

    while i < b:
        c = text[i]
        close = PAIRS.get(c)
        if c == "’" or (c == "‘" and i > a and text[i - 1].isalnum()):
            close = None
        if c == '"' and (i == a or text[i - 1].isspace() or text[i - 1] in "([{:—–-" or ord(text[i - 1]) > 0x2E7F):
            j = i + 1
            while True:
                j = find('"', j)
                if j < 0 or j + 1 >= b or not (text[j + 1].isalnum()) or text[j - 1] in TERMS:
                    break
                j += 1
            if j > 0:
                out.append((i, j))
                i = j
        elif close:
            ends = [j for j in (find(x, i + 1) for x in close) if j > 0] if c not in "([" else []
            if c in "([":
                ends = [partner[i]] if i in partner else []
            if c == "»" and i > a and not text[i - 1].isspace() and text[i - 1] not in "([":
                ends = []
            if ends:
                out.append((i, min(ends)))
                i = min(ends)
        elif c == "`":
            j = find("`", i + 1)
            if j > 0:
                out.append((i, j))
                i = j
        i += 1
    return out


def _emoji(c: str) -> bool:
    return ord(c) > 0x2190 and unicodedata.category(c) in ("So", "Sk", "Cf", "Mn", "Cs") and c not in "«»"


def _wide(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "＀" <= c <= "￯" or c in "　、。"


def language(text: str, lang: str | None) -> str | None:
    """The language of a text by its frequent words, as labels may be wrong; the label where the words don't tell."""
    words = [w.lower() for w in WORD.findall(text)]
    counts = {k: sum(w in known for w in words) for k, known in LANGUAGE_WORDS.items()}
    best = max(counts, key=counts.get)
    if counts[best] > 1 and sum(n == counts[best] for n in counts.values()) == 1:
        return best
    return re.split(r"[-_]", lang.strip().lower())[0] or None if lang else None


def _ends(text: str, a: int, b: int, i: int, run: str, j: int, quoted: bool, k: int, lang: Callable[[], str | None]) -> bool:
    """Whether the terminators ``run`` at i, closed until j and followed by text at k, end the sentence begun at a."""
    c, spaced = text[k], k > j
    word = WORD.match(text, k)
    nxt = word.group() if word else ""
    low = nxt.lower()
    if c in ",;:，、；：、،؛" or (c in "-–—" and quoted):
        return False
    wide = run[-1] in WIDE_TERMS or (run[-1] in ELLIPSIS and i > a and _wide(text[i - 1])) or (not spaced and _wide(c))
    if wide:
        if not quoted:
            return True
        return not ("぀" <= c <= "ゟ" or any(text.startswith(w, k) for w in ZH_GOES_ON))
    if run[-1] in OTHER_TERMS:
        return not (quoted and low in GOES_ON)
    if not spaced:
        return False
    lower = nxt[:1].islower() or (nxt and not nxt[0].isupper() and not nxt[0].islower())
    if quoted:
        return not (low in GOES_ON and not nxt[:1].isupper())
    if run[-1] == ELLIPSIS or run.endswith("..."):
        return not (low in GOES_ON and not nxt[:1].isupper())
    if run != ".":
        return True
    s = i
    while s > a and not text[s - 1].isspace():
        s -= 1
    written = text[s:i].lstrip("([{\"'“„«»‘’¿¡*_`")
    token = written.lower()
    before = text[max(a, s - 24) : s].split()
    prev = before[-1] if before else ""
    for apostrophe in "’'":
        if apostrophe in token and token.rpartition(apostrophe)[2] in BEFORE_NUMBER:
            token = token.rpartition(apostrophe)[2]
    if token.isdigit():
        if len(token) <= 2 and (low in MONTHS):
            return False
        return not (len(token) <= 2 and prev.lower() in ("am", "vom", "zum", "den", "dem", "der", "das", "im", "bis", "ab", "seit") and nxt)
    if token in NEVER_ENDS:
        if token in OPENED and nxt[:1].isupper() and low in OPENERS:
            return True
        if token not in ONLY_IN or not nxt[:1].isupper() or written[:1].isupper():
            return False
        return (lang() or "") not in {"", *ONLY_IN[token]}
    if token in BEFORE_NUMBER and (c.isdigit() or c in "#§"):
        return False
    if token in MAY_END and not (len(token) == 1 and prev[:1].isdigit()):
        if len(token) == 1:
            return not (nxt[:1].islower() or prev.endswith("."))
        return not lower
    if len(token) == 1 and token.isalpha():
        unit = prev[:1].isdigit() and prev[-1:].isdigit()
        return unit
    if "." in token and all(len(x) <= 3 and x.isalpha() for x in token.split(".")) and all(len(x) <= 2 for x in token.split(".")[:-1]):
        return not lower
    if len(token) <= 3 and token.isascii() and token.isalpha() and not set(token) & set("aeiouy") and lower and not prev[:1].isdigit():
        return False
    return True


def sentences(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of each sentence unit, end exclusive, without white space around it.

    Null, empty and blank texts give none. Blocks come first: blank lines, headings, list items and fenced code
    end a unit. Inside a block, terminators of any script end a sentence unless an abbreviation, a number or an
    open quotation forbids it, with abbreviations of the text's language; closing marks and emoji belong to the sentence they follow.
    """
    out: list[tuple[int, int]] = []
    if not text:
        return out
    candidate = CANDIDATE if FAR.search(text) else NEAR_CANDIDATE
    spoken = lru_cache(maxsize=1)(lambda: language(text, lang))
    for a, b, body in blocks(text):
        start = a
        if body < b:
            spans = quotations(text, body, b)
            closing = {j: i for i, j in spans}
            cuts: list[int] = []
            n = 0
            for m in candidate.finditer(text, body, b):
                i, j = m.span()
                if i < start:
                    continue
                while n < len(spans) and spans[n][1] < i:
                    n += 1
                inside = spans[n] if n < len(spans) and spans[n][0] < i else None
                quoted = False
                while j < b and (j in closing or text[j] in CLOSERS or text[j] in TERMS or (text[j] in "*_" and j + 1 < b and not text[j + 1].isalnum())):
                    if j in closing or text[j] in CLOSERS:
                        quoted = True
                    j += 1
                if inside and j <= inside[1]:
                    continue
                k = j
                while k < b and text[k].isspace():
                    k += 1
                    if text[k - 1] == "\n":
                        mark = LINE_MARK.match(text, k, b)
                        if mark and mark.end() < b:
                            k = mark.end()
                if k >= b:
                    break
                e = k
                while e < b and _emoji(text[e]):
                    e += 1
                if e > k and (e >= b or text[e].isspace()):
                    start = e
                    cuts.append(e)
                    continue
                if _ends(text, start, b, i, m.group(), j, quoted, k, spoken):
                    cuts.append(j)
                    start = j
            if any("฀" <= c <= "๿" for c in text[body:b]):
                cuts += _thai_cuts(text, body, b, spans)
                cuts = sorted(set(cuts))
        else:
            cuts = []
        start = a
        for cut in [*cuts, b]:
            part = text[start:cut]
            left = len(part) - len(part.lstrip())
            part = part.strip()
            if part:
                out.append((start + left, start + left + len(part)))
            start = cut
    return out


def _thai_cuts(text: str, a: int, b: int, spans: list[tuple[int, int]]) -> list[int]:
    """Thai parts sentences by spaces, but also phrases: a space ends one unless a connecting word follows."""
    out = []
    for m in THAI_SPACE.finditer(text, a, b):
        k = m.end()
        if any(x < m.start() < y for x, y in spans):
            continue
        thai = "฀" <= text[k] <= "๿"
        ended = text[max(a, m.start() - 12) : m.start()].endswith(TH_ENDS)
        if thai and not text.startswith(TH_GOES_ON, k):
            out.append(m.start())
        elif not thai and ended:
            out.append(m.start())
    return out




def sentence_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, sent_start int, sent_end int) of every sentence of every text; one narrow pass over Arrow batches.

    ``lang_col`` may be missing; it counts only where the words of a text don't tell its language.
    """
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = spread(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), lang.alias("_lang")).where(F.col("_text").isNotNull()))
    kind = rows.schema["_id"].dataType.simpleString()

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            units = [sentences(t, x) for t, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            counts = [len(u) for u in units]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(units)), counts)))
            flat = np.array([x for u in units for x in u], dtype=np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([ids, pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], names=["_id", "sent_start", "sent_end"])

    return rows.mapInArrow(cut, f"_id {kind}, sent_start int, sent_end int").withColumnRenamed("_id", id_col)
