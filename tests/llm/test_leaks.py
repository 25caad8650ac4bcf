import random

import pytest

from codestrata.llm import leaks, sentences

DOC, ITEM = "doc_id long, text string, item_id string", "item_id long, text string, doc_id string"


def _words(rnd, n):
    return ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(11)
    items = {i: _words(rnd, rnd.randint(25, 90)) for i in range(12)}
    zh = "评分为三十五因为这个函数只保护列表而批次计数仍然暴露在外请尽快修复它们"
    items[99] = list(zh)
    docs = []
    for n in range(240):
        body, leaked = _words(rnd, rnd.randint(0, 120)), None
        if n % 2:
            leaked = rnd.choice(list(items))
            w, k = items[leaked], (19, 20, 25)[n % 3]
            at = rnd.randint(0, len(w) - k)
            cut = rnd.randint(0, len(body))
            body = body[:cut] + [x.upper() for x in w[at : at + k]] + body[cut:]
        docs.append((n, rnd.choice([" ", "_", ",\n> "]).join(body)))
    docs += [(900, None), (901, ""), (902, "  "), (1, docs[1][1])]
    return docs, [(i, ("" if i == 99 else " ").join(w)) for i, w in items.items()] + [(500, None), (501, "too short")]


def _brute(docs, items):
    out = []
    for d, t in docs:
        w = leaks.words(t)
        grams = {tuple(w[i : i + leaks.RUN]) for i in range(len(w) - leaks.RUN + 1)}
        for i, s in items:
            v = leaks.words(s)
            if any(tuple(v[k : k + leaks.RUN]) in grams for k in range(len(v) - leaks.RUN + 1)):
                out.append((d, i))
    return sorted(out)


def test_runs_against_brute_force(spark, corpus):
    docs, items = corpus
    d = spark.createDataFrame([(*r, "clash") for r in docs], DOC)
    i = spark.createDataFrame([(*r, "clash") for r in items], ITEM)
    got = sorted((r["doc_id"], r["item_id"]) for r in leaks.leaks(d, i).where("kind = 'verbatim'").collect())
    assert got == _brute(docs, items) and len(got) > 40
    assert leaks.leaks(d.where("false"), i).count() == 0
    assert leaks.leaks(d, i.where("false")).count() == 0


def test_blocks_of_items_and_a_sampled_fit(spark, corpus, monkeypatch):
    docs, items = corpus
    d, i = spark.createDataFrame([(*r, "") for r in docs], DOC), spark.createDataFrame([(*r, "") for r in items], ITEM)
    monkeypatch.setattr(leaks, "ITEM_WORDS", 200)
    monkeypatch.setattr(leaks, "FIT_PASSAGES", 20)
    got = sorted((r["doc_id"], r["item_id"]) for r in leaks.leaks(d, i).where("kind = 'verbatim'").collect())
    assert got == _brute(docs, items)


def test_short_items_copied_whole(spark):
    rnd = random.Random(8)
    items = [(n, " ".join(_words(rnd, 12 + n))) for n in range(12)]
    docs = [(100 + n, " ".join(_words(rnd, 30 + n)) + " " + t + " " + " ".join(_words(rnd, 30))) for n, t in items]
    d, i = spark.createDataFrame([(*r, "") for r in docs], DOC), spark.createDataFrame([(*r, "") for r in items], ITEM)
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(d, i).collect()}
    assert got <= {(100 + n, n) for n, _ in items} and {(100 + n, n) for n, _ in items if n >= 8} <= got


def test_paraphrases(spark, corpus):
    rnd = random.Random(4)
    _, items = corpus
    long = [(i, leaks.words(t)) for i, t in items if t and len(leaks.words(t)) > 60]
    docs = [(i, " ".join(_words(rnd, 40) + [w if n % 9 else "zz" for n, w in enumerate(ws)] + _words(rnd, 40))) for i, ws in long]
    d = spark.createDataFrame([(*r, "") for r in docs], DOC)
    i = spark.createDataFrame([(*r, "") for r in items], ITEM)
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(d, i).where("kind = 'paraphrase'").collect()}
    assert got <= {(i, i) for i, _ in long} and len(got) >= 0.9 * len(long)


def test_common_words():
    assert leaks.common_words(list("xaybzc"), list("abc")) == 3
    assert leaks.common_words(list("cba"), list("abc")) == 1
    assert leaks.common_words([], list("abc")) == 0


CASES = {
    "Fixed it. npm users pin a@1.2.3, e.g. beta. Wait... is x() called twice?": ["Fixed it.", "npm users pin a@1.2.3, e.g. beta.", "Wait... is x() called twice?"],
    'He wrote: "Stop. Go." Then "Done. 3 left." and on. Was it?! (Yes.) Ship! 🚀 See Fig. 3.': [
        'He wrote: "Stop. Go."', 'Then "Done. 3 left." and on.', "Was it?!", "(Yes.)", "Ship! 🚀", "See Fig. 3.",
    ],
    "# Head. Line\ntext one\ngoes on. Two\n\n- item alpha. beta\n- item c\n1. first\n> quoted one.\n> quoted two.": [
        "# Head. Line", "text one\ngoes on.", "Two", "- item alpha.", "beta", "- item c", "1. first\n> quoted one.", "> quoted two.",
    ],
    "```py\nabc. B\n\nc\n```\nAfter.": ["```py\nabc. B\n\nc\n```", "After."],
    "日志写道：“完成。跳过3个。”然后继续。注意！为什么？": ["日志写道：“完成。跳过3个。”然后继续。", "注意！", "为什么？"],
    "担当者は「ない。」と書いた。次。": ["担当者は「ない。」と書いた。", "次。"],
    "ระบบใช้เวลา 5 มิลลิวินาที ต่อการสแกนหนึ่งครั้ง ทำไมค่า x ยังเปิดอยู่": ["ระบบใช้เวลา 5 มิลลิวินาที ต่อการสแกนหนึ่งครั้ง", "ทำไมค่า x ยังเปิดอยู่"],
    "Im Mittel d. h. rund 3 usw. Am 3. März lief es. „Warum?“, fragte er.": ["Im Mittel d. h. rund 3 usw.", "Am 3. März lief es.", "„Warum?“, fragte er."],
    "لماذا ما زال؟ انتبه!": ["لماذا ما زال؟", "انتبه!"],
    "क्या है? यह है। 3 मि.से. रहा।": ["क्या है?", "यह है।", "3 मि.से. रहा।"],
}


@pytest.mark.parametrize("text", list(CASES))
def test_sentences(text):
    assert [text[a:b] for a, b in sentences.sentences(text)] == CASES[text]


MORE_CASES = [
    ("en", "Set it in your env. Then run it.", ["Set it in your env.", "Then run it."]),
    (None, "Set the path to it in your env. Then run it.", ["Set the path to it in your env.", "Then run it."]),
    ("fr", "Il y a 30 env. Ensuite rien.", ["Il y a 30 env. Ensuite rien."]),
    ("en", "It is on Main St. The house in St. Petersburg is not.", ["It is on Main St.", "The house in St. Petersburg is not."]),
    ("my", "က ခ။ ဂ ဃ။", ["က ခ။", "ဂ ဃ။"]),
    (None, "ܐܒ܀ ܓܕ܀", ["ܐܒ܀", "ܓܕ܀"]),
    (None, "ᠠᠡ᠃ ᠢᠣ᠃", ["ᠠᠡ᠃", "ᠢᠣ᠃"]),
    (None, "ሀለ፨ ሐመ።", ["ሀለ፨", "ሐመ።"]),
    (None, "ߊߋ߹ ߌߍ߹", ["ߊߋ߹", "ߌߍ߹"]),
    ("en", "What‽ Yes﹗ No﹖ End", ["What‽", "Yes﹗", "No﹖", "End"]),
]


@pytest.mark.parametrize(("lang", "text", "want"), MORE_CASES)
def test_sentences_of_more_scripts_and_languages(lang, text, want):
    assert [text[a:b] for a, b in sentences.sentences(text, lang)] == want


def test_sentence_rows(spark):
    rows = [(1, "One. Two.", "x"), (1, "One. Two.", "x"), (2, None, "x"), (3, "", "x"), (4, " \n\t ", "x"), (5, "😀 One. Two", "x"), (6, "Long one. " * 20000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sent_start string")
    got = [tuple(r) for r in sentences.sentence_units(df).collect()]
    assert sorted(g for g in got if g[0] < 6) == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9), (5, 0, 6), (5, 7, 10)]
    assert sum(g[0] == 6 for g in got) == 20000
    assert sentences.sentence_units(df.where("false")).count() == 0


def test_units_cover_all_but_white_space():
    rnd = random.Random(9)
    for _ in range(500):
        t = "".join(rnd.choice('ab A.!?…"“”()\n\n- >#`。「」กข 1') for _ in range(rnd.randint(0, 120)))
        units = sentences.sentences(t)
        assert all(a < b and t[a:b] == t[a:b].strip() for a, b in units)
        assert all(x[1] <= y[0] for x, y in zip(units, units[1:], strict=False))
