import re
from collections import defaultdict

from risklens.llm.quality import LineRules, line_quality, quality_query, quality_stage
from risklens.llm.quality import BAR, BOILERPLATE, ENDINGS, MARKED, NAVIGATION

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, rules=LineRules()):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    inside = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)

    def good(line):
        bare = line.strip(" \t\n\r\x0b\x0c")
        n, low = len(WORD.findall(bare)), bare.lower()
        nav = n <= rules.short_words and (re.search(NAVIGATION, low) or len(re.findall(BAR, bare)) >= rules.bar_marks)
        return bare[-1] in ENDINGS and len(re.findall(MARKED, bare)) * 100 <= n * rules.marked_pct and not nav and not any(p in low for p in BOILERPLATE)

    chars = sum(map(len, words))
    left = sum(len(w) for x in lines if good(x) for w in WORD.findall(x))
    return (len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed, not failed and left * 100 >= chars * 50)


LINES = [
    "A plain line of prose that ends well, as it should do here.",
    "home | about | blog | contact", "Menu", "Sign in to continue.", "We use cookies. Read our privacy policy.",
    "no end of the line here at all", "BUY!! NOW!! CHEAP!! GOODS!! TODAY!!", 'She said "it is done and over now."', "",
    "   \t ", "café déjà vu, l'été était beau !", "de%%% el%%% por*** con$$$ la###",
]


def test_equals_brute_force(spark, odd_docs, odd_texts):
    rows = {r.doc_id: tuple(r)[1:8] for r in quality_query(odd_docs.filter("doc_id is not null")).collect()}
    for i, t in enumerate(odd_texts):
        assert rows[i] == brute(t), i


def test_lines(spark):
    texts = ["\n".join(LINES[i:] + LINES[:k]) for i in range(len(LINES)) for k in (0, 3, 9)]
    texts += ["\n".join([LINES[0]] * k + [LINES[1]] * 3) for k in (1, 2, 5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in quality_query(docs).collect():
        assert tuple(r)[1:8] == brute(texts[r.doc_id]), texts[r.doc_id]


def test_repetition(spark):
    texts = ["a b c d e f " * k + "x y z a b c d e." for k in range(1, 7)] + ["a " * 40, "a b c d e a b c d e", "a b c d e f g h i j k l"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in quality_query(docs).collect():
        assert r.n_repeat_words == brute(texts[r.doc_id])[4], texts[r.doc_id]


def test_stage_removes_lines_and_documents(spark):
    good = "\n".join([LINES[0], "Another sound line about rivers, towns and people.", LINES[1]])
    docs = spark.createDataFrame([(1, good, None, "s", 9), (2, "\n".join(LINES[1:3] * 4), "en", "s", 9), (3, None, None, None, None)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = quality_stage(docs)
    assert out.columns == docs.columns
    [row] = out.collect()
    assert row.doc_id == 1 and row.text == good.rsplit("\n", 1)[0] and row.n_chars == len(row.text)


def test_empty_and_clashing(spark, no_docs, odd_docs):
    assert quality_query(no_docs).collect() == [] and quality_stage(no_docs).collect() == []
    clash = odd_docs.selectExpr("*", "1 as quality", "2 as kept", "3 as n_words", "4 as _quality")
    assert line_quality(clash).count() == odd_docs.count()
    assert quality_query(clash).count() == odd_docs.count()
