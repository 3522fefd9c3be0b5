"""Line-first quality rules.

Every line is judged on its own: punctuation, navigation and boilerplate rules.
Failing lines are removed, and a document that loses too much of its text with
them is rejected.  Everything is a built-in expression inside the row: no
shuffle, no Python, linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklens.llm.records import aside

# Patterns both Spark and the SQL form use; only syntax that both engines share.
SPACE = "[\\x20\\x09-\\x0D]+"
# a line of prose ends in one of these, closing quotes and brackets included
ENDINGS = list(".!?:;,…。！？\"'”’»)]")
# words that are mostly marks: two or more in a row
MARKED = "[!?#*$%&|<>=~^_+]{2,}"
# separators of link bars
BAR_MARKS = list("|>»•·")
BAR = f"[{''.join(BAR_MARKS)}]"
NAVIGATION = (
    "^(home|menu|search|log ?in|sign ?in|sign ?up|register|next|previous|back to top|skip to (main )?content|contact us"
    "|about us|site ?map|share this|follow us|read more|comments?|tags?)([^a-z]|$)"
)
BOILERPLATE = [
    "lorem ipsum", "enable javascript", "javascript is required", "javascript is disabled", "uses cookies", "use cookies",
    "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "click here",
    "subscribe to our", "add to cart",
]


@dataclass(frozen=True)
class LineRules:
    """Thresholds; the defaults are the production ones."""

    min_words: int = 10  # base rule: fewer words fail
    max_repeat_pct: int = 20  # base rule: a larger share of repeated words fails
    window: int = 5  # words of a repeated window
    marked_pct: int = 30  # a line with a larger share of marked words fails
    bar_marks: int = 3  # so many separators make a short line a link bar
    short_words: int = 12  # navigation lines have at most so many words
    min_kept_pct: int = 50  # a document keeps at least this share of its word characters


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _solid(text: Column) -> Column:
    """Number of characters that are not white space."""
    return F.length(F.regexp_replace(text, SPACE, ""))


def _matches(text: Column, pattern: str) -> Column:
    """How often a one-character or run pattern occurs."""
    return F.size(F.split(text, pattern)) - 1


def _any(text: Column, phrases: Sequence[str]) -> Column:
    found = text.contains(phrases[0])
    for p in phrases[1:]:
        found = found | text.contains(p)
    return found


def line_passes(line: Column, suspects: Column, rules: LineRules) -> Column:
    """Whether a line with a word passes all line rules.

    ``suspects`` says of the whole text whether boilerplate phrases, runs of marks and
    separators occur in it at all; lines are only searched for what does."""

    def judged(bare: Column) -> Column:
        lowered = F.lower(bare)
        short = _matches(bare, SPACE) < rules.short_words
        bar = F.when(suspects["bars"], _matches(bare, BAR) >= rules.bar_marks).otherwise(False)
        navigation = (bar | lowered.rlike(NAVIGATION)) & short
        marked = F.when(
            suspects["marks"], _matches(bare, MARKED) * 100 > (_matches(bare, SPACE) + 1) * rules.marked_pct
        ).otherwise(False)
        phrase = F.when(suspects["phrases"], _any(lowered, BOILERPLATE)).otherwise(False)
        return F.right(bare, F.lit(1)).isin(*ENDINGS) & ~marked & ~navigation & ~phrase

    return _let(F.trim(line, F.lit(" \t\n\x0b\x0c\r")), judged)


def repeated_words(words: Column, window: int) -> Column:
    """Words inside windows of ``window`` words that occur twice or more.

    Window hashes are compared with their distinct ones first; only a row with a
    repetition sorts (hash, place) pairs, keeps places whose neighbour has the same
    hash and adds up what each place covers before the next.
    """

    def keyed(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        return _let(hashes, lambda h: F.slice(
            F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, window)])),
            1, F.size(w) - (window - 1),
        ))

    def places(keys: Column) -> Column:
        pairs = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        found = _let(pairs, lambda s: F.filter(
            F.transform(s, lambda x, j: F.when(
                (F.get(s, j - 1)["k"] == x["k"]) | (F.get(s, j + 1)["k"] == x["k"]), x["i"]
            )),
            lambda i: i.isNotNull(),
        ))
        return _let(F.sort_array(found), lambda p: F.aggregate(
            F.transform(p, lambda x, j: F.coalesce(F.least(F.get(p, j + 1) - x, F.lit(window)), F.lit(window))),
            F.lit(0).cast("bigint"), lambda a, b: a + b,
        ))

    counted = _let(keyed(words), lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("bigint")).otherwise(places(k)))
    return F.when(F.size(words) < window, F.lit(0).cast("bigint")).otherwise(counted)


def line_quality(df: DataFrame, text: str = "text", rules: LineRules = LineRules(), out: str = "quality") -> DataFrame:
    """``df`` with one struct column ``out``: n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, n_lines, n_lines_removed, kept_chars,
    kept and ``clean`` (the text without its failing lines; lines without a word stay).

    Words are runs without ASCII white space.  A null text has no words and is
    rejected; so is a text below ``min_words``.  A column named ``out`` is replaced,
    all others are left alone, so their names cannot clash.  Repeated rows are
    judged each on its own; an empty table gives an empty table.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def suspects(t: Column) -> Column:
        return _let(F.lower(t), lambda low: F.struct(
            _any(low, BOILERPLATE).alias("phrases"), t.rlike(MARKED).alias("marks"), _any(t, BAR_MARKS).alias("bars"),
        ))

    def judged(t: Column, words: Column, lines: Column) -> Column:
        n_words = F.size(words).cast("bigint")
        solid = F.filter(lines, lambda x: x.rlike(f"[^{SPACE[1:-2]}]"))
        good = _let(suspects(t), lambda u: F.filter(lines, lambda x: ~x.rlike(f"[^{SPACE[1:-2]}]") | line_passes(x, u, rules)))
        return _let(
            F.struct(
                n_words.alias("n_words"),
                _solid(t).cast("bigint").alias("word_chars"),
                _matches(t, "[#*$%&|<>]").cast("bigint").alias("n_symbols"),
                repeated_words(words, rules.window).alias("n_repeat_words"),
                F.size(lines).cast("bigint").alias("n_lines"),
                solid.alias("solid"),
                good.alias("good"),
            ),
            lambda s: _let(
                F.struct(
                    ((s["n_words"] < rules.min_words) | (s["n_repeat_words"] * 100 > s["n_words"] * rules.max_repeat_pct)).alias("failed"),
                    F.array_join(s["good"], "\n").alias("clean"),
                ),
                lambda v: _let(F.when(
                    F.size(s["good"]) == s["n_lines"], s["word_chars"]
                ).otherwise(_solid(v["clean"])), lambda left: F.struct(
                    s["n_words"].alias("n_words"), s["word_chars"].alias("word_chars"), s["n_symbols"].alias("n_symbols"),
                    (F.size(s["solid"]) - F.size(F.array_distinct(s["solid"]))).cast("bigint").alias("n_dup_lines"),
                    s["n_repeat_words"].alias("n_repeat_words"), v["failed"].alias("base_failed"),
                    (~v["failed"] & (left * 100 >= s["word_chars"] * rules.min_kept_pct)).alias("kept"),
                    s["n_lines"].alias("n_lines"), (s["n_lines"] - F.size(s["good"])).cast("bigint").alias("n_lines_removed"),
                    left.alias("kept_chars"), v["clean"].alias("clean"),
                )),
            ),
        )

    quality = _let(body, lambda t: _let(words_of(t), lambda w: _let(F.split(t, "\n"), lambda x: judged(t, w, x))))
    return df.withColumn(out, quality)


def quality_query(docs: DataFrame) -> DataFrame:
    """Every document's counts and verdict."""
    q = F.col("quality")
    return line_quality(docs.select("doc_id", "text")).select(
        "doc_id", *[q[c].alias(c) for c in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
            "n_lines_removed", "kept_chars",
        )],
    )


def quality_stage(docs: DataFrame) -> DataFrame:
    """Documents that pass, with their failing lines removed; same columns, whatever the
    names of further ones."""
    plain, names = aside(docs)
    q = F.col("quality")
    passed = line_quality(plain, names["text"], out="quality").filter(q["kept"])
    return passed.select(*[
        (q["clean"] if c == "text" else F.length(q["clean"]).cast("bigint") if c == "n_chars" else F.col(own)).alias(own)
        for c, own in names.items()
    ]).toDF(*docs.columns)
