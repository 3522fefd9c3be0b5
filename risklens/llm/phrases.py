"""Frequent phrases by Toivonen's method, and the collocations among them.

A sample of the documents is mined level by level with a lowered bar; what is frequent
there is the proposal.  One pass over all documents then counts the proposal and its
negative border: a phrase of k words is counted if its first and its last k - 1 words
are proposed, whether it is itself proposed or not.  A border phrase that turns out
frequent joins the proposal, and a further pass counts what that brings within the
border, until a pass finds none.  Then every frequent phrase has been counted, because
its shortest part outside the proposal would have been a failure of the border.

Proposals are kept as a bitmap over phrase hashes, of fixed size whatever the corpus.
A bit set by another phrase only makes more phrases be counted, so neither the
bitmap's size nor a collision in it changes the result.

Phrases are counted under a key and a mark, two hashes of 94 bits that share nothing
but the words' bytes.  Documents are dealt to shares, and a phrase's count brings the
least share it occurs in: a last pass has only the documents of that share send the
phrase's words, so what is sent follows the number of frequent phrases and not, as if
every task sent its own, that number times the tasks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from risklens.llm.records import runs
from risklens.llm.textvec import U64, Hasher, Texts, mix, slices
from risklens.session import materialize

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09]] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAPS = _BLANK | _BREAK
SLICE_BYTES = 1 << 20
HELD_KEYS = 1 << 21  # a task counts and sends its phrases when it holds so many occurrences
SHARES = 1 << 12  # of the documents; those of one share send a phrase's words
PROBES = 3  # bits that a phrase's share sets
BUCKET_BITS = 15  # bits that one value of bitmap_construct_agg holds


@dataclass(frozen=True)
class PhraseRules:
    """``min_count``: occurrences of a frequent phrase.  The sample holds one document in
    ``sample_one_in``, and its bar is ``lowered`` times what the share would make it."""

    max_words: int = 4
    min_count: int = 30
    covered_pct: int = 80
    per_lang: int = 2000
    sample_one_in: int = 4
    lowered: float = 0.4
    filter_bits: int = 27


class Filter:
    """The proposal: one bit for each value of the upper bits of a phrase's hash."""

    def __init__(self, bits: int):
        self.bits, self.bytes = bits, np.zeros(1 << (bits - 3), dtype=np.uint8)

    def __getstate__(self) -> tuple[int, bytes]:
        return self.bits, zlib.compress(self.bytes.tobytes(), 1)

    def __setstate__(self, state: tuple[int, bytes]) -> None:
        self.bits, self.bytes = state[0], np.frombuffer(zlib.decompress(state[1]), dtype=np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> U64(64 - self.bits)
        return (self.bytes[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & np.uint8(1) != 0

    def joined(self, keys: DataFrame) -> Filter:
        """This filter with the bits of a table of keys: a row for each run of 32,768
        bits, so at most ``2 ** bits`` bits come to the driver."""
        at = F.shiftrightunsigned("key", 64 - self.bits) + 1
        rows = keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
        out, width = Filter(self.bits), 1 << (BUCKET_BITS - 3)
        out.bytes[:] = self.bytes
        for r in rows.collect():
            lo = (r.bucket - 1) * width
            part = np.frombuffer(bytes(r.bits), dtype=np.uint8)[: len(out.bytes) - lo]
            out.bytes[lo : lo + len(part)] |= part
        return out


def distinct(keys: np.ndarray, marks: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each pair of key and mark once, with its number and its least share."""
    order = np.argsort(keys)
    if ((keys[order[1:]] == keys[order[:-1]]) & (marks[order[1:]] != marks[order[:-1]])).any():
        order = np.lexsort((marks, keys))
    heads = runs(keys[order], marks[order])
    least = np.minimum.reduceat(shares[order], heads) if len(heads) else shares
    return keys[order[heads]], marks[order[heads]], np.diff(np.append(heads, len(order))), least


def spot(keys: np.ndarray, shares: np.ndarray, probe: int) -> np.ndarray:
    """Where a filter of phrases with their shares has one of its bits."""
    return mix(keys + (shares.astype(U64) * U64(PROBES) + U64(probe + 1)) * U64(0xD6E8FEB86659FD93))


class Grams:
    """Words of a slice, and the hashes of its phrases by number of words.

    A hash depends on the language and the words alone.  Of a key, the two lowest
    bits are the number of words less one; a mark is made of other hashes of the words."""

    def __init__(self, part: pa.RecordBatch, hasher: Hasher):
        texts = Texts(part.column("text"), lower=True)
        self.raw = texts.data.tobytes()
        self.starts, self.ends = texts.words(_GAPS)
        self.row = np.repeat(np.arange(part.num_rows), np.diff(texts.split(self.starts)))
        breaks = np.cumsum(_BREAK[texts.data])
        self.piece = breaks[self.starts] if len(self.starts) else breaks[:0]
        self.langs = ["und" if x is None else x for x in part.column("lang").to_pylist()]
        salt = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(self.langs)}
        self.lang = np.array([salt[x] for x in self.langs], dtype=U64)
        self.data, self.other = texts.data, None
        self.word = mix(hasher.words(texts.data, self.starts, self.ends) ^ self.lang[self.row])

    def of(self, n_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, first words, hashes) for k = 1 to ``n_words``; phrases do not leave a piece."""
        at = np.arange(len(self.word))
        h = mix(self.word + U64(1))
        yield 1, at, h & ~U64(3)
        for k in range(2, n_words + 1):
            last = at + k - 1
            ok = last < len(self.word)
            at, last, h = at[ok], last[ok], h[ok]
            ok = (self.row[at] == self.row[last]) & (self.piece[at] == self.piece[last])
            at, h = at[ok], mix(h[ok] * U64(0x9FB21C651E98DF25) + self.word[last[ok]] + U64(k))
            yield k, at, (h & ~U64(3)) | U64(k - 1)

    def marks(self, at: np.ndarray, k: int, hasher: Hasher) -> np.ndarray:
        """Marks of the phrases of ``k`` words from the words ``at``; ``hasher`` has another
        base than that of the keys."""
        if self.other is None and len(at):
            self.other = mix(hasher.words(self.data, self.starts, self.ends) ^ self.lang[self.row])
        h = np.full(len(at), k, dtype=U64)
        for i in range(k if len(at) else 0):
            h = h * U64(0xC2B2AE3D27D4EB4F) + self.other[at + i]
        return (mix(h) >> U64(32)).astype(np.uint32).view(np.int32)

    def phrase(self, i: int, k: int) -> bytes:
        return b" ".join([self.raw[a:b] for a, b in zip(self.starts[i : i + k].tolist(), self.ends[i : i + k].tolist())])


def dealt(docs: DataFrame) -> DataFrame:
    """Texts, languages, and the share of every document."""
    return docs.select("text", "lang", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SHARES)).cast("smallint").alias("share"))


def border_counts(docs: DataFrame, now: Filter, before: Filter | None, bar: int, rules: PhraseRules, marked: bool = True) -> DataFrame:
    """(key, mark, n, share): the phrases whose parts of one word less are in ``now``, without
    those that ``before`` has already counted, that occur at least ``bar`` times in all of
    ``docs``, with the least share of a document that holds them; a written table.

    Not ``marked``, marks and shares are 0 and phrases of one key are one."""
    sent = docs.sparkSession.sparkContext.broadcast((now, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (now, before), hasher, other = sent.value, Hasher(), Hasher(1)

        def parts_in(inside: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
            # both parts begin where a phrase of one word less begins: at this word and the next
            return inside[place[at]] & inside[place[at + 1]]

        def counted(chosen: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            none = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int16)
            keys, marks, n, shares = distinct(*map(np.concatenate, zip(none, *chosen)))
            return pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(marks), pa.array(n.astype(np.int64)), pa.array(shares)], names=["key", "mark", "n", "share"],
            )

        chosen: list[tuple[np.ndarray, ...]] = []
        held = 0
        for part in slices(batches, "text", SLICE_BYTES):
            grams, share = Grams(part, hasher), part.column("share").to_numpy()
            place = inside = seen = np.zeros(0, dtype=np.int64)
            for k, at, keys in grams.of(rules.max_words):
                if k == 1:
                    pick = np.full(len(at), before is None)
                else:
                    pick = parts_in(inside, at, place)
                    if before is not None:
                        pick &= ~parts_in(seen, at, place)
                picked = at[pick]
                if marked:
                    chosen.append((keys[pick], grams.marks(picked, k, other), share[grams.row[picked]]))
                else:
                    chosen.append((keys[pick], np.zeros(len(picked), dtype=np.int32), np.zeros(len(picked), dtype=np.int16)))
                held += len(picked)
                place = np.zeros(len(grams.word) + 1, dtype=np.int64)
                place[at] = np.arange(len(at))
                inside = now.has(keys)
                seen = before.has(keys) if before is not None else inside
            if held > HELD_KEYS:
                yield counted(chosen)
                chosen, held = [], 0
        yield counted(chosen)

    counts = dealt(docs).mapInArrow(run, "key bigint, mark int, n bigint, share smallint").groupBy("key", "mark").agg(F.sum("n").alias("n"), F.min("share").alias("share"))
    written = materialize(counts.filter(F.col("n") >= bar), "phrases")
    sent.destroy()
    return written


def propose(docs: DataFrame, rules: PhraseRules) -> Filter:
    """What is frequent in a sample of the documents, level by level."""
    own = F.pmod(F.xxhash64("doc_id", "text"), F.lit(rules.sample_one_in)) == 0
    sample, bar = docs.filter(own), max(1, int(rules.min_count / rules.sample_one_in * rules.lowered))
    done, now = None, Filter(rules.filter_bits)
    for _ in range(rules.max_words - 1):
        done, now = now, now.joined(border_counts(sample, now, done, bar, rules, marked=False))
    return now


def frequent_keys(docs: DataFrame, rules: PhraseRules) -> tuple[DataFrame, int]:
    """All phrases that occur ``min_count`` times as ``border_counts`` has them, and the
    number of passes over all documents."""
    before, now, passes, found = None, propose(docs, rules), 0, None
    while True:
        counted = border_counts(docs, now, before, rules.min_count, rules)
        found = counted if found is None else found.unionByName(counted)
        passes += 1
        # frequent, of less than the greatest number of words, and not proposed
        sent = docs.sparkSession.sparkContext.broadcast(now)

        def failures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = b.column("key").to_numpy(zero_copy_only=False).view(U64)
                yield b.filter(pa.array(~sent.value.has(keys)))  # noqa: B023

        failed = counted.select("key").filter(F.col("key").bitwiseAND(F.lit(3)) < rules.max_words - 1).mapInArrow(failures, "key bigint")
        wider = now.joined(failed)
        sent.destroy()
        if np.array_equal(wider.bytes, now.bytes):
            return found, passes
        before, now = now, wider


def named(docs: DataFrame, found: DataFrame, rules: PhraseRules) -> DataFrame:
    """(key, mark, lang, phrase, n): the words of every phrase of ``found``, from the documents
    of its share (and of some more phrases, where filter bits collide); and without a
    phrase, numbers of words of the languages.  A written table."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, shares = b.column("key").to_numpy().view(U64), b.column("share").to_numpy()
            for probe in range(PROBES):
                yield pa.RecordBatch.from_arrays([pa.array(spot(keys, shares, probe).view(np.int64))], names=["key"])

    sent = docs.sparkSession.sparkContext.broadcast(Filter(rules.filter_bits).joined(found.select("key", "share").mapInArrow(places, "key bigint")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, hasher, other = sent.value, Hasher(), Hasher(1)
        for part in slices(batches, "text", SLICE_BYTES):
            grams, share = Grams(part, hasher), part.column("share").to_numpy()
            ids, langs, phrases = [], [], []
            for k, at, keys in grams.of(rules.max_words):
                for probe in range(PROBES):
                    pick = asked.has(spot(keys, share[grams.row[at]], probe))
                    at, keys = at[pick], keys[pick]
                marks = grams.marks(at, k, other)
                first = dict(zip(zip(keys.view(np.int64).tolist(), marks.tolist()), at.tolist()))
                ids += first
                langs += [grams.langs[grams.row[i]] for i in first.values()]
                phrases += [grams.phrase(i, k) for i in first.values()]
            totals: dict[str, int] = {}
            for lang, n in zip(grams.langs, np.bincount(grams.row, minlength=part.num_rows).tolist()):
                totals[lang] = totals.get(lang, 0) + n
            none = [None] * len(totals)
            yield pa.RecordBatch.from_arrays([
                pa.array([key for key, _ in ids] + none, pa.int64()), pa.array([mark for _, mark in ids] + none, pa.int32()),
                pa.array(langs + list(totals), pa.string()), pa.array(phrases + none, pa.binary()).cast(pa.string()),
                pa.array([None] * len(ids) + list(totals.values()), pa.int64()),
            ], names=["key", "mark", "lang", "phrase", "n"])

    written = materialize(dealt(docs).mapInArrow(run, "key bigint, mark int, lang string, phrase string, n bigint"), "phrases")
    sent.destroy()
    return written


def phrase_counts(df: DataFrame, rules: PhraseRules = PhraseRules(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, n_words, f): every phrase of 1 to ``max_words`` words that occurs at
    least ``min_count`` times in its language, with its exact count; and for each
    language a row without phrase, whose f is the number of its words.

    A-Z are lower-cased; pieces end at ``.,;:!?`` and line ends, words at blanks and
    tabs.  A null text is empty, a null language ``und``.  Ids only choose the sample and
    may be null or repeated; repeated rows count each time.  Only the three named
    columns are read, so any further columns may have any name.  An empty table
    gives an empty table.  The result is written, so it is counted once.
    """
    docs = df.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"),
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
    )
    found, _ = frequent_keys(docs, rules)
    names = named(docs, found, rules)
    words = names.filter("phrase is not null").groupBy("key", "mark").agg(F.min(F.struct("lang", "phrase")).alias("of"))
    exact = found.join(words, ["key", "mark"]).select(
        "of.lang", "of.phrase", (F.col("key").bitwiseAND(F.lit(3)) + 1).cast("int").alias("n_words"), F.col("n").alias("f"),
    )
    totals = names.filter("phrase is null").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter("f > 0")
    return materialize(exact.unionByName(totals.withColumn("n_words", F.lit(0))), "phrases")


def collocations(counts: DataFrame, rules: PhraseRules = PhraseRules()) -> DataFrame:
    """The best phrases of each language from ``phrase_counts``: lang, rank, phrase, a, l, r,
    n, score.

    A phrase scores as at its weakest cut, where l and r are the counts of the two
    sides: the whole part of 2,000,000 a / (l + r).  Phrases within a longer frequent one
    that has ``covered_pct`` percent of their count are left out."""
    known = counts.filter("phrase is not null").select("lang", "phrase", "n_words", "f")
    totals = counts.filter("phrase is null").select("lang", F.col("f").alias("n"))
    words = F.split("phrase", " ")
    joined = lambda start, size: F.array_join(F.slice(words, start, size), " ")
    chosen = known.filter("n_words > 1")

    places = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("n_words") - 1),
        lambda k: F.transform(F.sequence(F.lit(1), F.col("n_words") - k + 1), lambda s: joined(s, k)),
    ))
    inner = chosen.filter("n_words > 2").select("lang", F.col("f").alias("longer"), F.explode(F.array_distinct(places)).alias("phrase"))
    cover = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    open_ = chosen.join(cover, ["lang", "phrase"], "left").filter(f"longer is null or 100 * longer < {rules.covered_pct} * f").drop("longer")

    cuts = open_.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"), "n_words")
    sides = cuts.withColumns({"left": joined(F.lit(1), F.col("k")), "right": joined(F.col("k") + 1, F.col("n_words") - F.col("k"))})
    left = known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    scored = sides.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn(
        "score", F.expr("cast((cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r) as bigint)")
    )
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("m")).select("lang", "phrase", "m.*")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = weakest.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= rules.per_lang)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def phrases_query(docs: DataFrame) -> DataFrame:
    """The first 2,000 collocations of every language."""
    return collocations(phrase_counts(docs))
