"""Near-duplicate lines by an exact set-similarity join.

The distinct words of a line, rarest first, are its tokens.  Two lines of Jaccard
``percent`` share a token among their first ``n - ceil(percent * n / 100) + 1``, so
only those are sent.  Lines that meet at a token pass a length filter, a positional
filter (what can still be common after this token) and a bitmap filter (parity
bits of both sets differ in at most as many places as the sets), first on 256 bits
(64 if one of the lines is short) and then on ``WIDE_BITS``, and are then verified on their tokens.  A line is removed if a similar line comes earlier.

Rarity is counted over all words in a fixed number of hash ranges; any total order
of the tokens gives exact results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklens.llm.records import BUCKETS, aside, blocks, bucket_of, row_keys, runs, small_join, unpack
from risklens.llm.textvec import U64, Hasher, Texts, mix, ranges, slices
from risklens.session import materialize

RARITY_RANGES = 1 << 16
FLUSH = 1 << 19
SLICE_BYTES = 1 << 20  # texts and
AT_ONCE = 1 << 17  # records that a task works on at a time
WIDE_BITS = 1024  # parity bits by which candidates are sifted before their tokens are fetched

NARROW_WORDS = 4  # 64-bit words of parity bits that travel with each token
SHORT_LINE = 32  # sets up to this size have them folded into the first word
TOKEN = np.dtype([("token", "<u8"), ("set", "<u8"), ("bits", "<u8", (NARROW_WORDS,)), ("doc", "<i8"), ("tie", "<i8"), ("line", "<u4"), ("n", "<u4"), ("pos", "<u2")])
LINE = np.dtype([("set", "<u8"), ("bits", "<u8", (NARROW_WORDS,)), ("doc", "<i8"), ("tie", "<i8"), ("line", "<u4"), ("n", "<u4")])
REMOVED, BLOCK, PAIR, LIVE = 1, 2, 3, 4
_TYPES = [("doc", pa.int64()), ("tie", pa.int64()), ("line", pa.int64()), ("set", pa.int64()), ("other", pa.int64()), ("other_doc", pa.int64()),
          ("other_tie", pa.int64()), ("other_line", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())]
ROWS = "kind int, doc bigint, tie bigint, line bigint, set bigint, other bigint, other_doc bigint, other_tie bigint, other_line bigint, bucket int, payload binary"


@dataclass(frozen=True)
class LineRules:
    """Lines with fewer than ``min_tokens`` distinct words are left alone."""

    percent: int = 80
    min_tokens: int = 1


def _rows(kind: int, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    arrays = [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _TYPES]
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), *arrays], names=["kind", *(c for c, _ in _TYPES)])


def rarity_ranks(docs: DataFrame) -> np.ndarray:
    """Rank of each of ``RARITY_RANGES`` hash ranges by its number of words in the
    whole corpus, the rarest first.  Every task sends one number per range it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(), np.zeros(RARITY_RANGES, dtype=np.int64)
        for part in slices(batches, "text", SLICE_BYTES):
            texts = Texts(part.column("text"))
            starts, ends = texts.words()
            if len(starts):
                h = hasher.words(texts.data, starts, ends)
                total += np.bincount((h >> U64(48)).astype(np.int64), minlength=RARITY_RANGES)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["range", "n"])

    counts = np.zeros(RARITY_RANGES, dtype=np.int64)
    # bounded: one number for each of a fixed number of ranges
    for row in docs.select("text").mapInArrow(run, "range int, n bigint").groupBy("range").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row[0]] = row[1]
    ranks = np.empty(RARITY_RANGES, dtype=U64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(RARITY_RANGES, dtype=U64)
    return ranks


def grouped(key: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order by group, then by key; groups are small numbers."""
    order = np.argsort(key)
    for shift in range(0, int(group.max(initial=0)).bit_length(), 16):
        order = order[np.argsort((group[order] >> shift).astype(np.uint16), kind="stable")]
    return order


class Lines:
    """Token sets of all lines of a slice: flat arrays, rarest token first."""

    def __init__(self, texts: Texts, hasher: Hasher, ranks: np.ndarray):
        starts, ends = texts.words()
        breaks = np.flatnonzero(texts.data == 10) + 1
        row_of_break = np.searchsorted(texts.rows, breaks - 1, side="right") - 1
        heads = np.concatenate([texts.rows[:-1], breaks])
        rows = np.concatenate([np.arange(len(texts.rows) - 1), row_of_break])
        order = np.lexsort((heads, rows))
        heads, rows = heads[order], rows[order]
        first = np.searchsorted(rows, np.arange(len(texts.rows) - 1))
        number = np.arange(len(rows)) - first[rows] if len(rows) else rows
        if len(starts):
            h = hasher.words(texts.data, starts, ends)
            key = (ranks[(h >> U64(48)).astype(np.int64)] << U64(48)) | (h & U64((1 << 48) - 1))
        else:
            key = np.zeros(0, dtype=U64)
        line = np.searchsorted(heads, starts, side="right") - 1
        order = grouped(key, line)
        key, line = key[order], line[order]
        keep = runs(line, key)
        self.key, line = key[keep], line[keep]
        self.begin = runs(line)
        self.size = np.diff(np.append(self.begin, len(line)))
        index = line[self.begin]
        self.row, self.number = rows[index], number[index]
        if len(self.begin):
            mixed = mix(self.key ^ U64(0x2545F4914F6CDD1D))
            self.set = mix(np.add.reduceat(mixed, self.begin) + self.size.astype(U64) * U64(0xD6E8FEB86659FD93)) >> U64(1)
            self.bits = np.empty((len(self.begin), NARROW_WORDS), dtype=U64)
            bit, word = U64(1) << (mixed & U64(63)), (mixed >> U64(6)) & U64(NARROW_WORDS - 1)
            for w in range(NARROW_WORDS):
                self.bits[:, w] = np.bitwise_xor.reduceat(np.where(word == w, bit, U64(0)), self.begin)
            short = self.size <= SHORT_LINE
            self.bits[short, 0] = np.bitwise_xor.reduce(self.bits[short], axis=1)
            self.bits[short, 1:] = 0
        else:
            self.set, self.bits = np.zeros(0, dtype=U64), np.zeros((0, NARROW_WORDS), dtype=U64)


def wide_bits(lines: Lines, use: np.ndarray) -> np.ndarray:
    """``WIDE_BITS`` parity bits of each line in ``use``, as rows of words."""
    owner = np.repeat(np.arange(len(use)), lines.size[use])
    spot = mix(lines.key[ranges(lines.begin[use], lines.size[use])] ^ U64(0x9E6C63D0876A9A99)) & U64(WIDE_BITS - 1)
    words = np.zeros(len(use) * (WIDE_BITS // 64), dtype=U64)
    np.bitwise_xor.at(words, owner * (WIDE_BITS // 64) + (spot >> U64(6)).astype(np.int64), U64(1) << (spot & U64(63)))
    return words.reshape(len(use), -1)


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-n * percent // 100) + 1


def line_records(lines: Lines, docs: np.ndarray, ties: np.ndarray, rules: LineRules) -> tuple[np.ndarray, np.ndarray]:
    """One record per line that is long enough, and the prefix tokens of all of them."""
    use = np.flatnonzero(lines.size >= rules.min_tokens)
    out = np.empty(len(use), dtype=LINE)
    out["set"], out["bits"], out["n"] = lines.set[use], lines.bits[use], lines.size[use]
    out["doc"], out["tie"], out["line"] = docs[lines.row[use]], ties[lines.row[use]], lines.number[use]
    return out, lines.key[ranges(lines.begin[use], prefix_size(lines.size[use], rules.percent))]


def token_blocks(lines: np.ndarray, tokens: np.ndarray, use: np.ndarray, rules: LineRules) -> Iterator[tuple[list[int], list[bytes]]]:
    """Packed blocks of a record per prefix token of the lines ``use``; a bucket has one."""
    count = prefix_size(lines["n"].astype(np.int64), rules.percent)
    first = np.cumsum(count) - count
    owner, at = np.repeat(use, count[use]), ranges(first[use], count[use])
    bucket = bucket_of(mix(tokens[at]))
    order = np.argsort(bucket.astype(np.uint16), kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
    for lo, hi in _stretches(np.diff(ends)):
        part = order[ends[lo] : ends[hi]]
        mine, spot = lines[owner[part]], at[part]
        out = np.empty(len(part), dtype=TOKEN)
        for name in LINE.names:
            out[name] = mine[name]
        out["token"] = tokens[spot]
        out["pos"] = np.minimum(spot - first[owner[part]], 65535)  # too small a place only weakens the filter
        yield blocks(out, mix(out["token"]))


def _stretches(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of about ``AT_ONCE`` records together."""
    total, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        done = int(total[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + AT_ONCE, side="right")))
        if total[hi - 1] > done:
            yield lo, hi
        lo = hi


def first_places(r: np.ndarray, order: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each group of ``r[order]``, sorted by place inside it, the first; and those of
    the others that are at another place."""
    owner = np.repeat(order[heads], np.diff(np.append(heads, len(order))))
    elsewhere = (r["doc"][order] != r["doc"][owner]) | (r["tie"][order] != r["tie"][owner]) | (r["line"][order] != r["line"][owner])
    return order[heads], order[elsewhere]


def first_of_sets(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal lines at a token the first one; and the later ones' records at the
    first token."""
    order = np.argsort(mix(records["token"] ^ mix(records["set"])))
    token, own = records["token"][order], records["set"][order]
    same = (token[1:] == token[:-1]) & (own[1:] == own[:-1])
    twin = np.zeros(len(records), dtype=bool)
    twin[1:] |= same
    twin[:-1] |= same
    rest = records[order[twin]]
    by_place = np.lexsort((rest["line"], rest["tie"], rest["doc"], rest["set"], rest["token"]))
    kept, later = first_places(rest, by_place, runs(rest["token"][by_place], rest["set"][by_place]))
    later = rest[later]
    return np.concatenate([records[order[~twin]], rest[kept]]), later[later["pos"] == 0]


def filtered_pairs(r: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (later, earlier, bits apart) of records that share a token and pass the
    length, positional and bitmap filters.  ``r`` is sorted by token and size.

    Records are compared with their k-th successor, for all tokens at once; sizes
    ascend, so a pair that fails the length filter ends its record's comparisons.
    Each yield names a record at most once as the later one."""
    heads = runs(r["token"])
    end = np.repeat(np.append(heads[1:], len(r)), np.diff(np.append(heads, len(r))))
    n, pos = r["n"].astype(np.int64), r["pos"].astype(np.int64)
    bits = [np.ascontiguousarray(r["bits"][:, w]) for w in range(NARROW_WORDS)]
    folded = np.bitwise_xor.reduce(r["bits"], axis=1)  # parity bits too, fewer; of short lines the only ones
    left, k = np.arange(len(r)), 0
    while len(left):
        k += 1
        left = left[left + k < end[left]]
        right = left + k
        fits = n[left] * 100 >= n[right] * percent
        left, right = left[fits], right[fits]
        total = n[left] + n[right]
        need = -(-total * percent // (100 + percent))
        rest = 1 + np.minimum(n[left] - pos[left], n[right] - pos[right]) - 1
        a, b, most = left[rest >= need], right[rest >= need], (total - 2 * need)[rest >= need]
        d = np.bitwise_count(folded[a] ^ folded[b]).astype(np.int64)
        ok = d <= most
        a, b, d, most = a[ok], b[ok], d[ok], most[ok]
        long = np.flatnonzero(n[a] > SHORT_LINE)  # the second of a pair is no smaller
        d[long] = sum(np.bitwise_count(w[a[long]] ^ w[b[long]]).astype(np.int64) for w in bits)
        ok = (d <= most) & (r["set"][a] != r["set"][b])
        if ok.any():
            a, b, d = a[ok], b[ok], d[ok]
            same, tied = r["doc"][a] == r["doc"][b], r["tie"][a] == r["tie"][b]
            a_later = np.where(same & tied, r["line"][a] > r["line"][b], np.where(same, r["tie"][a] > r["tie"][b], r["doc"][a] > r["doc"][b]))
            yield a[a_later], b[a_later], d[a_later]
            yield b[~a_later], a[~a_later], d[~a_later]


def _pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """Rows of pairs of a later and an earlier record."""
    long = lambda v: v.astype(np.int64)
    return _rows(PAIR, doc=x["doc"], tie=x["tie"], line=long(x["line"]), set=long(x["set"]), other=long(y["set"]), other_doc=y["doc"], other_tie=y["tie"], other_line=long(y["line"]))


def _scan(docs: DataFrame, ranks: np.ndarray, rules: LineRules) -> DataFrame:
    """Prefix tokens of all lines as blocks, and lines repeated inside a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = Hasher(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            lines, tokens = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((lines["line"], lines["tie"], lines["doc"], lines["set"]))
            kept, later = first_places(lines, order, runs(lines["set"][order]))
            later = lines[later]
            yield _rows(REMOVED, doc=later["doc"], tie=later["tie"], line=later["line"].astype(np.int64))
            for bucket, payload in token_blocks(lines, tokens, np.sort(kept), rules):
                yield _rows(BLOCK, bucket=bucket, payload=payload)

        for part in slices(batches, "text", SLICE_BYTES):
            lines = Lines(Texts(part.column("text")), hasher, ranks)
            held.append(line_records(lines, part.column("doc").to_numpy(), part.column("tie").to_numpy(), rules))
            size += len(held[-1][1])
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return docs.mapInArrow(run, ROWS)


def _meet(rows: DataFrame, rules: LineRules) -> DataFrame:
    """Removed lines pass; for each line of a token its closest earlier candidate
    (``PAIR``); records with any candidate (``LIVE``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[bytes]] = {}
        for b in batches:
            is_block = pa.compute.equal(b.column("kind"), BLOCK)
            found = b.filter(is_block)
            for bucket, payload in zip(found.column("bucket").to_pylist(), found.column("payload").to_pylist()):
                parts.setdefault(bucket, []).append(payload)
            yield b.filter(pa.compute.invert(is_block))
        buckets = sorted(parts)
        sizes = np.array([sum(map(len, parts[x])) for x in buckets], dtype=np.int64) // TOKEN.itemsize
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        # a token is in one bucket, so a few buckets at a time meet as all at once do
        for lo, hi in _stretches(sizes):
            yield from meet(unpack([p for x in buckets[lo:hi] for p in parts.pop(x)], TOKEN), pairs)
        if pairs:
            x, y = (np.concatenate(side) for side in zip(*pairs))
            order = np.lexsort((y["set"], x["set"]))
            heads = order[runs(x["set"][order], y["set"][order])]
            yield _pairs(x[heads], y[heads])

    def meet(records: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        r, later = first_of_sets(records)
        yield _rows(REMOVED, doc=later["doc"], tie=later["tie"], line=later["line"].astype(np.int64))
        r = r[np.lexsort((r["n"], r["token"]))]
        closest, partner = np.full(len(r), 1 << 20), np.zeros(len(r), dtype=np.int64)
        live = np.zeros(len(r), dtype=bool)
        for x, y, d in filtered_pairs(r, rules.percent):
            live[x] = live[y] = True
            better = d < closest[x]
            closest[x[better]], partner[x[better]] = d[better], y[better]
        x = np.flatnonzero(closest < 1 << 20)
        pairs.append((r[x], r[partner[x]]))
        found = r[live]
        bucket, payload = blocks(found, mix(found["token"]))
        yield _rows(LIVE, bucket=bucket, payload=payload)

    spread = F.coalesce("bucket", F.pmod(F.xxhash64("doc", "tie", "line"), F.lit(1 << 30)).cast("int"))
    return rows.repartition(spread).mapInArrow(run, ROWS)


def _remaining(live: DataFrame, matched: DataFrame, rules: LineRules) -> DataFrame:
    """All candidates of lines that the first round did not settle."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = unpack(b.column("payload").to_pylist(), TOKEN)
            yield pa.RecordBatch.from_arrays(
                [pa.array((mix(r["token"]) >> U64(1)).astype(np.int64)), pa.array(r["set"].astype(np.int64)),
                 pa.array([x.tobytes() for x in r], pa.binary())],
                names=["token", "set", "record"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, settled = [], []
        for b in batches:
            parts += b.column("record").to_pylist()
            settled.append(b.column("settled").to_numpy(zero_copy_only=False))
        if not parts:
            return
        r, settled = np.frombuffer(b"".join(parts), dtype=TOKEN), np.concatenate(settled)
        order = np.lexsort((r["n"], r["token"]))
        r, settled = r[order], settled[order]
        for x, y, _ in filtered_pairs(r, rules.percent):
            open_ = ~settled[x]
            if open_.any():
                yield _pairs(r[x[open_]], r[y[open_]])

    rows = live.select("payload").mapInArrow(unfold, "token bigint, set bigint, record binary")
    flagged = rows.join(matched.withColumn("settled", F.lit(True)), "set", "left")
    # a token whose lines are all settled has nothing left to compare
    open_tokens = flagged.filter("settled is null").select("token").distinct()
    return (
        flagged.join(open_tokens, "token", "left_semi").select("token", "record", F.coalesce("settled", F.lit(False)).alias("settled"))
        .repartition("token").mapInArrow(run, ROWS)
    )


def _verify(docs: DataFrame, pairs: DataFrame, ranks: np.ndarray, rules: LineRules) -> DataFrame:
    """(set, doc, line) of the lines that are similar to their earlier candidate."""
    pairs = materialize(pairs.groupBy("set", "other").agg(
        F.first("doc").alias("doc"), F.first("tie").alias("tie"), F.first("line").alias("line"), F.first("other_doc").alias("other_doc"), F.first("other_tie").alias("other_tie"), F.first("other_line").alias("other_line")
    ), "pairs")
    both = pairs.select("set", "doc", "tie", "line").union(pairs.select("other", "other_doc", "other_tie", "other_line"))
    places = both.groupBy("set").agg(F.min(F.struct("doc", "tie", "line")).alias("at")).select("at.doc", "at.tie", "at.line")
    per_doc = materialize(places.groupBy(F.col("doc").alias("_doc"), F.col("tie").alias("_tie")).agg(F.collect_set("line").alias("lines")), "lines")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for part in slices(batches, "text", SLICE_BYTES):
            lines = Lines(Texts(part.column("text")), hasher, ranks)
            wanted = part.column("lines")
            counts = pa.compute.list_value_length(wanted).to_numpy()
            place = (np.repeat(np.arange(len(counts)), counts) << 32) | wanted.flatten().to_numpy()
            use = np.flatnonzero(np.isin((lines.row.astype(np.int64) << 32) | lines.number, place))
            wide = wide_bits(lines, use)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lines.set[use].astype(np.int64)), pa.array(lines.size[use].astype(np.int32)), pa.array([x.tobytes() for x in wide], pa.binary()),
                 pa.array([lines.key[b : b + s].tobytes() for b, s in zip(lines.begin[use].tolist(), lines.size[use].tolist())], pa.binary())],
                names=["id", "n", "wide", "tokens"],
            )

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=U64).reshape(-1, WIDE_BITS // 64) for c in ("mine", "theirs"))
            total = b.column("n").to_numpy().astype(np.int64) + b.column("m").to_numpy()
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            ok = apart <= total - 2 * -(-total * rules.percent // (100 + rules.percent))
            yield b.select(["set", "other", "doc", "tie", "line"]).filter(pa.array(ok, pa.bool_()))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("mine").to_pylist(), b.column("theirs").to_pylist()):
                x, y = np.frombuffer(x, dtype=U64), np.frombuffer(y, dtype=U64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= rules.percent * (len(x) + len(y) - common))
            yield b.select(["set", "doc", "tie", "line"]).filter(pa.array(ok, pa.bool_()))

    joined = small_join(docs, per_doc, (F.col("doc") == F.col("_doc")) & (F.col("tie") == F.col("_tie")), "inner", 72)
    # a set is read from one place, so it comes once
    sets = materialize(joined.select("text", "lines").mapInArrow(tokens, "id bigint, n int, wide binary, tokens binary"), "tokens")
    wide_mine = sets.select(F.col("id").alias("set"), "n", F.col("wide").alias("mine"))
    wide_theirs = sets.select(F.col("id").alias("other"), F.col("n").alias("m"), F.col("wide").alias("theirs"))
    near = pairs.join(wide_mine, "set").join(wide_theirs, "other").select("set", "other", "doc", "tie", "line", "n", "m", "mine", "theirs")
    likely = materialize(near.mapInArrow(sift, "set bigint, other bigint, doc bigint, tie bigint, line bigint"), "likely")
    mine, theirs = sets.select(F.col("id").alias("set"), F.col("tokens").alias("mine")), sets.select(F.col("id").alias("other"), F.col("tokens").alias("theirs"))
    ready = likely.join(mine, "set").join(theirs, "other").select("set", "doc", "tie", "line", "mine", "theirs")
    return materialize(ready.mapInArrow(check, "set bigint, doc bigint, tie bigint, line bigint").distinct(), "similar")


def repeated_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """(doc, tie, lines) of (doc, tie, text), keyed by ``row_keys``: for each document with any, the numbers (from 0) of its lines
    that are similar to an earlier line, at a smaller key or earlier in the document.

    Lines are cut at line feeds; words are runs without ASCII white space, as they
    are written.  Whether a line is similar is judged on the input alone, so a removed
    line still removes later ones.  Null ids come after all others, each
    row a document.  Rows with one id and one text are one document: lines at one place
    of both are one line.  Null, empty and blank texts have no lines.  An empty table gives an empty table.

    Equal lines are reduced to their first inside each task, so a line that occurs in
    a third of all documents is one record per task.  Candidates are settled in two
    rounds: each line's closest candidate first, then all candidates of the lines
    that are still open, so a large family of similar lines does not give all its pairs.
    """
    ranks = rarity_ranks(docs)
    met = materialize(_meet(_scan(docs, ranks, rules), rules), "met")
    near = _verify(docs, met.filter(F.col("kind") == PAIR), ranks, rules)
    rest = _remaining(met.filter(F.col("kind") == LIVE), near.select("set").distinct(), rules)
    late = _verify(docs, rest, ranks, rules)
    removed = met.filter(F.col("kind") == REMOVED).select("doc", "tie", "line").union(near.select("doc", "tie", "line")).union(late.select("doc", "tie", "line"))
    return materialize(removed.groupBy("doc", "tie").agg(F.collect_set("line").alias("lines")), "removed")


def remove_lines(df: DataFrame, rules: LineRules = LineRules(), doc_id: str = "doc_id", text: str = "text", out: str = "removed") -> DataFrame:
    """``df`` with repeated lines cut out of ``text`` and their numbers in the array
    column ``out``; see :func:`repeated_lines`.  A column named ``out`` is replaced,
    all others stay."""
    kept = [c for c in df.columns if c != out]
    keyed = row_keys(df.select(*[F.col(f"`{c}`") for c in kept]), doc_id, text)
    gone = repeated_lines(keyed.select(F.col("__doc").alias("doc"), F.col("__tie").alias("tie"), F.col(f"`{text}`").cast("string").alias("text")), rules)
    lines = gone.select(F.col("doc").alias("__gone"), F.col("tie").alias("__gone_tie"), F.array_sort("lines").alias("__lines"))
    # one plan at every size: half of all documents may have a list, and texts need no sort to be hashed
    joined = keyed.join(lines.hint("shuffle_hash"), (F.col("__doc") == F.col("__gone")) & (F.col("__tie") == F.col("__gone_tie")), "left")
    numbered = joined.select(*[F.col(f"`{c}`") for c in kept], F.coalesce("__lines", F.array().cast("array<bigint>")).alias(out))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = b.schema.get_field_index(text)
            new = []
            for t, lines in zip(b.column(place).to_pylist(), b.column(out).to_pylist()):
                if lines and t is not None:
                    drop = set(lines)
                    t = "\n".join([x for i, x in enumerate(t.split("\n")) if i not in drop])
                new.append(t)
            yield b.set_column(place, b.schema.field(place), pa.array(new, b.schema.field(place).type))

    return numbered.mapInArrow(cut, numbered.schema)


def lines_query(docs: DataFrame) -> DataFrame:
    """All documents without their repeated lines."""
    before = docs.select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("bigint").alias("n_lines"))
    return remove_lines(before).select("doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_removed"), "text")


def lines_stage(docs: DataFrame) -> DataFrame:
    """Documents without their repeated lines, same columns, whatever the names of further
    ones; a document that loses all its words that way goes."""
    plain, names = aside(docs)
    text = names["text"]
    out = remove_lines(plain, doc_id=names["doc_id"], text=text, out="removed")
    left = (F.size("removed") == 0) | F.col(text).rlike("[^\\x20\\x09-\\x0D]")
    return out.filter(left).select(*[
        (F.when(F.size("removed") > 0, F.length(text)).otherwise(F.col(own)).cast("bigint").alias(own) if c == "n_chars" else F.col(own))
        for c, own in names.items()
    ]).toDF(*docs.columns)
