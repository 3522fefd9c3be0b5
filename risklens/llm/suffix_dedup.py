"""Exact removal of repeated byte strings by blockwise suffix sorting.

1. Every window of ``length`` bytes gets an anchor: the leftmost of its ``GRAM``-byte
   substrings with the smallest hash.  Equal windows have equal anchors, and
   neighbouring windows mostly share theirs, so the windows of a text fall into runs.
   Runs meet by anchor hash.  A run whose anchor occurs once repeats nothing; of
   equal runs all but the first are repeats.
2. An anchor with more than ``HOT_RUNS`` runs of different text is split: a window's
   place relative to its anchor is a matter of its bytes, so windows are dealt by the
   class of that place and the hash of the bytes that all windows of the class share.
   Pieces meet like runs do, first by ``PIECE`` places, then window by window.
   Other runs with one anchor and different text are laid end to end per bucket of
   anchors, and the bucket's window suffixes are sorted.  A difference cover modulo
   ``COVER`` is sampled and ranked first; suffixes are then sorted block by block on
   their first ``COVER`` bytes, and those still tied are ordered by the ranks of the
   cover samples that both reach at one distance.  Windows with equal bytes are
   neighbours then, and all but the earliest of each class are repeats.
3. The repeated windows of a text are merged and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklens.llm.records import blocks, bucket_of, row_keys, runs, small_join, unpack
from risklens.llm.textvec import U64, Hasher, Texts, mix, ranges, slices
from risklens.session import materialize

GRAM = 24
COVER = 32
DEPTH = 16  # 8-byte words by which samples are ranked
SORT_BLOCK = 1 << 16  # window suffixes sorted at a time
FLUSH = 1 << 21
SCAN_BYTES = 256 << 10
SUFFIX_BUCKETS = 512  # at least; their number follows the open bytes
BUCKET_BYTES = 512 << 10  # of open text in a suffix bucket, about
TASK_BYTES = 32 << 20  # of open text in a task, about
HOT_RUNS = 1024  # runs of one anchor that go to a suffix bucket whole
PIECE = 8

RUN = np.dtype([("anchor", "<u8"), ("body", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("start", "<u4"), ("windows", "<u2")])
ROWS = "kind int, doc bigint, tie bigint, lo bigint, hi bigint, anchor bigint, windows int, bucket int, payload binary, body binary"
_TYPES = [("doc", pa.int64()), ("tie", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("anchor", pa.int64()), ("windows", pa.int32()),
          ("bucket", pa.int32()), ("payload", pa.binary()), ("body", pa.binary())]
REMOVED, BLOCK, OPEN = 1, 2, 3


def _rows(kind: int, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    arrays = [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _TYPES]
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), *arrays], names=["kind", *(c for c, _ in _TYPES)])


def anchors(kh: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` neighbours: the position of the leftmost smallest value."""
    n = len(kh) - width + 1
    place = np.arange(len(kh), dtype=np.int64)
    high = kh & ~U64(255)
    out = np.empty(n, dtype=np.int64)
    first = place[:n]
    # positions modulo 256 break ties; the second form serves windows that wrap in the first
    for shift in (0, 128):
        low = (place + shift) & 255
        m, have = high | low.astype(U64), 1
        while 2 * have <= width:
            m = np.minimum(m[:-have], m[have:])
            have *= 2
        m = np.minimum(m[:n], m[width - have : width - have + n])
        begin = (first + shift) & 255
        found = first + (((m & U64(255)).astype(np.int64) - begin) & 255)
        fits = begin + width <= 256
        if shift:
            out = np.where(fits & ~done, found, out)
        else:
            out, done = found, fits
    return out


def window_runs(texts: Texts, docs: np.ndarray, ties: np.ndarray, length: int, hasher: Hasher, second: Hasher) -> np.ndarray:
    """Runs of neighbouring windows with one anchor, as ``RUN`` records.  The anchor is
    64 bits of the first hash, the body 64 bits of the second one."""
    sizes = np.diff(texts.rows)
    count = np.maximum(sizes - length + 1, 0)
    if not count.sum():
        return np.zeros(0, dtype=RUN)
    sums = hasher.prefix(texts.data)
    n = len(texts.data) - GRAM + 1
    kh = mix((sums[GRAM:] - sums[:-GRAM]) * hasher.inverse[:n])
    at = anchors(kh, length - GRAM + 1)
    begin = ranges(texts.rows[:-1], count)
    row = np.repeat(np.arange(len(sizes)), count)
    place = at[begin]
    heads = runs(row, place)
    windows = np.diff(np.append(heads, len(begin)))
    out = np.empty(len(heads), dtype=RUN)
    out["anchor"] = kh[place[heads]]
    out["body"] = second.span(second.prefix(texts.data), begin[heads], begin[heads] + windows + length - 1)
    out["doc"], out["tie"] = docs[row[heads]], ties[row[heads]]
    out["start"] = begin[heads] - texts.rows[row[heads]]
    out["windows"] = windows
    return out


def merge_spans(doc: np.ndarray, tie: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of one document united."""
    order = np.lexsort((hi, lo, tie, doc))
    doc, tie, lo, hi = doc[order], tie[order], lo[order], hi[order]
    if not len(doc):
        return doc, tie, lo, hi
    # ends of earlier documents are pushed below all starts of later ones
    change = runs(doc, tie)
    base = np.repeat(np.arange(len(change), dtype=np.int64), np.diff(np.append(change, len(doc)))) << 33
    reach = np.maximum.accumulate(hi + base)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (lo + base)[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(doc)) - 1
    return doc[heads], tie[heads], lo[heads], reach[tails] - base[tails]


def first_of_equal(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal runs the first one; and the later ones."""
    order = np.argsort(records["anchor"], kind="stable")
    records = records[order]
    twin = np.zeros(len(records), dtype=bool)
    equal = records["anchor"][1:] == records["anchor"][:-1]
    twin[1:] |= equal
    twin[:-1] |= equal
    single, rest = records[~twin], records[twin]
    rest = rest[np.lexsort((rest["start"], rest["tie"], rest["doc"], rest["windows"], rest["body"], rest["anchor"]))]
    heads = runs(rest["anchor"], rest["body"], rest["windows"])
    kept = rest[heads]
    owner = np.repeat(kept, np.diff(np.append(heads, len(rest))))
    later = (rest["doc"] != owner["doc"]) | (rest["tie"] != owner["tie"]) | (rest["start"] != owner["start"])
    return np.concatenate([single, kept]), rest[later]


def _removed(later: np.ndarray, length: int) -> pa.RecordBatch:
    lo = later["start"].astype(np.int64)
    doc, tie, lo, hi = merge_spans(later["doc"], later["tie"], lo, lo + later["windows"] + length - 1)
    return _rows(REMOVED, doc=doc, tie=tie, lo=lo, hi=hi)


def _packed(parts: Iterator[np.ndarray], length: int) -> Iterator[pa.RecordBatch]:
    """Runs as blocks by anchor, and spans found repeated inside a task."""
    held, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        kept, later = first_of_equal(np.concatenate(held))
        if len(later):
            yield _removed(later, length)
        bucket, payload = blocks(kept, mix(kept["anchor"]))
        yield _rows(BLOCK, bucket=bucket, payload=payload)

    for new in parts:
        held.append(new)
        size += len(new)
        if size >= FLUSH:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


def _scan(docs: DataFrame, length: int) -> DataFrame:
    """Runs of all documents as blocks by anchor, and spans found repeated inside a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, second = Hasher(), Hasher(1)
        parts = slices(batches, "text", SCAN_BYTES)
        yield from _packed((window_runs(Texts(p.column("text")), p.column("doc").to_numpy(), p.column("tie").to_numpy(), length, hasher, second) for p in parts), length)

    return docs.mapInArrow(run, ROWS)


def _meet(rows: DataFrame, length: int) -> DataFrame:
    """Repeated spans (``REMOVED``), the given ones among them, and runs that share an
    anchor but not their text (``OPEN``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        for b in batches:
            is_block = pa.compute.equal(b.column("kind"), BLOCK)
            parts += b.filter(is_block).column("payload").to_pylist()
            yield b.filter(pa.compute.invert(is_block))
        if not parts:
            return
        kept, later = first_of_equal(unpack(parts, RUN))
        yield _removed(later, length)
        kept = kept[np.argsort(kept["anchor"], kind="stable")]
        equal = kept["anchor"][1:] == kept["anchor"][:-1]
        shared = np.zeros(len(kept), dtype=bool)
        shared[1:] |= equal
        shared[:-1] |= equal
        kept = kept[shared]
        yield _rows(OPEN, doc=kept["doc"], tie=kept["tie"], lo=kept["start"].astype(np.int64), anchor=kept["anchor"].view(np.int64), windows=kept["windows"].astype(np.int32))

    spread = F.coalesce("bucket", F.pmod(F.xxhash64("doc", "tie", "lo"), F.lit(1 << 30)).cast("int"))
    return rows.repartition(spread).mapInArrow(run, ROWS)


def pieces(texts: Texts, runs_: np.ndarray, row: np.ndarray, length: int, width: int, hasher: Hasher, second: Hasher) -> np.ndarray:
    """The windows of these runs as ``RUN`` records of windows whose places relative
    to the anchor are of one class of ``width``.  ``anchor`` is a hash of the run's
    anchor, the class and the bytes that all windows of the class share; equal windows
    are in pieces of equal ``anchor``."""
    if not len(runs_):
        return runs_
    sums = hasher.prefix(texts.data)
    n = len(texts.data) - GRAM + 1
    kh = mix((sums[GRAM:] - sums[:-GRAM]) * hasher.inverse[:n])
    begin = runs_["start"] + texts.rows[row]
    high = kh[begin[:, None] + np.arange(length - GRAM + 1)] & ~U64(255)
    place = begin + high.argmin(axis=1)
    windows = runs_["windows"].astype(np.int64)
    owner = np.repeat(np.arange(len(runs_)), windows)
    at = ranges(begin, windows)
    kind = (place[owner] - at) // width
    heads = runs(owner, kind)
    count = np.diff(np.append(heads, len(at)))
    owner, at, kind = owner[heads], at[heads], kind[heads]
    low = place[owner] - kind * width
    shared = hasher.span(sums, low, low + length - width + 1)
    out = runs_[owner]
    out["anchor"] = mix(shared ^ mix(runs_["anchor"][owner] + kind.astype(U64) * U64(0x9E3779B97F4A7C15)))
    out["body"] = second.span(second.prefix(texts.data), at, at + count + length - 1)
    out["start"] = at - texts.rows[row[owner]]
    out["windows"] = count
    return out


def _with_runs(docs: DataFrame, open_runs: DataFrame) -> DataFrame:
    """Documents that have open runs, with lists of them."""
    per_doc = materialize(open_runs.groupBy(F.col("doc").alias("_doc"), F.col("tie").alias("_tie")).agg(
        F.collect_list("lo").alias("lo"), F.collect_list("windows").alias("windows"), F.collect_list("anchor").alias("anchor")
    ), "open")
    return docs.join(per_doc, (F.col("doc") == F.col("_doc")) & (F.col("tie") == F.col("_tie"))).select("doc", "tie", "text", "lo", "windows", "anchor")


def _listed(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The listed runs as records, and each one's row."""
    lists = [part.column(c) for c in ("lo", "windows", "anchor")]
    counts = pa.compute.list_value_length(lists[0]).to_numpy()
    lo, windows, anchor = (x.flatten().to_numpy() for x in lists)
    row = np.repeat(np.arange(len(counts)), counts)
    records = np.zeros(len(lo), dtype=RUN)
    records["anchor"], records["start"], records["windows"] = anchor.view(U64), lo, windows
    records["doc"], records["tie"] = part.column("doc").to_numpy()[row], part.column("tie").to_numpy()[row]
    return records, row


def _split(docs: DataFrame, hot: DataFrame, length: int, width: int) -> DataFrame:
    """The hot runs in pieces, as blocks, and spans found repeated inside a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, second = Hasher(), Hasher(1)
        parts = slices(batches, "text", SCAN_BYTES)
        yield from _packed((pieces(Texts(p.column("text")), *_listed(p), length, width, hasher, second) for p in parts), length)

    return _with_runs(docs, hot).mapInArrow(run, ROWS)


def _settle(docs: DataFrame, open_runs: DataFrame, length: int) -> list[DataFrame]:
    """Tables with the repeated spans among open runs."""
    out: list[DataFrame] = []
    cold: DataFrame | None = None
    for width in (PIECE, 1):
        hot = materialize(open_runs.groupBy("anchor").count().filter(F.col("count") > HOT_RUNS).select("anchor"), "hot")
        if hot.isEmpty():
            break
        few = small_join(open_runs, hot, "anchor", "left_anti", 8)
        cold = few if cold is None else cold.unionByName(few)
        met = materialize(_meet(_split(docs, small_join(open_runs, hot, "anchor", "left_semi", 8), length, width), length), "met")
        out.append(met)
        open_runs = met.filter(F.col("kind") == OPEN)
    # what single windows leave open is one hash for different bytes, so it is not hot
    # by name: the join above puts the anchor first
    cold = open_runs if cold is None else cold.unionByName(open_runs)
    size = cold.agg(F.sum(F.col("windows").cast("bigint") + (length - 1))).first()[0] or 0
    buckets = max(SUFFIX_BUCKETS, 1 << (size // BUCKET_BYTES).bit_length())
    return [*out, materialize(_resolve(_texts_of_open(docs, cold, length, buckets), length, size), "resolved")]


def _texts_of_open(docs: DataFrame, open_runs: DataFrame, length: int, buckets: int) -> DataFrame:
    """The open runs with their bytes, in blocks by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = Texts(part.column("text"))
            records, row = _listed(part)
            begin = records["start"] + texts.rows[row]
            order = np.argsort(bucket_of(mix(records["anchor"]), buckets), kind="stable")
            records, begin = records[order], begin[order]
            bucket, payload = blocks(records, mix(records["anchor"]), buckets)
            sizes = records["windows"].astype(np.int64) + length - 1
            raw = texts.data[ranges(begin, sizes)].tobytes()
            ends = np.append(0, np.cumsum(sizes))
            cut = ends[np.append(0, np.cumsum([len(p) // RUN.itemsize for p in payload]))].tolist()
            yield _rows(BLOCK, bucket=bucket, payload=payload, body=[raw[a:b] for a, b in zip(cut, cut[1:])])

    return _with_runs(docs, open_runs).mapInArrow(run, ROWS)


def difference_cover(v: int) -> list[int]:
    """Residues whose pairwise differences are all residues modulo ``v``, chosen greedily."""
    cover, seen = [0], {0}
    while len(seen) < v:
        gain = lambda x: len(({(x - c) % v for c in cover} | {(c - x) % v for c in cover}) - seen)
        best = max(range(v), key=gain)
        cover.append(best)
        seen |= {(best - c) % v for c in cover} | {(c - best) % v for c in cover}
    return sorted(set(cover))


def meeting_distance(v: int, cover: list[int]) -> np.ndarray:
    """Table of the least distance at which positions with residues a and b both hit the cover."""
    inside = np.zeros(v, dtype=bool)
    inside[cover] = True
    table = np.full((v, v), -1, dtype=np.int64)
    for d in range(v - 1, -1, -1):
        on = np.roll(inside, -d)
        table[np.ix_(on, on)] = d
    return table


class SuffixSorter:
    """Orders positions of a byte string by the text that follows, far enough to tell
    windows of up to ``8 * DEPTH`` bytes apart."""

    _COVER = difference_cover(COVER)
    _MEET = meeting_distance(COVER, _COVER)

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(8 * (DEPTH + 2) + COVER, dtype=np.uint8)])
        n = len(padded) - 8
        self.word = np.zeros(n, dtype=U64)
        for k in range(8):
            self.word |= padded[k : k + n].astype(U64) << U64(56 - 8 * k)
        inside = np.zeros(COVER, dtype=bool)
        inside[self._COVER] = True
        sample = np.flatnonzero(inside[np.arange(len(data) + COVER) % COVER])
        order, group = self._by_words(sample, DEPTH)
        self.rank = np.full(len(data) + COVER, -1, dtype=np.int64)
        self.rank[sample[order]] = group

    def _by_words(self, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Permutation that sorts ``at`` by ``8 * depth`` bytes, and each place's class."""
        order, group = np.arange(len(at)), np.zeros(len(at), dtype=np.int64)
        open_ = np.arange(len(at))
        for w in range(depth):
            if not len(open_):
                break
            ids, key = order[open_], self.word[np.minimum(at[order[open_]] + 8 * w, len(self.word) - 1)]
            inner = np.lexsort((key, group[open_]))
            order[open_] = ids[inner]
            old, key = group[open_], key[inner]
            heads = runs(old, key)
            sizes = np.diff(np.append(heads, len(open_)))
            group[open_] = np.repeat(open_[heads], sizes)
            open_ = open_[np.repeat(sizes > 1, sizes)]
        return order, group

    def sort(self, at: np.ndarray) -> np.ndarray:
        """One block of positions in suffix order: first by ``COVER`` bytes, then by cover ranks."""
        order, group = self._by_words(at, COVER // 8)
        open_ = np.flatnonzero(self._tied(group))
        while len(open_):
            heads = runs(group[open_])
            sizes = np.diff(np.append(heads, len(open_)))
            here = at[order[open_]]
            pivot = np.repeat(here[heads + sizes // 2], sizes)
            d = self._MEET[here % COVER, pivot % COVER]
            side = np.sign(self.rank[here + d] - self.rank[pivot + d])
            inner = np.lexsort((side, group[open_]))
            order[open_] = order[open_][inner]
            side = side[inner]
            heads = runs(group[open_], side)
            sizes = np.diff(np.append(heads, len(open_)))
            group[open_] = np.repeat(open_[heads], sizes)
            open_ = open_[np.repeat((sizes > 1) & (side[heads] != 0), sizes)]
        return order

    @staticmethod
    def _tied(group: np.ndarray) -> np.ndarray:
        tied = np.zeros(len(group), dtype=bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        return tied

    def equal_before(self, at: np.ndarray, length: int) -> np.ndarray:
        """Whether each sorted position's ``length`` bytes equal those of the one before."""
        same = np.zeros(len(at), dtype=bool)
        left = np.arange(1, len(at))
        for step in [*range(0, length - 7, 8), length - 8]:
            left = left[self.word[at[left] + step] == self.word[at[left - 1] + step]]
        same[left] = True
        return same


def repeated_windows(records: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, tie, start) of the windows of these runs whose bytes also start earlier.
    ``data`` holds the runs' bytes end to end."""
    windows = records["windows"].astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(windows + length - 1)[:-1]])
    at = ranges(begin, windows)
    doc, tie = np.repeat(records["doc"], windows), np.repeat(records["tie"], windows)
    start = ranges(records["start"].astype(np.int64), windows)
    sorter = SuffixSorter(data)
    lead = sorter.word[at]
    # suffix buckets: ranges of leading words, so equal windows share one
    cuts = np.unique(np.sort(lead)[SORT_BLOCK::SORT_BLOCK]) if len(lead) > SORT_BLOCK else lead[:0]
    bucket = np.searchsorted(cuts, lead, side="right")
    by_bucket = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[by_bucket], np.arange(len(cuts) + 1), side="right")
    out_doc, out_tie, out_start, low = [], [], [], 0
    for high in ends.tolist():
        mine = by_bucket[low:high]
        low = high
        if not len(mine):
            continue
        mine = mine[sorter.sort(at[mine])]
        same = sorter.equal_before(at[mine], length)
        heads = np.flatnonzero(~same)
        label = np.cumsum(~same) - 1
        d, t, s = doc[mine], tie[mine], start[mine]
        first = np.lexsort((s, t, d, label))
        least = first[heads]
        later = (d != d[least][label]) | (t != t[least][label]) | (s != s[least][label])
        out_doc.append(d[later])
        out_tie.append(t[later])
        out_start.append(s[later])
    return np.concatenate(out_doc), np.concatenate(out_tie), np.concatenate(out_start)


def _resolve(rows: DataFrame, length: int, size: int) -> DataFrame:
    """Repeated spans among the open runs, whose texts have ``size`` bytes, bucket after bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[bytes], list[bytes]]] = {}
        for b in batches:
            for bucket, payload, body in zip(*(b.column(c).to_pylist() for c in ("bucket", "payload", "body"))):
                parts = held.setdefault(bucket, ([], []))
                parts[0].append(payload)
                parts[1].append(body)
        while held:
            _, (payload, body) = held.popitem()
            doc, tie, start = repeated_windows(unpack(payload, RUN), np.frombuffer(b"".join(body), dtype=np.uint8), length)
            if len(doc):
                doc, tie, lo, hi = merge_spans(doc, tie, start, start + length)
                yield _rows(REMOVED, doc=doc, tie=tie, lo=lo, hi=hi)

    tasks = -(-size // TASK_BYTES)
    many = tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(tasks, "bucket") if many else rows.repartition("bucket")).mapInArrow(run, ROWS)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        texts = Texts(part.column("text"))
        data, bounds = texts.data.tobytes(), texts.rows.tolist()
        kept, spans = [], []
        for r, (lo, hi) in enumerate(zip(part.column("lo").to_pylist(), part.column("hi").to_pylist())):
            text = data[bounds[r] : bounds[r + 1]]
            if not lo:
                kept.append(text)
                spans.append([])
                continue
            one = np.zeros(len(lo), dtype=np.int64)
            _, _, a, b = merge_spans(one, one, np.array(lo), np.array(hi))
            spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())])
            outside = zip([0, *b.tolist()], [*a.tolist(), len(text)])
            kept.append(b"".join([text[x:y] for x, y in outside]))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(np.diff(texts.rows)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "spans", "kept"],
        )


def remove_repeats(df: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, ``spans`` (removed byte ranges, start and
    end, in order) and ``kept`` (the remaining bytes; a cut may fall inside a character).

    Removed is each byte covered by a string of ``length`` bytes that also starts
    earlier: at a smaller id, or earlier in the same document.  Overlaps count, and
    the input alone decides.  A null or empty text has no bytes.  Null ids come after
    all others, each row a document.  Rows with one id and one text are one document: a
    string at the same place of both is no repeat.  Only the two named columns are read.  An empty
    table gives an empty table.

    Equal runs are reduced to their first inside each task before anything is
    shuffled, so copies of a text or a passage do not gather; hot anchors are split, so
    memory is bounded by a partition of packed runs or a suffix bucket of bounded text.  ``length`` is between 32 and 128.
    """
    if not 32 <= length <= 8 * DEPTH:
        raise ValueError("length must be between 32 and 128")
    both = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    docs = row_keys(both, "doc_id", "text").withColumnsRenamed({"__doc": "doc", "__tie": "tie"})
    keyed = docs.select("doc", "tie", "text")
    met = materialize(_meet(_scan(keyed, length), length), "met")
    removed = None
    for part in (met, *_settle(keyed, met.filter(F.col("kind") == OPEN), length)):
        spans = part.filter(F.col("kind") == REMOVED).select("doc", "tie", "lo", "hi")
        removed = spans if removed is None else removed.union(spans)
    per_doc = materialize(removed.groupBy(F.col("doc").alias("_doc"), F.col("tie").alias("_tie")).agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi")), "spans")
    joined = docs.join(per_doc, (F.col("doc") == F.col("_doc")) & (F.col("tie") == F.col("_tie")), "left")
    return joined.select("doc_id", "text", "lo", "hi").mapInArrow(
        _cut, "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"
    )


def repeats_query(docs: DataFrame) -> DataFrame:
    """All documents without their repeated 100-byte strings."""
    return remove_repeats(docs, 100).select(
        "doc_id", "n_bytes",
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
