"""Order-preserving packing of tokenised documents into fixed windows.

The tokens of a task's documents form one stream.  Dynamic programming chooses
the cuts among document ends and sentence ends so that padding plus penalties
for cutting a document are least:

    cost[j] = min over i of cost[i] + (window - (at[j] - at[i])) + penalty[j],
    at[j] - at[i] <= window

``cost[i] + at[i]`` is all that depends on i, so a monotone queue gives each
minimum in constant time.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklens.llm.textvec import Hasher, Texts, slices

PIECES = (
    "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
)


SLICE = 1 << 20  # bytes of text that are hashed at a time: small arrays beside the remembered words


@dataclass(frozen=True)
class PackRules:
    """``sentence`` and ``forced`` are penalties in tokens for a cut at a sentence
    end and for one inside a sentence; a cut at a document end is free."""

    window: int = 1024
    sentence: int = 24
    forced: int = 512
    block_tokens: int = 1 << 20  # the program runs over blocks of whole documents
    cached_words: int = 1 << 18  # words whose ids a task remembers; only speed depends on it


class WordTokenizer:
    """Byte-pair ids of whole texts, encoding every distinct word once.

    Texts are cut before each run of ASCII white space that follows a word.  The
    vocabulary's pattern never joins text across such a cut, unless Unicode
    white space stands next to it; texts with such characters are encoded whole.
    """

    # white space outside ASCII, as UTF-8, and the start of "next line"
    _ODD = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]

    def __init__(self, ranks_path: str, pattern: str, cached: int):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cached = cached
        self.known: dict[tuple[int, int], bytes] = {}
        self.hashers = Hasher(0), Hasher(1)
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        ends = (b".", b"!", b"?")
        self.ends_sentence = np.array([p.rstrip(b"\"')").endswith(ends) or b"\n" in p for p in pieces])
        self.opens = np.array([p[:1] in (b" ", b"\n", b"\t", b"\r") for p in pieces])

    def _encode(self, text: bytes) -> bytes:
        return np.asarray(self.coder.encode_ordinary(text.decode("utf-8")), dtype="<u4").tobytes()

    def rows(self, texts: Texts) -> list[bytes]:
        """Little-endian 32-bit ids of every row."""
        data, raw = texts.data, texts.data.tobytes()
        starts, ends = texts.words()
        # a chunk: the white space before a word, and the word
        first = texts.split(starts)
        heads = np.empty_like(starts)
        if len(starts):
            heads[1:] = ends[:-1]
            lead = first[:-1][first[:-1] < first[1:]]
            heads[lead] = texts.rows[:-1][first[:-1] < first[1:]]
            a, b = (h.words(data, heads, ends) for h in self.hashers)
            uniq, at, back = np.unique(a, return_index=True, return_inverse=True)
            clash = set(np.searchsorted(first, np.flatnonzero(b != b[at][back]), side="right").tolist())
            keys = list(zip(uniq.tolist(), b[at].tolist()))
            known, coded = self.known, [None] * len(keys)
            for i, key in enumerate(keys):
                ids = known.get(key)
                if ids is None:
                    ids = self._encode(raw[heads[at[i]] : ends[at[i]]])
                    if len(known) < self.cached:
                        known[key] = ids
                coded[i] = ids
        else:
            back, coded, clash = np.zeros(0, dtype=np.int64), [], set()
        order = back.tolist()
        bounds, out = texts.rows.tolist(), []
        for r in range(len(bounds) - 1):
            lo, hi = bounds[r], bounds[r + 1]
            i, j = int(first[r]), int(first[r + 1])
            whole = raw[lo:hi]
            if r + 1 in clash or any(x in whole for x in self._ODD):
                out.append(self._encode(whole))
                continue
            ids = b"".join([coded[k] for k in order[i:j]])
            tail = int(ends[j - 1]) if j > i else lo
            out.append(ids + self._encode(raw[tail:hi]) if tail < hi else ids)
        return out


def choose_cuts(at: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Indices into ``at`` of the cheapest cuts.  ``at`` are the allowed positions,
    ascending from 0 to the end, neighbours at most ``window`` apart."""
    places, fines = at.tolist(), penalty.tolist()
    cost, origin = [0] * len(places), [0] * len(places)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + position, index), ascending
    for j in range(1, len(places)):
        here = places[j]
        low = here - window
        while places[queue[0][1]] < low:
            queue.popleft()
        best, i = queue[0]
        origin[j] = i
        cost[j] = best + window - here + fines[j]
        value = cost[j] + here
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [], len(places) - 1
    while j > 0:
        cuts.append(j)
        j = origin[j]
    return cuts[::-1]


def allowed_cuts(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, opens: np.ndarray, rules: PackRules) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, and their penalties."""
    penalty = np.full(len(ids) + 1, -1, dtype=np.int64)
    penalty[1:-1][ends[ids[:-1]] & opens[ids[1:]]] = rules.sentence
    penalty[0] = 0
    penalty[doc_ends] = 0
    at = np.flatnonzero(penalty >= 0)
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > rules.window)
    if len(wide):  # a sentence longer than a window is cut where windows fill up
        extra = np.concatenate([np.arange(at[g] + rules.window, at[g + 1], rules.window) for g in wide])
        penalty[extra] = rules.forced
        at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def pack_documents(
    df: DataFrame, ranks_path: str, pattern: str, rules: PackRules = PackRules(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and
    ``ids`` (little-endian 32-bit).

    A document is the ids of its text and a closing 0; a null or empty text is the 0
    alone.  Documents keep their order.  Repeated rows and null ids are documents
    like any other.  Only the two named columns are read, so others cannot clash.
    An empty table gives an empty table.

    No shuffle: each task packs its input split, block by block of whole documents,
    so memory is bounded by a block or by the longest text.  The last window of a
    block is the only one that is short for that.
    """
    plain = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def blocks(batches: Iterator[pa.RecordBatch], coder: WordTokenizer):
        ids: list = []
        rows: list[bytes] = []
        size = 0
        for part in slices(batches, "text", SLICE):
            for doc, coded in zip(part.column("doc_id").to_pylist(), coder.rows(Texts(part.column("text")))):
                ids.append(doc)
                rows.append(coded + b"\0\0\0\0")
                size += len(coded) // 4 + 1
                if size >= rules.block_tokens:
                    yield ids, rows
                    ids, rows, size = [], [], 0
        if ids:
            yield ids, rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordTokenizer(ranks_path, pattern, rules.cached_words)
        sequence = TaskContext.get().partitionId() << 33
        for docs, rows in blocks(batches, coder):
            tokens = np.frombuffer(b"".join(rows), dtype="<u4")
            lengths = np.array([len(r) // 4 for r in rows], dtype=np.int64)
            doc_ends = np.cumsum(lengths)
            at, penalty = allowed_cuts(tokens, doc_ends, coder.ends_sentence, coder.opens, rules)
            cuts = at[choose_cuts(at, penalty, rules.window)]
            # a piece ends where a document or a window ends
            ends = np.union1d(cuts, doc_ends)
            starts = np.concatenate([[0], ends[:-1]])
            doc = np.searchsorted(doc_ends, starts, side="right")
            seq = np.searchsorted(cuts, starts, side="right")
            first = np.concatenate([[0], cuts])[seq]
            raw = tokens.tobytes()
            yield pa.RecordBatch.from_arrays([
                pa.array([docs[d] for d in doc.tolist()], pa.int64()),
                pa.array(starts - (doc_ends - lengths)[doc]), pa.array(ends - starts), pa.array(lengths[doc]),
                pa.array(sequence + seq), pa.array(starts - first),
                pa.array([raw[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist())], pa.binary()),
            ], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            sequence += len(cuts)

    return plain.mapInArrow(run, PIECES)


def pack_query(docs: DataFrame) -> DataFrame:
    """All documents in windows of 1024 ids of the public byte-level vocabulary."""
    return with_digest(pack_public(docs)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def pack_public(docs: DataFrame, rules: PackRules = PackRules()) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, rules)


def with_digest(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("ids_crc32", F.crc32("ids").cast("bigint"))
