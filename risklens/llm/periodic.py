"""Periodic runs of words: an online pass over sparse diagonals of matches.

Words q apart that agree, one after another, lie on the diagonal of lag q.  The pass
reads a text's words in order and keeps, for the lags that are open, how far their
diagonal has matched; at each word its earlier occurrences carry their lags on, and
a lag that is not carried on closes: if it is long enough, its run is emitted then.

A frequent word has very many earlier occurrences, nearly all on diagonals that
end at once.  So an occurrence only opens a lag if it is the nearest one followed by
the same m words, for the power of two m with m/2 < lag <= m.  Nothing is lost: a
run of at least four periods q holds, at every word but its first q and last m,
an occurrence q before whose next m words agree; a nearer one would, by the theorem
of Fine and Wilf, give the stretch a smaller period.  For the same reason a smallest
period is all that a lag can be, and the diagonal ends exactly m words after the
last such occurrence.  A text of n words costs O(n log n) at worst.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklens.llm.textvec import slices

SPACE = "[\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class RunRules:
    """A run has at least ``min_words`` words and ``min_periods`` whole periods (four or
    more: the proof above needs them)."""

    min_words: int = 6
    min_periods: int = 4


def earlier_occurrences(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, lags), by position: the words' nearest earlier occurrences with the
    same m words from there on, m/2 < lag <= m, for m = 1, 2, 4, ..."""
    n, m = len(ids), 1
    rank = ids.astype(np.int64)
    places, lags = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    while 2 * m <= n:
        live = np.flatnonzero(rank >= 0)
        order = live[np.argsort(rank[live], kind="stable")]
        same = rank[order[1:]] == rank[order[:-1]]
        at, lag = order[1:][same], (order[1:] - order[:-1])[same]
        if not len(at):
            break
        near = (lag <= m) & (2 * lag > m)
        places.append(at[near])
        lags.append(lag[near])
        # twice as many words: two neighbours that both occur again
        again = np.zeros(n, dtype=bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        live = np.flatnonzero(again[: n - m] & again[m:])
        pair = rank[live] * (int(rank.max()) + 1) + rank[live + m]
        _, back, count = np.unique(pair, return_inverse=True, return_counts=True)
        rank = np.full(n, -1, dtype=np.int64)
        rank[live] = np.where(count[back] > 1, back, -1)
        m *= 2
    place, lag = np.concatenate(places), np.concatenate(lags)
    by = np.argsort(place, kind="stable")
    return place[by], lag[by]


def runs_of(ids: np.ndarray, rules: RunRules = RunRules()) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    found: list[tuple[int, int, int]] = []
    opened: dict[int, tuple[int, int]] = {}  # open lags: first and last word that carried them on

    def close(lag: int, first: int, last: int) -> None:
        start, end = first - lag, last + (1 << (lag - 1).bit_length())
        if end - start >= max(rules.min_words, rules.min_periods * lag):
            found.append((start, end - start, lag))

    now = -1
    for i, lag in zip(*(x.tolist() for x in earlier_occurrences(ids))):
        if i > now:  # the word before did not carry these on
            for q in [q for q, (_, last) in opened.items() if last < i - 1]:
                close(q, *opened.pop(q))
            now = i
        opened[lag] = (opened[lag][0] if lag in opened else i, i)
    for q, (first, last) in opened.items():
        close(q, first, last)
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Marks the words that no run contains after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def periodic_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: RunRules = RunRules()) -> DataFrame:
    """One row per row: doc_id, ``runs`` (array of start, length, period; words
    numbered from 0, by start, then period) and ``collapsed`` (the words that no run
    contains after its first period, joined by a blank).

    Words are runs without ASCII white space and are compared as bytes.  A null, empty
    or blank text has no runs and collapses to an empty string.  Ids may be null or
    repeated: each row is a document of its own.  Only the two named columns are read,
    so any further columns may have any name.  An empty table gives an empty table.
    Nothing is shuffled; a task holds one document's words at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            starts, lengths, periods, ends, texts = [], [], [], [0], []
            for raw in part.column("text").cast(pa.large_binary()):
                words = (raw.as_py() or b"").split()
                number: dict[bytes, int] = {}
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
                found = runs_of(ids, rules)
                for s, l, p in found:
                    starts.append(s)
                    lengths.append(l)
                    periods.append(p)
                ends.append(len(starts))
                texts.append(b" ".join([words[i] for i in np.flatnonzero(kept_words(len(words), found))] if found else words))
            each = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (starts, lengths, periods)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "runs", "collapsed"],
            )

    rows = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def with_planted_period(doc_id: Column, text: Column) -> Column:
    """The text, made periodic where the checksum of the id is divisible by ten."""
    h = F.crc32(doc_id.cast("string"))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        g = F.floor(h / 10).cast("bigint")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("bigint")
        at = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))
        return F.array_join(F.transform(at, lambda i: F.get(w, i.cast("int"))), " ")

    planted = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit(""))), 1)
    return F.when((F.pmod(h, F.lit(10)) == 0) & text.isNotNull(), planted).otherwise(text)


def runs_query(docs: DataFrame) -> DataFrame:
    """Every document's runs as one row: number, the run with most periods, and
    digests of the runs and of the collapsed text."""
    made = docs.select("doc_id", with_planted_period(F.col("doc_id").cast("bigint"), F.col("text")).alias("text"))
    out = periodic_runs(made)
    # more periods exactly: products of counts of words, below 2**63 for any text
    before = lambda x, y: F.when(x["length"] * y["period"] != y["length"] * x["period"], x["length"] * y["period"] > y["length"] * x["period"]).otherwise(
        F.struct(x["start"], x["period"]) < F.struct(y["start"], y["period"])
    )
    best = F.aggregate("runs", F.try_element_at("runs", F.lit(1)), lambda b, x: F.when(before(x, b), x).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return out.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
