"""Quality by compression: which of two dictionaries makes a text smaller.

One zstandard dictionary is built from good labelled text, one from bad.  A text is
compressed with each, block by block, so that its length does not matter; the
difference of the sizes per byte is the evidence, and a logistic curve fitted on other
labelled documents turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from risklens.llm.records import small_join
from risklens.llm.textvec import slices
from risklens.session import materialize


@dataclass(frozen=True)
class CompressionRules:
    """The model is fitted on a bounded sample: of each label at most ``per_label``
    documents build the dictionary and at most ``per_label`` others the curve, the first
    by hash of the id, and of those at most ``sample_bytes`` of text."""

    per_label: int = 2000
    sample_bytes: int = 16 << 20
    dictionary_bytes: int = 256 << 10
    block_bytes: int = 4096
    level: int = 3
    steepest: float = 0.15  # a difference per byte beyond this says no more
    prior_bytes: int = 64  # so many bytes without evidence are added to each text


def held_out(doc_id: Column) -> Column:
    """Whether the id's checksum keeps its label out of the fit (never for null)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("bigint").cast("string")), F.lit(5)) == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rules: CompressionRules) -> DataFrame:
    """(label, place, text) of the sampled documents; the places of a label count from
    1 and alternate between the dictionary's documents (odd) and the curve's (even).

    ``labels`` has (doc_id, label), label 0 or 1.  An id with several labels has the
    least; of several texts of one id the sample has the one whose hash is least."""
    spark, order = docs.sparkSession, F.xxhash64(F.lit(11), "_id")
    each = labels.filter("doc_id is not null and label in (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(F.min("label").cast("int").alias("label"))
    wanted = 2 * rules.per_label
    counts = {r[0]: r[1] for r in each.groupBy("label").count().collect()}  # two rows
    share = lambda n: int(min(1.0, 4 * wanted / n) * (1 << 30))
    limit = F.lit(0)
    for label, n in sorted(counts.items()):
        limit = F.when(F.col("label") == label, F.lit(share(n))).otherwise(limit)
    # a range of hashes bounds what is ordered, however many labels there are
    thin = each.filter(F.pmod(order, F.lit(1 << 30)) <= limit)
    first = thin.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(order, "_id"))).filter(F.col("place") <= wanted)
    chosen = materialize(first, "labelled")
    sized = small_join(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.xxhash64("text").alias("h")), chosen, F.col("doc_id") == F.col("_id"), "inner", 24)
    one = sized.groupBy("label", "place", "_id").agg(F.min(F.struct("h", "size")).alias("m")).select("label", "place", "_id", "m.h", "m.size")
    part = Window.partitionBy("label", F.col("place") % 2).orderBy("place")
    fits = materialize(one.withColumn("total", F.sum("size").over(part)).filter(F.col("total") <= rules.sample_bytes), "labelled")
    texts = small_join(docs, fits, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("h")), "inner", 32)
    # copies of a row: one text for each place
    return materialize(texts.groupBy("label", "place").agg(F.first("text").alias("text")), "labelled") if counts else spark.createDataFrame([], "label int, place int, text string")


def _dictionary(lines: Iterable[str], rules: CompressionRules) -> bytes:
    """Dictionary bytes for a text of these lines; the text itself where it is too
    short to train one."""
    whole = "\n".join(lines).encode()
    blocks = [whole[i : i + rules.block_bytes] for i in range(0, len(whole), rules.block_bytes)]
    try:
        return zstandard.train_dictionary(rules.dictionary_bytes, blocks).as_bytes()
    except zstandard.ZstdError:
        return whole[: rules.dictionary_bytes]


class SizeDifference:
    """Bytes saved by the good dictionary against the bad one, per byte of text."""

    def __init__(self, bad: bytes, good: bytes, rules: CompressionRules):
        self.rules, self.coders = rules, []
        for body in (bad, good):
            loaded = zstandard.ZstdCompressionDict(body)
            loaded.precompute_compress(level=rules.level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=loaded, level=rules.level, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, raw: bytes) -> tuple[int, int]:
        """Compressed bytes of all blocks with the bad and the good dictionary."""
        blocks = [raw[i : i + self.rules.block_bytes] for i in range(0, len(raw), self.rules.block_bytes)]
        bad, good = (sum(len(c.compress(b)) for b in blocks) for c in self.coders)
        return bad, good


def evidence(bad: np.ndarray, good: np.ndarray, length: np.ndarray, rules: CompressionRules, neutral: float = 0.0) -> np.ndarray:
    """Difference per byte; short texts are drawn to the ``neutral`` value."""
    return np.clip((bad - good + neutral * rules.prior_bytes) / (length + rules.prior_bytes), -rules.steepest, rules.steepest)


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and intercept of a weighted logistic curve; a slight
    pull towards 0 keeps separable labels finite."""
    total = max(float(weight.sum()), 1e-9)
    yes = (float(weight[y == 1].sum()) + 1) / (total + 2)
    flat = 0.0, float(np.log(yes / (1 - yes)))
    if not (y == 0).any() or not (y == 1).any() or float(np.ptp(x)) == 0:
        return flat
    scale = float(x.std())
    design, w = np.stack([x / scale, np.ones(len(x))], axis=1), np.zeros(2)
    pull = np.diag([1e-2 * total / len(x), 1e-6 * total / len(x)])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + pull @ w
        step = np.linalg.solve((design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + pull, gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0] / scale), float(w[1])) if w[0] > 0 else flat


@dataclass(frozen=True)
class CompressionModel:
    bad: bytes
    good: bytes
    slope: float
    intercept: float
    neutral: float
    rules: CompressionRules


def train_model(docs: DataFrame, labels: DataFrame, rules: CompressionRules = CompressionRules()) -> CompressionModel:
    """Dictionaries and curve from the bounded sample, which comes to the driver.

    Lines count once in a dictionary, and lines that both labels have say nothing and
    are left out.  The curve weighs the labels by their shares among all labelled
    documents, and the evidence at which it gives the share of label 1 is the neutral
    value.  Without documents of both labels every text gets the share of label 1
    (one half without any)."""
    sample = labelled_sample(docs, labels, rules).orderBy("label", "place").collect()
    lines: list[dict[str, None]] = [{}, {}]
    for r in sample:
        if r.place % 2:
            lines[r.label].update(dict.fromkeys((r.text or "").split("\n")))
    bad, good = (_dictionary((x for x in lines[c] if x not in lines[1 - c]), rules) for c in (0, 1))
    curve = [r for r in sample if r.place % 2 == 0] or sample
    differ, texts = SizeDifference(bad, good, rules), [(r.text or "").encode() for r in curve]
    sizes = np.array([differ.sizes(t) for t in texts], dtype=np.float64).reshape(-1, 2)
    x = evidence(sizes[:, 0], sizes[:, 1], np.array([len(t) for t in texts]), rules)
    y = np.array([r.label for r in curve], dtype=np.int64)
    shares = {r[0]: r[1] for r in labels.filter("label in (0, 1)").groupBy("label").count().collect()}
    weight = np.array([shares[c] / max((y == c).sum(), 1) for c in y.tolist()])
    weight = weight * len(y) / weight.sum() if len(y) else weight
    slope, intercept = fit_curve(x, y, weight)
    yes = (float(weight[y == 1].sum()) + 1) / (float(weight.sum()) + 2)
    neutral = float(np.clip((np.log(yes / (1 - yes)) - intercept) / slope, -rules.steepest, rules.steepest)) if slope else 0.0
    return CompressionModel(bad, good, slope, intercept, neutral, rules)


def quality_scores(df: DataFrame, model: CompressionModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, n_bytes, bad_bytes and good_bytes (the text's size with
    either dictionary) and ``score``, the probability of label 1.

    Whole texts are compressed.  A null or empty text has no evidence and gets the share
    of label 1 among the labelled documents.  Ids may be null or repeated; equal texts get equal scores.  Only the two
    named columns are read, so any further columns may have any name.  An empty
    table gives an empty table.  Nothing is shuffled.
    """
    rules, sent = model.rules, df.sparkSession.sparkContext.broadcast((model.bad, model.good))  # two dictionaries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        differ = SizeDifference(*sent.value, rules)
        for part in slices(batches, "text"):
            length, bad, good = [], [], []
            for raw in part.column("text").cast(pa.large_binary()):
                body = raw.as_py() or b""
                sizes = differ.sizes(body)
                length.append(len(body))
                bad.append(sizes[0])
                good.append(sizes[1])
            n, b, g = (np.array(c, dtype=np.int64) for c in (length, bad, good))
            score = 1 / (1 + np.exp(-np.clip(model.slope * evidence(b, g, n, rules, model.neutral) + model.intercept, -30, 30)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in (n, b, g, score))], names=["doc_id", "n_bytes", "bad_bytes", "good_bytes", "score"])

    rows = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, bad_bytes bigint, good_bytes bigint, score double")


def score_query(docs: DataFrame, labels: DataFrame, rules: CompressionRules = CompressionRules()) -> DataFrame:
    """Every document's score, from the labels of documents that are not held out."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    scores = quality_scores(docs, train_model(docs, known, rules))
    return scores.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_bytes", "bad_bytes", "good_bytes"
    )
