"""Soft-membership mixing of documents to target domain weights.

A classifier trained on labelled documents gives every document its probabilities
over domains.  Document rates are then fitted so that the expected tokens of each
domain, sum of rate x tokens x probability, match the targets: nonnegative least
squares by projected gradient steps.

In the metric that weighs a document by its tokens, a step is
``rate <- clip(rate - p . M^-1 (totals - targets))`` with M = sum of tokens x p p',
so a rate depends on the probabilities alone and a document needs no state but its
row: each round is one aggregation that replays the rounds' directions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from risklens.llm.linear import Logistic, distinct, features, posteriors
from risklens.llm.records import aside, small_join
from risklens.llm.textvec import Hasher, Texts, slices
from risklens.session import materialize


@dataclass(frozen=True)
class MixRules:
    """``targets``: share of all tokens that each domain shall have.  At most
    ``per_domain`` labelled documents of each domain, the first by hash of the id, train
    the classifier."""

    targets: dict[str, float] = field(default_factory=lambda: {"clean": 0.92, "low": 0.04, "toxic": 0.04})
    per_domain: int = 1000
    max_rate: float = 4.0
    rounds: int = 60
    tolerance: float = 1e-6


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table; nulls count as quality 1 and not toxic."""
    domain = F.when(F.coalesce("toxic", F.lit(0)) == 1, "toxic").when(F.coalesce("quality", F.lit(1)) == 0, "low").otherwise("clean")
    return labels.filter("doc_id is not null").select("doc_id", domain.alias("domain"))


def _word_features(part: pa.RecordBatch, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words per row, and distinct (row, feature) pairs."""
    texts = Texts(part.column("text"), lower=True)
    starts, ends = texts.words()
    first = texts.split(starts)
    h = hasher.span(hasher.prefix(texts.data), starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)
    row = np.repeat(np.arange(part.num_rows), np.diff(first))
    owner, feature = distinct(row, features(h, False))
    return np.diff(first), owner, feature


def train(docs: DataFrame, labelled: DataFrame, domains: Sequence[str], per_domain: int) -> Logistic:
    """Classifier from at most ``per_domain`` labelled documents of each domain."""
    named = labelled.filter(F.col("domain").isin(*domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    shares = {r[0]: r[1] for r in named.groupBy("domain").agg(F.count(F.lit(1))).collect()}  # one row per domain
    total = sum(shares.values())
    # of a large domain only a hash range of about four times per_domain ids is ordered
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    within = F.lit(False)
    for name, count in shares.items():
        within = within | ((F.col("domain") == name) & (spot <= int(min(1.0, 4 * per_domain / count) * (1 << 30))))
    order = Window.partitionBy("domain").orderBy("spot", "doc_id")
    few = named.filter(within).withColumn("spot", spot)
    # bounded: per_domain rows of each of a few domains
    chosen = few.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_domain).select(F.col("doc_id").alias("chosen_id"), "domain")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for part in slices(batches, "text"):
            _, owner, feature = _word_features(part, hasher)
            cut = np.searchsorted(owner, np.arange(part.num_rows + 1)).tolist()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("domain"), pa.array([feature[a:b].astype("<i2").tobytes() for a, b in zip(cut, cut[1:])], pa.binary())],
                names=["doc_id", "domain", "features"],
            )

    texts, y = [], []
    training = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id")).select("doc_id", "text", "domain")
    found = training.mapInArrow(run, "doc_id bigint, domain string, features binary")
    # an id that many rows carry trains once
    for row in found.groupBy("doc_id").agg(F.min("domain").alias("domain"), F.min("features").alias("features")).orderBy("doc_id").collect():
        texts.append(np.frombuffer(row.features, dtype="<i2").astype(np.int64))
        y.append(list(domains).index(row.domain))
    return Logistic(texts, y, len(domains), priors=[shares.get(d, 0) / total for d in domains] if total else None)


def domain_posteriors(docs: DataFrame, model: Logistic) -> DataFrame:
    """doc_id, text_hash, n_tokens (words) and ``p``, the probability of each domain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for part in slices(batches, "text"):
            n, owner, feature = _word_features(part, hasher)
            p = posteriors(model.scores(feature, owner, part.num_rows))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array(n.astype(np.int64)), pa.array(list(p), pa.list_(pa.float64()))],
                names=["doc_id", "text_hash", "n_tokens", "p"],
            )

    return docs.mapInArrow(run, "doc_id bigint, text_hash bigint, n_tokens bigint, p array<double>")


def _rate(directions: list[np.ndarray], max_rate: float) -> Column:
    """Rate after the given steps, from a document's probabilities."""
    rate = F.lit(1.0)
    if directions:
        steps = F.array(*[F.array(*[F.lit(float(x)) for x in d]) for d in directions])
        dot = lambda g: sum((F.col("p")[i] * g[i] for i in range(1, len(directions[0]))), F.col("p")[0] * g[0])
        rate = F.aggregate(steps, rate, lambda r, g: F.least(F.greatest(r - dot(g), F.lit(0.0)), F.lit(max_rate)))
    return rate


def fit_rates(soft: DataFrame, shares: Sequence[float], rules: MixRules) -> tuple[DataFrame, list[float]]:
    """``soft`` with ``rate``, and the expected tokens per domain that result.

    Domains that no document belongs to are left out of the fit."""
    c = len(shares)
    entries = [F.sum(F.col("n_tokens") * F.col("p")[i] * F.col("p")[j]) for i in range(c) for j in range(c)]
    head = soft.agg(F.sum("n_tokens").alias("n"), *[e.alias(f"m{k}") for k, e in enumerate(entries)]).first()
    total = float(head.n or 0)
    metric = np.array([float(head[f"m{k}"] or 0) for k in range(c * c)]).reshape(c, c)
    inverse = np.linalg.pinv(metric, rcond=1e-9)
    goal, directions, reached = np.array(shares) * total, [], np.zeros(c)
    for _ in range(rules.rounds if total else 0):
        rate = _rate(directions, rules.max_rate)
        row = soft.agg(*[F.sum(rate * F.col("n_tokens") * F.col("p")[i]).alias(f"t{i}") for i in range(c)]).first()
        reached = np.array([float(row[f"t{i}"]) for i in range(c)])
        if np.abs(reached - goal).max() <= rules.tolerance * total:
            break
        step = inverse @ (reached - goal)
        if np.abs(step).max() < 1e-9:
            break
        directions.append(step)
    return soft.withColumn("rate", _rate(directions, rules.max_rate)), reached.tolist()


def mixing_rates(df: DataFrame, labelled: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """One row per document: doc_id, text_hash, n_tokens, ``p`` (domain to probability),
    rate, copies.

    ``labelled`` has (doc_id, domain).  Copies round the rate by the hash of the id and
    of the text, so their expected number is the rate, for rows without an id too.  A null
    or empty text has no tokens and keeps the probabilities of a text without known words.
    Repeated rows are documents of their own with equal rates and copies.  Domains without labelled documents
    get a probability near 0.  Targets that nonnegative rates up to ``max_rate`` cannot
    reach are met as closely as least squares allow.  An empty table gives an empty table.
    """
    docs = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    names = sorted(rules.targets)
    model = train(docs, labelled, names, rules.per_domain)
    soft = materialize(domain_posteriors(docs, model), "posteriors")
    fitted, _ = fit_rates(soft, [rules.targets[x] for x in names], rules)
    chance = F.pmod(F.xxhash64(F.lit("copies"), "doc_id", "text_hash"), F.lit(1 << 20)) / float(1 << 20)
    return fitted.select(
        "doc_id", "text_hash", "n_tokens", F.map_from_arrays(F.array(*[F.lit(x) for x in names]), "p").alias("p"), "rate",
        F.floor(F.col("rate") + chance).cast("int").alias("copies"),
    )


def mix_query(docs: DataFrame, labels: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """Every document's domain probabilities, rate and number of copies."""
    rates = mixing_rates(docs, domains_of(labels), rules)
    return rates.select("doc_id", "n_tokens", *[F.col("p")[x].alias(f"p_{x}") for x in sorted(rules.targets)], "rate", "copies")


def mix_stage(docs: DataFrame, labels: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """Each document as often as its copies say; same columns, whatever the names of
    further ones.  Rows of one id, or without one, have the copies of their own text."""
    rates = mixing_rates(docs, domains_of(labels), rules).filter("copies > 0").select("doc_id", "text_hash", "copies")
    rates = materialize(rates.dropDuplicates(["doc_id", "text_hash"]), "copies")
    plain, names = aside(docs)
    row = F.col(names["doc_id"]).cast("bigint").eqNullSafe(F.col("doc_id"))
    text = F.xxhash64(F.col(names["text"]).cast("string")) == F.col("text_hash")
    joined = small_join(plain, rates, row & text, "inner", 24)
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*names.values()).toDF(*docs.columns)
