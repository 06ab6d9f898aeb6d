"""Toxicity by a chain of linear classifiers."""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listings_spark.llm.common import stored, whole

SAMPLE = 10_000  # labelled documents that the chain is fitted on, drawn by a hash of their ids
FEATURES = 4096  # kept for each category
LEAST_DOCS = 6  # of the sample that a feature must stand in
LEAST_CHI = 40.0
FOLDS = 4
PREFIXES = (4, 5)  # letters; compounds and inflected forms share their beginnings
THRESHOLD = 0.5
CHAIN = ("low_quality", "toxic")
TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]{2,}")


def features(text: str) -> set[str]:
    """Distinct words, runs of symbols, and beginnings of words, lower-cased."""
    words = set(TOKEN.findall(text.lower()))
    found = {f"={w}" for w in words}
    for n in PREFIXES:
        found.update(f"{n}{w[:n]}" for w in words if len(w) > n)
    return found


class Linear(NamedTuple):
    """A logistic model over present features and the probabilities of earlier categories."""

    bias: float
    weights: np.ndarray
    earlier: np.ndarray


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: np.ndarray, columns: np.ndarray, before: np.ndarray, y: np.ndarray, width: int,
        penalty: float = 1e-4, steps: int = 300) -> Linear:
    """Logistic regression by accelerated gradient steps; entry i says rows[i] has columns[i]."""
    n, k = before.shape
    if not n or y.min() == y.max():
        rate = float(y.mean()) if n else 0.0
        return Linear(-30.0 if rate < 0.5 else 30.0, np.zeros(width), np.zeros(k))
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
    heavy = np.bincount(rows, minlength=n).max(initial=0) + k + 1
    rate = 1.0 / (0.25 * balance.max() * heavy + penalty)
    w = last = np.zeros(width + k + 1)
    for step in range(1, steps + 1):
        at = w + (w - last) * (step - 1) / (step + 2)
        score = at[-1] + before @ at[width:-1]
        score = score + np.bincount(rows, weights=at[columns], minlength=n)
        off = balance * (_sigmoid(score) - y) / n
        slope = np.concatenate([
            np.bincount(columns, weights=off[rows], minlength=width), before.T @ off, [off.sum()]
        ])
        slope[:-1] += penalty * at[:-1]
        # columns are sparse, so each gets a step of its own size
        w, last = at - slope * (rate * _scale(columns, width, n, k, heavy)), w
    return Linear(float(w[-1]), w[:width], w[width:-1])


def _scale(columns, width, n, k, heavy):
    share = np.bincount(columns, minlength=width) / n
    return np.concatenate([np.minimum(heavy, 1.0 / np.maximum(share, 1.0 / n)), np.ones(k + 1)])


def _scores(model: Linear, rows, columns, before, n):
    return _sigmoid(
        model.bias + before @ model.earlier + np.bincount(rows, weights=model.weights[columns], minlength=n)
    )


def fit_chain(rows, columns, labels: np.ndarray, fold: np.ndarray, width: int) -> list[Linear]:
    """One model per column of labels, each given the probabilities of those before it.

    While fitting, the earlier probabilities of a document come from models that did not see its
    fold, so that later models meet them as unsure as they will be on new documents.
    """
    n = len(labels)
    before = np.zeros((n, 0))
    models = []
    for category in range(labels.shape[1]):
        y = labels[:, category].astype(float)
        models.append(fit(rows, columns, before, y, width))
        if category == labels.shape[1] - 1:
            break
        unseen = np.zeros(n)
        for f in range(FOLDS):
            train = np.flatnonzero(fold != f)
            place = np.full(n, -1)
            place[train] = np.arange(len(train))
            used = place[rows] >= 0
            part = fit(place[rows[used]], columns[used], before[train], y[train], width)
            held = fold == f
            unseen[held] = _scores(part, rows, columns, before, n)[held]
        before = np.column_stack([before, unseen])
    return models


def _count_batches(chain: int):
    def run(batches):
        for batch in batches:
            seen, hits = Counter(), [Counter() for _ in range(chain)]
            labels = [batch.column(2 + i).to_pylist() for i in range(chain)]
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = features(text)
                seen.update(found)
                for c in range(chain):
                    if labels[c][i]:
                        hits[c].update(found)
            names = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, type=pa.string()), pa.array([seen[f] for f in names], type=pa.int64()),
                 *[pa.array([h[f] for f in names], type=pa.int64()) for h in hits]],
                names=["feature", "n", *[f"n{c}" for c in range(chain)]],
            )

    return run


def _index_batches(vocabulary: dict[str, int]):
    def run(batches):
        for batch in batches:
            found = [
                sorted(vocabulary[f] for f in features(t) if f in vocabulary)
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], pa.array(found, type=pa.list_(pa.int32()))],
                names=[batch.schema.names[0], *batch.schema.names[2:], "found"],
            )

    return run


class Chain(NamedTuple):
    """A fitted chain; the vocabulary is bounded by FEATURES for each category."""

    vocabulary: dict[str, int]
    models: list[Linear]


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, text, low_quality, toxic) of the sample, one row an id.

    The sample is `sample` labelled ids that the documents have, drawn by hash. Ids with several
    labels count the worst; of rows that share an id the text with the least hash counts.
    """
    told = (
        labels.filter("doc_id is not null and (toxic is not null or quality is not null)")
        .join(docs.select("doc_id"), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(
            F.max(F.coalesce(F.col("quality") == 0, F.lit(False)).cast("int")).alias("low_quality"),
            F.max(F.coalesce(F.col("toxic"), F.lit(0))).cast("int").alias("toxic"),
        )
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    chosen = docs.select("doc_id", whole().alias("text")).join(F.broadcast(told), "doc_id")
    return chosen.groupBy("doc_id", *CHAIN).agg(
        F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text")
    ).select("doc_id", "text", *CHAIN)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """Fit the chain on at most `sample` labelled documents.

    Features are counted over the sample's whole texts by tasks; those most tied to a category
    (chi-square) are kept. The driver gets only indices of kept features. Without labels, or
    with one class only, a category's model says its only class, and no where there is none.
    """
    rows = stored(labelled(docs, labels, sample), "labelled")
    chain = len(CHAIN)
    totals = rows.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in CHAIN]).first()
    n = totals[0]
    counted = (
        rows.mapInArrow(
            _count_batches(chain), "feature string, n long, " + ", ".join(f"n{c} long" for c in range(chain))
        )
        .groupBy("feature")
        .agg(F.sum("n").alias("n"), *[F.sum(f"n{c}").alias(f"n{c}") for c in range(chain)])
        .filter(F.col("n") >= LEAST_DOCS)
    )
    kept: set[str] = set()
    counted = stored(counted, "features")
    for c in range(chain):
        p = totals[1 + c] / n if n else 0.0
        if not 0.0 < p < 1.0:
            continue
        off = F.col(f"n{c}") - F.col("n") * p
        chi = off * off / (F.col("n") * p * (1 - p) * F.greatest(F.lit(1e-9), 1 - F.col("n") / n))
        best = counted.withColumn("chi", chi).filter(F.col("chi") >= LEAST_CHI)
        kept.update(r[0] for r in best.orderBy(F.desc("chi"), "feature").limit(FEATURES).collect())
    vocabulary = {f: i for i, f in enumerate(sorted(kept))}
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(
        _index_batches(vocabulary), f"doc_id {kind}, low_quality int, toxic int, found array<int>"
    ).select(F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("fold"), *CHAIN, "found", "doc_id")
    made = made.orderBy("doc_id").collect()  # at most `sample` short rows
    lengths = [len(r["found"]) for r in made]
    columns = np.fromiter((i for r in made for i in r["found"]), dtype=np.int64, count=sum(lengths))
    owner = np.repeat(np.arange(len(made)), lengths)
    truth = np.array([[r[c] for c in CHAIN] for r in made]).reshape(len(made), chain)
    fold = np.array([r["fold"] for r in made], dtype=np.int64)
    return Chain(vocabulary, fit_chain(owner, columns, truth, fold, len(vocabulary)))


class _Scorer:
    """Probabilities of texts; built once a task, with the vocabulary split by kind of feature."""

    def __init__(self, chain: Chain):
        self.models, self.width = chain.models, len(chain.vocabulary)
        self.words: dict[str, int] = {}
        self.starts: dict[int, dict[str, int]] = {n: {} for n in PREFIXES}
        for f, i in chain.vocabulary.items():
            (self.words if f[0] == "=" else self.starts[int(f[0])])[f[1:]] = i

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        rows, columns = [], []
        for at, text in enumerate(texts):
            present = set(TOKEN.findall((text or "").lower()))
            found = {self.words[w] for w in present & self.words.keys()}
            for n, known in self.starts.items():
                found.update(known[p] for p in {w[:n] for w in present if len(w) > n} & known.keys())
            columns.extend(found)
            rows.extend([at] * len(found))
        n = len(texts)
        rows, columns = np.array(rows, dtype=np.int64), np.array(columns, dtype=np.int64)
        before = np.zeros((n, 0))
        for model in self.models:
            p = _scores(model, rows, columns, before, n) if self.width else np.full(n, _sigmoid(model.bias))
            before = np.column_stack([before, p])
        return before


def _score_batches(chain: Chain):
    def run(batches):
        scorer = _Scorer(chain)
        for batch in batches:
            p = scorer(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(p[:, c]) for c in range(len(chain.models))]],
                names=["doc_id", *[f"p_{c}" for c in CHAIN]],
            )

    return run


def reject(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of `docs`, with all their columns, that are not toxic; decided row by row."""
    at = docs.columns.index("text")

    def run(batches):
        scorer = _Scorer(chain)
        for batch in batches:
            p = scorer(batch.column(at).to_pylist())[:, CHAIN.index("toxic")]
            yield batch.filter(pa.array(p < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, the probability of each category, and `toxic`, for every whole text.

    Categories follow the order of CHAIN. Null text: as empty, scored by the biases. Null and
    repeated ids: one row per row. Empty input: no rows. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        docs.select("doc_id", "text")
        .mapInArrow(_score_batches(chain), f"doc_id {kind}, " + ", ".join(f"p_{c} double" for c in CHAIN))
        .withColumn("toxic", F.col("p_toxic") >= THRESHOLD)
    )
