"""Toxicity categories by a chain of linear classifiers.

Each category has its own logistic model. The chain runs in a fixed order, and every model but the
first also sees the probabilities of the categories before it. While fitting, those probabilities
are predicted out of fold, so that a later model meets them as unsure as they will be on new texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.batches import small_batches
from logsieve.llm.words import shingles
from logsieve.sources.sinks import stage

#: Category and its label as an expression over the columns of ``labels``.
CATEGORIES = {
    "toxic": "toxic = 1",
    "toxic_junk": "toxic = 1 AND quality = 0",
    "toxic_fluent": "toxic = 1 AND quality = 1",
}
#: Labelled documents that a fit uses at most (about; chosen by a hash), candidate features, folds,
#: and the least documents of a feature.
SAMPLE, FEATURES, FOLDS, LEAST = 10_000, 128, 5, 8
#: Features that a task counts before it hands them on.
FLUSH = 200_000
#: The least chi-square statistic of a candidate.
ALONE = 40.0
#: A word, for features, and the lengths of the stems that its start gives.
WORD, STEMS = re.compile(r"[^\W_]+"), (3, 4, 5)


class LinearModel:
    """Logistic regression with a ridge, on 0/1 features and earlier probabilities; Newton's method.
    Fitted on nothing it knows nothing to be positive: every probability is 0."""

    def __init__(self, penalty: float = 0.02, rounds: int = 40):
        self.penalty, self.rounds = penalty, rounds
        self.weights, self.known = np.zeros(0), False

    def fit(self, x: np.ndarray, y: np.ndarray) -> LinearModel:
        x = np.hstack([np.ones((len(x), 1)), x])
        # Equal rows count by their number: few differ.
        x, place = np.unique(x, axis=0, return_inverse=True)
        n = np.bincount(place.ravel(), minlength=len(x)).astype(float)
        y = np.bincount(place.ravel(), weights=y, minlength=len(x))
        w = np.zeros(x.shape[1])
        ridge = np.full(len(w), self.penalty)
        ridge[0] = 1e-3
        for _ in range(self.rounds if len(x) else 0):
            p = _probability(x @ w)
            step = np.linalg.solve(
                (x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge),
                x.T @ (y - n * p) - ridge * w,
            )
            w += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-4:
                break
        self.weights, self.known = w, len(x) > 0
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.zeros(len(x))
        return _probability(self.weights[0] + x @ self.weights[1:])


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Chain:
    """Models in order; model k has the k earlier probabilities behind the text's features."""

    def __init__(self, words: list[str], models: dict[str, LinearModel]):
        self.words, self.models = words, models

    @classmethod
    def fit(cls, words: list[str], x: np.ndarray, y: dict[str, np.ndarray], folds: np.ndarray) -> Chain:
        models = {}
        for name, labels in y.items():
            models[name] = LinearModel().fit(x, labels)
            held = np.zeros(len(x))
            for fold in np.unique(folds):
                out = folds == fold
                held[out] = LinearModel().fit(x[~out], labels[~out]).predict(x[out])
            x = np.hstack([x, held[:, None]])
        return cls(words, models)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """A column of probabilities for each category."""
        first = x.shape[1]
        for model in self.models.values():
            x = np.hstack([x, model.predict(x)[:, None]])
        return x[:, first:]


def features_of(text: str | None) -> list[str]:
    """``=word`` for each word, and ``stem*k`` if k different words (1 to 3) start with the stem."""
    found = set(WORD.findall((text or "").lower()))
    stems = Counter(w[:n] for w in found for n in STEMS if len(w) > n)
    return [f"={w}" for w in found] + [f"{p}*{k}" for p, c in stems.items() for k in range(1, min(c, 3) + 1)]


def _looks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The least hash of five words of each text: most near copies share it."""
    for batch in batches:
        look = [shingles(t, 5).min(initial=2**64 - 1).astype(np.int64) for t in batch["text"]]
        yield batch.drop(columns="text").assign(look=look)


def _count_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n, n1 = Counter(), Counter()

    def rows() -> pd.DataFrame:
        return pd.DataFrame({"f": list(n), "n": list(n.values()), "n1": [n1[f] for f in n]})

    for batch in batches:
        for text, y in zip(batch["text"], batch["y0"]):
            found = features_of(text)
            n.update(found)
            if y:
                n1.update(found)
        if len(n) > FLUSH:
            yield rows()
            n.clear()
            n1.clear()
    if n:
        yield rows()


def _matrix(found, index: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(found), len(index)), np.float32)
    for row, features in zip(x, found):
        row[[index[f] for f in features if f in index]] = 1
    return x


def fit_chain(
    docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES,
    sample: int = SAMPLE, features: int = FEATURES,
) -> Chain:
    """Fits the chain on about ``sample`` labelled documents at most, chosen by a hash of doc_id.

    The candidate features are those with the largest chi-square statistic for the first category.
    Of texts that look alike (the same least hash of five words) and have the same labels one is
    used, since the words of a text with many copies would pass for cues. Only the candidates, and which of them each sampled document has,
    come to the driver. A null label counts as 0; a document with several label rows has their
    maximum. Without a labelled document every probability is 0: nothing is known to be toxic.
    """
    small_batches(docs.sparkSession)
    names = list(categories)
    values = [F.max(F.coalesce(F.expr(e), F.lit(False)).cast("int")).alias(f"y{i}") for i, e in enumerate(categories.values())]
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(*values)
    share = min(1.0, sample / max(known.count(), 1))
    keep = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * share))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    ys = [f"y{i}" for i in range(len(names))]
    labelled = "id long, " + ", ".join(f"{y} int" for y in ys)
    # The sample is bounded by its parameter, so its ids and labels may go to every task.
    rows = texts.join(F.broadcast(stage(known.where(keep))), "id").select("id", *ys, "text")
    looks = rows.mapInPandas(_looks, f"{labelled}, look long")
    chosen = stage(looks.groupBy("look", *ys).agg(F.min("id").alias("id")).select("id", *ys))
    sizes = chosen.agg(F.count("*").alias("n"), F.sum("y0").alias("n1")).first()
    all_n, all_1 = float(sizes["n"]), float(sizes["n1"] or 0)
    rows = texts.join(F.broadcast(chosen), "id").select("id", *ys, "text")
    counts = rows.mapInPandas(_count_features, "f string, n long, n1 long").groupBy("f").agg(
        F.sum("n").alias("n"), F.sum("n1").alias("n1")
    )
    n, n1 = F.col("n").cast("double"), F.col("n1").cast("double")
    gap = n1 * all_n - n * all_1
    score = gap * gap / (n * (all_n - n + 1) * max(all_1, 1.0) * max(all_n - all_1, 1.0))
    top = counts.where((F.col("n") >= LEAST) & (score * all_n >= ALONE)).select("f", score.alias("score")).orderBy(F.desc("score"), "f").limit(features)
    found = [r["f"] for r in top.collect()]
    finder = _Finder(found)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="text").assign(found=[finder.found(t) for t in batch["text"]])

    data = rows.mapInPandas(find, f"{labelled}, found array<string>").orderBy("id").toPandas()
    x = _matrix(data["found"], {f: i for i, f in enumerate(found)})
    y = {name: data[f"y{i}"].to_numpy(float) for i, name in enumerate(names)}
    return Chain.fit(found, x, y, np.arange(len(data)) % FOLDS)


class _Finder:
    """Finds the wanted ones among the features of a text."""

    def __init__(self, features: list[str]):
        self.words = {f[1:] for f in features if f[0] == "="}
        self.stems = {f[:-2] for f in features if f[0] != "="}

    def found(self, text: str | None) -> list[str]:
        ws = set(WORD.findall((text or "").lower()))
        stems = Counter(p for w in ws for n in STEMS if (p := w[:n]) in self.stems and len(w) > n)
        hits = [f"={w}" for w in ws & self.words]
        return hits + [f"{p}*{k}" for p, c in stems.items() for k in range(1, min(c, 3) + 1)]


class _Scorer:
    """A fitted chain with what finds its features."""

    def __init__(self, chain: Chain):
        self.chain, self.finder = chain, _Finder(chain.words)
        self.index = {f: i for i, f in enumerate(chain.words)}

    def __call__(self, texts: pd.Series) -> pd.DataFrame:
        p = self.chain.predict(_matrix([self.finder.found(t) for t in texts], self.index))
        return pd.DataFrame(p, columns=list(self.chain.models))


def score_chain(docs: DataFrame, chain: Chain, prefix: str = "p_") -> DataFrame:
    """``docs`` with one probability ``<prefix><category>`` for each category of the chain.

    Null and empty texts have no features and get the probabilities of such a text. Rows are scored
    where they are: no shuffle, and repeated rows, null ids and other columns come back as they are.
    Columns named like a probability are replaced.
    """
    small_batches(docs.sparkSession)
    scorer = _Scorer(chain)
    fields = ", ".join(f"`{name}` double" for name in chain.models)

    @F.pandas_udf(fields)
    def probabilities(texts: pd.Series) -> pd.DataFrame:
        return scorer(texts)

    own = f"{prefix}chain"
    out = docs.withColumn(own, probabilities("text"))
    return out.withColumns({prefix + name: F.col(f"{own}.{name}") for name in chain.models}).drop(own)
