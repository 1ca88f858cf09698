"""Language-model scores from a lattice of subword pieces.

A text is a sequence of words and an end. A word, with the mark of its start, is spelled by pieces
of an existing vocabulary in every way that they allow; a spelling's probability is the product of
its pieces', and the word's the sum over all spellings, taken by a forward recursion in
logarithms. No piece crosses a word's start, so a document's marginal is the product of its words'.
The vocabulary stays as it is. The probabilities of its pieces start from its scores and are
re-estimated as expected counts over the distinct learnt words.

Two arcs join each word's spellings in the lattice: the word as a whole, with its discounted count
in the learning texts, and the word as a repetition of an earlier one in the same document. All
paths are summed:

    P(word) = (max(count - D, 0) + D * distinct * spelled) / tokens
    P(word | document so far) = (K * P(word) + earlier uses) / (K + earlier words)
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.batches import small_batches
from logsieve.llm.words import words
from logsieve.sources.sinks import stage

MARK = "▁"
#: Rounds of re-estimation, and what each piece's expected count gets on top.
ROUNDS, SMOOTHING = 2, 0.1
#: The discount D of a learnt word, and the weight K of the model against the document so far.
DISCOUNT, CONCENTRATION = 0.75, 1500.0
#: Frequent words whose counts go to every task; the others' counts come by a join.
FREQUENT = 50_000
#: Words that a task counts before it hands them on, and word scores that a worker remembers.
FLUSH, REMEMBERED = 400_000, 400_000


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces that can spell lower-case text, and their scores as natural logarithms that sum to 1.

    Scores of a merge-based vocabulary are ranks (0, -1, -2, ...): the logarithm of 1 / (rank + 10)
    takes their place. Every single byte is a piece, so everything can be spelled.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    raw: dict[bytes, float] = {bytes([b]): -float(model.get_piece_size()) for b in range(256)}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        key = piece.encode()
        if key == key.lower():
            raw[key] = max(model.get_score(i), raw.get(key, -math.inf))
    scores = np.array(list(raw.values()))
    if scores.min() < -100:
        scores = -np.log(10 - scores)
    scores -= np.log(np.exp(scores).sum())
    return list(raw), scores


class Lattice:
    """The pieces as a table of transitions that many words walk at once."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        children: list[dict[int, int]] = [{}, {}]
        ends = [-1, -1]
        for number, piece in enumerate(pieces):
            node = 1
            for byte in piece:
                child = children[node].get(byte)
                if child is None:
                    child = children[node][byte] = len(children)
                    children.append({})
                    ends.append(-1)
                node = child
            ends[node] = number
        self.next = np.zeros((len(children), 256), np.int32)
        for node, out in enumerate(children):
            for byte, child in out.items():
                self.next[node, byte] = child
        self.ends = np.array(ends)
        node = 1
        for byte in MARK.encode():
            node = int(self.next[node, byte])
        self.start = node
        self.mark = int(self.ends[node])

    def scores_by_node(self, scores: np.ndarray) -> np.ndarray:
        return np.where(self.ends >= 0, scores[self.ends], -np.inf)

    def _arcs(self, batch: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """From, to and the node of every arc of words of one length, by start then end.

        Start -1 stands for the mark before the word.
        """
        length = batch.shape[1]
        for begin in range(-1, length):
            node = np.full(len(batch), self.start if begin < 0 else 1, np.int32)
            for end in range(max(begin, 0), min(length, max(begin, 0) + self.longest)):
                node = self.next[node, batch[:, end]]
                if not node.any():
                    break
                yield begin, end + 1, node

    def forward(self, batch: np.ndarray, by_node: np.ndarray) -> np.ndarray:
        """Logarithms of the total probability of each prefix; the last column is the word's."""
        alpha = np.full((len(batch), batch.shape[1] + 1), -np.inf)
        alpha[:, 0] = by_node[self.start]
        with np.errstate(divide="ignore"):
            for begin, end, node in self._arcs(batch):
                before = 0.0 if begin < 0 else alpha[:, begin]
                alpha[:, end] = np.logaddexp(alpha[:, end], before + by_node[node])
        return alpha

    def expected(self, batch: np.ndarray, by_node: np.ndarray) -> np.ndarray:
        """How often each node's piece is used by the words, in expectation over their spellings."""
        alpha = self.forward(batch, by_node)
        total = alpha[:, -1]
        length = batch.shape[1]
        beta = np.full((len(batch), length + 1), -np.inf)
        beta[:, length] = 0
        arcs = list(self._arcs(batch))
        nodes, uses = [], []
        for begin, end, node in sorted(arcs, key=lambda a: -a[0]):
            arc = by_node[node] + beta[:, end]
            if begin >= 0:
                beta[:, begin] = np.logaddexp(beta[:, begin], arc)
            used = np.exp(arc + (0.0 if begin < 0 else alpha[:, begin]) - total)
            hit = used > 1e-12
            nodes.append(node[hit])
            uses.append(used[hit])
        out = np.zeros(len(self.ends))
        if nodes:
            out += np.bincount(np.concatenate(nodes), weights=np.concatenate(uses), minlength=len(out))
        out[self.start] += np.exp(by_node[self.start] + beta[:, 0] - total).sum()
        return out

    @staticmethod
    def batches(ws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in ``ws`` and the bytes of words of one length, at most about a megabyte."""
        sizes = np.array([len(w) for w in ws])
        order = np.argsort(sizes, kind="stable")
        for places in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            if not len(places):
                continue
            length = int(sizes[places[0]])
            step = max(1, 200_000 // max(length, 1))
            for at in range(0, len(places), step):
                some = places[at : at + step]
                joined = b"".join([ws[i] for i in some])
                yield some, np.frombuffer(joined, np.uint8).reshape(len(some), length)

    def log_probabilities(self, ws: list[bytes], by_node: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ws))
        for places, batch in self.batches(ws):
            out[places] = self.forward(batch, by_node)[:, -1]
        return out


@functools.lru_cache(maxsize=1)
def _lattice(pieces: tuple[bytes, ...]) -> Lattice:
    return Lattice(list(pieces))


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()

    def rows() -> pd.DataFrame:
        return pd.DataFrame({"word": list(counts), "n": list(counts.values())}).astype({"n": "int64"})

    for batch in batches:
        for text in batch["text"]:
            counts.update(words(text))
        if len(counts) > FLUSH:
            yield rows()
            counts.clear()
    if counts:
        yield rows()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word binary, n long`` over all texts, counted within the tasks before the shuffle."""
    found = docs.select("text").mapInPandas(_count_words, "word binary, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _use_pieces(pieces, scores):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = _lattice(pieces.value)
        by_node = lattice.scores_by_node(scores)
        total = np.zeros(len(lattice.ends))
        ws: list[bytes] = []

        def use() -> None:
            for _, part in lattice.batches(ws):
                np.add(total, lattice.expected(part, by_node), out=total)
            ws.clear()

        # Words of one length are walked together, so many are gathered first.
        for batch in batches:
            ws.extend(batch["word"].tolist())
            if len(ws) > 100_000:
                use()
        use()
        node = np.flatnonzero(total)
        yield pd.DataFrame({"piece": lattice.ends[node], "used": total[node]})

    return run


class Model:
    """Piece probabilities (natural logarithms) and the word counts behind them."""

    def __init__(self, pieces, scores, counts, tokens, distinct, ends):
        self.pieces, self.scores, self.counts = pieces, scores, counts
        #: Learnt tokens with the ends, distinct words without the end, ends.
        self.tokens, self.distinct, self.ends = tokens, distinct, ends

    def base(self, count: float) -> float:
        """log10 of a token's probability under the add-half unigram model."""
        distinct = self.distinct + (self.ends > 0)
        return math.log10((count + 0.5) / (self.tokens + 0.5 * (distinct + 1)))


def fit(docs: DataFrame, path: str, rounds: int = ROUNDS) -> Model:
    """Learns from every text of ``docs``; null texts are empty, each row counts one end.

    Word counts stay a table. The driver gets one number for each piece of the vocabulary.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces, scores = vocabulary(path)
    counts = stage(word_counts(docs))
    ends = docs.count()
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    shared = spark.sparkContext.broadcast(tuple(pieces))
    for _ in range(rounds):
        used = (
            counts.select("word").mapInPandas(_use_pieces(shared, scores), "piece int, used double")
            .groupBy("piece").agg(F.sum("used").alias("used"))
        )
        expected = np.full(len(pieces), SMOOTHING)
        for row in used.collect():
            expected[row["piece"]] += row["used"]
        scores = np.log(expected / expected.sum())
    return Model(shared, scores, counts, sums["n"] + ends, sums["v"], ends)


def _score(model: dict, frequent):
    tokens, distinct, ends = model["tokens"], model["distinct"], model["ends"]
    scale = DISCOUNT * distinct

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = _lattice(model["pieces"].value)
        by_node = lattice.scores_by_node(model["scores"])
        counts = frequent.value
        base = {w: model["base"](c) for w, c in counts.items()}
        known: dict[bytes, float] = {}
        for batch in batches:
            texts = [words(text) for text in batch["text"]]
            fresh = list({w for t in texts for w in t if w not in known})
            if len(known) + len(fresh) > REMEMBERED:
                known.clear()
                fresh = list({w for t in texts for w in t})
            known.update(zip(fresh, lattice.log_probabilities(fresh, by_node).tolist()))
            rows = []
            for t in texts:
                uses = Counter(t)
                total, rare = 0.0, []
                for w, c in uses.items():
                    if w in counts:
                        p = CONCENTRATION * (counts[w] - DISCOUNT + scale * math.exp(known[w])) / tokens
                        total += math.lgamma(p + c) - math.lgamma(p) if p > 1e-9 else math.log(p) + math.lgamma(c)
                    else:
                        rare.append(w)
                seen = len(t)
                total -= math.lgamma(CONCENTRATION + seen + 1) - math.lgamma(CONCENTRATION)
                # With the half of the end, the masses of words and end sum to 1.
                total += math.log(CONCENTRATION * (ends + 0.5) / tokens)
                rows.append((
                    seen + 1,
                    sum(c for w, c in uses.items() if w in counts) + (ends > 0),
                    math.fsum(base[w] * c for w, c in uses.items() if w in counts) + model["base"](ends),
                    total / math.log(10),
                    math.fsum(known[w] * c for w, c in uses.items()) / math.log(10),
                    rare,
                    [uses[w] for w in rare],
                    [known[w] / math.log(10) for w in rare],
                ))
            out = pd.DataFrame(rows, columns=[
                "n_tokens", "n_known", "base_score", "score", "spelled_score", "rare", "times", "spelled",
            ])
            yield pd.concat([batch.drop(columns="text").reset_index(drop=True), out], axis=1)

    return run


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``keep``, ``n_tokens, n_known, train_tokens, base_score, score`` and
    ``spelled_score`` (pieces alone, without the end) for every row; scores are log10.

    Words are runs outside ASCII white space with A-Z lowered; null texts are empty and score their
    end alone. Repeated rows come back repeated, null ids too; other columns are ignored.

    Counts of the frequent words go to every task (a bounded list); the rare words of a document
    travel once and meet the word counts in a join. Both ways score by the same formula.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # Written first: the driver gets the words once, not each task's candidates.
    top = stage(model.counts.orderBy(F.desc("n"), "word").limit(FREQUENT)).collect()
    frequent = spark.sparkContext.broadcast({bytes(r["word"]): r["n"] for r in top})
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *keep,
        F.monotonically_increasing_id().alias("row"), "text",
    )
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    parts = {
        "pieces": model.pieces, "scores": model.scores, "base": _Base(model),
        "tokens": model.tokens + 0.5, "distinct": model.distinct, "ends": model.ends,
    }
    found = stage(rows.mapInPandas(
        _score(parts, frequent),
        f"{schema}, n_tokens long, n_known long, base_score double, score double, spelled_score double, "
        "rare array<binary>, times array<int>, spelled array<float>",
    ))
    rare = found.select(
        "row", F.explode(F.arrays_zip("rare", "times", "spelled")).alias("r")
    ).select("row", "r.rare", "r.times", "r.spelled").withColumnRenamed("rare", "word")
    c = F.coalesce("n", F.lit(0))
    tokens, distinct = model.tokens + 0.5, float(model.distinct)
    whole = F.greatest(c - DISCOUNT, F.lit(0.0))
    spelled = F.pow(F.lit(10.0), F.col("spelled").cast("double"))
    # Far below the range of doubles only the spelling is left, and its logarithm is at hand.
    first = F.when(c > 0, F.log10((whole + DISCOUNT * distinct * spelled) / tokens)).otherwise(
        F.col("spelled").cast("double") + (math.log10(DISCOUNT * distinct / tokens) if distinct else 0.0)
    ) + math.log10(CONCENTRATION)
    # Later uses: the weight of the model and of the uses before, one after another.
    mass = (whole + DISCOUNT * distinct * spelled) * (CONCENTRATION / tokens)
    more = F.get(
        F.transform(
            F.array(mass),
            lambda m: F.aggregate(
                F.sequence(F.lit(1), F.col("times") - 1), F.lit(0.0), lambda total, i: total + F.log10(m + i)
            ),
        ),
        F.lit(0),
    )
    later = F.when(F.col("times") == 1, 0.0).when(F.col("times") == 2, F.log10(mass + 1)).otherwise(more)
    size = float(model.tokens + 0.5 * (model.distinct + (model.ends > 0) + 1))
    sums = (
        rare.join(model.counts.select("word", "n"), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"),
            F.sum(F.col("times") * F.log10((c + 0.5) / F.lit(size))).alias("more_base"),
            F.sum(first + later).alias("more_score"),
        )
    )
    nothing = F.lit(0.0)
    return found.drop("rare", "times", "spelled").join(sums, "row", "left").select(
        "doc_id", *keep, "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(model.tokens)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", nothing)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", nothing)).alias("score"),
        "spelled_score",
    )


class _Base:
    """The model's base scores without its table, for the tasks."""

    def __init__(self, model: Model):
        self.tokens, self.distinct, self.ends = model.tokens, model.distinct, model.ends

    def __call__(self, count: float) -> float:
        return Model.base(self, count)
