"""Toxicity by a classifier chain.

Categories are predicted one after another.  The linear model of each sees the text and the log-odds of all
earlier categories (a clipped monotone map of their probabilities).  While fitting, those come from out-of-fold predictions: models, and the choice of
their features, rest on the other folds alone, so a later model never learns from scores that have seen the same row's labels.

A text is described by which informative features it holds: whole words, word beginnings of four and five
letters (so inflected and compounded words share evidence), and a few of its shape.  Presence, not frequency,
counts: one hit weighs the same in a long text as in a short one.

Models are fitted on the driver from the features of at most SAMPLE_ROWS labelled rows, taken in order of a hash of the id;
texts are described where they lie.  Scoring reads every row and whole texts.

Defined cases: a null or empty text holds no words; rows without labels are scored as all others; labels
for unknown ids and null labels are left out; repeated labels of an id count as one, set if any of them is, and of the texts of a
repeated id the least is fitted, so no more than SAMPLE_ROWS rows, and of each its distinct features only, reach the driver; a category without both classes in the sample has the constant
probability 0 or 1 that it shows, 0 with no labels at all; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import read_table, small_batches

#: Bounds of fitting: labelled rows, features for each category, rows that hold a feature and its chi-square at least.
SAMPLE_ROWS, FEATURES, LEAST_ROWS, LEAST_CHI = 12_000, 1_000, 4, 25.0
#: Features are told apart by a hash of so many values.
BUCKETS = 1 << 22
FOLDS, RIDGE, STEPS = 4, 3e-6, 120
REJECT_AT = 0.3
#: Words whose features a chain remembers.
REMEMBERED = 100_000
#: Categories in order, by conditions on the columns of labels.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"), ("severe", "toxic = 1 AND quality = 0"))
_CAPITALS = bytes(range(65, 91))
_EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»„“”‘’¡¿…"


def word_features(word: str) -> list[str]:
    word = word.strip(_EDGES)
    return ["=" + word, *(f"{n}:{word[:n]}" for n in (4, 5) if len(word) >= n)] if word else []


def shape_features(text: str, words: int, distinct: int) -> list[str]:
    raw = text.encode()
    size = max(1, len(raw))
    capitals = (len(raw) - len(raw.translate(None, _CAPITALS))) / size
    marks = (len(raw) - len(raw.translate(None, b"!?#$%*&"))) / size
    digits = (len(raw) - len(raw.translate(None, b"0123456789"))) / size
    return [
        f"capitals {min(9, int(capitals * 20))}", f"marks {min(9, int(marks * 40))}", f"digits {min(9, int(digits * 40))}",
        f"distinct {int(distinct / max(1, words) * 10)}", f"words {min(12, int(words).bit_length())}"
    ]


def bucket(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) % BUCKETS


class Known(dict):
    """word -> its features, as numbers; works out what is missing and forgets all when it is full."""

    def __init__(self, number=None):
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = tuple(self.numbers(word_features(word)))
        return found

    def numbers(self, features: list[str]) -> list[int]:
        buckets = map(bucket, features)
        return list(buckets) if self.number is None else [self.number[b] for b in buckets if b in self.number]

    def text(self, text: str) -> set[int]:
        words = text.lower().split()
        distinct = set(words)
        found = set(self.numbers(shape_features(text, len(words), len(distinct))))
        found.update(chain.from_iterable(filter(None, map(self.__getitem__, distinct))))
        return found


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Linear:
    """Logistic model over present features and a few dense columns."""

    weights: np.ndarray
    dense: np.ndarray
    bias: float

    @staticmethod
    def fit(rows: np.ndarray, cols: np.ndarray, size: int, dense: np.ndarray, y: np.ndarray) -> Linear:
        """rows and cols: places of ones in a sparse matrix.  Accelerated gradient steps on the ridge-penalised loss."""
        n, k = len(y), dense.shape[1]
        if y.min() == y.max():
            return Linear(np.zeros(size), np.zeros(k), 30.0 if y[0] else -30.0)
        theta = np.zeros(size + k + 1)
        theta[-1] = np.log(y.mean() / (1 - y.mean()))
        ahead, before = theta.copy(), theta
        # no curvature exceeds a quarter of a column's sum of its rows' total weights: a safe step for each coordinate
        heavy = np.bincount(rows, minlength=n) + np.abs(dense).sum(1) + 1.0
        most = np.concatenate((np.bincount(cols, heavy[rows], size), np.abs(dense).T @ heavy, [heavy.sum()]))
        rate = 1.0 / (most / (4.0 * n) + RIDGE)
        loss_at = lambda t: np.bincount(rows, t[cols], n) + dense @ t[size : size + k] + t[-1]
        for step in range(STEPS):
            gap = (sigmoid(loss_at(ahead)) - y) / n
            grad = np.concatenate((np.bincount(cols, gap[rows], size), dense.T @ gap, [gap.sum()]))
            grad[:-1] += RIDGE * ahead[:-1]
            now = ahead - rate * grad
            ahead = now + step / (step + 3.0) * (now - before)
            before = now
        return Linear(before[:size], before[size : size + k], float(before[-1]))

    def score(self, rows: np.ndarray, cols: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.bincount(rows, self.weights[cols], len(dense)) + dense @ self.dense + self.bias


@dataclass
class Chain:
    """Fitted models of a chain, by category."""

    names: list[str]
    number: dict[int, int] = field(default_factory=dict)
    models: list[Linear] = field(default_factory=list)
    held_out: dict[str, float] = field(default_factory=dict)
    #: Of the fitted texts, the log-odds from models that have not seen them.
    out_of_fold: np.ndarray | None = None
    #: Names this chain and its copies, and no other.
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    def probabilities(self, texts) -> np.ndarray:
        """One row for each text, one column for each category."""
        if not self.models:
            return np.zeros((len(texts), len(self.names)))
        known = words_of(self)
        rows, cols = [], []
        for text in texts:
            held = known.text(text)
            rows.append(len(held))
            cols += held
        rows, cols = np.repeat(np.arange(len(rows)), rows), np.array(cols, np.int64)
        scores = np.zeros((len(texts), 0))
        for model in self.models:
            scores = np.column_stack((scores, np.clip(model.score(rows, cols, scores), -30, 30)))
        return sigmoid(scores)


_words: tuple[str, Known] | None = None


def words_of(chain: Chain) -> Known:
    """The words that this process has met for the chain; those of the chain before are let go."""
    global _words
    if _words is None or _words[0] != chain.token:
        _words = chain.token, Known(chain.number)
    return _words[1]


def informative(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, size: int) -> np.ndarray:
    """The columns, of size, that set a category's rows apart most, by chi-square, for any category.  rows and columns: places of ones among the rows of labels."""
    total, chosen = len(labels), []
    n = np.bincount(columns, minlength=size).astype(float)
    often = np.flatnonzero(n >= LEAST_ROWS)
    n = n[often]
    for y in labels.T:
        ones = int(y.sum())
        if not 0 < ones < total:
            continue
        a = np.bincount(columns[y[rows] > 0], minlength=size)[often]
        expected = n * ones / total
        chi = (a - expected) ** 2 / expected + (a - expected) ** 2 / np.maximum(n - expected, 1e-9)
        chosen.append(often[np.argsort(-chi, kind="stable")[: min(FEATURES, int((chi >= LEAST_CHI).sum()))]])
    return np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)


@dataclass
class Ones:
    """Places of ones in a sparse matrix of texts and features."""

    rows: np.ndarray
    cols: np.ndarray
    size: int

    def only(self, columns: np.ndarray) -> Ones:
        """The matrix of these columns."""
        place = np.full(self.size, -1, np.int32)
        place[columns] = np.arange(len(columns))
        held = place[self.cols] >= 0
        return Ones(self.rows[held], place[self.cols[held]], max(1, len(columns)))

    def among(self, texts: np.ndarray, total: int) -> Ones:
        """The matrix of these texts, of total."""
        place = np.full(total, -1, np.int32)
        place[texts] = np.arange(len(texts))
        held = place[self.rows] >= 0
        return Ones(place[self.rows[held]], self.cols[held], self.size)

    def fit(self, dense: np.ndarray, y: np.ndarray) -> Linear:
        return Linear.fit(self.rows, self.cols, self.size, dense, y)


def features(texts) -> list[np.ndarray]:
    """The distinct features of each text."""
    known = Known()
    return [np.sort(np.fromiter(known.text(t), np.int32)) for t in texts]


def fit_chain(held: list[np.ndarray], labels: np.ndarray, names: list[str]) -> Chain:
    """held: the features of each text; labels: 0 or 1 for each text and category.

    What a fold is scored by has seen none of its labels: its models are fitted, and their features chosen, on the other folds alone."""
    fitted = Chain(names)
    if not len(held):
        return fitted
    many = len(held)
    # what fewer than LEAST_ROWS texts hold is informative in no fold: it goes before anything is laid out
    groups = [range(low, min(low + 1000, many)) for low in range(0, many, 1000)]
    often = np.zeros(BUCKETS, np.int32)
    for group in groups:
        often += np.bincount(np.concatenate([held[i] for i in group]), minlength=BUCKETS).astype(np.int32)
    buckets = np.flatnonzero(often >= LEAST_ROWS)
    number = np.full(BUCKETS, -1, np.int32)
    number[buckets] = np.arange(len(buckets))
    rows, cols = [], []
    for group in groups:
        found = number[np.concatenate([held[i] for i in group])]
        rows.append(np.repeat(np.array(group, np.int32), [len(held[i]) for i in group])[found >= 0])
        cols.append(found[found >= 0])
    ones = Ones(np.concatenate(rows), np.concatenate(cols), max(1, len(buckets)))
    del rows, cols, often, number
    chosen = informative(ones.rows, ones.cols, labels, ones.size)
    fitted.number = {int(b): i for i, b in enumerate(buckets[chosen])}
    fold, folds = np.arange(many) % FOLDS, []
    for k in range(FOLDS):
        seen, unseen = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(seen) and len(unseen):
            mine = ones.among(seen, many)
            folds.append((seen, unseen, informative(mine.rows, mine.cols, labels[seen], mine.size)))
            del mine
    # from here on only columns that some model uses; the matrices of a fold are made when they are used
    used = np.unique(np.concatenate([chosen, *(best for *_, best in folds)]))
    ones, chosen = ones.only(used), np.searchsorted(used, chosen)
    folds = [(seen, unseen, np.searchsorted(used, best)) for seen, unseen, best in folds]
    del held
    scores = np.zeros((many, 0))
    for name, y in zip(names, labels.T.astype(float)):
        out_of_fold = np.zeros(many)
        for seen, unseen, best in folds:
            model = ones.among(seen, many).only(best).fit(scores[seen], y[seen])
            theirs = ones.among(unseen, many).only(best)
            out_of_fold[unseen] = model.score(theirs.rows, theirs.cols, scores[unseen])
        fitted.models.append(ones.only(chosen).fit(scores, y))
        fitted.held_out[name] = float(((out_of_fold >= 0) == (y > 0)).mean())
        scores = np.column_stack((scores, np.clip(out_of_fold, -30, 30)))
    fitted.out_of_fold = scores
    return fitted


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories=CATEGORIES, sample_rows: int = SAMPLE_ROWS) -> Chain:
    """Fits a chain on at most sample_rows labelled rows."""
    flags = [F.coalesce(F.expr(condition), F.lit(False)).cast("int").alias(f"c{i}") for i, (_, condition) in enumerate(categories)]
    wanted = labels.filter("quality IS NOT NULL AND toxic IS NOT NULL") if {"quality", "toxic"} <= set(labels.columns) else labels
    wanted = wanted.select(F.col(id_col).cast("long").alias("id"), *flags).filter("id IS NOT NULL")
    wanted = wanted.groupBy("id").agg(*(F.max(f"c{i}").alias(f"c{i}") for i in range(len(categories))))
    sample = wanted.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "id")
    rows = rows.groupBy("id", *(f"c{i}" for i in range(len(categories)))).agg(F.min("text").alias("text"))

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="text").assign(held=pd.Series(features(batch["text"]), dtype=object))

    columns = ", ".join(f"c{i} int" for i in range(len(categories)))
    rows = rows.mapInPandas(described, f"id long, {columns}, held array<int>").toArrow().sort_by("id")
    flags = np.array([rows.column(f"c{i}").to_numpy() for i in range(len(categories))]).T.reshape(len(rows), len(categories))
    held = [x.values.to_numpy() for x in rows.column("held")]
    del rows
    chain = fit_chain(held, flags, [name for name, _ in categories])
    del held, flags
    pa.default_memory_pool().release_unused()  # the sample leaves the driver
    return replace(chain, out_of_fold=None)


def probabilities(chain: Chain, text: Column) -> Column:
    """array<double> of the probabilities of all categories."""

    @F.pandas_udf("array<double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(chain.probabilities(batch.tolist())), dtype=object)

    return scored(F.coalesce(text, F.lit("")))


def without_toxic(docs: DataFrame, chain: Chain, category: str = "toxic", text_col: str = "text") -> DataFrame:
    """The rows whose probability of category is below REJECT_AT, with all columns of docs."""
    place = chain.names.index(category)
    return docs.filter(probabilities(chain, F.col(text_col))[place] < REJECT_AT)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    chain = train(docs, read_table(spark, sf_dir, "labels"))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), probabilities(chain, F.col("text")).alias("p"))
    columns = [F.col("p")[i].alias(f"p_{name}") for i, name in enumerate(chain.names)]
    return scored.select("doc_id", *columns, (F.col("p")[chain.names.index("toxic")] >= REJECT_AT).alias("toxic"))
