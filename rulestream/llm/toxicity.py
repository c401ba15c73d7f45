"""Toxicity by two class-conditional Kneser-Ney word models.

One model is estimated from toxic documents and one from ordinary ones. A word's class count is its
Kneser-Ney continuation count: after how many different words it was seen in the class (the begin
of a line counts as one). ``rare`` is taken off each count, and the mass so gained goes to a level
that both classes share: the counts of the words in all documents of the corpus. So a word that a
class holds only by chance has the shared probability in both, and says nothing for either.

A text's evidence is the length-normalised difference of its two log-likelihoods: over the whole
text, and over its best window of each of ``SPANS`` words, since a few expressions make a long text
toxic. A logistic curve over these differences, and nothing else, gives the score. It is fitted on
labelled documents, each compared by models that were estimated without its quarter of the ids.

Nothing is drawn: the class counts and the curve cover every labelled document that isn't held out, the
shared counts and the scores all documents, each by its whole text. Counts, their joins and the models'
logarithms are made where the rows lie, and so are the sums of each step of the curve's fit. The driver
gets these sums and the models, a line for each word above the discount in a class, which are broadcast:
they grow with the vocabulary. Labelled ids, and words, are broadcast to the documents up to
``BROADCAST_ROWS`` and joined by shuffle beyond.

Defined results: a null or empty text, or one without letters, has the share of toxic documents
among the labelled ones as its score. Without labelled rows of both classes in each quarter that
share is the score of all (0 if there are none). Bytes that aren't UTF-8 separate words. Repeated
rows are scored alike; of contradicting labels for an id the largest counts. The texts of rows that share
a labelled id all count in its class; one of them, the first by hash, counts in the curve. An empty table gives an empty
table. Input columns pass through; ``score`` and ``predicted`` replace columns of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulestream.llm.common import add_columns, cut, held_out, valid, without

SPANS = (1, 2, 4, 8, 16, 32)
RARE = 3
FOLDS = 4
#: Labelled ids, and words of the models, up to which they are broadcast to the documents.
BROADCAST_ROWS = 1_000_000
# letters, and numerals that aren't digits; the second pattern says the same of what lies between words
_WORD = re.compile(r"[^\W\d_]+")
BETWEEN = r"[^\p{L}\p{Nl}\p{No}]+"


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def differences(each: np.ndarray) -> np.ndarray | None:
    """The length-normalised differences of a whole text and of its best windows, from those of its words."""
    if not len(each):
        return None
    sums = np.concatenate(([0.0], np.cumsum(each)))
    best = [(sums[k:] - sums[:-k]).max() / k if k < len(each) else sums[-1] / k for k in SPANS]
    return np.array([sums[-1] / len(each), *best])


@dataclass
class ClassModels:
    """For each word above the discount, the log of its probability in toxic texts over that in ordinary ones; ``unknown`` for all others."""

    words: dict[str, float] = field(default_factory=dict)
    unknown: float = 0.0

    def differences(self, text: str) -> np.ndarray | None:
        """The length-normalised differences of the whole text and of its best windows; null without a word."""
        get, unknown = self.words.get, self.unknown
        return differences(np.array([get(w, unknown) for w in tokens(text)]))


@dataclass
class Model:
    models: ClassModels | None
    weights: np.ndarray
    prior: float

    def score(self, text: str | None) -> float:
        if self.models is None or (x := self.models.differences(text or "")) is None:
            return self.prior
        return float(_sigmoid(np.append(x, 1.0) @ self.weights))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _total(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``of(x, label)`` over all rows of (label, x), added up in the order of the partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [of(np.array(b.column(1).flatten()).reshape(b.num_rows, -1), np.array(b.column(0), float)) for b in batches if b.num_rows]
        if sums:
            yield pa.RecordBatch.from_pylist([{"at": TaskContext.get().partitionId(), "s": np.sum(sums, 0).tolist()}], schema)

    schema = pa.schema([("at", pa.int32()), ("s", pa.list_(pa.float64()))])
    found = sorted(rows.select("label", "x").mapInArrow(run, "at int, s array<double>").collect())
    return np.sum([r["s"] for r in found], 0)


def fit_logistic(rows: DataFrame, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights, the last for the constant, by Newton's method over all rows of (label, x); only sums leave a task."""
    n, *sums = _total(rows, lambda x, y: np.array([len(x), *x.sum(0)]))
    center = np.array(sums) / n
    scale = np.sqrt(_total(rows, lambda x, y: ((x - center) ** 2).sum(0)) / n) + 1e-9
    k = len(center) + 1
    w = np.zeros(k)
    penalty = np.full(k, ridge * max(1, n) / 100)
    penalty[-1] = 1e-6
    for _ in range(steps):

        def slopes(x, y, w=w.copy()):
            x = np.column_stack([(x - center) / scale, np.ones(len(x))])
            p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
            return np.concatenate([((x * (p * (1 - p) + 1e-9)[:, None]).T @ x).ravel(), x.T @ (y - p)])

        found = _total(rows, slopes)
        step = np.linalg.solve(found[: k * k].reshape(k, k) + np.diag(penalty), found[k * k :] - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    w[:-1] /= scale
    w[-1] -= center @ w[:-1]
    return w


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BETWEEN), "")


def _fold(doc_id: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(folds)).cast("int")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int) -> DataFrame:
    """(doc_id, label, text) of every document whose id has a label and isn't held out; null texts are left out.

    Up to ``BROADCAST_ROWS`` labelled ids go to the documents and no text moves; beyond, both are shuffled by
    id and the labelled texts are written once, since they are read twice.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    rows = _settled(rows.where(~held_out(F.col("doc_id"), parts, part)).groupBy("doc_id").agg(F.max("label").alias("label")))
    texts = docs.select("doc_id", valid().alias("text")).where(F.col("text").isNotNull())
    if rows.count() <= BROADCAST_ROWS:
        return texts.join(F.broadcast(rows), "doc_id").select("doc_id", "label", "text")
    return _settled(texts.join(rows, "doc_id").select("doc_id", "label", "text"))


def _settled(df: DataFrame) -> DataFrame:
    """``df`` as ``cut`` leaves it, without the shuffles it came from: nothing reads them any more."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return cut(df.select("*"))
    finally:
        if before is None:
            conf.unset(key)
        else:
            conf.set(key, before)


def continuation_counts(texts: DataFrame, rare: int = RARE, folds: int = FOLDS) -> DataFrame:
    """(word, n_0, n0_0, ..., n_1, n0_1, ...): the counts of ordinary and of toxic texts; all words at or below the discount are one row without a word.

    ``n`` counts the different words before a word in a class; ``n0`` those outside the first part of the ids and so on.
    Copied documents and passages would make chance words look frequent: a pair of words counts once in a class. The row
    of a word holds its own counts and what is left of them above the discount (``kept_n_0``, ...).
    """
    # one bit for each class and part
    bit = F.element_at(F.array(*(F.lit(1 << k) for k in range(2 * folds))), F.col("label") * folds + _fold(folds=folds) + 1)
    lines = texts.select(bit.alias("m"), F.explode(F.split("text", "\n")).alias("line")).select("m", _words(F.col("line")).alias("w"))
    # words hold letters only: one text for a word and the one before it
    before = F.concat(F.array(F.lit("")), F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))))
    pairs = lines.select("m", F.explode(F.zip_with("w", before, lambda w, b: F.concat(w, F.lit(" "), b))).alias("pair"))
    pairs = pairs.groupBy("pair").agg(F.bit_or("m").alias("m")).select(F.substring_index("pair", " ", 1).alias("word"), "m")
    masks = {}
    for k in (0, 1):
        of = ((1 << folds) - 1) << (k * folds)
        masks |= {f"n_{k}": of} | {f"n{f}_{k}": of & ~(1 << (k * folds + f)) for f in range(folds)}
    words = pairs.groupBy("word").agg(*(F.count_if(F.col("m").bitwiseAND(F.lit(v)) != 0).alias(c) for c, v in masks.items()))
    known = F.when(F.greatest("n_0", "n_1") > rare, F.col("word"))
    kept = [F.sum(F.greatest(F.col(c) - rare, F.lit(0))).alias(f"kept_{c}") for c in masks]
    return _settled(words.groupBy(known.alias("word")).agg(*(F.sum(c).alias(c) for c in masks), *kept))


def corpus_counts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(word, found): how often each word of ``known`` occurs in all documents; all other words are one row without a word.

    Up to ``BROADCAST_ROWS`` words go to the documents; beyond, the counts of all words are joined by shuffle.
    """
    words = docs.select(F.explode(_words(valid())).alias("word"))
    known = known.select("word", F.lit(True).alias("known"))
    if known.count() <= BROADCAST_ROWS:
        joined = words.withColumn("found", F.lit(1)).join(F.broadcast(known), "word", "left")
    else:
        joined = words.groupBy("word").agg(F.count(F.lit(1)).alias("found")).join(known, "word", "left")
    return _settled(joined.groupBy(F.when(F.col("known"), F.col("word")).alias("word")).agg(F.sum("found").alias("found")))


def class_models(docs: DataFrame, counts: DataFrame, folds: int = FOLDS) -> tuple[pa.Table, dict[str, float]] | None:
    """A table of the words above the discount with, for each count, the log of toxic over ordinary; and that of all other words.

    None if a class has no word, in all or outside one of the parts.
    """
    keys = ["n", *(f"n{f}" for f in range(folds))]
    total = counts.agg(*(F.sum(c).alias(c) for c in counts.columns[1:])).first()
    if not all(total[f"{c}_{k}"] for c in keys for k in (0, 1)):
        return None
    known = counts.where(F.col("word").isNotNull())
    corpus = corpus_counts(docs, known)
    every = corpus.agg(F.sum("found")).first()[0] or 0
    shared = F.greatest(F.coalesce("found", F.lit(0)), F.lit(0.5)) / max(1, every)
    back = {c: [max(1e-9, 1 - total[f"kept_{c}_{k}"] / total[f"{c}_{k}"]) for k in (0, 1)] for c in keys}
    chance = {c: [F.col(f"kept_{c}_{k}") / total[f"{c}_{k}"] + F.lit(back[c][k]) * shared for k in (0, 1)] for c in keys}
    table = known.join(corpus, "word", "left").select("word", *(F.log(chance[c][1] / chance[c][0]).alias(c) for c in keys)).toArrow()
    return table, {c: float(np.log(back[c][1] / back[c][0])) for c in keys}


def train(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0, label: str = "toxic", rare: int = RARE) -> Model:
    """A model from all labelled documents that aren't held out."""
    mine = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), parts, part))
    prior = mine.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    texts = labelled_texts(docs, labels, label, parts, part)
    if (found := class_models(docs, continuation_counts(texts, rare))) is None:
        return Model(None, np.zeros(1), prior)
    table, unknown = found
    words = table.column("word").to_pylist()
    # one dictionary for all parts: a word's row in the table of their differences
    rows = np.column_stack([table.column(f"n{f}").to_numpy() for f in range(FOLDS)])
    told = docs.sparkSession.sparkContext.broadcast((words, np.vstack([rows, [unknown[f"n{f}"] for f in range(FOLDS)]])))

    def compare():
        words, rows = told.value
        at = {w: i for i, w in enumerate(words)}

        def one(text: bytes | None, fold: int) -> list[float] | None:
            x = differences(rows[[at.get(w, -1) for w in tokens((text or b"").decode())], fold])
            return None if x is None else x.tolist()

        return lambda texts, folds: [[one(t, f) for t, f in zip(texts, folds)]]

    compared = add_columns(texts.withColumn("h", F.xxhash64("text")), "x array<double>", ("text", _fold()), compare).where("x IS NOT NULL")
    compared = compared.groupBy("doc_id", "label").agg(F.min_by("x", "h").alias("x"))
    # in one order, so that the sums don't depend on that of the rows
    compared = _settled(compared.repartition(docs.sparkSession.sparkContext.defaultParallelism, "doc_id").sortWithinPartitions("doc_id"))
    # each step reads these rows again: few tasks for few rows
    weights = fit_logistic(compared.coalesce(1 + compared.count() // 20_000))
    told.destroy()
    return Model(ClassModels(dict(zip(words, table.column("n").to_pylist())), unknown["n"]), weights, prior)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from a score of 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fill():
        m = shared.value
        return lambda texts: [[m.score(t.decode("utf-8", "replace") if t else None) for t in texts]]

    return add_columns(without(docs, "predicted"), "score double", "text", fill).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
