"""Toxicity by two class-conditional Kneser-Ney models.

The history of a word is its class, toxic or ordinary:

    P(w | class) = max(c(class, w) - D(c), 0) / c(class) + taken(class) / c(class) * P_shared(w)

c counts documents, so a text that repeats itself counts once; D has the three discounts of modified Kneser-Ney
smoothing, from each class's counts of counts; taken is what they take away. Both classes back off to one shared
distribution of continuation counts (after how many histories, here classes, w stands; and half of one more, which an
unknown word has too). So rare and unknown expressions are smoothed alike on both sides, and no word is left out.

Most words of a toxic text are ordinary, so a toxic text is likened to the ordinary model with a share of toxic words.
Its evidence is the difference of both log-likelihoods, length-normalised: the mean over its words of
log(1 - share + share * P(w | toxic) / P(w | ordinary)). The share, out of SHARES, and the cut on the evidence are those
of the best F1 on the training rows, whose evidence is cross-fitted; a logistic curve through the cut gives the score.

Words are lower-cased (A-Z), split at ASCII white space and freed of punctuation at their ends. The models are fitted on
at most SAMPLE toxic and ORDINARY other rows (by hash of doc_id, ties by doc_id), so their size is bounded by that
sample; all texts are scored. A null or empty text has no evidence. Of several labels of one doc_id the largest counts;
null labels don't. Rows of equal doc_id are all kept; the largest text of them trains. Without training rows of both
labels each score is the share of toxic ones (0 if none), and no document is rejected. Empty table: empty result. Columns
other than doc_id and text are kept by `accepted` as they are, and neither read nor returned by `scored`, whatever their
names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import by_bytes, documents, remainder, words, written

#: Training rows of label 1 and of label 0, at most.
SAMPLE, ORDINARY = 8_000, 24_000
FOLDS = 4
#: Bytes of text that are split into words at once.
BATCH = 2 << 20
#: Shares of toxic words that are tried.
SHARES = (0.03, 0.01, 0.003, 0.001, 0.0001)
EDGES = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]))


@dataclass
class Model:
    #: 64-bit hashes of the words, ascending.
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    #: P(w | toxic) / P(w | ordinary): a column for the whole training set and one without each fold; last the row of unknown words.
    ratios: np.ndarray = field(default_factory=lambda: np.ones((1, 1 + FOLDS)))
    share: float = SHARES[0]
    centre: float = 0.0
    slope: float = 1.0
    constant: float | None = None

    def evidences(self, texts: pa.Array, column: np.ndarray, shares: tuple[float, ...]) -> np.ndarray:
        """A row for each share. column: for each text the column of ratios to use."""
        index, rows = expressions(texts)
        n = np.diff(rows)
        out = np.zeros((len(shares), len(n)))
        if len(index):
            at = self.places(hashes(index.dictionary))[index.indices.to_numpy(zero_copy_only=False)]
            ratio = self.ratios[at, np.repeat(column, n)]
            row = np.repeat(np.arange(len(n)), n)
            for k, share in enumerate(shares):
                out[k] = np.bincount(row, weights=np.log(1 - share + share * ratio), minlength=len(n))
        return out / np.maximum(n, 1)

    def places(self, words_: np.ndarray) -> np.ndarray:
        """The row of each word's ratios; the last one for unknown words."""
        if not len(self.vocabulary):
            return np.full(len(words_), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, words_), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words_, at, -1)

    def scoring(self) -> Model:
        """What scoring needs: no folds."""
        return replace(self, ratios=self.ratios[:, :1])

    def evidence(self, texts: pa.Array, column: np.ndarray) -> np.ndarray:
        return self.evidences(texts, column, (self.share,))[0]

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x = self.slope * (self.evidence(texts, np.zeros(len(texts), dtype=np.int64)) - self.centre)
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def expressions(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of a column, deduplicated, and each row's first."""
    found, rows = words(texts)
    column = found.dictionary_encode()
    return pa.DictionaryArray.from_arrays(column.indices, pc.utf8_trim(column.dictionary.cast(pa.large_string()), EDGES).cast(pa.string())), rows


def hashes(names: pa.Array) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(x) for x in names.to_pylist()), dtype=np.uint64, count=len(names))


def fold_of(doc_ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"fold %d" % (i or 0)) % FOLDS for i in doc_ids], dtype=np.int64)


def count(sample: DataFrame) -> DataFrame:
    """The hash of every word, and how many documents of each label and fold hold it (a column for each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH):
            index, rows = expressions(batch.column("text"))
            at = index.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(at):
                continue
            names = index.dictionary.dictionary_encode()  # trimmed words may be equal
            at = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)[at]
            size = len(names.dictionary)
            row = np.repeat(np.arange(batch.num_rows), np.diff(rows))
            once = np.unique(row * size + at)
            kind = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64) * FOLDS + fold_of(batch.column("doc_id").to_pylist())
            counts = np.bincount(once % size * (2 * FOLDS) + kind[once // size], minlength=size * 2 * FOLDS).reshape(size, 2 * FOLDS)
            yield pa.RecordBatch.from_arrays([pa.array(hashes(names.dictionary).view(np.int64)), *(pa.array(counts[:, k].astype(np.int32)) for k in range(2 * FOLDS))], ["word", *(f"n{k}" for k in range(2 * FOLDS))])

    each = [f"n{k}" for k in range(2 * FOLDS)]
    rows = sample.mapInArrow(run, f"word long, {', '.join(f'{c} int' for c in each)}")
    return rows.groupBy("word").agg(*(F.sum(c).cast("int").alias(c) for c in each))


def discounts(counts: np.ndarray) -> np.ndarray:
    """What modified Kneser-Ney smoothing takes from each count: one amount for 1, 2, and more, by the counts of counts."""
    n = [1 + int((counts == k).sum()) for k in (1, 2, 3, 4)]  # one more, for few words
    y = n[0] / (n[0] + 2 * n[1])
    each = [min(k, max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3)]
    return np.minimum(counts, np.select([counts <= 0, counts == 1, counts == 2], [0.0, each[0], each[1]], each[2]))


def likelihoods(counts: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """P(w | class) for every word, and for an unknown one behind them, of both classes' document counts."""
    follows = np.append(sum((c > 0).astype(float) for c in counts), 0) + 0.5
    # Words that only a fold left out holds are unknown here, and an unknown word counts once.
    shared, out = follows / (follows[follows > 0.5].sum() + 0.5), []
    for c in counts:
        taken, size = discounts(c), c.sum()
        out.append((np.append(c - taken, 0) + taken.sum() * shared) / size if size and taken.sum() else (np.append(c, 0) + shared) / (size + 1))
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    labels = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(remainder(F.col("doc_id")) != 0)
    by_hash = labels.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id")
    chosen = by_hash.where("toxic = 1").limit(SAMPLE).unionByName(by_hash.where("toxic = 0").limit(ORDINARY))
    weigh = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    # At most SAMPLE + ORDINARY rows of two numbers.
    # One row for each sampled doc_id, so that repeated ones don't pass the bound.
    sample = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text")), "toxic-sample")
    if not (weigh.get(0) and weigh.get(1)) or {r.toxic for r in sample.select("toxic").distinct().collect()} != {0, 1}:
        return Model(constant=float(weigh.get(1, 0) / max(1, sum(weigh.values()))))
    found = count(sample).toArrow()  # the words of at most SAMPLE + ORDINARY texts
    names = found.column("word").to_numpy().view(np.uint64)
    order = np.argsort(names)
    n = np.column_stack([found.column(f"n{k}").to_numpy() for k in range(2 * FOLDS)])[order].astype(float)
    ratios = np.zeros((len(n) + 1, 1 + FOLDS))
    for at, fold in enumerate([-1, *range(FOLDS)]):
        use = [k for k in range(FOLDS) if k != fold]
        ordinary, toxic = likelihoods(tuple(n[:, [label * FOLDS + k for k in use]].sum(1) for label in (0, 1)))
        ratios[:, at] = toxic / ordinary
    return calibrated(sample, Model(names[order], ratios), weigh)


def calibrated(sample: DataFrame, model: Model, weigh: dict[int, int]) -> Model:
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH):
            each = shared.value.evidences(batch.column("text"), 1 + fold_of(batch.column("doc_id").to_pylist()), SHARES)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(list(each.T), pa.list_(pa.float64()))], ["toxic", "x"])

    got = sample.mapInArrow(run, "toxic int, x array<double>").toArrow()  # at most SAMPLE + ORDINARY rows
    y = got.column("toxic").to_numpy()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), len(SHARES))
    w = np.where(y == 1, weigh[1] / max(1, (y == 1).sum()), weigh[0] / max(1, (y == 0).sum()))
    cuts = [best_cut(x[:, k], y, w) for k in range(len(SHARES))]
    k = max(range(len(SHARES)), key=lambda k: cuts[k][0])
    model.share, (_, model.centre) = SHARES[k], cuts[k]
    spread = np.sqrt(np.average((x[:, k] - np.average(x[:, k], weights=w)) ** 2, weights=w))
    model.slope = 4 / (spread or 1.0)
    return model


def best_cut(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """The largest weighted F1, and the cut between two values of x that gives it."""
    order = np.argsort(-x, kind="stable")
    hits, all_ = np.cumsum((w * y)[order]), np.cumsum(w[order])
    last = np.append(np.diff(x[order]) != 0, True)  # a cut lies between different values
    f1 = np.where(last, 2 * hits / (all_ + (w * y).sum()), 0)
    best = int(f1.argmax())
    above, below = x[order][best], x[order][min(best + 1, len(x) - 1)]
    return float(f1[best]), float((above + below) / 2 if below < above else above - 1)


def scored(df: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of doc_id and text."""
    shared = df.sparkSession.sparkContext.broadcast(model.scoring())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(batch.column("text")))], ["doc_id", "score"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def accepted(df: DataFrame, model: Model) -> DataFrame:
    """The rows, all columns as they are, whose text isn't predicted toxic; all rows where no model could be fitted."""
    if model.constant is not None:
        return df
    shared = df.sparkSession.sparkContext.broadcast(model.scoring())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH):
            yield batch.filter(pa.array(shared.value.scores(batch.column("text")) < 0.5))

    return df.mapInArrow(run, df.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
