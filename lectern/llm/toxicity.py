"""Toxicity by multiple-instance learning: sentences get the scores, documents the labels.

A document is a bag of sentences. A sentence's score is a logistic function of the weights of its words, and the
document's is their noisy-or, 1 - prod(1 - score): it is toxic as soon as one sentence is. The weights are fitted to
document labels by the gradient of that likelihood, so the model learns which sentences offend without being told.

Features are words with A-Z as a-z, and their first and last few bytes (inflected and compound words share them),
hashed into ``2**bits`` buckets. Counting and selecting them and all scoring run on the executors; the driver gets the
selected buckets (``features`` at most) of the training documents and fits. Training rows are a bounded sample of the
labelled ones: ``per_class`` of each label at most, by the order of a hash of the id, as long as they have no more than
``pairs`` occurrences of features in all (a text that would exceed that is left out whole); the loss weighs them back to
the labels' shares. Everything else covers all rows.

Cases: texts of any length; null text is empty; an empty text has the score of a bag without sentences, 0. Labels that are null or of
null ids are left out; the larger of several labels of an id holds, and of several texts of an id the least trains. Without labels of both kinds all scores are 0.
Repeated rows are scored each; other columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._run import Carried, cut, lean, ship

U = np.uint64
HEADS, TAILS = (3, 4, 5, 6), (4, 5)
ENDS = np.zeros(256, dtype=bool)
ENDS[list(b".!?\n")] = True


def _features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[W.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words; the sentence of each word, numbered over the chunk; the row of each sentence; buckets, one column a kind (-1: none)."""
    w = W.words(data, offsets, W.ALNUM)
    stops = np.cumsum(ENDS[data]) if len(data) else np.zeros(0, dtype=np.int64)
    part = stops[w.start] if len(w.start) else np.zeros(0, dtype=np.int64)
    new = np.concatenate([[True], (part[1:] != part[:-1]) | (w.doc[1:] != w.doc[:-1])]) if len(part) else np.zeros(0, dtype=bool)
    sentence = np.cumsum(new) - 1
    cols = [w.code]
    inside, value = W.ALNUM.tables()
    power, back = W._powers("byte", len(data))
    run = np.concatenate([np.zeros(1, dtype=U), np.cumsum(value[data] * power[: len(data)], dtype=U)])
    size = w.end - w.start
    gone = np.zeros(len(w.code), dtype=U)
    for k, sides in ((0, HEADS), (1, TAILS)):
        for n in sides:
            ok = size > n
            a = np.where(ok, w.end - n if k else w.start, 0)
            z = np.where(ok, a + n, 0)
            cols.append(np.where(ok, W.mix((run[z] - run[a]) * back[a] + U(1000 * (k + 1) + n)), gone))
    buckets = (np.stack(cols, axis=1) >> U(64 - bits)).astype(np.int64) if len(w.code) else np.zeros((0, len(cols)), dtype=np.int64)
    buckets[np.stack(cols, axis=1) == 0] = -1
    return w, sentence, w.doc[new], buckets


def _counts(bits: int):
    """Documents of each label that have a bucket; as counts of a batch, for buckets that a toxic one has."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 1 << bits
        for b in batches:
            label = b.column(1).to_numpy(zero_copy_only=False)
            held = np.zeros((2, n), dtype=np.int64)
            for row, _, data, offsets in W.chunks(b.column(0)):
                w, _, _, buckets = _features(data, offsets, bits)
                pair = np.unique(w.doc[:, None] * (n + 1) + buckets + 1)
                doc, bucket = pair // (n + 1), pair % (n + 1) - 1
                doc, bucket = doc[bucket >= 0], bucket[bucket >= 0]
                y = label[row + doc]
                for side in (0, 1):
                    held[side] += np.bincount(bucket[y == side], minlength=n)
            found = np.flatnonzero(held.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(held[1][found]), pa.array(held[0][found])], names=["bucket", "toxic", "clean"])

    return each


def _bags(bits: int, shared):
    """Of each training text: its order, label, number of sentences, and (sentence, feature) pairs of the selected buckets."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full((1 << bits) + 1, -1, dtype=np.int64)
        place[shared.value] = np.arange(len(shared.value))
        for b in batches:
            for row, rows, data, offsets in W.chunks(b.column(0)):
                w, sentence, of, buckets = _features(data, offsets, bits)
                f = place[buckets]
                at = np.nonzero(f >= 0)
                first = np.searchsorted(of, np.arange(rows + 1))
                doc = w.doc[at[0]]
                to = np.searchsorted(doc, np.arange(rows + 1))
                lists = [pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (sentence[at[0]] - first[doc], f[at])]
                yield pa.RecordBatch.from_arrays([b.column(2).slice(row, rows), b.column(1).slice(row, rows), pa.array(np.diff(first).astype(np.int32)), *lists], names=["order", "label", "n", "sentence", "feature"])

    return each


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(label: np.ndarray, n: np.ndarray, doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, features: int, weight: np.ndarray, steps: int = 400, ridge: float = 0.003) -> tuple[float, np.ndarray]:
    """Bias and weights that maximize the noisy-or likelihood, by Adam on the whole sample."""
    first = np.concatenate([[0], np.cumsum(n)])
    of = np.repeat(np.arange(len(n)), n)
    row = first[doc] + sentence
    theta = np.concatenate([[-4.0], np.full(features, 0.5)])
    m = v = np.zeros(features + 1)
    for step in range(1, steps + 1):
        p = _sigmoid(theta[0] + np.bincount(row, theta[1:][feature], minlength=len(of)))
        none = np.exp(np.bincount(of, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(n)))  # no sentence offends
        pull = np.where(label == 1, none / np.maximum(1 - none, 1e-9), -1.0) * weight
        g = pull[of] * p
        slope = np.concatenate([[g.sum()], np.bincount(feature, g[row], minlength=features)]) / weight.sum()
        slope[1:] -= ridge * theta[1:] / np.sqrt(max(len(n), 1))
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return float(theta[0]), theta[1:]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 4000, features: int = 3000, bits: int = 18, pairs: int = 20_000_000) -> tuple[float, np.ndarray]:
    """Bias and the weight of every bucket."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    weights = np.zeros(1 << bits, dtype=np.float32)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    # the sample is the per_class least of a hash: each step keeps so many at most, whatever the table's size
    drawn = [known.where(f"_y = {y}").orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    total = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    sample = drawn[0].unionByName(drawn[1])
    texts = cut(docs.select(F.col(id_col).alias("_i"), F.coalesce(text_col, F.lit("")).alias("_t")).join(F.broadcast(sample), F.col("_i") == F.col("_id")).groupBy("_id").agg(F.min("_t").alias("_t"), F.max("_y").alias("_y")))
    found = texts.select("_t", "_y").mapInArrow(lean(_counts(bits)), "bucket long, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("p"), F.sum("clean").alias("q")).where("p >= 2")
    sizes = {r["_y"]: r["count"] for r in texts.groupBy("_y").count().collect()}
    if len(sizes) < 2:
        return -30.0, weights
    rate = F.log(((F.col("p") + 0.5) / sizes[1]) / ((F.col("q") + 0.5) / sizes[0]))
    best = found.withColumn("gain", F.col("p") * rate).where(rate > 1.0).orderBy(F.desc("gain"), "bucket").limit(features).select("bucket").toPandas()["bucket"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(best)
    drawn_by = F.xxhash64("_id")
    bags = cut(texts.select("_t", "_y", drawn_by.alias("_o")).mapInArrow(lean(_bags(bits, shared)), "order long, label int, n int, sentence array<int>, feature array<int>"))
    held, taken = 0, []
    for r in bags.select("order", F.size("feature").alias("m")).orderBy("order").collect():  # 2 * per_class rows at most
        if held + r["m"] <= pairs:
            held += r["m"]
            taken.append(r["order"])
    if len(taken) < sum(sizes.values()):
        bags = bags.join(spark.createDataFrame([(x,) for x in taken], "order long"), "order", "left_semi")
    bags = bags.toPandas().sort_values("order", ignore_index=True)
    doc = np.repeat(np.arange(len(bags)), bags["feature"].map(len).to_numpy())
    flat = lambda c: np.concatenate([np.asarray(x, dtype=np.int64) for x in bags[c]]) if len(bags) else np.empty(0, dtype=np.int64)
    label = bags["label"].to_numpy()
    weight = np.where(label == 1, total[1] / max((label == 1).sum(), 1), total[0] / max((label == 0).sum(), 1))
    bias, w = fit(label, bags["n"].to_numpy().astype(np.int64), doc, flat("sentence"), flat("feature"), len(best), weight)
    weights[best] = w
    return bias, weights


def _score(shared, bits: int, spans: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, weights = shared.value
        weights = np.append(weights, np.float32(0))  # bucket -1
        for b in batches:
            for row, rows, data, offsets in W.chunks(b.column(0)):
                w, sentence, of, buckets = _features(data, offsets, bits)
                p = _sigmoid(bias + np.bincount(sentence, weights[buckets].sum(axis=1, dtype=np.float64), minlength=len(of)))
                score = 1 - np.exp(np.bincount(of, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=rows))
                out = [b.column(1).slice(row, rows), pa.array(np.clip(score, 0.0, 1.0))]
                names = ["_row", "score"]
                if spans:
                    bad = np.flatnonzero(p >= 0.5)
                    first = np.searchsorted(sentence, np.arange(len(of) + 1))
                    texts = [data[w.start[first[s]] : w.end[first[s + 1] - 1]].tobytes().decode() for s in bad]
                    out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(of[bad], np.arange(rows + 1)).astype(np.int32)), pa.array(texts, pa.string())))
                    names.append("offending")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return each


def toxicity(docs: DataFrame, model: tuple[float, np.ndarray], text_col: str = "text", spans: bool = True) -> DataFrame:
    """docs' columns with score (0 to 1) and, if spans, offending: the sentences that score 0.5 or more."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    bits = len(model[1]).bit_length() - 1
    more = [("score", "double")] + [("offending", "array<string>")] * spans
    own = Carried(docs, tuple(n for n, _ in more))
    scored = docs.select(F.col(text_col).alias("_text"), own.packed).mapInArrow(lean(_score(shared, bits, spans)), own.schema(*more))
    return own.unpacked(scored, *[n for n, _ in more])


def held_out(id_col: str = "doc_id"):
    """Rows kept from training: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
