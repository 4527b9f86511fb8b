"""Operator 3: a quality classifier over random-indexing word vectors."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, crc32_of_id, doc_columns, tidy
from .wordhash import column_words, scrambled

U = np.uint64
PARTS, GRAMS, CONTEXT, NONZERO = 64, 4096, 32, 4


def index_entries(h: np.ndarray, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-th of a word's few non-zero index entries: (dimension, +1 or -1)."""
    r = scrambled(h + U(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF))
    return (r >> U(1)).astype(np.int64) % dims, (r & U(1)).astype(np.float32) * 2 - 1


def gram_vectors() -> np.ndarray:
    """The fixed random index vector of each bucket of byte trigrams."""
    rng = np.random.default_rng(7)
    out = np.zeros((GRAMS, PARTS), np.float32)
    for row in out:
        row[rng.choice(PARTS, 8, replace=False)] = rng.choice([-1.0, 1.0], 8)
    return out


class Vectors:
    """Word vectors: for every word the index vectors of its byte trigrams, for words of the vocabulary also a context vector."""

    def __init__(self, vocabulary: np.ndarray, contexts: np.ndarray):
        self.vocabulary, self.contexts, self.grams = vocabulary, contexts, gram_vectors()

    @staticmethod
    def learn(texts: list[np.ndarray], most: int = 20_000, least_count: int = 3) -> Vectors:
        """Contexts from word hashes of texts: each vocabulary word sums the index vectors of words up to two places away."""
        every = np.concatenate(texts) if texts else np.empty(0, np.uint64)
        words, n = np.unique(every, return_counts=True)
        words, n = words[n >= least_count], n[n >= least_count]
        vocabulary = np.sort(words[np.argsort(-n, kind="stable")[:most]])
        sums = np.zeros(len(vocabulary) * CONTEXT, np.float64)
        if len(vocabulary):
            at = np.minimum(np.searchsorted(vocabulary, every), len(vocabulary) - 1)
            known = vocabulary[at] == every
            text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            for k in range(NONZERO):
                dim, sign = index_entries(every, k, CONTEXT)
                for step in (1, 2):
                    same = text[step:] == text[:-step]
                    for near, own in ((slice(step, None), slice(None, -step)), (slice(None, -step), slice(step, None))):
                        use = same & known[own]
                        sums += np.bincount(at[own][use] * CONTEXT + dim[near][use], weights=sign[near][use], minlength=len(sums))
        contexts = sums.reshape(-1, CONTEXT)
        contexts = contexts - contexts.mean(0) if len(contexts) else contexts
        contexts /= np.linalg.norm(contexts, axis=1, keepdims=True) + 1e-9
        return Vectors(vocabulary, contexts.astype(np.float32))

    def pooled(self, column: pa.Array) -> np.ndarray:
        """A row for each whole text: mean trigram and context vectors of its words, and how long and how varied it is."""
        raw, starts, ends, first, h = column_words(column)
        docs, n = len(first) - 1, np.diff(first)
        text = np.repeat(np.arange(docs), n)
        out = np.zeros((docs, PARTS + CONTEXT + 6), np.float32)
        many = np.maximum(n, 1)[:, None]
        if len(h):
            size = ends - starts
            # trigrams of each word with a space before and after it, from the bytes around its places
            place = np.repeat(starts, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            at_start, at_end = np.zeros(len(place), bool), np.zeros(len(place), bool)
            at_start[np.cumsum(size) - size] = True
            at_end[np.cumsum(size) - 1] = True
            before = np.where(at_start, 32, raw[np.maximum(place - 1, 0)]).astype(np.uint32)
            after = np.where(at_end, 32, raw[np.minimum(place + 1, len(raw) - 1)]).astype(np.uint32)
            gram = ((before << 16 | raw[place].astype(np.uint32) << 8 | after) * np.uint32(2654435761) >> np.uint32(20)).astype(np.int64)
            owner = np.repeat(text, size)
            counts = np.bincount(owner * GRAMS + gram, minlength=docs * GRAMS).reshape(docs, GRAMS).astype(np.float32)
            out[:, :PARTS] = counts @ self.grams / np.maximum(counts.sum(1, keepdims=True), 1)
            if len(self.vocabulary):
                at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
                known = np.flatnonzero(self.vocabulary[at] == h)
                for k in range(CONTEXT):
                    out[:, PARTS + k] = np.bincount(text[known], weights=self.contexts[at[known], k], minlength=docs)
                out[:, -1] = np.bincount(text[known], minlength=docs) / many[:, 0]
                out[:, PARTS : PARTS + CONTEXT] /= many
            order = np.lexsort((h, text))
            new = np.ones(len(h), bool)
            new[1:] = (h[order[1:]] != h[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
            distinct = np.bincount(text[order[new]], minlength=docs)
            out[:, -2] = distinct / many[:, 0]
            out[:, -3] = np.log1p(distinct)
            out[:, -5] = np.bincount(text, weights=size, minlength=docs) / many[:, 0]
            out[:, -6] = np.linalg.norm(out[:, PARTS : PARTS + CONTEXT], axis=1)
        out[:, -4] = np.log1p(n)
        return out


class Network:
    """Two layers in numpy, and the temperature its outputs are divided by."""

    def __init__(self, mean, scale, w1, b1, w2, b2, temperature: float = 1.0):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = mean, scale, w1, b1, w2, b2, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, steps: int = 600, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> Network:
        """Adam on the log loss over four fifths of the rows; the temperature that fits the rest best."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        hold, train = order[: len(y) // 5], order[len(y) // 5 :]
        net = Network(x.mean(0), x.std(0) + 1e-6, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1))
        z, t = (x[train] - net.mean) / net.scale, y[train]
        params = [net.w1, net.b1, net.w2, net.b2]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            a = np.tanh(z @ net.w1 + net.b1)
            gap = (1 / (1 + np.exp(-np.clip(a @ net.w2 + net.b2, -40, 40))) - t) / max(len(t), 1)
            back = np.outer(gap, net.w2) * (1 - a * a)
            for k, g in enumerate((z.T @ back + decay * net.w1, back.sum(0), a.T @ gap + decay * net.w2, np.array([gap.sum()]))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if len(hold):
            raw = net.logits(x[hold])
            loss = {c: np.mean(np.logaddexp(0, np.where(y[hold] > 0, -raw, raw) / c)) for c in np.geomspace(0.5, 8, 60)}
            net.temperature = float(min(loss, key=loss.get))
        return net


def fit_sample(batches: Iterator[pa.RecordBatch]) -> bytes:
    """The model of labelled texts (columns text and quality), as bytes."""
    kept, hashes, labels = [], [], []
    for whole in batches:
        for b in byte_slices(whole, "text", 1 << 19, 1000):
            _, _, _, first, h = column_words(b.column("text"))
            hashes += [h[i:j] for i, j in zip(first, first[1:], strict=False)]
            labels += b.column("quality").to_pylist()
            kept.append(b.column("text"))
    vectors = Vectors.learn(hashes)
    y = np.array(labels, np.float64)
    del hashes
    x = np.concatenate([vectors.pooled(c) for c in kept]) if kept else np.zeros((0, PARTS + CONTEXT + 6))
    if not len(y):  # nothing is known of quality, so nothing is rejected
        x, y = np.zeros((1, x.shape[1])), np.ones(1)
    net = Network.fit(x.astype(np.float64), y)
    out = io.BytesIO()
    np.savez(out, vocabulary=vectors.vocabulary, contexts=vectors.contexts, mean=net.mean, scale=net.scale, w1=net.w1, b1=net.b1, w2=net.w2, b2=net.b2, temperature=net.temperature)
    return out.getvalue()


def load_model(content: bytes) -> tuple[Vectors, Network]:
    """The word vectors and the network of :func:`fit_sample`."""
    z = np.load(io.BytesIO(content))
    return Vectors(z["vocabulary"], z["contexts"]), Network(*(z[k] for k in ("mean", "scale", "w1", "b1", "w2", "b2")), float(z["temperature"]))


def _fitted(docs: DataFrame, labels: DataFrame, sample: int, folds: int, id_col: str, text_col: str):
    """The broadcast model of at most ``sample`` labelled rows; labels of held-out ids are never read."""
    own = doc_columns(docs, id_col, text_col)
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("_id").isNotNull() & F.col("quality").isNotNull() & (F.pmod(crc32_of_id(F.col("_id")), F.lit(folds)) != 0))
    drawn = known.groupBy("_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = own.join(F.broadcast(drawn), own["doc_id"] == drawn["_id"])
    # one row of an id, so that repeated ids add none
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "quality")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([fit_sample(batches)], pa.binary())], ["model"])
        tidy()

    fitted = rows.repartition(1).sortWithinPartitions(F.xxhash64("text")).mapInArrow(fit, "model binary").first()
    return docs.sparkSession.sparkContext.broadcast(bytes(fitted["model"]) if fitted else fit_sample(iter(())))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = 6000, threshold: float = 0.3, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    held_out: crc32 of the id as text is divisible by ``folds``; labels of such rows
    are never used.  Of the other labelled ids the ``sample`` ones with the smallest
    hashes are learned from, a row for each, in one task: that bound keeps the fit
    alike at every size.  Every whole text is scored, from its words alone.
    predicted: 1 if the score is ``threshold`` or more.

    Null and empty texts are scored as texts without words.  Null labels are left
    out; of several labels of an id the largest counts, of several texts the one with
    the smallest hash.  Without labels all scores are high.  Null and repeated ids
    are rows like others.
    """
    model = _fitted(docs, labels, sample, folds, id_col, text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = load_model(model.value)
        for whole in batches:
            for b in byte_slices(whole, "text", 1 << 19, 1000):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(net.scores(vectors.pooled(b.column("text"))).astype(np.float64))], ["doc_id", "score"])
        tidy()

    scored = doc_columns(docs, id_col, text_col).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (F.pmod(crc32_of_id(F.col("doc_id")), F.lit(folds)) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept_by_quality(docs: DataFrame, labels: DataFrame, sample: int = 6000, threshold: float = 0.3, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own text scores ``threshold`` or more, as :func:`quality_scores` scores it; all columns stay and nothing moves."""
    model = _fitted(docs, labels, sample, folds, id_col, text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = load_model(model.value)
        for whole in batches:
            for b in byte_slices(whole, text_col, 1 << 19, 1000):
                yield b.filter(pa.array(net.scores(vectors.pooled(b.column(text_col))) >= threshold))
        tidy()

    return docs.mapInArrow(keep, docs.schema)
