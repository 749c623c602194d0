"""Quality by random-indexing word vectors, pooled per document, and a two-layer network with calibrated probabilities.

Every whitespace-separated word, whatever its length, is a hashed term with a sparse random index vector; its context
vector is the sum of the index vectors of the words within REACH places, over the whole corpus. Beside its term a word
has a shape (``Aa.``, ``A!``, ``a$``; a mark if it repeats the word before), which has an index vector only. A document
is the mean, least and greatest of its words' vectors over stretches of STRETCH words. The network's logits are divided
by a temperature that is fitted on rows which the weights haven't seen.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathlore.llm._common import arrow_columns, read, stored, text_or_empty

#: Hashed words, and hashed shapes; the tables of vectors are of these sizes whatever the corpus.
TERMS, SHAPES = 1 << 15, 1 << 13
#: Dimensions of index and context vectors, places other than 0 of an index vector, and the reach of a context.
DIM, ONES, REACH = 32, 4, 2
#: Words of a stretch that is pooled by itself.
STRETCH = 64
#: Longest word that is its own shape, in bytes.
SHORT = 4
#: Words whose contexts a task adds at once.
WORDS_AT_ONCE = 1 << 20
#: Labelled rows to learn from at most (about, drawn by a hash of the id); a fifth of them fits the temperature.
SAMPLE = 20_000
MEMO_WORDS = 100_000
#: Scores from this on are predicted to be good.
GOOD = 0.7
REPEAT = 0
#: Features of a document.
WIDTH = 3 * 3 * DIM


def _index_vectors(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the ONES values of n sparse vectors."""
    rng = np.random.default_rng(seed)
    at = np.argsort(rng.random((n, DIM)), axis=1)[:, :ONES]
    return at, rng.choice([-1.0, 1.0], (n, ONES))


def _dense(at: np.ndarray, sign: np.ndarray) -> np.ndarray:
    out = np.zeros((len(at), DIM), np.float32)
    np.put_along_axis(out, at, sign.astype(np.float32), axis=1)
    return out


PLACES, SIGNS = _index_vectors(TERMS, 11)
INDEX = _dense(PLACES, SIGNS)
SHAPE_VECTORS = _dense(*_index_vectors(SHAPES, 12)) / np.float32(np.sqrt(ONES))
_RUNS = re.compile(r"(.)\1+", re.S)


class Terms(dict):
    """word -> hashed term, and its hashed shape above it; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        shape = word
        if len(word) > SHORT:
            kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word.decode("utf-8", "replace"))
            shape = b"\0" + _RUNS.sub(r"\1", kinds).encode("utf-8", "replace")[:12]
        self[word] = out = xxhash.xxh3_64_intdigest(word) % TERMS | 1 + xxhash.xxh3_64_intdigest(shape) % (SHAPES - 1) << 16
        return out


def terms(text: str | None, memory: Terms | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of a whole text, in order, and their hashed shapes."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    both = np.fromiter(map((Terms() if memory is None else memory).__getitem__, words), np.uint32, len(words))
    shapes = (both >> 16).astype("<u2")
    if len(words) > 1:
        same = np.fromiter((a == b for a, b in zip(words[1:], words[:-1], strict=True)), bool, len(words) - 1)
        shapes[1:][same] = REPEAT
    return both.astype("<u2"), shapes


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of index vectors by term over a task's texts, some words at a time."""
    total = np.zeros(TERMS * DIM)

    def add(codes: np.ndarray, of: np.ndarray) -> None:
        for step in range(1, REACH + 1):
            for a in range(step, len(codes), WORDS_AT_ONCE):
                second = slice(a, a + WORDS_AT_ONCE)
                first = slice(a - step, min(a + WORDS_AT_ONCE, len(codes)) - step)
                near = of[first] == of[second]
                before, after = codes[first][near].astype(np.int64), codes[second][near].astype(np.int64)
                for own, other in ((before, after), (after, before)):
                    for one in range(ONES):
                        total[:] += np.bincount(own * DIM + PLACES[other, one], weights=SIGNS[other, one], minlength=TERMS * DIM)

    waiting, of, size, at = [], [], 0, 0
    for batch in batches:
        for data in batch["codes"]:
            own = np.frombuffer(data, "<u2")
            waiting.append(own)
            of.append(np.full(len(own), at))
            size, at = size + len(own), at + 1
            if size > WORDS_AT_ONCE:
                add(np.concatenate(waiting), np.concatenate(of))
                waiting, of, size = [], [], 0
    if size:
        add(np.concatenate(waiting), np.concatenate(of))
    vectors = total.reshape(TERMS, DIM)
    used = np.flatnonzero(np.abs(vectors).sum(axis=1))
    # the salt keeps the sums of one term from meeting in one task; a repeated task draws the same
    yield pd.DataFrame({"term": used, "salt": TaskContext.get().partitionId() % 64, "vector": [v.tobytes() for v in vectors[used].astype(np.int32)]})


def _added(rows: pd.DataFrame, kind: type) -> pd.DataFrame:
    terms_, at = np.unique(rows["term"], return_inverse=True)
    vectors = np.zeros((len(terms_), DIM))
    np.add.at(vectors, at, np.frombuffer(b"".join(rows["vector"]), kind).reshape(-1, DIM))
    return pd.DataFrame({"term": terms_, "vector": [v.tobytes() for v in vectors]})


def word_vectors(codes: DataFrame) -> np.ndarray:
    """Index and context vector of every hashed word, from all rows of codes: TERMS x 2 DIM, of fixed size."""
    parts = codes.select("codes").mapInPandas(_contexts, "term long, salt long, vector binary")
    schema = "term long, vector binary"
    some = parts.withColumn("part", F.col("term") % 256).groupBy("part", "salt").applyInPandas(lambda rows: _added(rows, np.int32), schema)
    sums = some.withColumn("part", F.col("term") % 256).groupBy("part").applyInPandas(lambda rows: _added(rows, np.float64), schema).collect()  # TERMS rows at most
    context = np.zeros((TERMS, DIM))
    for r in sorted(sums):
        context[r["term"]] = np.frombuffer(r["vector"], np.float64)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    return np.concatenate([INDEX / np.sqrt(ONES), context], axis=1).astype(np.float32)


def pooled(codes: np.ndarray, shapes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean, least and greatest over the stretches of a document; zeros without words."""
    if not len(codes):
        return np.zeros(WIDTH, np.float32)
    starts = np.arange(0, max(1, len(codes) - STRETCH // 2), STRETCH)
    sums = np.concatenate([np.add.reduceat(v[of], starts, axis=0) for v, of in ((vectors, codes), (SHAPE_VECTORS, shapes))], axis=1)
    means = sums / np.diff(np.append(starts, len(codes)))[:, None]
    return np.concatenate([sums.sum(axis=0) / len(codes), means.min(axis=0), means.max(axis=0)]).astype(np.float32)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(((x - self.mean) / self.scale) @ w1 + b1) @ w2 + b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, decay: float = 1e-4) -> Network:
    """Fits the weights to four fifths of the rows and the temperature to the rest."""
    rng = np.random.default_rng(5)
    if not len(x) or y.min() == y.max():  # nothing to tell apart
        d = x.shape[1]
        rate = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(d), np.ones(d), (np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(rate / (1 - rate)))))
    order = rng.permutation(len(x))
    fit, rest = order[len(x) // 5 :], order[: len(x) // 5]
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    z, t = (x[fit] - mean) / scale, y[fit].astype(float)
    param = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in param], [np.zeros_like(p) for p in param], 0
    steps = epochs * -(-len(z) // 256)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(z)), -(-len(z) // 256)):
            step += 1
            h = np.tanh(z[batch] @ param[0] + param[1])
            g = (1 / (1 + np.exp(-np.clip(h @ param[2] + param[3][0], -60, 60))) - t[batch]) / len(batch)
            back = np.outer(g, param[2]) * (1 - h * h)
            grads = [z[batch].T @ back + decay * param[0], back.sum(axis=0), h.T @ g + decay * param[2], np.array([g.sum()])]
            rate = 5e-3 * (1 - (step - 1) / steps)
            for i, grad in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                param[i] = param[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, (param[0], param[1], param[2], float(param[3][0])))
    if len(rest):
        logits, want = net.logits(x[rest]), y[rest]
        choices = np.geomspace(0.25, 8, 61)
        loss = [np.mean(np.logaddexp(0, np.where(want == 1, -1, 1) * logits / c)) for c in choices]
        net.temperature = float(choices[int(np.argmin(loss))])
    return net


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, score (the probability of label 1), predicted (1 if score >= GOOD, else 0) for each row of docs.

    Word vectors come from all texts, the network from about ``sample`` rows of labels (id, quality 0 or 1), drawn by
    a hash of the id. Only texts are inputs of a score. Null and empty texts are scored too, as a document without
    terms; null ids and labels, and labels of no row, are no rows to learn from; rows that repeat an id with different
    labels count with the least. Without two kinds of labels every row has the labels' smoothed share as its score. An
    empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))

    def coded() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        memory = Terms()

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            both = [terms(t.as_py(), memory) for t in batch["text"]]
            return [pa.array([b[i].tobytes() for b in both], pa.binary()) for i in (0, 1)]

        return run

    codes = stored(arrow_columns(rows, coded, [("codes", T.BinaryType()), ("shapes", T.BinaryType())], drop=["text"]), "quality-codes")
    shared = docs.sparkSession.sparkContext.broadcast(word_vectors(codes))

    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    share = min(1.0, sample / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def features(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [pooled(np.frombuffer(c, "<u2"), np.frombuffer(o, "<u2"), shared.value) for c, o in zip(batch["codes"].to_pylist(), batch["shapes"].to_pylist(), strict=True)]

    def pool(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([x.tobytes() for x in features(batch)], pa.binary())]

    learn = sorted(arrow_columns(codes.join(F.broadcast(drawn), "doc_id"), lambda: pool, [("x", T.BinaryType())], drop=["codes", "shapes"]).collect())  # bounded by sample
    x = np.array([np.frombuffer(r["x"], np.float32) for r in learn], np.float64).reshape(len(learn), WIDTH)
    net = docs.sparkSession.sparkContext.broadcast(train(x, np.array([r["quality"] for r in learn], np.int64)))

    def scored(batch: pa.RecordBatch) -> list[pa.Array]:
        p = net.value.probabilities(np.array(features(batch), np.float64).reshape(-1, WIDTH))
        return [pa.array(p), pa.array((p >= GOOD).astype(np.int32))]

    return arrow_columns(codes, lambda: scored, [("score", T.DoubleType()), ("predicted", T.IntegerType())], drop=["codes", "shapes"])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; a quarter of the labels is held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    labels = read(spark, sf_dir, "labels").where(~held_out)
    return score_quality(read(spark, sf_dir, "documents"), labels).select("doc_id", held_out.alias("held_out"), "score", "predicted")
