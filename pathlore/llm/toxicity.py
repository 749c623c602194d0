"""Severity of toxicity by cumulative-link (proportional odds) ordinal regression on sparse features of words and stems.

``P(grade <= k) = sigmoid(cut[k] - w . x)``: all thresholds share the weights w, the cuts ascend. x holds, for the
hashed words and stems of a text, log(1 + count). The score is the expected grade.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathlore.llm._common import arrow_columns, packed, read, stored, text_or_empty, unpacked

#: Hashed words, rows to fit on at most (about, drawn by a hash of the id), and words that may have a weight.
SPACE, SAMPLE, FEATURES = 1 << 22, 20_000, 2048
#: Lengths of stems in characters, and words that a task remembers at most.
STEMS, MEMO_WORDS = (4, 5, 6), 100_000
#: Rows of which so few have a word, or whose grades it tells apart by fewer standard errors, give it no weight.
LEAST_ROWS, LEAST_Z = 3, 3.0
#: Rejected are rows whose probability of a grade above 0 is at least this.
REJECT = 0.3
_EDGE = re.compile(rb"^[\x00-/:-@\[-`{-\x7f]+|[\x00-/:-@\[-`{-\x7f]+$")


class Words(dict):
    """word -> its row in ``slots``: hashes of the word, without what is no letter or digit at its ends, and of its
    first characters, which stand for a stem; bounded."""

    def __init__(self) -> None:
        super().__init__()
        self.slots = np.zeros((1 << 14, 1 + len(STEMS)), np.int32)

    def __missing__(self, word: bytes) -> int:
        if (row := len(self)) == len(self.slots):
            self.slots = np.resize(self.slots, (2 * row, 1 + len(STEMS)))
        bare = _EDGE.sub(b"", word).decode("utf-8", "replace")
        forms = [bare, *[f"{n} {bare[:n]}" if len(bare) > n else bare for n in STEMS]]
        self.slots[row] = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace")) % SPACE for x in forms]
        self[word] = row
        return row

    def rows(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMO_WORDS:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.slots[at]


def features(text: str | None, memory: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and stems of a whole text, ascending, and their log(1 + count)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    slots = np.sort((Words() if memory is None else memory).rows(words), axis=1)
    fresh = np.concatenate([np.ones((len(slots), 1), bool), slots[:, 1:] != slots[:, :-1]], axis=1)  # a short word is its own stem
    found, counts = np.unique(slots[fresh], return_counts=True)
    return found, np.log1p(counts).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    slots: np.ndarray  #: ascending hashed words that have a weight
    weights: np.ndarray
    cuts: np.ndarray  #: ascending, one fewer than grades

    def grades(self, z: np.ndarray) -> np.ndarray:
        """The probability of each grade (a column each) at w . x = z."""
        below = np.concatenate([np.zeros((len(z), 1)), _sigmoid(self.cuts[None, :] - z[:, None]), np.ones((len(z), 1))], axis=1)
        return np.diff(below, axis=1)

    def logit(self, row: tuple[np.ndarray, np.ndarray]) -> float:
        slots, values = row
        if not len(slots) or not len(self.slots):
            return 0.0
        at = np.minimum(np.searchsorted(self.slots, slots), len(self.slots) - 1)
        hit = self.slots[at] == slots
        return float(self.weights[at[hit]] @ values[hit])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, ridge: float = 1e-5, steps: int = 800) -> OrdinalModel:
    """Fits the model to rows of features and their grades 0, 1, ...; words that don't tell grades apart have no weight."""
    n_grades = max(2, int(grade.max(initial=0)) + 1)
    of = np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows])
    slots, values = (np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, np.int32) for i in (0, 1))
    names, col = np.unique(slots, return_inverse=True)
    seen, bad = np.bincount(col, minlength=len(names)), np.bincount(col, weights=(grade > 0)[of], minlength=len(names))
    rate = float((grade > 0).mean()) if len(grade) else 0.0
    z = (bad - seen * rate) / np.sqrt(np.maximum(seen * rate * (1 - rate), 1e-9))
    useful = np.flatnonzero((seen >= LEAST_ROWS) & (np.abs(z) >= LEAST_Z))
    useful = np.sort(useful[np.argsort(-np.abs(z[useful]), kind="stable")[:FEATURES]])
    index = np.full(len(names), -1)
    index[useful] = np.arange(len(useful))
    keep = index[col] >= 0
    of, col, values = of[keep], index[col[keep]], values[keep].astype(float)

    share = np.clip([np.mean(grade <= k) if len(grade) else 1.0 for k in range(n_grades - 1)], 1e-3, 1 - 1e-3)
    cuts = np.log(share / (1 - share))
    param = np.concatenate([np.zeros(len(useful)), [cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-2))])
    d, n = len(useful), max(1, len(rows))
    m, v = np.zeros_like(param), np.zeros_like(param)
    for step in range(1, steps + 1):
        w, cuts = param[:d], np.cumsum(np.concatenate([param[d : d + 1], np.exp(param[d + 1 :])]))
        x = np.bincount(of, weights=w[col] * values, minlength=len(rows))
        upper = np.where(grade < n_grades - 1, _sigmoid(cuts[np.minimum(grade, n_grades - 2)] - x), 1.0)
        lower = np.where(grade > 0, _sigmoid(cuts[np.maximum(grade - 1, 0)] - x), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        gx = (du - dl) / n  # of the negative log likelihood by x
        by_cut = (np.bincount(np.minimum(grade, n_grades - 2), weights=-du * (grade < n_grades - 1), minlength=n_grades - 1) + np.bincount(np.maximum(grade - 1, 0), weights=dl * (grade > 0), minlength=n_grades - 1)) / n
        tail = np.cumsum(by_cut[::-1])[::-1]
        g = np.concatenate([np.bincount(col, weights=gx[of] * values, minlength=d) + ridge * w, tail[:1], tail[1:] * np.exp(param[d + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        param -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return OrdinalModel(names[useful], param[:d], np.cumsum(np.concatenate([param[d : d + 1], np.exp(param[d + 1 :])])))


def severity(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> np.ndarray:
    """Grades of rows that are only marked toxic or not: 0, and for toxic rows 1, 2 or 3 by thirds of how much toxic
    matter they hold, by a first fit to the marks alone."""
    grade = (toxic > 0).astype(np.int64)
    model = fit(rows, grade)
    amount = np.array([model.logit(r) for r in rows])[grade > 0] if rows else np.zeros(0)
    if len(amount) >= 3:
        grade[grade > 0] += np.searchsorted(np.quantile(amount, [1 / 3, 2 / 3]), amount, side="right")
    return grade


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", id_col: str = "doc_id", toxic: str = "toxic") -> OrdinalModel:
    """Fits on about ``sample`` labelled rows, drawn by a hash of the id; all of them when there are fewer.

    Labels without an id or a mark are left out, and an id with several marks has the largest; documents without a label
    are left out, documents that share an id each count, and null texts are empty ones. Without rows nothing is toxic.
    """
    known = labels.where(F.col(toxic).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(toxic).cast("int")).alias("toxic"))
    share = min(1.0, sample / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text).alias("text")).join(F.broadcast(drawn), "id")

    def of() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        memory = Words()

        def found(batch: pa.RecordBatch) -> list[pa.Array]:
            made = [features(t.as_py(), memory) for t in batch["text"]]
            return [pa.array([s.astype("<i4").tobytes() for s, _ in made], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary())]

        return found

    found = stored(arrow_columns(rows, of, [("slots", T.BinaryType()), ("values", T.BinaryType())], drop=["text"]), "toxicity-features")
    # the words that tell grades apart are chosen from counts, so that the driver gets no other feature
    n, rate = found.agg(F.count(F.lit(1)), F.coalesce(F.avg((F.col("toxic") > 0).cast("double")), F.lit(0.0))).first()
    seen = found.select("slots", "toxic").mapInPandas(_counts, "slot int, seen long, bad long").groupBy("slot").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))
    z = F.abs(F.col("bad") - F.col("seen") * rate) / F.sqrt(F.greatest(F.col("seen") * (rate * (1 - rate)), F.lit(1e-9)))
    useful = seen.where(F.col("seen") >= LEAST_ROWS).select("slot", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "slot").limit(FEATURES)
    slots = np.array(sorted(r["slot"] for r in useful.collect()), np.int32)

    def chosen(batch: pa.RecordBatch) -> list[pa.Array]:
        out: list[tuple[bytes, bytes]] = []
        for own, values in zip(batch["slots"].to_pylist(), batch["values"].to_pylist(), strict=True):
            own, values = np.frombuffer(own, "<i4"), np.frombuffer(values, "<f4")
            keep = np.isin(own, slots, assume_unique=True)
            out.append((own[keep].tobytes(), values[keep].tobytes()))
        return [pa.array([o[i] for o in out], pa.binary()) for i in (0, 1)]

    new = [("own", T.BinaryType()), ("value", T.BinaryType())]
    got = sorted(arrow_columns(found, lambda: chosen, new, drop=["slots", "values"]).select("id", "own", "value", "toxic").collect())  # bounded by sample
    sparse = [(np.frombuffer(r["own"], "<i4"), np.frombuffer(r["value"], "<f4")) for r in got]
    return fit(sparse, severity(sparse, np.array([r["toxic"] for r in got], np.int64)))


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each feature of a batch, how many rows have it and how many of them are toxic."""
    for batch in batches:
        own = [np.frombuffer(s, "<i4") for s in batch["slots"]]
        if own:
            slot, at = np.unique(np.concatenate(own), return_inverse=True)
            toxic = np.repeat((batch["toxic"] > 0).to_numpy(), [len(s) for s in own])
            yield pd.DataFrame({"slot": slot, "seen": np.bincount(at, minlength=len(slot)), "bad": np.bincount(at, weights=toxic, minlength=len(slot)).astype(np.int64)})


def score(docs: DataFrame, model: OrdinalModel, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """docs (or those columns of it) with severity (the expected grade), p_toxic (of a grade above 0) and toxic
    (p_toxic >= REJECT); own columns of these names give way. Without labelled rows nothing is toxic. Every whole text
    is scored; null and empty texts have no features and the grades of the cuts alone, but are never toxic. Ids aren't
    read: null, tied and repeated ones are scored like others, by their text. Repeated rows and other columns make no
    difference; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size
    own = docs.columns if columns is None else columns
    rows = docs.select(packed(docs.select(*[F.col(f"`{c}`") for c in own])), text_or_empty(F.col(f"`{text}`")).alias("_text"))

    def scored() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        memory = Words()

        def of(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch["_text"].to_pylist()
            p = shared.value.grades(np.array([shared.value.logit(features(t, memory)) for t in texts]))
            some = np.array([bool(t.strip()) for t in texts])
            return [pa.array(p @ np.arange(p.shape[1])), pa.array(1 - p[:, 0]), pa.array((1 - p[:, 0] >= REJECT) & some)]

        return of

    new = [("severity", T.DoubleType()), ("p_toxic", T.DoubleType()), ("toxic", T.BooleanType())]
    return unpacked(arrow_columns(rows, scored, new, drop=["_text"]), own, [n for n, _ in new])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of all documents."""
    docs = read(spark, sf_dir, "documents")
    out = score(docs, train(docs, read(spark, sf_dir, "labels")), columns=["doc_id"])
    return out.select("doc_id", "severity", "p_toxic", "toxic", (~F.col("toxic")).alias("kept"))
