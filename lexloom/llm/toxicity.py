"""Toxicity by a linear-chain conditional random field over words.

Two states, clean and toxic. A word's emission is a sum of weights of the word, its
beginnings and its endings; transitions and the start have weights of their own.

Fitting takes a bounded, documented sample of labelled documents, chosen by a hash
of their ids, in one task. Labels are per document, so words get theirs first: a
word or beginning that stands in toxic documents far more often than chance allows
(Chernoff bound, corrected for the number of candidates) marks a toxic word of a
toxic document; all words of clean documents are clean. The field is then fitted by
gradient ascent on segments, and a logistic curve over the marginals gives the
document score. The fitted model is a vector of fixed size and goes to the tasks
that score; scoring covers all words of all texts and shuffles nothing.
"""
from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

WORD = re.compile(r"[^\W\d_]+")
#: Words that one chain runs over; the next one starts anew.
SEGMENT = 128
#: Size of the weight vector. Feature 0 is always 0.
DIMENSIONS = 1 << 18
#: The fitting sample: labelled documents of either class, segments of one document
#: for the vocabulary, and segments of either kind for the field. Longer texts than
#: SAMPLE_CHARS are not taken into it.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 2000, 6000, 100_000
FIELD_SEGMENTS, EPOCHS = 3000, 60
#: Words whose emission a task remembers at most, and words scored at once.
CACHE, AT_ONCE = 500_000, 200_000
THRESHOLD = 0.3


def features(word: str) -> list[int]:
    """Hashed: the word, its beginnings of 3 to 6 letters, its last 3 and 4."""
    names = ["w" + word, *["b" + word[:n] if len(word) >= n else "" for n in (3, 4, 5, 6)],
             *["e" + word[-n:] if len(word) > n else "" for n in (3, 4)]]
    return [zlib.crc32(n.encode()) % (DIMENSIONS - 1) + 1 if n else 0 for n in names]


def _begins(word: str) -> list[str]:
    return ["=" + word, *[word[:n] for n in (4, 5, 6) if len(word) >= n]]


def marginals(e: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray):
    """Forward-backward over rows of emissions e (segments x words), of which the
    first `lengths` count: P(toxic) of each word, and the scaled messages."""
    rows, n = e.shape
    emit = np.exp(np.clip(np.stack([-e / 2, e / 2], axis=2), -30, 30))
    step = np.exp(move)
    forward, backward = np.empty((n, rows, 2)), np.ones((n, rows, 2))
    a = np.exp(start) * emit[:, 0]
    forward[0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, n):
        a = (forward[t - 1] @ step) * emit[:, t]
        forward[t] = a / a.sum(axis=1, keepdims=True)
    for t in range(n - 2, -1, -1):
        b = (backward[t + 1] * emit[:, t + 1]) @ step.T
        b /= b.sum(axis=1, keepdims=True)
        backward[t] = np.where((lengths > t + 1)[:, None], b, 1.0)
    p = forward * backward
    p /= p.sum(axis=2, keepdims=True)
    return p[:, :, 1].T, forward, backward, emit


class Field:
    """The fitted model."""

    def __init__(self, weights, start, move, curve):
        self.weights, self.start, self.move, self.curve = weights, start, move, curve
        self.known: dict[str, float] = {}

    def to_bytes(self) -> bytes:
        return b"".join(np.asarray(x, np.float64).tobytes()
                        for x in (self.curve, self.start, self.move, self.weights))

    @classmethod
    def from_bytes(cls, data: bytes) -> Field:
        x = np.frombuffer(data, np.float64)
        return cls(x[9:], x[3:5], x[5:9].reshape(2, 2), x[:3])

    def emissions(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            if len(known) + len(new) > CACHE:
                known.clear()
                new = list(dict.fromkeys(words))
            sums = self.weights[np.array([features(w) for w in new])].sum(axis=1)
            known.update(zip(new, sums.tolist()))
        return np.fromiter((known[w] for w in words), float, len(words))

    def words(self, texts: list[str]) -> list[np.ndarray]:
        """P(toxic) of each word of each text."""
        out: list[np.ndarray] = []
        group, size = [], 0
        for text in texts:
            found = WORD.findall(text.lower())
            group.append(found)
            size += len(found)
            if size >= AT_ONCE:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _group(self, group: list[list[str]]) -> list[np.ndarray]:
        if not group:
            return []
        e = self.emissions([w for words in group for w in words])
        counts = np.array([len(words) for words in group])
        p, at = np.empty(len(e)), 0
        # Segment starts, in order: those of each text in turn.
        first = np.concatenate([np.arange(b - c, b, SEGMENT) for b, c in zip(np.cumsum(counts), counts)])
        lengths = np.minimum(SEGMENT, np.repeat(np.cumsum(counts), -(-counts // SEGMENT)) - first)
        for at in range(0, len(first), 2048):
            f, n = first[at:at + 2048].astype(int), lengths[at:at + 2048].astype(int)
            width = int(n.max(initial=1))
            place = f[:, None] + np.arange(width)
            real = np.arange(width) < n[:, None]
            got = marginals(np.where(real, e[np.minimum(place, len(e) - 1)], 0.0), n,
                            self.start, self.move)[0]
            p[place[real]] = got[real]
        return np.split(p, np.cumsum(counts)[:-1])

    def score(self, p: np.ndarray) -> float:
        z = float(self.curve @ document_features(p))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def document_features(p: np.ndarray) -> np.ndarray:
    """1, log odds of the most toxic word, log of the expected number of them."""
    top = min(max(float(p.max(initial=1e-6)), 1e-6), 1 - 1e-6)
    return np.array([1.0, math.log(top / (1 - top)), math.log1p(float(p[p > 0.05].sum()))])


def seeds(toxic: list[list[str]], clean: list[list[str]]) -> set[str]:
    """Words and beginnings that toxic documents hold more often than chance."""
    a, b = Counter(), Counter()
    for docs, count in ((toxic, a), (clean, b)):
        for words in docs:
            count.update({x for w in set(words) for x in _begins(w)})
    share = len(toxic) / (len(toxic) + len(clean))
    least = math.log(max(1, len(a)) / 0.01)
    found = set()
    for x, n in a.items():
        q = n / (n + b[x])
        if q > max(0.8, share):
            log_odds = q * math.log(q / share) + (1 - q) * (math.log((1 - q) / (1 - share)) if q < 1 else 0)
            if (n + b[x]) * log_odds > least:
                found.add(x)
    return found


def fit(texts: list[str], labels: list[int], counts: tuple[int, int]) -> Field | None:
    """A field from a sample; counts: clean and toxic documents it was drawn from."""
    n_clean, n_toxic = counts
    if not texts:
        return None
    # One object for each different word, however often it stands in the sample.
    shared: dict[str, str] = {}
    words = [[shared.setdefault(w, w) for w in WORD.findall(t.lower())] for t in texts]
    del shared
    toxic = [w for w, y in zip(words, labels) if y]
    clean = [w for w, y in zip(words, labels) if not y]
    prior = math.log((n_toxic + 0.5) / (n_clean + 0.5))
    flat = Field(np.zeros(DIMENSIONS), np.zeros(2), np.zeros((2, 2)), np.array([prior, 0, 0]))
    if not toxic or not clean:
        return flat
    seed = seeds(toxic, clean)
    is_seed: dict[str, bool] = {}
    for w in {w for ws in toxic for w in ws}:
        is_seed[w] = any(x in seed for x in _begins(w))

    # Segments with toxic words, and as many of clean documents.
    rng = np.random.default_rng(7)
    cut = lambda docs: [ws[i:i + SEGMENT] for ws in docs for i in range(0, len(ws), SEGMENT)]
    marked = [s for s in cut(toxic) if any(is_seed[w] for w in s)]
    plain = cut(clean)
    if not marked:
        return flat
    pick = lambda x: [x[i] for i in rng.permutation(len(x))[:FIELD_SEGMENTS]]
    marked, plain = pick(marked), pick(plain)
    segments = [(s, [is_seed[w] for w in s]) for s in marked] + [(s, [False] * len(s)) for s in plain]

    types = list({w for s, _ in segments for w in s})
    number = {w: i for i, w in enumerate(types)}
    type_features = np.array([features(w) for w in types])
    lengths = np.array([len(s) for s, _ in segments])
    width = int(lengths.max())
    ids = np.zeros((len(segments), width), int)
    y = np.zeros((len(segments), width))
    for i, (s, labelled) in enumerate(segments):
        ids[i, :len(s)] = [number[w] for w in s]
        y[i, :len(s)] = labelled
    real = np.arange(width) < lengths[:, None]
    pairs = real[:, 1:]
    yi = y.astype(int)
    seen_move = np.zeros((2, 2))
    np.add.at(seen_move, (yi[:, :-1][pairs], yi[:, 1:][pairs]), 1)
    seen_start = np.bincount(yi[:, 0], minlength=2)
    w, start, move = np.zeros(DIMENSIONS), np.zeros(2), np.zeros((2, 2))
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, start, move)]
    total = lengths.sum()
    for epoch in range(1, EPOCHS + 1):
        e = w[type_features].sum(axis=1)[ids] * real
        p, forward, backward, emit = marginals(e, lengths, start, move)
        by_type = np.bincount(ids[real], (y - p)[real], len(types))
        g = np.bincount(type_features.ravel(), np.repeat(by_type, type_features.shape[1]), DIMENSIONS)
        g[0] = 0
        # In place: the largest array of the fit, held once.
        joint = forward[:-1, :, :, None] * np.exp(move)
        joint *= np.multiply(backward[1:], emit.transpose(1, 0, 2)[1:], out=backward[1:])[:, :, None, :]
        joint /= joint.sum(axis=(2, 3), keepdims=True)
        joint *= pairs.T[:, :, None, None]
        expected = joint.sum(axis=(0, 1))
        del forward, backward, emit, joint
        first = np.array([(1 - p[:, 0]).sum(), p[:, 0].sum()])
        grads = (g / len(segments) - 1e-4 * w, (seen_start - first) / len(segments) - 1e-3 * start,
                 (seen_move - expected) / total * 4 - 1e-3 * move)
        for x, d, (m, v) in zip((w, start, move), grads, state):      # Adam
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            x += 0.15 * (m / (1 - 0.9 ** epoch)) / (np.sqrt(v / (1 - 0.99 ** epoch)) + 1e-8)
    field = Field(w, start, move, np.array([prior, 0, 0]))
    del words, toxic, clean, marked, plain, segments, ids, y, yi, real, pairs, types, number, type_features, is_seed

    # The document curve, with the classes weighted as in the labelled rows.
    x = np.array([document_features(p) for at in range(0, len(texts), 256) for p in field.words(texts[at:at + 256])])
    t = np.array(labels, float)
    weight = np.where(t == 1, n_toxic / max(1, t.sum()), n_clean / max(1, (1 - t).sum()))
    curve = np.zeros(3)
    for _ in range(50):                                               # Newton, ridge
        q = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(3)
        curve += np.linalg.solve(h, x.T @ (weight * (t - q)) - 0.1 * curve)
    field.curve = curve
    return field


def _fit_task(batches):
    texts, labels, counts = [], [], (0, 0)
    for batch in batches:
        texts += batch["text"].to_pylist()
        labels += batch["toxic"].to_pylist()
        for n0, n1 in zip(batch["n_clean"].to_pylist(), batch["n_toxic"].to_pylist()):
            counts = (n0, n1)
    field = fit(texts, labels, counts)
    if field is not None:
        yield pa.RecordBatch.from_pydict({"model": pa.array([field.to_bytes()], pa.binary())})


def held_out(id_column):
    """crc32 of the id as text, mod 4, is 2. A null id counts as an empty text."""
    text = F.coalesce(id_column.cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % 4 == 2


def fit_field(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "toxic") -> bytes | None:
    """The model, from labelled rows that are not held out; None without any.

    The sample: the SAMPLE_TOXIC and SAMPLE_CLEAN ids with the smallest hashes. It is
    joined as a broadcast of at most that many ids, and fitted in one task."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
             .where("id is not null and toxic in (0, 1)").where(~held_out(F.col("id")))
             .groupBy("id").agg(F.max("toxic").alias("toxic")))
    n = dict(known.groupBy("toxic").count().collect())          # two numbers
    drawn = [known.where(f"toxic = {y}").orderBy(F.xxhash64("id"), "id").limit(most)
             for y, most in ((0, SAMPLE_CLEAN), (1, SAMPLE_TOXIC))]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = (rows.where(f"length(text) between 1 and {SAMPLE_CHARS}")
              .join(F.broadcast(drawn[0].unionByName(drawn[1])), "id")
              .groupBy("id", "toxic").agg(F.min("text").alias("text"))
              .select("text", "toxic", F.lit(n.get(0, 0)).alias("n_clean"),
                      F.lit(n.get(1, 0)).alias("n_toxic"), F.xxhash64("id", "text").alias("h")))
    got = (sample.repartition(1).sortWithinPartitions("h").drop("h")
           .mapInArrow(_fit_task, "model binary").collect())
    return got[0][0] if got else None


def _score_batches(spread, text_col: str, passing: bool):
    """Rows with their scores; or, when `passing`, the rows below the threshold."""
    def run(batches):
        data = spread.value
        field = Field.from_bytes(data) if data else None
        for batch in batches:
            texts = [t or "" for t in batch[text_col].to_pylist()]
            scores, spans = [], []
            for at in range(0, len(texts), 256):
                part = texts[at:at + 256]
                for text, p in zip(part, field.words(part) if field else [np.zeros(0)] * len(part)):
                    scores.append(field.score(p) if field else 0.0)
                    spans.append("" if passing else _spans(text, p))
            if passing:
                yield batch.filter(pa.array([s < THRESHOLD for s in scores]))
            else:
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], pa.array(scores, pa.float64()), pa.array(spans, pa.string())],
                    ["id", "score", "spans"])
    return run


def _spans(text: str, p: np.ndarray) -> str:
    """start:end of the runs of words that are rather toxic than not."""
    if not (p >= 0.5).any():
        return ""
    # Lower case may have other lengths: offsets are of the text itself where it has not.
    found = list(WORD.finditer(text))
    if len(found) != len(p):
        found = list(WORD.finditer(text.lower()))
    out: list[list[int]] = []
    last = -2
    for i in np.flatnonzero(p >= 0.5).tolist():
        if i == last + 1:
            out[-1][1] = found[i].end()
        else:
            out.append([found[i].start(), found[i].end()])
        last = i
    return ",".join(f"{a}:{b}" for a, b in out)


def _spread(spark: SparkSession, model: bytes | None):
    """The model as a broadcast: its size is fixed by DIMENSIONS."""
    return spark.sparkContext.broadcast(model)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted, spans), one row for each document.

    Null and empty texts get the score of a text without toxic words. Labels of
    unknown ids, null labels and labels other than 0 and 1 are ignored; of repeated
    ones the toxic one counts. Without labelled rows every score is 0, with one class
    only the score is its share. Spans are offsets of toxic words in code points.
    Other columns, whatever their names, are not read.
    """
    model = _spread(docs.sparkSession, fit_field(docs, labels, id_col, text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return (rows.mapInArrow(_score_batches(model, "text", False), f"id {kind}, score double, spans string")
            .select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """The documents, with all columns, whose score is below the threshold."""
    model = _spread(docs.sparkSession, fit_field(docs, labels, id_col, text_col))
    return docs.mapInArrow(_score_batches(model, text_col, True), docs.schema)
