"""Operator 3: quality classifier, an ordinal cumulative-link regression on hashed text.

Grades are ordered: 0 toxic, 1 of low quality, 2 good. One weight vector over hashed features gives
a document's score s; P(grade > k) = sigmoid(s - theta_k) with thresholds theta_0 < theta_1. The
expected grade is the sum of these tail probabilities; documents are selected by the tail
P(grade >= 2). Features are hashed names: each distinct word (lower case) with its first four and six
letters, and token shapes, the steps that the share of each passes among a text's tokens. A shape has
a letter for capitals, one for other letters and one for digits, signs as they are, and runs as one;
its beginning, its end, and a token that comes twice in a row, by its shape, count as well. No shape
is named here. Only buckets that tell grades apart in a test of proportions get a weight.

The model is fitted by full-batch gradient steps on a bounded sample of labelled rows (``FIT_DOCS``
documents, taken by hash); scoring is one pass over all documents without a shuffle.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import read, slices

#: Documented bound of the sample that the model is fitted on.
FIT_DOCS = 10_000
DIM = 1 << 18
GRADES = 3
#: Buckets in fewer sample documents, or that differ by fewer standard errors, get no weight.
LEAST_DOCS, LEAST_Z = 4, 4.5
#: Pull of weights to zero; gradient steps and their size.
RIDGE, STEPS, RATE = 1e-4, 200, 0.1
#: Documents whose tail probability is below are rejected.
KEEP = 0.5
#: Words whose weight a worker remembers.
CACHE = 200_000
#: Shares of a text's tokens at which a shape has a step.
LEVELS = (0.005, 0.02, 0.05, 0.1, 0.2, 0.4)

_WORD = re.compile(r"\w+").findall
_RUN = re.compile(rb"([^ ])\1+")


def _classes() -> bytes:
    """Bytes to their class: A, a (also all beyond ASCII), 9, a blank, or the sign itself."""
    out = bytearray(range(256))
    for i in range(256):
        c = bytes([i])
        out[i] = ord("A") if c.isupper() else ord("a") if c.isalpha() or i > 127 else ord("9") if c.isdigit() else 32 if c.isspace() else i
    return bytes(out)


_CLASSES = _classes()


def _bucket(s: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(s) % DIM


def word_buckets(word: str) -> list[int]:
    return [_bucket(w) for w in (f"w {word}", f"4 {word[:4]}", f"6 {word[:6]}")]


def shape_names(text: str | None) -> list[str]:
    """A name for each step of LEVELS that the share of a token shape passes."""
    raw = (text or "").encode()
    tokens, shapes = raw.split(), _RUN.sub(rb"\1+", raw.translate(_CLASSES)).split()
    whole = Counter(shapes)
    counts = [("shape", whole), ("again", Counter([s for a, b, s in zip(tokens, tokens[1:], shapes[1:]) if a == b]))]
    for kind, part in (("begin", slice(1)), ("end", slice(-2, None))):
        some: Counter = Counter()
        for x, n in whole.items():
            some[x[part]] += n
        counts.append((kind, some))
    n = len(shapes)
    return [f"{kind} {x.decode('latin-1')} {level}" for kind, some in counts for x, k in some.items() for level in LEVELS if k > level * n]


def words_and_shapes(text: str | None) -> tuple[set[str], list[str]]:
    """Distinct words, and names of token shapes."""
    return set(_WORD((text or "").lower())), shape_names(text)


def features(text: str | None) -> np.ndarray:
    """Distinct buckets of a text."""
    words, shapes = words_and_shapes(text)
    return np.unique(np.array([b for w in words for b in word_buckets(w)] + [_bucket(s) for s in shapes], "i4"))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0 .. GRADES - 2."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -30, 30)))


def _counts(at: np.ndarray) -> np.ndarray:
    """How often each bucket comes; bincount takes wide numbers, so a part at a time."""
    out = np.zeros(DIM, "i8")
    for i in range(0, len(at), 1 << 20):
        out += np.bincount(at[i : i + (1 << 20)], minlength=DIM)
    return out


def fit(rows: list[np.ndarray], grades: np.ndarray) -> OrdinalModel:
    """Maximum likelihood of the cumulative-link model with a ridge penalty, by Adam steps on all rows at once."""
    if not rows:
        return OrdinalModel(np.zeros(DIM, "f4"), np.arange(GRADES - 1) - 10.0)
    at, row = np.concatenate(rows), np.repeat(np.arange(len(rows), dtype="i4"), [len(a) for a in rows])
    docs = _counts(at)
    tells = np.zeros(DIM, bool)
    for k in range(1, GRADES):
        high = grades >= k
        n1, n0 = int(high.sum()), int((~high).sum())
        if n1 and n0:
            ones = _counts(at[high[row]])
            p = docs / len(rows)
            z = (ones / n1 - (docs - ones) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
            tells |= np.abs(z) >= LEAST_Z
    keep = (tells & (docs >= LEAST_DOCS))[at]
    at, row = at[keep], row[keep]
    used, at = np.unique(at, return_inverse=True)
    n = len(rows)
    # theta_0 and the logarithms of the gaps keep the thresholds in order.
    x = np.concatenate([np.zeros(len(used)), [-3.0], np.zeros(GRADES - 2)])
    m, v = np.zeros_like(x), np.zeros_like(x)
    upper, lower = grades < GRADES - 1, grades > 0
    for step in range(1, STEPS + 1):
        w, theta = x[: len(used)], np.cumsum(np.concatenate([[x[len(used)]], np.exp(x[len(used) + 1 :])]))
        s = np.bincount(row, w[at], minlength=n)
        # P(grade = g) = F(theta_g - s) - F(theta_{g-1} - s)
        a = np.where(upper, theta[np.minimum(grades, GRADES - 2)] - s, np.inf)
        b = np.where(lower, theta[np.maximum(grades - 1, 0)] - s, -np.inf)
        fa, fb = (1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (a, b))
        fa, fb = np.where(upper, fa, 1.0), np.where(lower, fb, 0.0)
        p = np.maximum(fa - fb, 1e-12)
        da, db = fa * (1 - fa) / p, fb * (1 - fb) / p
        ds = (da - db) / n  # of minus the mean log-likelihood
        gw = np.bincount(at, ds[row], minlength=len(used)) + RIDGE * w
        gt = np.zeros(GRADES - 1)
        np.add.at(gt, grades[upper], -da[upper] / n)
        np.add.at(gt, grades[lower] - 1, db[lower] / n)
        total = np.cumsum(gt[::-1])[::-1]
        g = np.concatenate([gw, [total[0]], total[1:] * np.exp(x[len(used) + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    weights = np.zeros(DIM, "f4")
    weights[used] = x[: len(used)]
    return OrdinalModel(weights, np.cumsum(np.concatenate([[x[len(used)]], np.exp(x[len(used) + 1 :])])))


def grade() -> F.Column:
    """0 toxic, 1 of low quality, 2 good; null without a quality label (unless toxic)."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, skip_share: float = 0.0) -> OrdinalModel:
    """Fit on ``fit_docs`` labelled documents at most. ``skip_share`` of the ids (by hash) is left out, for held-out tests.

    Several labels of a document: the least grade counts. Labels without a grade or a document are
    ignored; without any the model grades every text as good.
    """
    h = F.xxhash64("doc_id")
    graded = labels.select("doc_id", grade().alias("grade")).where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    graded = graded.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1000)) >= int(1000 * skip_share)).orderBy(h).limit(fit_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(graded), "doc_id").select("text", "grade")  # at most fit_docs rows are broadcast
    schema = pa.schema([("at", pa.list_(pa.int32())), ("grade", pa.int32())])

    def run(batches):
        for b in slices(batches):
            got = [features(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, schema[0].type), b["grade"].cast(pa.int32())], schema=schema)

    got = rows.mapInArrow(run, "at array<int>, grade int").toArrow()
    return fit([x.values.to_numpy() for x in got["at"]], got["grade"].to_numpy())  # views: nothing is copied here


_SCORERS: dict = {}


class _Scorer:
    def __init__(self, model: OrdinalModel):
        self.model, self.known = model, {}
        self.weights = {int(i): float(model.weights[i]) for i in np.flatnonzero(model.weights)}

    def score(self, text: str | None) -> float:
        words, shapes = words_and_shapes(text)
        return sum(self.weights[b] for b in self._weighty(words, word_buckets) | self._weighty(shapes, lambda s: [_bucket(s)]))

    def _weighty(self, names, buckets) -> set[int]:
        """The names' buckets that have a weight, each once."""
        known = self.known
        try:
            return {b for w in names for b in known[w]}
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            for w in names:
                if w not in known:
                    known[w] = tuple(b for b in buckets(w) if b in self.weights)
            return {b for w in names for b in known[w]}


def score_quality(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``docs`` (with text) -> its columns, and expected_grade, p_not_toxic, p_good.

    One row per row. Null text is empty, and an empty text has no word that speaks against it.
    Columns of these names are replaced; an empty table gives none.
    """
    docs = docs.drop("expected_grade", "p_not_toxic", "p_good")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM weights
    cols = docs.columns
    key = uuid.uuid4().hex

    def run(batches):
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = _Scorer(shared.value)
        scorer = _SCORERS[key]
        for b in slices(batches):
            s = np.array([scorer.score(t) for t in b["text"].to_pylist()], float)
            p = scorer.model.tails(s)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in cols), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(p[:, -1])], names=[*cols, "expected_grade", "p_not_toxic", "p_good"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, expected_grade double, p_not_toxic double, p_good double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    got = score_quality(docs.select("doc_id", "text"), train(docs, read(spark, sf_dir, "labels")))
    return got.select("doc_id", "expected_grade", "p_not_toxic", "p_good", (F.col("p_good") >= KEEP).alias("keep"))
