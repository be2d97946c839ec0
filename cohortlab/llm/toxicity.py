"""Toxicity severity by cumulative-link (proportional-odds) regression on sparse words.

P(grade <= k) = sigmoid(threshold_k - w.x), one weight vector for all ordered thresholds;
x holds one indicator for each feature that a text contains: words, and their first 3 to 7
bytes (stems). The labels are binary, so
grades come from them: 0 not toxic; toxic rows are 1 or 2 by whether they hold more
distinct feature words than the median toxic row that holds any. Expected severity is the sum of
P(grade > k).

The model is fitted on at most ``max_train`` labelled rows (a hash-ordered sample of the
labels, a documented bound); features are those whose document rate is higher among toxic rows
by ``min_z`` standard errors and whose holders are mostly toxic. Every text is scored whole.

Defined cases: a null text has no words and gets the intercept's severity; null labels are
left out; ids labelled more than once take the largest label; without toxic or without other
labelled rows nothing is toxic (severity 0); other columns pass through, and one that is named
like an output column is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import pack, texts_of, unpack
from .hashing import WORD_ALNUM, joined, stretch_hash, words
from .caches import enter
from .stage import ship, stage

MAX_TRAIN = 10_000
MIN_Z = 5.0
MAX_FEATURES = 4096
MIN_SHARE = 0.4  # at least this share of the rows that hold a feature is toxic; words that only lean (of one language, say) are none
MIN_HOLDERS = 5  # a feature is held by this many toxic rows; a share of all of them would leave a rare language without words
PREFIXES = range(3, 8)
PREFIX_MARK = 0x7C15F39CC0605CED  # keeps a prefix apart from the equal word
SLICE = 1 << 18  # bytes of text whose features are held at once: each byte makes about 16 bytes of them


@dataclass(frozen=True)
class OrdinalModel:
    features: np.ndarray    # word hashes, ascending
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k), one column for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def text_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature hash) of every word and of its first 3 to 7 bytes."""
    buf, starts = joined(texts)
    ws, we, doc, wh = words(buf, starts, WORD_ALNUM, True)
    docs, features = [doc], [wh]
    for k in PREFIXES:
        long = we - ws >= k
        docs.append(doc[long])
        features.append(stretch_hash(buf, ws[long], k, True) ^ np.uint64(PREFIX_MARK))
    return np.concatenate(docs), np.concatenate(features)


def _distinct(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((feature, doc))
    doc, feature = doc[order], feature[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])
    return doc[new], feature[new]


def _known(doc: np.ndarray, feature: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, number) of the distinct features that stand in ``features`` (ascending)."""
    if not len(features) or not len(feature):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(features, feature), len(features) - 1)
    hit = features[at] == feature
    pairs = np.unique(doc[hit] * len(features) + at[hit])
    return pairs // len(features), pairs % len(features)


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """(first, past the last) of runs of texts of ``SLICE`` bytes at most, or of one longer text."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= SLICE):
            size, stop = size + len(texts[stop]), stop + 1
        yield at, stop
        at = stop


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about ``SLICE`` bytes, cut between words only."""
    data, at = np.frombuffer(text, np.uint8), 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        while end < len(data) and WORD_ALNUM[data[end - 1]] and WORD_ALNUM[data[end]]:
            gap = np.flatnonzero(~WORD_ALNUM[data[end:end + SLICE]])
            end = end + int(gap[0]) if len(gap) else min(len(data), end + SLICE)
        yield text[at:end]
        at = end


def _slice_features(texts: list[bytes], known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of a slice's distinct features, or (document, number) of those in ``known``."""
    def own(part):
        return _distinct(*text_features(part)) if known is None else _known(*text_features(part), known)
    if len(texts) > 1 or not texts or len(texts[0]) <= SLICE:
        return own(texts)
    seen = np.unique(np.concatenate([own([piece])[1] for piece in _pieces(texts[0])]))
    return np.zeros(len(seen), np.int64), seen


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_ordinal(doc: np.ndarray, col: np.ndarray, grade: np.ndarray, n_features: int, n_grades: int,
                ridge: float = 1e-5, steps: int = 1500, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by accelerated gradient ascent on the cumulative-link
    likelihood. (doc, col): the indicators that are set."""
    n = len(grade)
    w = np.zeros(n_features)
    share = np.clip(np.cumsum(np.bincount(grade, minlength=n_grades))[:-1] / n, 1e-4, 1 - 1e-4)
    cut = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(cut), 1e-2))  # thresholds are cut[0] plus sums of exp(gaps), so they stay ordered
    theta = np.concatenate((w, cut[:1], gaps))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    low_ok, high_ok = grade > 0, grade < n_grades - 1
    for t in range(1, steps + 1):
        w, first, gaps = theta[:n_features], theta[n_features], theta[n_features + 1:]
        cuts = first + np.concatenate(([0], np.cumsum(np.exp(gaps))))
        score = np.bincount(doc, w[col], n) if len(doc) else np.zeros(n)
        upper = np.where(high_ok, _sigmoid(cuts[np.minimum(grade, n_grades - 2)] - score), 1.0)
        lower = np.where(low_ok, _sigmoid(cuts[np.maximum(grade - 1, 0)] - score), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        d_score = dl - du
        d_cut = np.bincount(np.minimum(grade, n_grades - 2), np.where(high_ok, du, 0), n_grades - 1) \
            - np.bincount(np.maximum(grade - 1, 0), np.where(low_ok, dl, 0), n_grades - 1)
        tail = np.cumsum(d_cut[::-1])[::-1]
        grad = np.concatenate((np.bincount(col, d_score[doc], n_features) / n - ridge * w,
                               tail[:1] / n, tail[1:] * np.exp(gaps) / n))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        theta = theta + rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8) / np.sqrt(t)
    cuts = theta[n_features] + np.concatenate(([0], np.cumsum(np.exp(theta[n_features + 1:]))))
    return theta[:n_features], cuts


def _feature_rows(rows: DataFrame, known: np.ndarray | None) -> list:
    """(doc_id, toxic, digest, features) of the rows' texts: all distinct features, or
    the numbers of those in ``known``. ``rows`` is a bounded sample."""
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        for batch in batches:
            texts, packed = texts_of(batch), []
            for at, stop in _slices(texts):
                doc, feature = _slice_features(texts[at:stop], known)
                edge = np.searchsorted(doc, np.arange(stop - at + 1))
                packed += [pack(feature[a:b].astype("<u8").tobytes()) for a, b in zip(edge[:-1], edge[1:])]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), batch.column("toxic").cast(pa.int32()),
                pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array(packed, pa.binary())],
                names=["doc_id", "toxic", "digest", "features"])

    got = rows.select("doc_id", "toxic", "text").mapInArrow(features, "doc_id long, toxic int, digest binary, features binary").collect()
    by = {bytes(r["digest"]): r for r in sorted(got, key=lambda r: (r["toxic"], r["doc_id"]))}  # copies of a text count once
    return [(by[k]["toxic"] > 0, np.frombuffer(unpack(by[k]["features"]), np.uint64)) for k in sorted(by)]


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, min_z: float = MIN_Z) -> OrdinalModel:
    ship(docs.sparkSession)
    sample = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = stage(docs.select("doc_id", F.col("text").cast("string").alias("text"))
                 .join(F.broadcast(sample), "doc_id"), "labelled")  # at most max_train labels
    nothing = OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([500.0, 501.0]))
    own = [f for _, f in _feature_rows(rows.where("toxic > 0"), None)]
    if not own:
        return nothing
    known, in1 = np.unique(np.concatenate(own), return_counts=True)
    known = known[in1 >= MIN_HOLDERS]
    got = _feature_rows(rows, known)
    toxic, own = np.array([t for t, _ in got], bool), [f.astype(np.int64) for _, f in got]
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    if not n1 or not n0:
        return nothing
    doc, col = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own)
    in1, in0 = np.bincount(col, toxic[doc], len(known)), np.bincount(col, ~toxic[doc], len(known))
    rate = (in1 + in0) / (n1 + n0)
    z = (in1 / n1 - in0 / n0) / np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / n1 + 1 / n0))
    kept = np.flatnonzero((z >= min_z) & (in1 >= MIN_SHARE * (in1 + in0)))
    kept = np.sort(kept[np.argsort(-z[kept], kind="stable")][:MAX_FEATURES])
    number = np.full(len(known), -1)
    number[kept] = np.arange(len(kept))
    used = number[col] >= 0
    doc, col = doc[used], number[col][used]
    lean = np.bincount(doc, minlength=len(own))
    marked = lean[toxic & (lean > 0)]
    grade = np.where(toxic, 1 + (lean > (np.median(marked) if len(marked) else 0)), 0).astype(np.int64)
    weights, cuts = fit_ordinal(doc, col, grade, len(kept), 3)
    return OrdinalModel(known[kept], weights, cuts)


def score_severity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``docs`` plus severity (expected grade), grade (most likely), p_toxic and toxic (p_toxic >= 1/2)."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("severity", "grade", "p_toxic", "toxic")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        for batch in batches:
            texts = texts_of(batch)
            scores = [_score(texts[at:stop], model) for at, stop in _slices(texts)]
            score = np.concatenate(scores) if scores else np.zeros(0)
            above = model.above(score)
            p = -np.diff(np.concatenate((np.ones((len(score), 1)), above, np.zeros((len(score), 1))), axis=1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(above.sum(1)), pa.array(p.argmax(1), pa.int32()),
                                                   pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)],
                names=[*kept, "severity", "grade", "p_toxic", "toxic"])

    from pyspark.sql import types as T
    schema = T.StructType([docs.schema[c] for c in kept] + [
        T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()),
        T.StructField("p_toxic", T.DoubleType()), T.StructField("toxic", T.BooleanType())])
    return docs.select(*kept).mapInArrow(run, schema)


def _score(texts: list[bytes], model: OrdinalModel) -> np.ndarray:
    doc, number = _slice_features(texts, model.features)
    return np.bincount(doc, model.weights[number], len(texts)) if len(doc) else np.zeros(len(texts))
