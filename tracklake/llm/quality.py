"""Quality by compression: a text shrinks more under a dictionary made from texts like it.

Two zstandard dictionaries are built from good and from bad labelled texts. A text's score is a logistic
function, fitted on other labelled texts, of the difference of its two compressed sizes, normalised by
its length, and of the smaller of them, normalised likewise: repetitive texts leave no difference to see.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL = 3
DICTIONARY_BYTES = 256 << 10
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 8192
THRESHOLD = 0.3


def fold(key: str, folds: int) -> Column:
    return F.crc32(F.col(key).cast("string")) % folds


def training_rows(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int, size: int
) -> list[tuple[int, int, bytes]]:
    """At most ``rows`` labelled texts of each class, chosen by a hash of the key, ``size`` characters each.

    The bound makes the driver's and the broadcast's share fixed: twice ``rows`` keys, and texts cut to
    ``size`` characters from a place that the hash gives.
    """
    wanted = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    wanted = wanted.filter("_key is not null and _label in (0, 1)").distinct()
    order = F.xxhash64("_key")
    picked = [wanted.filter(F.col("_label") == c).orderBy(order, "_key").limit(rows) for c in (0, 1)]
    sample = picked[0].union(picked[1])
    whole = F.coalesce(F.col(text), F.lit(""))
    spare = F.greatest(F.length(whole) - size, F.lit(0))
    start = F.pmod(F.xxhash64(key, F.lit(1)), spare + 1) + 1
    found = docs.select(F.col(key).alias("_key"), F.substring(whole, start.cast("int"), F.lit(size)).alias("_text"))
    # Several rows may bear one key; one of their texts will do.
    found = found.join(F.broadcast(sample), "_key").groupBy("_key", "_label").agg(F.min("_text").alias("_text"))
    return [(r["_key"], r["_label"], r["_text"].encode()) for r in found.orderBy("_key", "_label").collect()]


def dictionary(texts: list[bytes], size: int) -> bytes:
    """The content of a dictionary for such texts: trained, or the texts themselves where they are few."""
    try:
        return zstandard.train_dictionary(size, texts, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        per = max(256, size // max(1, len(texts)))
        return b"".join(t[:per] for t in texts)[:size]


class Sizes:
    """Compressed sizes of a text under the bad and the good dictionary."""

    def __init__(self, bad: bytes, good: bytes):
        self.compressors = []
        for content in (bad, good):
            own = zstandard.ZstdCompressionDict(content) if content else None
            if own:
                own.precompute_compress(level=LEVEL)
            self.compressors.append(
                zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)
            )

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Per text: 1, normalised difference, log of the normalised smaller size, and products."""
        bad, good = (np.array([len(c.compress(t)) for t in texts], float) for c in self.compressors)
        length = np.maximum([len(t) for t in texts], 1)
        empty = np.array([not t for t in texts])
        difference = 10 * (bad - good) / length
        shrunk = np.where(empty, 0, np.log(np.minimum(bad, good) / length))
        return np.stack([np.ones(len(texts)), difference, shrunk, shrunk * difference, shrunk * shrunk], 1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Penalised logistic regression by Newton steps that are halved until they gain."""
    weights = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, np.where(y > 0, -z, z)).sum() + 0.5 * ridge * w @ w)

    now = loss(weights)
    for _ in range(steps):
        p = sigmoid(x @ weights)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(weights))
        step = np.linalg.solve(hessian, x.T @ (p - y) + ridge * weights)
        while np.abs(step).max() > 1e-9 and (then := loss(weights - step)) > now:
            step = step / 2
        if np.abs(step).max() <= 1e-9:
            break
        weights, now = weights - step, then
    return weights


def fit(rows: list[tuple[int, int, bytes]], size: int = DICTIONARY_BYTES) -> tuple[bytes, bytes, np.ndarray]:
    """Bad dictionary, good dictionary and weights; halves of the rows serve dictionaries and weights.

    Without rows of both classes in both halves all scores are the share of good rows, one half for none.
    """
    halves = [[r for n, r in enumerate(rows) if n % 2 == h] for h in (0, 1)]
    labels = np.array([r[1] for r in rows], float)
    if any(len({r[1] for r in half}) < 2 for half in halves):
        prior = (labels.sum() + 1) / (len(labels) + 2)
        return b"", b"", np.array([np.log(prior / (1 - prior)), 0, 0, 0, 0])
    bad, good = (dictionary([r[2] for r in halves[0] if r[1] == c and r[2]], size) for c in (0, 1))
    x = Sizes(bad, good).features([r[2] for r in halves[1]])
    return bad, good, fit_logistic(x, np.array([r[1] for r in halves[1]], float))


def with_quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    score: str = "score",
    folds: int | None = 5,
    rows: int = SAMPLE_ROWS,
    size: int = SAMPLE_BYTES,
) -> DataFrame:
    """Adds ``score``, 0 to 1, higher for texts more like those labelled 1; it replaces a column so named.

    Labels of rows whose crc32(key as text) mod ``folds`` is 0 are held out; with None all may be used.
    Nothing but a text enters its score. The fit uses a bounded sample: ``rows`` labelled texts of each
    class, ``size`` characters of each; scores come from whole texts. Labels that are null or neither 0
    nor 1 are ignored, a key labelled both ways counts in both classes. A null text is an empty one, null
    keys are scored too, equal rows each get their score, empty tables give empty results.
    """
    usable = labels.filter(fold(key, folds) != 0) if folds else labels
    bad, good, weights = fit(training_rows(docs, usable, key, text, label, rows, size))
    place = docs.columns.index(text)
    kept = [c for c in docs.columns if c.lower() != score.lower()]
    places = [docs.columns.index(c) for c in kept]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(bad, good)
        for batch in batches:
            texts = [(v or "").encode() for v in batch.column(place).to_pylist()]
            scores = sigmoid(sizes.features(texts) @ weights) if texts else np.zeros(0)
            columns = [batch.column(p) for p in places]
            yield pa.record_batch([*columns, pa.array(scores)], names=[*kept, score])

    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add(score, "double")
    return docs.mapInArrow(scan, schema)
