"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, runs of other characters than letters become one space,
and every n-gram of 1 to 4 code points is hashed to one of ``2 ** bits``
features.  The model is one log-probability row per language; its size is fixed by ``bits`` and the
number of languages, so it is broadcast.  A batch is scored by gathering the rows of its features and
summing them per text in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import appended, chunks, string_array, widened, without

ORDERS = (1, 2, 3, 4)
BITS = 16
UNKNOWN = "und"
_MULTIPLIER = np.uint32(0x9E3779B1)


@dataclass
class LanguageModel:
    """``languages[i]`` has the log prior ``prior[i]`` and the log feature probabilities ``weights[:, i]``."""

    languages: list[str]
    prior: np.ndarray
    weights: np.ndarray
    bits: int = BITS


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased letters of each text between single spaces, and each text's first one."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " ")
    joined = spaced.to_pylist()
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in joined])]).astype(np.int64)
    return np.frombuffer("".join(joined).encode("utf-32-le"), np.uint32), bounds


def _features(points: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The feature of the n-gram that ends at each code point from ``order - 1`` on."""
    n = len(points) - order + 1
    h = np.full(max(n, 0), order, np.uint32)
    for k in range(order):
        h = (h ^ points[k : k + n]) * _MULTIPLIER
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - bits)


def _grams(points: np.ndarray, bounds: np.ndarray, bits: int):
    """For each order: the features, and the bounds of each text's own; n-grams over two texts belong to none."""
    for order in ORDERS:
        yield _features(points, order, bits), bounds[:-1], np.maximum(bounds[1:] - order + 1, bounds[:-1])


def fit(labelled: DataFrame, *, max_rows: int = 20_000, bits: int = BITS, smoothing: float = 0.5) -> LanguageModel:
    """Learn from (doc_id, text, lang); rows with a null text or lang teach nothing.

    About ``max_rows`` rows at most are used, chosen by a hash of doc_id; the
    hash never reaches the features.  Counts are summed per (language, slice of
    the features), so no task gathers more than a slice from each worker batch.  With no labelled row
    the model is empty and everything is ``und``."""
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    share = min(1.0, max_rows / max(1, rows.count()))
    rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20))).select("text", "lang")
    slices = 16
    width = (1 << bits) // slices

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for part in chunks(batch):
                points, bounds = _points(string_array(part.column("text")))
                langs, codes = np.unique(np.asarray(part.column("lang").to_pylist(), object).astype(str), return_inverse=True)
                for i, lang in enumerate(langs):
                    docs[lang] = docs.get(lang, 0) + int((codes == i).sum())
                    total = seen.setdefault(lang, np.zeros(1 << bits, np.int64))
                    for features, first, last in _grams(points, bounds, bits):
                        step = np.zeros(len(points) + 1, np.int8)
                        own = (codes == i) & (last > first)
                        np.add.at(step, first[own], 1)
                        np.add.at(step, last[own], -1)
                        total += np.bincount(features[np.cumsum(step[: len(features)], dtype=np.int32) > 0], minlength=1 << bits)
        out = [(lang, s, docs[lang] if s == 0 else 0, total[s * width : (s + 1) * width].tobytes()) for lang, total in seen.items() for s in range(slices)]
        yield pa.RecordBatch.from_pydict({"lang": [x[0] for x in out], "slice": pa.array([x[1] for x in out], pa.int32()), "docs": pa.array([x[2] for x in out], pa.int64()), "counts": pa.array([x[3] for x in out], pa.binary())})

    def add(key, batches):
        total, docs = np.zeros(width, np.int64), 0
        for batch in batches:
            docs += int(pc.sum(batch.column("docs")).as_py() or 0)
            for counts in batch.column("counts"):
                total += np.frombuffer(counts.as_buffer(), np.int64)
        yield pa.RecordBatch.from_pydict({"lang": [key[0].as_py()], "slice": pa.array([key[1].as_py()], pa.int32()), "docs": pa.array([docs], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "lang string, slice int, docs long, counts binary"
    added = _typed(add)
    got = rows.mapInArrow(count, schema).groupBy("lang", "slice").applyInArrow(added, schema).collect()
    languages = sorted({r.lang for r in got})
    counts, docs = np.zeros((1 << bits, len(languages))), np.zeros(len(languages))
    for r in got:
        counts[r.slice * width : (r.slice + 1) * width, languages.index(r.lang)] = np.frombuffer(r.counts, np.int64)
        docs[languages.index(r.lang)] += r.docs
    weights = np.log(counts + smoothing) - np.log(counts.sum(axis=0) + smoothing * (1 << bits))
    return LanguageModel(languages, np.log(docs / docs.sum()) if len(docs) else docs, weights.astype(np.float32), bits)


def _typed(f):
    """Spark tells the two forms of a grouped Arrow function apart by their annotations."""
    from collections.abc import Iterator

    f.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return f


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior probability of that language.

    The whole text counts and nothing else does.  A text that is null, empty or has no
    letter is ``und`` with score 0; of equally likely languages the first by name wins.
    Columns of the same names are replaced; repeated rows get equal results."""
    docs = without(docs, ["lang_pred", "score"])
    shared = docs.sparkSession.sparkContext.broadcast((list(model.languages), model.prior, model.weights, model.bits))

    def run(batches):
        languages, prior, weights, bits = shared.value
        names = np.array([*languages, UNKNOWN], object)
        for batch in batches:
            for part in chunks(batch, most=1 << 20):
                texts = string_array(part.column("text"))
                points, bounds = _points(texts)
                lettered = np.asarray(pc.match_substring_regex(texts, r"\p{L}"), bool)
                if not languages:
                    lettered[:] = False
                logs = np.tile(prior, (len(texts), 1)) if languages else np.zeros((len(texts), 1))
                for features, first, last in _grams(points, bounds, bits):
                    spans = np.minimum(np.column_stack([first, last]), len(features))
                    for i in range(len(languages)):
                        total = np.concatenate([[0.0], np.cumsum(weights[:, i][features], dtype=np.float64)])
                        logs[:, i] += total[spans[:, 1]] - total[spans[:, 0]]
                best = np.where(lettered, logs.argmax(axis=1), len(languages))
                top = logs.max(axis=1)
                share = 1 / np.exp(logs - top[:, None]).sum(axis=1)
                yield appended(part, lang_pred=pa.array(names[best].tolist(), pa.string()), score=np.where(lettered, share, 0.0))

    return docs.mapInArrow(run, widened(docs, "lang_pred string, score double"))
