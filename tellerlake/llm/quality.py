"""Quality classifier and quality rules: hashed n-gram logistic models over whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .labels import SAMPLE_ROWS, fold, sample
from .shingles import WordHashes

BITS = 18  # weights: 2^18 numbers of 4 bytes, whatever the corpus
SCALE = 40.0  # length of a text made of one item only
GOOD_AT = 0.3
KEEP_AT = 0.3


def _word_features(text: str, known: WordHashes) -> linear.Features:
    return linear.counted(linear.word_grams(text, known), BITS, SCALE)


def _word_margin(model: np.ndarray, text: str | None, known: WordHashes) -> float:
    return linear.dot_counted(model, linear.word_grams(text, known), BITS, SCALE) + float(model[-1])


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted): hashed word n-grams, trained by FTRL.

    The model sees labels of at most about ``rows`` documents outside the held-out fold
    (crc32 of the id, modulo ``folds``, equal to ``held``) and nothing but their texts. Its
    scores are sparse dot products put through the logistic function.

    Null and empty texts get the score of the bias alone. A null doc_id is not held out and
    comes back as null. Repeated rows get equal scores; other columns are ignored. Without
    labels every score is one half.
    """
    usable = fold(F.col("doc_id"), folds) != held
    model = linear.fit(sample(docs, labels, "quality", usable, rows), _word_features, 1 << BITS, linear.ftrl)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            known = WordHashes()
            margins = [_word_margin(weights, t.as_py(), known) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(linear.sigmoid(np.array(margins, float)))], names=["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = slim.mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= GOOD_AT).cast("int").alias("predicted"))


_SYMBOLS = b"#*$%&|<>"
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    found = raw.split()
    space = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (len(found), len(text) - space, symbols, len(lines) - len(set(lines)), repeated_words(found))


def repeated_words(found: list[bytes], size: int = 5) -> int:
    """Words that lie in a run of ``size`` words found twice or more in the text."""
    if len(found) <= size:
        return 0
    ids: dict[bytes, int] = {}
    code = np.array([ids.setdefault(w, len(ids)) for w in found], np.int64)
    run = code[: len(code) - size + 1]
    for k in range(1, size):  # pairs of dense codes, coded densely again: no hash, no overflow
        _, run = np.unique(run * len(ids) + code[k: len(code) - size + 1 + k], return_inverse=True)
    again = np.bincount(run)[run] > 1
    edge = np.zeros(len(code) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _rule_features(text: str, known: WordHashes) -> linear.Features:
    a, x = linear.counted(linear.word_grams(text, known), BITS - 1, SCALE)
    b, y = linear.counted(linear.char_grams(text), BITS - 1, SCALE)
    return np.concatenate([a, b + (1 << (BITS - 1))]), np.concatenate([x, y])


def _rule_margin(model: np.ndarray, text: str | None, known: WordHashes) -> float:
    half = 1 << (BITS - 1)
    return (linear.dot_counted(model[:half], linear.word_grams(text, known), BITS - 1, SCALE)
            + linear.dot_counted(model[half:-1], linear.char_grams(text), BITS - 1, SCALE) + float(model[-1]))


def rules(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, keep_at: float = KEEP_AT) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    probability and kept in place of columns of those names.

    Base rule: fewer than 10 words, or more than 20 % of them in repeated five-word runs.
    Other texts get the calibrated probability of a quality label of 1 from word and
    character n-grams; ``kept`` needs ``keep_at`` or more. The model is fitted on at most
    about ``rows`` labelled rows, four fifths for weights, one fifth for the calibration
    (a logistic curve over the margin).

    Null and empty texts have no words and fail. Ids are not used beyond the labels, so a
    null id passes through; repeated rows get equal results. Without labels the probability
    is one half, so only the base rule rejects.
    """
    calibrating = fold(F.col("doc_id"), 5) == 0
    model = linear.fit(sample(docs, labels, "quality", ~calibrating, rows), _rule_features, 1 << BITS, linear.adagrad)
    slope, shift = _calibration(sample(docs, labels, "quality", calibrating, rows // 4), model)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*_BASE, "base_failed", "probability", "kept"]
    rest = docs.select([c for c in docs.columns if c not in names])
    spec = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema]
                     + [f"{c} long" for c in _BASE] + ["base_failed boolean, probability double, kept boolean"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            known, counts, chances = WordHashes(), [], []
            for cell in batch.column("text"):
                text = cell.as_py()
                counts.append(base_counts(text))
                margin = _rule_margin(weights, text, known)
                chances.append(float(linear.sigmoid(slope * margin + shift)))
            failed = [c[0] < 10 or 100 * c[4] > 20 * c[0] for c in counts]
            made = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(_BASE))]
            made += [pa.array(failed), pa.array(chances, pa.float64()),
                     pa.array([not f and p >= keep_at for f, p in zip(failed, chances, strict=True)])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return rest.mapInArrow(judge, spec)


def _calibration(sampled: DataFrame, model: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over margins, fitted on a bounded held-out sample."""
    shared = sampled.sparkSession.sparkContext.broadcast(model)

    def margin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = WordHashes()
            found = [_rule_margin(shared.value, t.as_py(), known) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column("y")], names=["m", "y"])

    rows = sampled.select("text", "y").mapInArrow(margin, "m double, y int").collect()  # two numbers a sampled row
    m, y = np.array([r.m for r in rows]), np.array([r.y for r in rows], float)
    a, b = 1.0, 0.0
    if len(set(y)) < 2:
        return a, b
    for _ in range(50):  # Newton's method with a small ridge
        p = linear.sigmoid(a * m + b)
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * m).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
        h = np.array([[(w * m * m).sum() + 1e-2, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 0.0)), float(b)
