"""Quality classifier: random Fourier features of document statistics, ridge regression by partition-summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import words
from lectern.llm.id_filter import flagged
from lectern.llm.labelled import fold, labelled
from lectern.storage import materialize

#: Random features, ridge penalty per row, and the decimals of a ridge score that calibration tells apart.
FEATURES, RIDGE, DECIMALS = 384, 2e-4, 3
NAMES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "space", "stop", "mark", "bang", "bar", "symbol", "symbol_run", "other_script",
    "lines", "line_length", "repeated_lines", "repeated_line_bytes", "distinct_words", "top_word", "repeated_shingles", "short_words", "long_words", "upper_words", "marked_words",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _class("0123456789")
_SPACE = _class(" \t\r\n\f\v")
_STOP = _class(".,;:?")
_MARK = _class("'\"()-")
_SYMBOL = _class("#$%&*+/<=>@[\\]^_`{|}~!")
_OTHER = np.arange(256) >= 128
_TOKEN = ~_SPACE
_LINE = ~_class("\n")


def _share(flags: np.ndarray, offsets: np.ndarray, per: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(per, 1)


def _repeats(values: np.ndarray, doc: np.ndarray, n: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """By document: the weight of values that occurred before, and the count of the most frequent value."""
    top = np.zeros(n)
    if not len(values):
        return np.zeros(n), top
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    again = np.zeros(len(v), bool)
    again[1:] = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
    first = np.flatnonzero(~again)
    np.maximum.at(top, d[first], np.diff(np.append(first, len(v))))
    return np.bincount(d, again * (1.0 if weight is None else weight[order]), n), top


def statistics(text: pa.Array) -> np.ndarray:
    """(documents, len(NAMES)) float32 of whole texts; an empty or null text has zeros."""
    buf, offsets = words.raw_bytes(text)
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((n, len(NAMES)))
    if not len(buf):
        return out.astype(np.float32)
    start, end, doc = words.spans(buf, offsets, _TOKEN)
    n_words = np.bincount(doc, minlength=n)
    length = end - start
    per_word = np.maximum(n_words, 1)
    symbol = _SYMBOL[buf]
    run = symbol.copy()
    run[1:] &= buf[1:] == buf[:-1]
    run[0] = False
    ls, le, ld = words.spans(buf, offsets, _LINE)
    n_lines = np.bincount(ld, minlength=n)
    h = words.span_hashes(buf, start, end) if len(start) else np.zeros(0, np.uint64)
    lh = words.span_hashes(buf, ls, le) if len(ls) else np.zeros(0, np.uint64)
    again, top = _repeats(h, doc, n)
    line_again, _ = _repeats(lh, ld, n)
    line_bytes_again, _ = _repeats(lh, ld, n, (le - ls).astype(float))
    gram_again, n_grams = np.zeros(n), np.maximum(n_words - 2, 1)
    if len(h) > 2:
        whole = doc[:-2] == doc[2:]
        gram = words.mix(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7))[whole]
        gram_again, _ = _repeats(gram, doc[:-2][whole], n)
    upper_total = np.concatenate(([0], np.cumsum(_UPPER[buf], dtype=np.int64)))
    symbol_total = np.concatenate(([0], np.cumsum(symbol, dtype=np.int64)))
    columns = (
        np.log1p(size), np.log1p(n_words), np.bincount(doc, length, n) / per_word,
        _share(_UPPER[buf], offsets, size), _share(_DIGIT[buf], offsets, size), _share(_SPACE[buf], offsets, size), _share(_STOP[buf], offsets, size),
        _share(_MARK[buf], offsets, size), _share(buf == ord("!"), offsets, size), _share(buf == ord("|"), offsets, size), _share(symbol, offsets, size), _share(run, offsets, size),
        _share(_OTHER[buf], offsets, size), np.log1p(n_lines), np.log1p(size / np.maximum(n_lines, 1)), line_again / np.maximum(n_lines, 1), line_bytes_again / np.maximum(size, 1),
        (n_words - again) / np.sqrt(per_word), top / per_word, gram_again / n_grams,
        np.bincount(doc, length <= 3, n) / per_word, np.bincount(doc, length >= 12, n) / per_word,
        np.bincount(doc, (upper_total[end] - upper_total[start]) * 2 > length, n) / per_word, np.bincount(doc, symbol_total[end] > symbol_total[start], n) / per_word,
    )
    for k, c in enumerate(columns):
        out[:, k] = c
    out[size == 0] = 0
    return out.astype(np.float32)


def _statistics_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, x): the statistics, one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, to in words.slices(b.column(1)):
                x = statistics(b.column(1).slice(lo, to - lo))
                flat = pa.array(x.reshape(-1))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, to - lo), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), flat)], names=["doc_id", "x"])

    words.bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<float>")


@dataclass
class QualityModel:
    """Standardisation, random features, ridge weights and the calibration curve."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    weights: np.ndarray
    curve_x: np.ndarray
    curve_y: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate((np.cos(z @ self.w + self.b) * np.sqrt(2 / self.w.shape[1]), np.ones((len(x), 1))), axis=1)

    def probability(self, ridge: np.ndarray) -> np.ndarray:
        """The curve between its points, with a hundredth of the ridge score itself to keep order on its level parts."""
        return 0.99 * np.interp(ridge, self.curve_x, self.curve_y) + 0.01 * np.clip(ridge, 0, 1)


def isotonic(x: np.ndarray, positives: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; points (first and last x, rate) of each pooled block, the rates smoothed by half a row of each label."""
    blocks: list[list[float]] = []
    for a, p, c in zip(x, positives, counts):
        blocks.append([p, c, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p1, c1, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p1, blocks[-1][1] + c1, blocks[-1][2], last]
    rate = np.maximum.accumulate(np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks]))
    points = [(a, r) for b, r in zip(blocks, rate) for a in sorted({b[2], b[3]})]
    return np.array([a for a, _ in points]), np.array([r for _, r in points])


def _summed(rows: DataFrame, part, size: int) -> dict[int, np.ndarray]:
    """Sums by fold of part(x, label), a vector of ``size`` numbers for a batch: within partitions, in groups of partitions, and over the groups; one row a fold comes here."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1).astype(np.float64)
            y, f = b.column(1).to_numpy().astype(np.float64), b.column(2).to_numpy()
            for k in np.unique(f):
                total[int(k)] = total.get(int(k), 0) + part(x[f == k], y[f == k])
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["fold", "sums"])

    def grouped(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.float64) for v in table.column("sums").to_pylist())
        return pa.table({"fold": table.column("fold").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    sums = rows.select("x", "label", "fold").mapInArrow(within, "fold int, sums binary")
    sums = sums.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(32))).groupBy("fold", "g").applyInArrow(grouped, "fold int, sums binary")
    sums = sums.groupBy("fold").applyInArrow(grouped, "fold int, sums binary")
    out: dict[int, np.ndarray] = {}
    for row in sums.collect():
        out[row["fold"]] = out.get(row["fold"], np.zeros(size)) + np.frombuffer(row["sums"], np.float64)
    return out


def fit(rows: DataFrame) -> QualityModel | None:
    """Fit on (x, label, fold) with folds 0 and 2: ridge weights on both, the calibration curve on scores that each fold gets from the other's weights."""
    d = len(NAMES)
    moments = sum(_summed(rows, lambda x, y: np.concatenate(([len(x)], x.sum(0), (x * x).sum(0), [y.sum()])), 2 * d + 2).values())
    if np.isscalar(moments) or moments[0] < 2:
        return None
    mean = moments[1 : d + 1] / moments[0]
    scale = np.sqrt(np.maximum(moments[d + 1 : 2 * d + 1] / moments[0] - mean**2, 0)) + 1e-3
    rng = np.random.default_rng(11)
    model = QualityModel(mean, scale, rng.standard_normal((d, FEATURES)) / np.sqrt(d) * 0.9, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.0]))
    m = FEATURES + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.concatenate(((z.T @ z).reshape(-1), z.T @ y, [len(x)]))

    sums = _summed(rows, normal, m * m + m + 1)
    total = sum(sums.values())

    def solve(s: np.ndarray) -> np.ndarray:
        penalty = RIDGE * max(s[-1], 1) * np.eye(m) + 0.05 * np.eye(m)
        penalty[-1, -1] = 1e-6
        return np.linalg.solve(s[: m * m].reshape(m, m) + penalty, s[m * m : -1])

    model.weights = solve(total)
    other = {k: solve(total - v) if (total - v)[-1] >= 1 else model.weights for k, v in sums.items()}

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1).astype(np.float64)
            f = b.column(2).to_numpy()
            s = np.einsum("ij,ij->i", model.features(x), np.array([other[k] for k in f]).reshape(len(f), m))
            yield pa.RecordBatch.from_arrays([pa.array(np.round(np.clip(s, -1, 2), DECIMALS)), b.column(1)], names=["s", "label"])

    bins = rows.select("x", "label", "fold").mapInArrow(crossed, "s double, label int").groupBy("s").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n"))
    table = bins.toArrow().sort_by("s")
    model.curve_x, model.curve_y = isotonic(*(table.column(c).to_numpy().astype(float) for c in ("s", "p", "n")))
    return model


def _fit_on(table: DataFrame, labels: DataFrame, label_col: str) -> QualityModel | None:
    return fit(table.join(labelled(labels, label_col), "doc_id").select("x", "label", "fold"))


def _labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of docs whose id may be a labelled one, by a filter of fixed size; the join of the statistics with the labels leaves out the rest."""
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    return flagged(rows, F.col(id_col), labelled(labels, label_col), "doc_id", "_may_be_labelled").where("_may_be_labelled")


def keep_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that ``quality_scores`` predicts as 1, with all their columns; rows are judged one by one, without a shuffle of texts.

    Statistics for the fit are made of the labelled rows only. Defined cases are those of ``quality_scores``:
    null and empty texts are judged by zeros, rows that repeat an id or have none are judged each by its
    text, and without any usable label all rows stay.
    """
    model = _fit_on(materialize(_statistics_table(_labelled_rows(docs, labels, label_col, id_col, text_col), id_col, text_col), "statistics"), labels, label_col)
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            for lo, to in words.slices(b.column(at)):
                part = b.slice(lo, to - lo)
                s = model.probability(model.features(statistics(part.column(at))) @ model.weights)
                yield part.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted; score estimates the probability of label 1.

    Statistics of the whole text are the only inputs of a score. Labels are learnt from rows whose
    crc32(doc_id as text) mod 3 is not 1; all of them enter the sums, there is no sample.

    Defined cases: null text counts as empty, and empty texts are scored like others; a row without an
    id is scored, is not held out and teaches nothing; rows that repeat an id are scored each; without
    any usable label every score is 0.5; an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    table = materialize(_statistics_table(docs, id_col, text_col), "statistics")
    model = _fit_on(table, labels, label_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1).astype(np.float64)
            s = np.full(len(b), 0.5) if model is None else model.probability(model.features(x) @ model.weights)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.clip(s, 0, 1))], names=["doc_id", "score"])

    scored = table.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
