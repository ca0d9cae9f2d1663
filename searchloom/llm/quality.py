"""Quality classifier: a regularised quadratic discriminant on document statistics.

Each text becomes a vector of transformed statistics (lengths, repetition,
symbols, lines).  For either class the mean and a shrunken covariance are
fitted; a score is the logistic of the difference of the two Gaussian log
densities, whose Mahalanobis terms use Cholesky factors computed once.

Fitting adds up counts, sums and products of *all* labelled rows in one
aggregation of partial sums, so nothing but two 16 x 16 matrices reaches the
driver.  Labels, language, source and ids are no inputs of a score.

Defined cases: a null text counts as empty and an empty text has a score like
any other; labels that are null are left out; a table without labelled rows of
both classes gives a score of 0.5 everywhere; a document that is in ``labels``
twice counts twice; an empty table gives no rows; other columns pass through, but
for one with the name of the new column, which replaces it.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .bpe import forget
from .common import batched, besides, read_table, save, unused
from .textbytes import Words, blocks

FEATURES = (
    "log_bytes", "log_words", "word_length", "symbols", "marks", "digits", "capitals", "distinct_words",
    "top_word", "same_as_before", "distinct_pairs", "log_lines", "repeated_lines", "line_words", "short_words", "spaces",
)
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.isin(np.arange(256), list(b".,;:!?'\"()-"))
_SPACE = np.isin(np.arange(256), list(b" \t\r\n"))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:127] = True
_SYMBOL &= ~(_MARK | _DIGIT)
_SYMBOL[65:91] = _SYMBOL[97:123] = False


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """log((part + 1) / (whole + 10)): shares spread over their orders of magnitude, steady for short texts."""
    return np.log((part + 1.0) / (whole + 10.0))


def _runs(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row: how many distinct keys, and how often the commonest comes."""
    distinct, most = np.zeros(n), np.zeros(n)
    if len(doc):
        both = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (key >> np.uint64(24)))
        at = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
        row = (both[at] >> np.uint64(40)).astype(np.int64)
        np.add.at(distinct, row, 1)
        np.maximum.at(most, row, np.diff(np.append(at, len(both))))
    return distinct, most


def statistics(texts: pa.Array | list) -> np.ndarray:
    """A row of FEATURES for every text; whole texts are read."""
    out = np.zeros((len(texts), len(FEATURES)))
    for first, end, raw in blocks(texts):
        n = end - first
        w = Words(raw)
        plain = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        starts = np.concatenate(([0], w.doc_ends[:-1]))
        size = np.diff(np.append(starts, w.doc_ends[-1])) - 1.0
        per = lambda table: np.add.reduceat(table[plain], starts, dtype=np.int64).astype(float)  # noqa: E731, B023
        spaces = per(_SPACE) - 1
        words = w.count.astype(float)
        length = np.bincount(w.doc, w.end - w.start, n)
        distinct, most = _runs(w.doc, w.hash, n)
        same = np.zeros(len(w.hash), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        pairs, _ = _runs(w.doc[1:], w.hash[1:] + np.uint64(3) * w.hash[:-1], n) if len(w.hash) else (np.zeros(n), None)
        lines, repeated = np.zeros(n), np.zeros(n)
        for i, text in enumerate(raw):
            own = text.split(b"\n")
            lines[i], repeated[i] = len(own), len(own) - len(set(own))
        out[first:end] = np.stack(
            [
                np.log1p(size), np.log1p(words), np.log((length + 1) / (words + 1)), _share(per(_SYMBOL), size),
                _share(per(_MARK), size), _share(per(_DIGIT), size), _share(per(_CAPITAL), size), _share(distinct, words),
                _share(most, words), _share(np.bincount(w.doc, same, n), words), _share(pairs, words), np.log1p(lines),
                _share(repeated, lines), np.log((words + 1) / (lines + 1)),
                _share(np.bincount(w.doc, w.end - w.start <= 3, n), words), _share(spaces, size),
            ],
            axis=1,
        )
    return out


@dataclass(frozen=True)
class Gaussian:
    """One class: its mean, the inverse of its Cholesky factor, and its log density's constant."""

    mean: np.ndarray
    whiten: np.ndarray
    constant: float

    @classmethod
    def fit(cls, n: float, total: np.ndarray, products: np.ndarray, pooled: np.ndarray, shrinkage: float, ridge: float) -> Gaussian:
        """Shrinks the class covariance to the pooled one, and that to its diagonal."""
        mean = total / n
        cov = products / n - np.outer(mean, mean)
        cov = (1 - shrinkage) * cov + shrinkage * pooled
        cov = (1 - ridge) * cov + ridge * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(mean))
        factor = np.linalg.cholesky(cov)
        return cls(mean, np.linalg.inv(factor), -float(np.log(np.diag(factor)).sum()))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return self.constant - 0.5 * (((x - self.mean) @ self.whiten.T) ** 2).sum(axis=1)


@dataclass(frozen=True)
class QualityModel:
    bad: Gaussian | None
    good: Gaussian | None
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of FEATURES."""
        if self.bad is None or self.good is None:
            return np.full(len(x), 0.5)
        difference = self.good.log_density(x) - self.bad.log_density(x) + self.prior
        return 1 / (1 + np.exp(-np.clip(difference, -60, 60)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(FEATURES))


def _sums(batches):
    """Adds up (class, 1, x, x x') over a partition of (statistics, class): one row for each class."""
    k = len(FEATURES)
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        label = np.asarray(batch.column(1).to_pylist(), int)
        x = _matrix(batch.column(0))
        for c in (0, 1):
            some = x[label == c]
            if len(some):
                found.setdefault(c, np.zeros(1 + k + k * k))
                found[c] += np.concatenate(([len(some)], some.sum(axis=0), (some.T @ some).ravel()))
    if found:
        yield pa.RecordBatch.from_pydict({"label": pa.array(list(found), pa.int32()), "sums": pa.array([v.tolist() for v in found.values()], pa.list_(pa.float64()))})


def measure(docs: DataFrame, text: str = "text", out: str = "statistics", columns: list[str] | None = None) -> DataFrame:
    """``columns`` (all, by default) of ``docs`` with the texts' statistics; no shuffle."""
    kept = [i for i in besides(docs, (out,)) if columns is None or docs.columns[i] in columns]
    read, at, fields = _read(docs, kept, text)
    schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        forget()
        for batch in batches:
            x = statistics(batch.column(at))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(list(x), pa.list_(pa.float64()))], names=schema.names)
        forget()

    return read.mapInArrow(run, schema)


def _read(docs: DataFrame, kept: list[int], needed: str) -> tuple[DataFrame, int, list[T.StructField]]:
    """The columns ``kept`` under plain names, with ``needed`` at the end if it isn't among them; its place; the kept fields."""
    at = docs.columns.index(needed)
    more = [] if at in kept else [F.col(f"`{needed}`").alias("c")]
    fields = [T.StructField(docs.columns[i], docs.schema[i].dataType) for i in kept]
    return docs.select(*(F.col(f"`{docs.columns[i]}`").alias(f"c{i}") for i in kept), *more), len(kept) if more else kept.index(at), fields


def fit(labelled: DataFrame, measured: str = "statistics", label: str = "quality", shrinkage: float = 0.5, ridge: float = 0.0) -> QualityModel:
    """Fits on every labelled row; ``label`` is 1 for good, 0 for bad."""
    parts = labelled.where(F.col(label).isin(0, 1)).select(F.col(measured), F.col(label).cast("int")).mapInArrow(_sums, "label int, sums array<double>")
    at = F.posexplode("sums").alias("i", "x")
    rows = parts.select("label", at).groupBy("label", "i").agg(F.sum("x").alias("x")).collect()  # 2 x (1 + k + k * k) rows
    k = len(FEATURES)
    sums = {c: np.array([r.x for r in sorted((r for r in rows if r.label == c), key=lambda r: r.i)]) for c in (0, 1)}
    if any(len(v) == 0 for v in sums.values()):
        return QualityModel(None, None, 0.0)
    split = {c: (v[0], v[1 : 1 + k], v[1 + k :].reshape(k, k)) for c, v in sums.items()}
    total = sum(n for n, _, _ in split.values())
    pooled = sum(p - np.outer(s, s) / n for n, s, p in split.values()) / total
    bad, good = (Gaussian.fit(*split[c], pooled, shrinkage, ridge) for c in (0, 1))
    return QualityModel(bad, good, float(np.log(split[1][0] / split[0][0])))


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learned from: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, model: QualityModel, text: str | None = None, measured: str = "statistics", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``; no shuffle.

    The statistics are those in the column ``measured``, which goes, or with
    ``text`` they are taken from that column, which stays.
    """
    kept = [i for i in besides(docs, (out,)) if text or docs.columns[i] != measured]
    read, at, fields = _read(docs, kept, text or measured)
    schema = T.StructType([*fields, T.StructField(out, T.DoubleType())])

    def run(batches):
        forget()
        for batch in batches:
            x = statistics(batch.column(at)) if text else _matrix(batch.column(at))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(model.score(x), pa.float64())], names=schema.names)
        forget()

    return read.mapInArrow(run, schema)


def train(measured: DataFrame, labels: DataFrame) -> QualityModel:
    """Learns from the labelled rows of (doc_id, statistics) outside the held-out fold.

    The statistics travel to the labels, not the texts.
    """
    known = labels.where(~held_out(F.col("doc_id"))).select("doc_id", "quality").where("quality is not null")
    return fit(measured.where(~held_out(F.col("doc_id"))).join(known, "doc_id"))


@batched
def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = save(measure(docs, columns=["doc_id"]), "statistics")
    model = train(measured, read_table(spark, sf_dir, "labels"))
    return score(measured, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@batched
def quality_stage(spark, docs: DataFrame, sf_dir: str, keep: float = 0.5) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go."""
    labels = read_table(spark, sf_dir, "labels")
    known = read_table(spark, sf_dir, "documents").select("doc_id", "text").where(~held_out(F.col("doc_id")))
    model = train(measure(known, columns=["doc_id"]), labels)
    name = unused(docs, "_score")
    return score(docs, model, "text", out=name).where(F.col(name) >= keep).drop(name)


def crc_mod_3(doc_id: int) -> int:
    """The same fold in plain Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 3
