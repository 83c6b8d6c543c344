"""Text quality by a regularised quadratic discriminant over document statistics.

Each class is a normal distribution of transformed statistics of the text. Its covariance is shrunk towards the pooled
one and the identity. A score is the logistic of the difference of log densities and priors, where Mahalanobis distances
come from Cholesky factors that are computed once and sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import as_bytes, as_documents, text_key, written

STATISTICS = (
    "words", "word_length", "distinct_words", "repeats", "top_word", "symbols", "marked_words", "digits",
    "capitals", "bars", "shouts", "stops", "distinct_lines", "line_length", "beyond_ascii",
)
_CLASS = np.zeros((256, 8))
for _c in range(128):
    _ch = chr(_c)
    _CLASS[_c] = [
        not _ch.isalnum() and not _ch.isspace() and _ch not in ".,;:!?|'\"-()",
        _ch.isdigit(),
        _ch.isupper(),
        _ch == "|",
        _ch == "!",
        _ch in ".,;:?",
        _ch.isalpha(),
        0,
    ]
_CLASS[128:, 7] = 1
_MARKS = frozenset(b"#$%&*@^~=<>{}[]\\/_+")


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of a text; shares are moved to a square-root scale, counts to a logarithmic one."""
    words = text.split()
    n = max(1, len(words))
    shares = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS) / max(1, len(text))
    symbols, digits, capitals, bars, shouts, stops, letters, beyond = shares
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x]
    same = sum(map(bytes.__eq__, words, words[1:])) / n
    marked = sum(w[-1] in _MARKS for w in words) / n
    return [
        np.log1p(len(words)),
        np.log1p(len(text) / n),
        len(counts) / n,
        same**0.5,
        (max(counts.values(), default=0) / n) ** 0.5,
        symbols**0.5,
        marked**0.5,
        digits**0.5,
        (capitals / letters) ** 0.5 if letters else 0.0,
        bars**0.5,
        shouts**0.5,
        stops**0.5,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(len(text) / max(1, len(lines))),
        beyond**0.5,
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and stats of each row's whole text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = pa.array([statistics(t) for t in as_bytes(batch.column(2))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), stats], ["doc_id", "text_key", "stats"])

    return docs.mapInArrow(measure, "doc_id long, text_key long, stats array<double>")


@dataclass(frozen=True)
class Discriminant:
    """For labels 0 and 1: mean, inverse Cholesky factor of the shrunk covariance, half its log determinant, log prior."""

    means: np.ndarray
    inverses: np.ndarray
    half_logs: np.ndarray
    priors: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.inverses[c].T
            logs.append(self.priors[c] - self.half_logs[c] - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))


def fit(labelled: DataFrame, shrink: float, ridge: float) -> Discriminant | float:
    """The discriminant of rows (stats, label), or the share of label 1 if a class has less than two rows.

    Sums and products are gathered by Spark over all rows; the driver reads one row for each class.
    """
    d = len(STATISTICS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).to_pylist())
                y = batch.column(1).to_numpy()
                own = [x[y == c] for c in (0, 1)]
                sums = [np.r_[len(a), a.sum(axis=0), (a.T @ a).ravel()].tolist() for a in own]
                yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(sums, pa.list_(pa.float64()))], ["label", "sums"])

    parts = labelled.select("stats", "label").mapInArrow(moments, "label long, sums array<double>")
    totals = parts.select("label", F.posexplode("sums").alias("i", "v")).groupBy("label", "i").agg(F.sum("v").alias("v"))
    sums = np.zeros((2, 1 + d + d * d))
    for r in totals.collect():  # two classes times the fixed number of moments
        sums[r.label, r.i] = r.v
    n = sums[:, 0]
    if min(n) < 2:
        return float(n[1] / n.sum()) if n.sum() else 0.5
    means = sums[:, 1 : d + 1] / n[:, None]
    covs = np.array([sums[c, d + 1 :].reshape(d, d) / n[c] - np.outer(means[c], means[c]) for c in (0, 1)])
    pooled = (covs * n[:, None, None]).sum(axis=0) / n.sum()
    floor = ridge * np.diag(np.maximum(np.diag(pooled), 1e-6))
    factors = [np.linalg.cholesky((1 - shrink) * covs[c] + shrink * pooled + floor) for c in (0, 1)]
    return Discriminant(
        means, np.array([np.linalg.inv(f) for f in factors]), np.array([np.log(np.diag(f)).sum() for f in factors]), np.log(n / n.sum())
    )


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    label_col: str = "quality",
    shrink: float = 0.1,
    ridge: float = 0.05,
    threshold: float = 0.3,
    folds: int = 5,
    keyed: bool = False,
) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1, high for label 1) and predicted (1 if score >= threshold).

    keyed: text_key too, which tells rows of one id apart.

    Labels of held-out rows, those with crc32(doc_id as text) mod folds of 0, are never learned from; ids, languages and
    sources are never inputs. All other labelled rows are used. Null or empty texts are scored as texts without words. Of
    labels that repeat a doc_id, each counts; null labels and labels other than 0 and 1 are left out. A null doc_id is
    not held out. Without two rows of each class all scores are the share of label 1, or 0.5. An empty table gives no
    rows. Texts are read whole; other columns are ignored.
    """
    docs = as_documents(docs, id_col, text_col).select("doc_id", text_key().alias("text_key"), "text")
    stats = written(measured(docs), "statistics")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))
    known = labels.select(F.col(label_id_col).cast("long").alias("label_id"), F.col(label_col).cast("long").alias("label")).where("label in (0, 1)")
    model = fit(stats.where(~held_out).join(known, F.col("doc_id") == F.col("label_id")), shrink, ridge)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(3).to_pylist(), float).reshape(batch.num_rows, -1)
            values = np.full(len(x), model) if isinstance(model, float) else model.scores(x)
            own = [batch.column(i) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(values, pa.float64())], ["doc_id", "text_key", "held_out", "score"])

    scored = (
        stats.select("doc_id", "text_key", held_out.alias("held_out"), "stats")
        .mapInArrow(score, "doc_id long, text_key long, held_out boolean, score double")
        .withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
    )
    return scored if keyed else scored.drop("text_key")
