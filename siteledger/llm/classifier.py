"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Every whole text becomes STATISTICS numbers (ratios and logarithms, so that long texts don't stand out by length
alone). Standardised, they go through WAVES cosines of drawn directions, whose products approximate a Gaussian kernel of
width BANDWIDTH. Each task sums the normal equations of its rows, fold by fold; the sums meet row by row of the matrix, so what
the driver solves has a fixed size however many labels there are. Each labelled row is then scored by the equations without its
own fold, and these scores, counted in BINS equal bins, are made monotone by pooling adjacent violators: that is the
calibration. All labelled rows count; nothing is drawn but the cosines, by a fixed seed.

Null texts count as empty; empty texts have statistics of zero and so a score as well. Null and other labels than 0 and 1 don't
count; a document with several labels, or several rows, counts once for each pair. With labels of one kind alone
every score is that label, without any 0.5. Repeated rows get equal scores. An empty table gives no rows. Only the named
columns are read, so others can have any names. One text is held at a time beside a batch, of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.llm.quality import KINDS, measure
from siteledger.llm.shared import annotated, cut

WAVES, BANDWIDTH, RIDGE, FOLDS, SEED = 256, 2.0, 1e-4, 4, 20
#: Scores of the ridge regression are counted in BINS equal bins from LOW to HIGH; those beyond go to the last one.
LOW, HIGH, BINS = -0.5, 1.5, 2000
#: Bytes of text that one array pass takes; a longer text is a pass of its own.
PASS = 400_000
STATISTICS = ("log words", "characters of a word", "symbols", "repeated lines", "words in repeated windows", "capitals", "digits", "marks", "exclamations", "bars", "bytes beyond ASCII", "log words of a line")


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of STATISTICS for each text."""
    m = measure(texts)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = np.append(0, ends[:-1])
    count = lambda flags: np.add.reduceat(flags, starts, dtype=np.int64)
    upper, lower = count(KINDS["upper"][data]), count(KINDS["lower"][data])
    words, ink = np.maximum(m.n_words, 1), np.maximum(m.word_chars, 1)
    lines = np.bincount(m.line_text, minlength=len(texts))
    columns = [
        np.log1p(m.n_words), m.word_chars / words, m.n_symbols / ink, m.n_dup_lines / np.maximum(lines, 1), m.n_repeat_words / words, upper / np.maximum(upper + lower, 1),
        count(KINDS["digit"][data]) / ink, count(KINDS["mark"][data]) / ink, count(data == ord("!")) / ink, count(data == ord("|")) / ink, count(data >= 128) / ink, np.log1p(m.n_words / np.maximum(lines, 1)),
    ]
    return np.stack(columns, 1).astype(np.float64)


def described(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """row (the kept columns) and x (the statistics) of every row."""

    def answer(texts: list[str | None]) -> Iterator[list]:
        blobs, at = [(t or "").encode() for t in texts], 0
        while at < len(blobs):
            stop, size = at + 1, len(blobs[at])
            while stop < len(blobs) and size + len(blobs[stop]) <= PASS:
                size, stop = size + len(blobs[stop]), stop + 1
            yield [list(statistics(blobs[at:stop]))]
            at = stop

    return annotated(docs, keep, text_col, answer, "x array<double>")


@dataclass
class Model:
    """mean and spread of the statistics, the cosines, weights (last: all folds), levels of the bins; or one score for all."""

    mean: np.ndarray
    spread: np.ndarray
    waves: np.ndarray
    shift: np.ndarray
    weights: np.ndarray | None = None
    levels: np.ndarray | None = None
    only: float | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        """Cosines of standardised statistics, and 1."""
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.shift)) * np.cos(z @ self.waves + self.shift), np.ones((len(x), 1))])

    def ridge(self, x: np.ndarray, fold: np.ndarray | int = -1) -> np.ndarray:
        return np.einsum("nf,nf->n", self.features(x), self.weights[np.broadcast_to(fold, len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.only) if self.only is not None else self.levels[binned(self.ridge(x))]


def binned(scores: np.ndarray) -> np.ndarray:
    return np.clip((scores - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int64)


def matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def equations(rows: DataFrame, model: Model) -> np.ndarray:
    """Sums of features' products with each other and (last column) with the label, by fold; rows: fold, y, x.

    Each task adds up its own rows and puts out a line for each row of the matrix; lines of one row are added up in one pass
    over them, so neither holds more than one set of sums.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a fixed number of numbers
    n = WAVES + 1

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((FOLDS, n, n + 1)), False
        for batch in batches:
            fold, y = (batch.column(c).to_numpy() for c in (0, 1))
            for at in range(0, batch.num_rows, 4096):
                part = slice(at, at + 4096)
                z = shared.value.features(matrix(batch.slice(at, 4096), 2))
                both, seen = np.hstack([z, y[part, None]]), True
                for f in range(FOLDS):
                    mine = fold[part] == f
                    total[f] += z[mine].T @ both[mine]
        if seen:
            yield lines({f * n + i: total[f, i] for f in range(FOLDS) for i in range(n)})

    def lines(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["line", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for line, values in zip(batch.column(0).to_pylist(), matrix(batch, 1), strict=True):
                sums[line] = sums.get(line, 0.0) + values
        if sums:
            yield lines(sums)

    kind = "line long, sums array<double>"
    got = rows.select("fold", "y", "x").mapInArrow(own, kind).repartition("line").mapInArrow(added, kind).collect()  # FOLDS * (WAVES + 1) lines
    out = np.zeros((FOLDS * n, n + 1))
    for r in got:
        out[r[0]] = r[1]
    return out.reshape(FOLDS, n, n + 1)


def solved(sums: np.ndarray) -> np.ndarray:
    """Weights of the ridge regression without each fold, and with all of them; the constant isn't held down."""
    whole, n = sums.sum(0), sums.shape[1]

    def weights(s: np.ndarray) -> np.ndarray:
        hold = RIDGE * max(s[-1, -2], 1.0) * np.eye(n)  # the last feature is 1, so its square counts the rows
        hold[-1, -1] = 0 if s[-1, -2] else 1.0
        return np.linalg.solve(s[:, :-1] + hold, s[:, -1])

    return np.stack([weights(whole - s) for s in sums] + [weights(whole)])


def monotone(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing values in the weighted square, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools[-1]
            pools[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def calibrated(counts: list[tuple[int, int, int]]) -> np.ndarray:
    """The level of each bin from (bin, rows, rows of label 1); bins without rows lie on the line between their neighbours."""
    counts = sorted(counts)
    at, n, good = (np.array([c[k] for c in counts], np.float64) for k in range(3))
    return np.interp(np.arange(BINS), at, monotone(good / n, n))


def train(described_: DataFrame, labels: DataFrame, id_col: Column, learn: Column) -> Model:
    """described_: row and x; labels: doc_id, quality; id_col and learn: of row, its id and whether it may teach."""
    good = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("y"))
    fold = F.pmod(F.xxhash64("_id", F.lit(SEED)), F.lit(FOLDS)).cast("int").alias("fold")
    rows = cut(described_.where(learn).select(id_col.alias("_id"), "x").join(good, "_id").select(fold, "y", "x"), "lessons")
    k, draw = len(STATISTICS), np.random.default_rng(SEED)
    waves, shift = draw.normal(0, 1 / BANDWIDTH, (k, WAVES)), draw.uniform(0, 2 * np.pi, WAVES)
    moments = rows.agg(F.count(F.lit(1)), F.avg("y"), *[f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(k)]).first()
    if moments[1] in (None, 0, 1):
        return Model(np.zeros(k), np.ones(k), waves, shift, only=0.5 if moments[1] is None else float(moments[1]))
    spread = np.array(moments[2 + k :])
    model = Model(np.array(moments[2 : 2 + k]), np.where(spread > 1e-9, spread, 1.0), waves, shift)
    model.weights = solved(equations(rows, model))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = binned(shared.value.ridge(matrix(batch, 2), batch.column(0).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1)], names=["bin", "y"])

    counts = rows.select("fold", "y", "x").mapInArrow(scored, "bin long, y int").groupBy("bin").agg(F.count(F.lit(1)), F.sum("y"))
    model.levels = calibrated([tuple(r) for r in counts.collect()])  # BINS rows at most
    return model


def score(described_: DataFrame, model: Model) -> DataFrame:
    """row and score (0 to 1) of every row."""
    shared = described_.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(matrix(batch, 1)))], names=["row", "score"])

    return described_.select("row", "x").mapInArrow(run, f"row {described_.schema['row'].dataType.simpleString()}, score double")
