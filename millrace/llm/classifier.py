"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Random features, the width of the Gaussian kernel in units of the root of the number of statistics, the ridge, the seed.
FEATURES, WIDTH, RIDGE, SEED = 192, 1.0, 1.0, 42
#: Bins of raw scores that the calibration sums; raw scores are fitted to labels 0 and 1.
BINS, LOW, HIGH = 2000, -1.0, 2.0
#: Folds that hold-outs are told by, and the training fold that only calibrates.
FOLDS, CALIBRATION = 5, 1
#: Rows to a partial sum of the normal equations, about.
ROWS_A_SUM = 20_000

_CLASSES = {
    "lower": range(ord("a"), ord("z") + 1),
    "upper": range(ord("A"), ord("Z") + 1),
    "digit": range(ord("0"), ord("9") + 1),
    "blank": (32, 9, 11, 12, 13),
    "line": (10,),
    "stop": tuple(map(ord, ".,;:?'\"-()")),
    "shout": (ord("!"),),
    "symbol": tuple(map(ord, "#*$%&|<>@^~=_+{}[]\\/")),
    "wide": range(128, 256),
}
_TABLE = np.zeros((256, len(_CLASSES)))
for _k, _codes in enumerate(_CLASSES.values()):
    _TABLE[list(_codes), _k] = 1
STATISTICS = len(_CLASSES) + 9


def statistics(text: str | None) -> np.ndarray:
    """Statistics of one whole text: shares of classes of bytes, and of its words and lines; zeros for null or empty."""
    out = np.zeros(STATISTICS)
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    k = len(_CLASSES)
    out[:k] = counts @ _TABLE / n
    shares = counts[counts > 0] / n
    found = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(len(found), 1)
    lengths = np.fromiter(map(len, found), np.float64, len(found))
    pairs = len(set(zip(found, found[1:], strict=False)))
    out[k:] = (
        np.log1p(len(found)),
        float(-(shares * np.log(shares)).sum()),
        lengths.mean() if len(found) else 0.0,
        lengths.std() if len(found) else 0.0,
        len(set(found)) / m,
        pairs / max(len(found) - 1, 1),
        1 - len(set(lines)) / max(len(lines), 1),
        np.log1p(len(found) / max(len(lines), 1)),
        sum(map(bytes.isupper, found)) / m,
    )
    return out


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, fold, f) for every row of ``docs`` (doc_id, text): crc32 of the id as text, mod ``FOLDS``; the statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                found = np.concatenate([statistics(t) for t in batch.column("text").to_pylist()])
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * STATISTICS)
                column = pa.ListArray.from_arrays(offsets, pa.array(found))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fold"), column], names=["doc_id", "fold", "f"])

    fold = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS).cast("int")
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("fold"), "text")
    return told.mapInArrow(run, "doc_id long, fold int, f array<double>")


@dataclass
class Model:
    """Scores of statistics; all of it of a fixed size, whatever the input."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    ridge: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, f: np.ndarray) -> np.ndarray:
        """Random Fourier features (whose inner products approximate a Gaussian kernel) and a constant."""
        z = np.clip((f - self.mean) / self.scale, -8, 8) @ self.weights + self.phases
        return np.concatenate([np.cos(z) * np.sqrt(2 / len(self.phases)), np.ones((len(f), 1))], axis=1)

    def raw(self, f: np.ndarray) -> np.ndarray:
        return self.features(f) @ self.ridge

    def scores(self, f: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(f), 0.5)
        # rounded, so that equal texts score alike in whatever batch they stand
        return np.round(np.clip(np.interp(self.raw(f), self.knots, self.values), 0.0, 1.0), 9)


def isotonic(x: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the rising step function nearest to the means ``sums / counts`` at ``x`` (rising), by pooling
    neighbours that fall; a knot is the mean place of its pool, so that scores between knots keep their order."""
    pools: list[list[float]] = []
    for place, total, n in zip(x, sums, counts, strict=True):
        if not n:
            continue
        pools.append([place * n, total, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p / n for p, _, n in pools]), np.array([t / n for _, t, n in pools])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(rows: DataFrame, make, width: int) -> np.ndarray:
    """The sum of ``make(f, y)``, a matrix of ``width`` columns, over the batches of ``rows`` (f, y).

    A partition gives one row of the matrix at a time, these are added up by row number on the executors, and the driver gets the
    one sum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(_matrix(batch.column("f")), batch.column("y").to_numpy(zero_copy_only=False).astype(float))
                total = part if total is None else total + part
        if total is not None:
            offsets = pa.array(np.arange(len(total) + 1, dtype=np.int32) * width)
            column = pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), column], names=["i", "v"])

    def add(table: pa.Table) -> pa.Table:
        whole = table.column("v").combine_chunks()
        return pa.table({"i": table.column("i").slice(0, 1), "v": pa.array([_matrix(whole).sum(axis=0)], pa.list_(pa.float64()))})

    parts = rows.mapInArrow(run, "i int, v array<double>")
    found = parts.groupBy("i").applyInArrow(add, "i int, v array<double>").collect()
    return np.array([row.v for row in sorted(found)]) if found else np.zeros((0, width))


def fit(rows: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """A model of ``rows`` (fold, f, y), all of them: y 0 or 1. Fold ``CALIBRATION`` only calibrates, unless there is no other or
    it is empty, when all rows do both. No rows give a model that scores 0.5."""
    n = rows.count()
    rng = np.random.default_rng(seed)
    weights = rng.normal(size=(STATISTICS, features)) / (width * np.sqrt(STATISTICS))
    phases = rng.uniform(0, 2 * np.pi, features)
    model = Model(np.zeros(STATISTICS), np.ones(STATISTICS), weights, phases, np.zeros(features + 1), np.empty(0), np.empty(0))
    if not n:
        return model
    rows = rows.repartition(-(-n // ROWS_A_SUM))  # by no key, as a third of the texts may be alike
    folds = {r.fold for r in rows.groupBy("fold").count().collect()}
    split = CALIBRATION in folds and len(folds) > 1
    train, other = (rows.where(F.col("fold") != CALIBRATION), rows.where(F.col("fold") == CALIBRATION)) if split else (rows, rows)
    told = train.agg(*(g(F.get("f", i)) for g in (F.avg, F.stddev_pop) for i in range(STATISTICS))).first()
    model.mean = np.array(told[:STATISTICS])
    spread = np.array(told[STATISTICS:])
    model.scale = np.where(spread > 1e-9, spread, 1.0)

    def normal(f: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(f)
        return np.concatenate([z.T @ z, (z.T @ y)[:, None]], axis=1)

    sums = summed(train.select("f", "y"), normal, features + 2)
    penalty = np.full(features + 1, ridge)
    penalty[-1] = 1e-6
    model.ridge = np.linalg.solve(sums[:, :-1] + np.diag(penalty), sums[:, -1])

    def bins(f: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip(((model.raw(f) - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
        return np.stack([np.bincount(at, minlength=BINS), np.bincount(at, y, minlength=BINS)])

    counts, good = summed(other.select("f", "y"), bins, BINS)
    places = LOW + (np.arange(BINS) + 0.5) * (HIGH - LOW) / BINS
    model.knots, model.values = isotonic(places, good, counts)
    return model


def score(found: DataFrame, model: Model) -> DataFrame:
    """(doc_id, fold, score) for each row of ``found`` (doc_id, fold, f)."""
    shared = found.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = pa.array(shared.value.scores(_matrix(batch.column("f"))))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fold"), out], names=["doc_id", "fold", "score"])

    return found.mapInArrow(run, "doc_id long, fold int, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, quality).

    Only texts are inputs of a score. Labels are learnt from rows whose crc32(doc_id as text) mod 5 is not 0, all of them;
    the others are held out. Texts are described once, whole, by a few numbers; labels meet these, not the texts. Normal
    equations and calibration bins are summed a partition and then by row number, so the driver gets sums of a fixed size.

    Null and empty texts have statistics of 0 and a score like others. Rows that repeat are scored and learnt from each; null ids are held
    out, null labels and labels of no document ignored; without labels every score is 0.5; no documents give no rows.
    """
    found = checkpoint(described(docs))
    marks = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("y"))
    rows = found.where("fold != 0").join(marks, F.col("doc_id") == F.col("_id")).select("fold", "f", "y")
    scored = score(found, fit(checkpoint(rows)))
    return scored.select("doc_id", (F.col("fold") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
