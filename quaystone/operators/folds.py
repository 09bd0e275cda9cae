"""Logistic regressions of expanding folds: all folds and labels are fitted in common passes over the rows.

A task sums its rows' losses, gradients and second derivatives for every model; the driver adds the tasks' sums (a few KB each) and
takes Newton's step.  A pass reads every row once, whatever the number of models.

The loss is convex, so the fit does not depend on where it starts, only the number of passes does.  Large panels start from the fit of
one row in so many, which spares most of the passes; from there on steps are taken over all rows until they vanish.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Rows from whose fit the passes over all rows start, about.
START_ROWS = 2_000_000
#: Rows of one block of array steps.
BLOCK = 8192
#: A feature that varies less does not count, as it has no scale.
LEAST_SPREAD = 1e-9


def fold_cuts(panel: DataFrame) -> list[float]:
    """Last day number (since 1970) before each fold's tested days: 2 to 5 folds between approximate quantiles of the rows' days."""
    n = panel.count()
    folds = 2 if n < 120 else min(5, max(2, n // 300))
    return panel.select(day_number().cast("double").alias("d")).approxQuantile("d", [i / (folds + 1) for i in range(1, folds + 1)], 0.001)


def day_number():
    return F.datediff("date", F.lit("1970-01-01"))


def blocks(batches, features, labels):
    """(days, features, labels) of at most ``BLOCK`` rows each; a row of an array is a column, null counts as 0."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            whole = lambda x: x.fill_null(0.0) if x.null_count else x
            column = lambda c: whole(part.column(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            stack = lambda names: np.stack([column(c) for c in names]) if names else np.empty((0, part.num_rows))  # noqa: B023, E731
            yield column("_day"), stack(features), stack(labels)


def doubles(panel: DataFrame, *columns: str) -> DataFrame:
    return panel.select(day_number().cast("double").alias("_day"), *(F.col(c).cast("double").alias(c) for c in columns))


def over_rows(panel: DataFrame, columns: list[str], run, schema: str, stored: bool) -> DataFrame:
    """``run`` over Arrow batches of the panel's day and ``columns``.

    ``stored``: the panel is whole Parquet files, just as written; a task then reads its files' columns as arrays, one row group at a time, which spares
    each pass the way of every row through the JVM.  Spark deals the files out.
    """
    files = panel.inputFiles() if stored else []
    if not files:
        return doubles(panel, *columns).mapInArrow(run, schema)

    def read(batches):
        def rows():
            for batch in batches:
                for uri in batch.column(0).to_pylist():
                    system, path = pa.fs.FileSystem.from_uri(uri)
                    with system.open_input_file(path) as file:
                        parquet = pq.ParquetFile(file)
                        for group in range(parquet.num_row_groups):
                            table = parquet.read_row_group(group, columns=["date", *columns], use_threads=False)
                            day = table.column("date").cast(pa.int32()).cast(pa.float64())
                            yield from pa.table([day, *(table.column(c).cast(pa.float64()) for c in columns)], names=["_day", *columns]).to_batches(max_chunksize=BLOCK)

        yield from run(rows())

    one_each = panel.sparkSession.range(0, len(files), 1, len(files))
    return one_each.select(F.get(F.array(*(F.lit(f) for f in files)), F.col("id").cast("int")).alias("uri")).mapInArrow(read, schema)


def summed(panel: DataFrame, features, labels, size: int, of_block, stored: bool = False) -> np.ndarray:
    """``of_block`` (``size`` numbers) summed over all blocks: one row a task goes to the driver."""

    def run(batches):
        total = np.zeros(size)
        for block in blocks(batches, features, labels):
            total += of_block(*block)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = over_rows(panel, [*features, *labels], run, "sums binary", stored).collect()
    return sum((np.frombuffer(bytes(r.sums)) for r in parts), np.zeros(size))


class FoldModels:
    """Standardised, class-balanced logistic regressions (as ``models.probability_model``) of every label and fold.

    Fold k learns from the rows whose day is at most ``cuts[k] - gap_days`` and tests those after ``cuts[k]`` up to the next cut.  All
    models see the features on one scale; the penalty of each is stated on its own fold's scale.
    """

    def __init__(self, panel: DataFrame, features, labels, cuts, gap_days: int = 0, stored: bool = False):
        self.stored = stored
        self.labels, self.cuts, self.limits = list(labels), np.array(cuts), np.array(cuts) - gap_days
        n, positives, mean, spread, own = self._moments(panel, list(features))
        alive = np.flatnonzero(spread > LEAST_SPREAD)
        self.features, self.mean, self.scale = [features[j] for j in alive], mean[alive], spread[alive]
        self.models = [(i, k) for i in range(len(self.labels)) for k in range(len(cuts))]
        #: probability of a fold that has seen one class
        self.prior = {(i, k): float(positives[k, i] > 0) for i, k in self.models if positives[k, i] in (0, n[k])}
        self.weights = {(i, k): (n[k] / (2 * (n[k] - positives[k, i])), n[k] / (2 * positives[k, i])) for i, k in self.models if (i, k) not in self.prior}
        self.penalty = np.hstack([np.zeros((len(cuts), 1)), (own[:, alive] / self.scale) ** 2])
        self.free = np.hstack([np.ones((len(cuts), 1), bool), own[:, alive] > LEAST_SPREAD])
        zero = {key: np.zeros(len(self.features) + 1) for key in self.weights}
        every = int(n[-1] // START_ROWS)
        if every > 1 and zero:
            few = panel.where(F.rand(42) * every < 1).select("date", *self.features, *self.labels)
            zero = self._fitted(written(few, "fold-start"), zero, every)
        self.coefficients = self._fitted(panel, zero)

    def learned_from(self, day) -> np.ndarray:
        """The first fold that learns from a day; all later ones do, too."""
        return np.searchsorted(self.limits, day, side="left")

    def standard(self, x) -> np.ndarray:
        out = np.ones((len(x) + 1, x.shape[1]))
        np.divide(x - self.mean[:, None], self.scale[:, None], out=out[1:])
        return out

    def _moments(self, panel, features):
        """Rows and positives of each fold, common mean and deviation of what any fold learns from, each fold's deviation."""
        d, m, folds = len(features), len(self.labels), len(self.cuts)
        first = panel.select(*features).first()
        centre = np.array([float(first[c] or 0.0) for c in features]) if first else np.zeros(d)
        width, learned_from = 1 + m + 2 * d, self.learned_from

        def of_block(day, x, y):
            part, x = learned_from(day), x - centre[:, None]
            here = (part == np.arange(folds)[:, None]).astype(float)
            return np.hstack([here.sum(axis=1)[:, None], here @ (y > 0.5).astype(float).T, here @ x.T, here @ (x * x).T]).ravel()

        got = summed(panel, features, self.labels, folds * width, of_block, self.stored).reshape(folds, width).cumsum(axis=0)
        n, positives, total, squares = got[:, 0], got[:, 1 : 1 + m], got[:, 1 + m : 1 + m + d], got[:, 1 + m + d :]
        own = np.sqrt(np.maximum(squares - total**2 / np.maximum(n, 1)[:, None], 0) / np.maximum(n - 1, 1)[:, None])
        return n, positives, centre + total[-1] / max(n[-1], 1), own[-1], own

    def _sums(self, panel, coefficients: dict) -> dict:
        """Loss, gradient and second derivatives of each model at its coefficients, without the penalty."""
        todo, d = list(coefficients), len(self.features) + 1
        width = 1 + d + d * d
        learned_from, standard, weights, folds = self.learned_from, self.standard, self.weights, len(self.cuts)

        def of_block(day, x, y):
            out = np.zeros((len(todo), width))
            part = learned_from(day)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(folds), side="right")  # fold k learns from the first ends[k]
            order = order[: ends[-1]]
            z, y = standard(x[:, order]), y[:, order] > 0.5
            for row, (i, k) in zip(out, todo, strict=True):
                zk, yk = z[:, : ends[k]], y[i, : ends[k]]
                at = coefficients[i, k] @ zk
                small = np.exp(-np.abs(at))
                p = np.where(at >= 0, 1.0, small) / (1 + small)
                w = np.where(yk, weights[i, k][1], weights[i, k][0])
                row[0] = w @ (np.log1p(small) + np.maximum(at, 0) - yk * at)
                row[1 : 1 + d] = zk @ (w * (p - yk))
                row[1 + d :] = ((zk * (w * p * (1 - p))) @ zk.T).ravel()
            return out.ravel()

        got = summed(panel, self.features, self.labels, len(todo) * width, of_block, self.stored).reshape(len(todo), width)
        return {key: (row[0], row[1 : 1 + d], row[1 + d :].reshape(d, d)) for key, row in zip(todo, got, strict=True)}

    def _fitted(self, panel, start: dict, share: int = 1, passes: int = 50, least_step: float = 1e-3) -> dict:
        """Newton's steps for all models at once, halved where one raises the loss; a step below ``least_step`` is the last, as its successor is about its square.

        ``share``: ``panel`` holds one row in so many, so the penalty weighs as much less; a label that is hardly there keeps a finite constant.
        """
        at = dict(start)
        best, step, done = {}, {}, {}
        for _ in range(passes):
            if not at:
                break
            for key, (loss, gradient, second) in self._sums(panel, at).items():
                b, k = at[key], key[1]
                free, penalty = self.free[k], np.where(np.arange(len(b)) == 0, float(share > 1), self.penalty[k]) / share
                loss = loss + 0.5 * penalty @ b**2
                if key in best and not loss <= best[key][0] * (1 + 1e-12):
                    step[key] = step[key] / 2
                else:
                    best[key] = (loss, b)
                    step[key] = np.zeros(len(b))
                    step[key][free] = -np.linalg.solve((second + np.diag(penalty))[np.ix_(free, free)], (gradient + penalty * b)[free])
                at[key] = best[key][1] + step[key]
                if np.abs(step[key]).max() < least_step:
                    done[key] = at.pop(key)
        return done | at

    def tested(self, panel: DataFrame) -> DataFrame:
        """(label, fold, y, p) of every tested row and label: its fold's probability, to six digits."""
        folds, labels, prior = self.cuts, range(len(self.labels)), self.prior
        fitted, standard = self.coefficients, self.standard
        features, names = self.features, self.labels

        def run(batches):
            for day, x, y in blocks(batches, features, names):
                fold = np.searchsorted(folds, day, side="left") - 1
                at = np.flatnonzero(fold >= 0)
                fold, z, y = fold[at], standard(x[:, at]), y[:, at] > 0.5
                for i in labels:
                    p = np.empty(len(at))
                    for k in range(len(folds)):
                        here = fold == k
                        p[here] = prior[i, k] if (i, k) in prior else 1 / (1 + np.exp(-np.clip(fitted[i, k] @ z[:, here], -700, 700)))
                    number = lambda v: pa.array(v.astype(np.int32))
                    yield pa.record_batch([number(np.full(len(at), i)), number(fold), number(y[i]), pa.array(np.floor(p * 1e6 + 0.5) / 1e6)], names=["label", "fold", "y", "p"])

        return over_rows(panel, [*features, *names], run, "label int, fold int, y int, p double", self.stored)
