"""Risk models fitted by data-parallel gradient steps, many at once, led by a validation fold.

A step is one Spark job: every task sums the gradients of its rows with the weights it was sent, Spark adds the
sums place by place, and the driver moves the weights, whose number the models bound. Models that look at other
inputs or learn from other rows share the job: each row says which models it belongs to.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stayframe.functions.hashing import key_draw
from stayframe.operators.folds import TRAIN_FOLDS, VALIDATION_FOLDS
from stayframe.session import scratch_path

# Fixed value: epochs without gain after which training ends.
PATIENCE = 100
# Rows that a task turns into a dense matrix at once, for models with hidden layers.
_DENSE_ROWS = 512
# Places of a gradient table that hold counts and losses.
_TRAIN_ROWS, _TRAIN_LOSS, _HELD_ROWS, _HELD_LOSS = -1, -2, -3, -4


@dataclass(frozen=True)
class Model:
    """A model of the first ``width`` inputs: logistic, or with ``hidden`` layers of rectified units between."""

    name: str
    width: int
    hidden: tuple[int, ...] = ()

    @property
    def shapes(self) -> list[tuple[int, int]]:
        """Of each layer's matrix; its last row is the intercept."""
        sizes = [self.width, *self.hidden, 1]
        return [(a + 1, b) for a, b in zip(sizes, sizes[1:])]

    def layers(self, weights: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([a * b for a, b in self.shapes])
        return [w.reshape(s) for w, s in zip(np.split(weights, ends[:-1]), self.shapes)]

    def start(self, seed: int) -> np.ndarray:
        """Zeros for a logistic model, else small random weights."""
        if not self.hidden:
            return np.zeros(self.width + 1)
        rng = np.random.default_rng([seed, len(self.name), *self.name.encode()])
        made = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in self.shapes]
        for layer in made:
            layer[-1] = 0
        return np.concatenate([layer.reshape(-1) for layer in made])


@dataclass
class Rows:
    """Sparse rows of one batch: ``place`` and ``value`` of each entry, and the row that it belongs to, ascending."""

    label: np.ndarray
    place: np.ndarray
    value: np.ndarray
    row: np.ndarray
    # What models that see the same rows share: entries below a width, and the dense form of that width.
    _below: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict, repr=False)
    _dense: dict[int, np.ndarray] = field(default_factory=dict, repr=False)

    @classmethod
    def of(cls, label: pa.Array, places: pa.Array, values: pa.Array) -> Rows:
        counts = np.diff(places.offsets.to_numpy())
        return cls(
            label.to_numpy(zero_copy_only=False).astype(float), places.flatten().to_numpy(), values.flatten().to_numpy(),
            np.repeat(np.arange(len(label)), counts),
        )

    def some(self, rows: np.ndarray) -> Rows:
        if len(rows) == len(self.label):
            return self
        number = np.full(len(self.label), -1)
        number[rows] = np.arange(len(rows))
        mine = number[self.row] >= 0
        return Rows(self.label[rows], self.place[mine], self.value[mine], number[self.row[mine]])

    def span(self, first: int, last: int) -> Rows:
        """The rows from ``first`` up to ``last``."""
        if first == 0 and last >= len(self.label):
            return self
        a, b = np.searchsorted(self.row, [first, last])
        return Rows(self.label[first:last], self.place[a:b], self.value[a:b], self.row[a:b] - first)

    def below(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, value and row of the entries that a model of this width sees."""
        if width not in self._below:
            seen = self.place < width
            self._below[width] = (self.place, self.value, self.row) if seen.all() else (self.place[seen], self.value[seen], self.row[seen])
        return self._below[width]

    def dense(self, width: int) -> np.ndarray:
        """The rows as a matrix, with a last column of ones for the intercept; models of one width share it."""
        if width not in self._dense:
            place, value, row = self.below(width)
            spots = np.bincount(row * (width + 1) + place, weights=value, minlength=len(self.label) * (width + 1))
            out = spots.astype(float, copy=False).reshape(len(self.label), width + 1)
            out[:, width] = 1
            self._dense[width] = out
        return self._dense[width]


def _losses(margin: np.ndarray, label: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, margin) - label * margin


def _layered(layers: list[np.ndarray], inputs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """What goes into each layer, ones for the intercept last, and the margins that come out of the last layer."""
    inner = [inputs]
    for layer in layers[:-1]:
        out = np.empty((len(inputs), layer.shape[1] + 1))
        np.maximum(inner[-1] @ layer, 0, out=out[:, :-1])
        out[:, -1] = 1
        inner.append(out)
    return inner, (inner[-1] @ layers[-1])[:, 0]


def forward(model: Model, weights: np.ndarray, rows: Rows) -> np.ndarray:
    """The margin of each row: the log of the odds."""
    if not model.hidden:
        place, value, row = rows.below(model.width)
        sums = np.bincount(row, weights=value * weights[place], minlength=len(rows.label))
        return sums + weights[-1]
    return _layered(model.layers(weights), rows.dense(model.width))[1]


def gradient(model: Model, weights: np.ndarray, rows: Rows) -> tuple[np.ndarray, float]:
    """Sum of the rows' gradients of the log loss, and of their losses."""
    if not model.hidden:
        margin = forward(model, weights, rows)
        off = 1 / (1 + np.exp(-margin)) - rows.label
        place, value, row = rows.below(model.width)
        out = np.bincount(place, weights=value * off[row], minlength=model.width + 1).astype(float)
        out[-1] = off.sum()
        return out, float(_losses(margin, rows.label).sum())
    layers = model.layers(weights)
    inner, margin = _layered(layers, rows.dense(model.width))
    back, out = (1 / (1 + np.exp(-margin)) - rows.label)[:, None], np.empty(len(weights))
    for at, slope in reversed(list(enumerate(model.layers(out)))):
        slope[:] = inner[at].T @ back
        if at:  # Nothing asks for the slopes of the inputs.
            back = back @ layers[at][:-1].T
            back *= inner[at][:, :-1] > 0
    return out, float(_losses(margin, rows.label).sum())


def _parts(dense: bool, rows: Rows) -> Iterator[Rows]:
    """The rows, a bounded number at a time where they are made dense."""
    if not dense:
        yield rows
        return
    for a in range(0, len(rows.label), _DENSE_ROWS):
        yield rows.span(a, a + _DENSE_ROWS)


def _shared(rows: Rows, models: Sequence[tuple[int, Model, np.ndarray]]) -> Iterator[tuple[Rows, int, Model, np.ndarray]]:
    """The rows in parts, each with every model in turn, so that models share what is made of a part."""
    for dense in (False, True):
        some = [x for x in models if bool(x[1].hidden) == dense]
        for part in _parts(dense, rows) if some else ():
            for m, model, w in some:
                yield part, m, model, w


@dataclass
class Fitted:
    """Models with their best weights, and the loss of every epoch."""

    models: list[Model]
    weights: list[np.ndarray]
    history: list[tuple[str, int, float | None, float | None]] = field(default_factory=list)

    def losses(self, spark: SparkSession) -> DataFrame:
        """(run, epoch, train_loss, val_loss), a row for each model and epoch."""
        return spark.createDataFrame(self.history, "run string, epoch int, train_loss double, val_loss double")

    def table(self, spark: SparkSession) -> DataFrame:
        """(model, width, hidden, place, weight): every weight of every model."""
        made = [
            pa.table({
                "model": [m.name] * len(w), "width": [m.width] * len(w), "hidden": [list(m.hidden)] * len(w),
                "place": np.arange(len(w)), "weight": w,
            }, schema=pa.schema([("model", pa.string()), ("width", pa.int32()), ("hidden", pa.list_(pa.int32())), ("place", pa.int32()), ("weight", pa.float64())]))
            for m, w in zip(self.models, self.weights)
        ]
        return spark.createDataFrame(pa.concat_tables(made))

    def write(self, spark: SparkSession, path: str) -> None:
        self.table(spark).write.mode("overwrite").parquet(f"{path}/weights")
        self.losses(spark).write.mode("overwrite").parquet(f"{path}/losses")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Fitted:
        table = spark.read.parquet(f"{path}/weights").orderBy("model", "place").toArrow().to_pandas()
        models, weights = [], []
        for name, own in table.groupby("model", sort=False):
            models.append(Model(name, int(own["width"].iloc[0]), tuple(int(x) for x in own["hidden"].iloc[0])))
            weights.append(own["weight"].to_numpy())
        losses = spark.read.parquet(f"{path}/losses").orderBy("run", "epoch").collect()
        return cls(models, weights, [tuple(r) for r in losses])


def membership(rules: Sequence[Column]) -> Column:
    """The numbers of the models that a row belongs to, from one condition per model; null is no."""
    each = F.array(*[F.when(rule, F.lit(m)) for m, rule in enumerate(rules)])
    return F.filter(each, lambda m: m.isNotNull())


def prepared(inputs: DataFrame, batches: int = 1, key: str = "pat_key", seed: int = 1) -> DataFrame:
    """``label, places, values, models, batch`` written out by batch, so that a step reads its own rows only.

    ``inputs`` has ``fold, label, places, values`` and, unless all models learn from all rows, ``models``.
    Training rows are dealt to ``batches`` by a hash of their key; validation rows are batch -1, others are left out.
    """
    models = F.col("models") if "models" in inputs.columns else F.lit(None).cast("array<int>")
    fold = F.col("fold")
    dealt = F.when(fold.isin(VALIDATION_FOLDS), -1).when(fold.isin(TRAIN_FOLDS), F.pmod(key_draw(seed, key), F.lit(batches)))
    rows = inputs.select(F.col("label").cast("double").alias("label"), "places", "values", models.alias("models"), dealt.cast("int").alias("batch"))
    path = scratch_path(inputs.sparkSession, "steps")
    rows.where("batch is not null and label is not null").write.partitionBy("batch").parquet(path)
    return inputs.sparkSession.read.schema(rows.schema).parquet(path)


def step_sums(rows: DataFrame, models: Sequence[Model], weights: Sequence[np.ndarray | None]) -> DataFrame:
    """(model, place, total): gradients of the training rows summed, with counts and losses at places below 0.

    A model without weights takes no part. Each task sums its own rows first, so what is shuffled follows the
    number of tasks and weights, not of rows.
    """
    active = [(m, model, w) for m, (model, w) in enumerate(zip(models, weights)) if w is not None]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {m: np.zeros(len(w)) for m, _, w in active}
        extra = {m: {_TRAIN_ROWS: 0.0, _TRAIN_LOSS: 0.0, _HELD_ROWS: 0.0, _HELD_LOSS: 0.0} for m, _, _ in active}
        for batch in batches:
            rows = Rows.of(batch.column(0), batch.column(1), batch.column(2))
            held = batch.column(4).to_numpy() < 0
            member = batch.column(3)
            everyone = member.is_null().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(held)), np.diff(member.offsets.to_numpy()))
            numbers = member.flatten().to_numpy()
            shares: dict[bytes, tuple[np.ndarray, list]] = {}
            for m, model, w in active:
                mine = everyone.copy()
                mine[owner[numbers == m]] = True
                shares.setdefault(mine.tobytes(), (mine, []))[1].append((m, model, w))
            for mine, alike in shares.values():
                for part, m, model, w in _shared(rows.some(np.flatnonzero(mine & ~held)), alike):
                    found, loss = gradient(model, w, part)
                    sums[m] += found
                    extra[m][_TRAIN_ROWS] += len(part.label)
                    extra[m][_TRAIN_LOSS] += loss
                for part, m, model, w in _shared(rows.some(np.flatnonzero(mine & held)), alike):
                    extra[m][_HELD_ROWS] += len(part.label)
                    extra[m][_HELD_LOSS] += float(_losses(forward(model, w, part), part.label).sum())
        for m, model, w in active:
            touched = np.flatnonzero(sums[m])
            place = np.append(touched, list(extra[m]))
            total = np.append(sums[m][touched], list(extra[m].values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(place), m, np.int32)), pa.array(place.astype(np.int32)), pa.array(total)], ["model", "place", "total"]
            )

    each = rows.select("label", "places", "values", "models", "batch").mapInArrow(work, "model int, place int, total double")
    return each.groupBy("model", "place").agg(F.sum("total").alias("total"))


@dataclass
class _Course:
    """Where one model's training stands."""

    weights: np.ndarray
    best: np.ndarray
    best_epoch: int = 0
    best_loss: float = np.inf
    moments: tuple[np.ndarray, np.ndarray] | None = None
    steps: int = 0
    stopped: bool = False

    def move(self, slope: np.ndarray, rate: float, adam: bool) -> None:
        self.steps += 1
        if not adam:
            self.weights = self.weights - rate * slope
            return
        first, second = self.moments or (np.zeros(len(slope)), np.zeros(len(slope)))
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
        self.moments = first, second
        level = np.sqrt(second / (1 - 0.999**self.steps)) + 1e-8
        self.weights = self.weights - rate * (first / (1 - 0.9**self.steps)) / level


def fit(
    rows: DataFrame,
    models: Sequence[Model],
    *,
    epochs: int,
    batches: int = 1,
    rate: float = 0.01,
    adam: bool = True,
    patience: int = PATIENCE,
    l2: float = 0.0,
    seed: int = 1,
    warm: Fitted | None = None,
) -> Fitted:
    """Train the models on ``prepared`` rows; each keeps the weights of its epoch with the least validation loss.

    An epoch takes a step on every batch. A model stops ``patience`` epochs after its last gain on the
    validation fold, and the others go on without it. ``warm`` starts models of the same names from their
    weights. The loss after an epoch is measured within the first step of the next, so it costs no job of
    its own. Without validation rows the last weights are the best, and the loss is null.
    """
    known = {m.name: w for m, w in zip(warm.models, warm.weights)} if warm else {}
    starts = [np.array(known[m.name]) if m.name in known else m.start(seed) for m in models]
    courses = [_Course(w, w) for w in starts]
    trained: list[dict[int, list[float]]] = [{} for _ in models]
    history: list[tuple[str, int, float | None, float | None]] = []

    def sums(batch_list: list[int]) -> dict[int, tuple[np.ndarray, dict[int, float]]]:
        found = step_sums(rows.where(F.col("batch").isin(batch_list)), models, [None if c.stopped else c.weights for c in courses])
        table = found.toArrow()
        m, place, total = (table.column(c).to_numpy() for c in ("model", "place", "total"))
        out = {}
        for k, course in enumerate(courses):
            if not course.stopped:
                own, slope = m == k, np.zeros(len(course.weights))
                up = own & (place >= 0)
                slope[place[up]] = total[up]
                out[k] = slope, dict(zip(place[own & (place < 0)].tolist(), total[own & (place < 0)].tolist()))
        return out

    def judge(epoch: int, found: dict) -> None:
        """The validation loss after ``epoch`` epochs."""
        for k, (_, extra) in found.items():
            course = courses[k]
            held = extra.get(_HELD_ROWS, 0.0)
            loss = extra[_HELD_LOSS] / held if held else None
            if epoch:
                seen, total = trained[k].get(epoch, [0.0, 0.0])
                history.append((models[k].name, epoch, total / seen if seen else None, loss))
            if loss is None or loss < course.best_loss:
                course.best, course.best_epoch, course.best_loss = course.weights, epoch, np.inf if loss is None else loss
            elif epoch - course.best_epoch >= patience:
                course.stopped = True

    for epoch in range(1, epochs + 1):
        for b in range(batches):
            found = sums([b, -1] if b == 0 else [b])
            if b == 0:
                judge(epoch - 1, found)
            for k, (slope, extra) in found.items():
                n, course = extra.get(_TRAIN_ROWS, 0.0), courses[k]
                if course.stopped or not n:
                    continue
                seen = trained[k].setdefault(epoch, [0.0, 0.0])
                seen[0] += n
                seen[1] += extra[_TRAIN_LOSS]
                course.move(slope / n + l2 * course.weights, rate, adam)
        if all(c.stopped for c in courses):
            break
    else:
        judge(epochs, sums([-1]))
    return Fitted(list(models), [c.best for c in courses], sorted(history))


def score(fitted: Fitted, inputs: DataFrame, *kept: str) -> DataFrame:
    """(kept ..., model, score): the chance of every row of ``inputs`` under every model."""
    pairs = list(zip(fitted.models, fitted.weights))
    numbered = [(m, model, w) for m, (model, w) in enumerate(pairs)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Rows.of(pa.array(np.zeros(len(batch))), batch.column(0), batch.column(1))
            margins: list[list[np.ndarray]] = [[np.zeros(0)] for _ in pairs]
            for part, m, model, w in _shared(rows, numbered):
                margins[m].append(forward(model, w, part))
            chances = pa.array((1 / (1 + np.exp(-np.array([np.concatenate(own) for own in margins]).T))).reshape(-1))
            at = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(pairs))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.ListArray.from_arrays(at, chances)], ["kept", "scores"])

    packed = inputs.select("places", "values", F.struct(*kept).alias("kept"))
    kind = packed.select("kept", F.array(F.lit(0.0)).alias("scores")).schema
    names = F.array(*[F.lit(m.name) for m, _ in pairs])
    each = packed.mapInArrow(work, kind).select("kept.*", F.explode(F.arrays_zip(names.alias("model"), F.col("scores").alias("score"))).alias("s"))
    return each.select(*kept, F.col("s.model").alias("model"), F.col("s.score").alias("score"))
