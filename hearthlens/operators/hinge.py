"""Hinge-loss machines solved to a proven distance from the optimum, many settings in the same passes.

A machine minimises penalty / 2 |w|^2 + mean of max(0, 1 - y (w x + b)), the mean taken by weight. The corner of
the loss is rounded over a width mu, which costs at most mu / 2; Newton steps find the minimum of the rounded
loss, and mu shrinks. At any w the rounded loss tells each row's dual value by itself, min(1, max(0,
1 - y f) / mu), so the pass that adds up gradient and curvature also adds up a feasible point of the
dual problem. Its value is a lower bound: the gap between the best loss and the best bound says how far the
machine can be from the optimum at most.

Rows are packed in blocks that tasks add up as matrices, one for each machine, whose size does not depend on the
rows. The matrices of a machine meet in one task, which adds them up and finds the step; the driver sees a few
numbers per feature and machine.
"""

from __future__ import annotations

import math
import pickle
import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from hearthlens.session import ship

#: The widths: the first, the factor of each shrinking and the least.
FIRST_WIDTH, SHRINK, LEAST_WIDTH = 2.0, 0.25, 1e-12
#: The excess, as a share of the width, at which a point counts as the minimum of the rounded loss.
CENTRED = 0.05
#: Rounds at one width after which it shrinks in any case.
MOST_AT_WIDTH = 30
#: Step lengths that are tried at once: halves of halves, down from a double step, and none.
STEPS = np.append(2.0 ** -np.arange(-1, 26), 0.0)
#: Sums that meet in one task or go to the driver at once, and bytes of sums that a task holds.
GATHERED, SUM_BYTES = 64, 128 << 20
#: Bytes of the sums of all tasks up to which the driver adds them up itself.
SMALL_SUMS = 1 << 20
#: Rows that are mapped at once, rows that are measured at once, and rows whose losses at all step lengths are taken at once,
#: so that they stay in the cache of a core.
MAPPED, PIECE, SLICE = 128, 1024, 512
#: The series of sin(2 pi v) in odd powers of v; a quarter of a turn on either side it ends within 3e-16.
SINE = [(-1) ** k * (2 * math.pi) ** (2 * k + 1) / math.factorial(2 * k + 1) for k in range(10)]
#: The penalty that stands for an unlimited c.
LEAST_PENALTY = 1e-8
#: A loss this near to the bound is the best one, whatever its size.
NEAR_ENOUGH = 1e-6


@dataclass(frozen=True)
class FourierMap:
    """sqrt(2 / size) cos(x W + offset): a random map whose products approach a Gaussian kernel."""

    width: int
    gamma: float
    size: int
    seed: int

    def arrays(self) -> tuple[np.ndarray, np.ndarray, float]:
        draw = np.random.default_rng(self.seed)
        directions = draw.standard_normal((self.width, self.size)) * np.sqrt(2.0 * self.gamma)
        return directions, draw.uniform(0.0, 2.0 * np.pi, self.size), float(np.sqrt(2.0 / self.size))


@dataclass
class Machine:
    """A machine and what is proven of it: its loss and a lower bound of the best loss. The penalty is 1 / (c rows),
    the rows being the sum of the weights unless they are given."""

    c: float
    mapping: FourierMap | None
    coefficients: np.ndarray
    intercept: float = 0.0
    loss: float = np.inf
    bound: float = -np.inf
    rounds: int = 0
    rows: float | None = None
    point: np.ndarray = field(default=None, repr=False)
    width: float = FIRST_WIDTH
    damping: float = 1e-12
    at_width: int = 0

    @property
    def gap(self) -> float:
        return self.loss - self.bound


@dataclass
class Blocks:
    """Packed rows and the number of tasks that read them."""

    rows: DataFrame
    tasks: int

    @property
    def readers(self) -> int:
        """Tasks that send sums: no more than the cores, since each sends a whole set."""
        return max(1, min(self.tasks, self.rows.sparkSession.sparkContext.defaultParallelism))


def packed(df: DataFrame, x: Column, label: str = "label", weight: str | None = None) -> DataFrame:
    """Blocks of rows as raw matrices. ``x`` is an array of numbers; a row without it, without a label or with a
    weight that is missing or not above zero takes no part, a number that is not finite is an error."""
    weights = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(x.cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), weights.alias("s"))
    rows = rows.where("x is not null and y is not null and s > 0")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            y, s = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            if len(flat) % batch.num_rows or not np.isfinite(flat).all() or not np.isfinite(s).all():
                raise ValueError("rows need features of one length and finite numbers")
            signs = np.where(y > 0.5, 1.0, -1.0)
            yield pa.RecordBatch.from_arrays([pa.array([v.astype("<f8").tobytes()], pa.binary()) for v in (flat, signs, s)], ["x", "y", "s"])

    return rows.mapInArrow(pack, "x binary, y binary, s binary")


SUMS = "part int, task int, sums binary"


def _sums_row(part: int, task: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([task], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["part", "task", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    """The sum of each run of rows of one part, and the number of the first task in it."""
    run: tuple[int, int] | None = None
    total = np.zeros(0)
    for batch in batches:
        for part, task, sums in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if run is None or run[0] != part:
                if run is not None:
                    yield *run, total
                run, total = (part, task), np.frombuffer(sums).copy()
            else:
                total += np.frombuffer(sums)
    if run is not None:
        yield *run, total


def _task_sums(blocks: Blocks, measure: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], length: int, parts: int = 1) -> DataFrame:
    """The sums of a measure over the blocks of a task, one row for each of ``parts`` equal parts. Those of many tasks are added up
    in groups."""
    tasks = blocks.readers

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(length)
        for batch in batches:
            for x, y, s in zip(*(batch.column(i).to_pylist() for i in range(3))):
                y, s = np.frombuffer(y), np.frombuffer(s)
                total += measure(np.frombuffer(x).reshape(len(y), -1), y, s)
        for part, sums in enumerate(total.reshape(parts, -1)):
            yield _sums_row(part, TaskContext.get().partitionId(), sums)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, task, sums in _added(batches):
            yield _sums_row(part, task, sums)

    sums = blocks.rows.coalesce(tasks).mapInArrow(partial, SUMS)
    if tasks > GATHERED:
        groups = int(tasks ** 0.5) + 1
        sums = sums.repartition(groups, F.col("task") % groups).sortWithinPartitions("part", "task").mapInArrow(grouped, SUMS)
    return sums


def summed(blocks: Blocks, measure: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], length: int) -> np.ndarray:
    """The sum of a small measure over all blocks."""
    sums = _task_sums(blocks, measure, length)
    total = np.zeros(length)
    for row in sorted(sums.collect(), key=lambda row: row["task"]):
        total += np.frombuffer(row["sums"])
    return total


def _by_mapping(machines: Sequence[Machine]) -> list[tuple[tuple[np.ndarray, np.ndarray, float] | None, list[int]]]:
    groups: dict[FourierMap | None, list[int]] = {}
    for i, machine in enumerate(machines):
        groups.setdefault(machine.mapping, []).append(i)
    return [(mapping.arrays() if mapping else None, own) for mapping, own in groups.items()]


def _mapped(x: np.ndarray, arrays: tuple[np.ndarray, np.ndarray, float], out: np.ndarray) -> None:
    """Writes scale cos(x W + offset). The cosine of f turns is the sine of a quarter less |f| turns, whose series takes a
    fourth of the time of the library's cosine."""
    directions, offsets, scale = arrays[0] / (2 * np.pi), arrays[1] / (2 * np.pi), arrays[2]
    turns, series = np.empty((MAPPED, len(offsets))), np.empty((MAPPED, len(offsets)))
    for begin in range(0, len(x), MAPPED):
        part = x[begin:begin + MAPPED]
        v, sine = turns[:len(part)], series[:len(part)]
        np.matmul(part, directions, out=v)
        v += offsets
        v -= np.rint(v, out=sine)
        np.subtract(0.25, np.abs(v, out=v), out=v)
        square = v * v
        np.multiply(square, scale * SINE[-1], out=sine)
        for term in SINE[-2:0:-1]:
            sine += scale * term
            sine *= square
        sine += scale * SINE[0]
        np.multiply(sine, v, out=out[begin:begin + MAPPED])


def _rows(x: np.ndarray, arrays: tuple[np.ndarray, np.ndarray, float] | None, middle: np.ndarray) -> np.ndarray:
    """Mapped rows with a last column of ones. Plain rows are taken about the middle, which a free intercept makes up for."""
    rows = np.ones((len(x), (x.shape[1] if arrays is None else len(arrays[1])) + 1))
    if arrays is None:
        np.subtract(x, middle, out=rows[:, :-1])
    else:
        _mapped(x, arrays, rows[:, :-1])
    return rows


def _pieces(x: np.ndarray, arrays: tuple[np.ndarray, np.ndarray, float] | None, middle: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Stretches of the rows, mapped."""
    for begin in range(0, len(x), PIECE):
        part = slice(begin, begin + PIECE)
        yield part, _rows(x[part], arrays, middle)


def _sums_at(machines: Sequence[Machine], middle: np.ndarray) -> tuple[Callable, int]:
    """The measure that gives for each machine at its point: rounded loss, loss, the dual values of both classes and their
    weighted rows, the weighted rows on the rounded corner alone, and the upper triangle of the curvature."""
    groups = _by_mapping(machines)
    points = [m.point for m in machines]
    widths = [m.width for m in machines]
    n = len(points[0])
    upper = np.triu_indices(n)
    each = 4 + 2 * (n - 1) + n + len(upper[0])

    def measure(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
        out = np.zeros((len(points), each))
        bends: dict[int, np.ndarray] = {}
        near: dict[int, list[np.ndarray]] = {}

        def bend(i: int) -> None:
            close = np.concatenate(near.pop(i))
            bends[i] = close.T @ close + bends.get(i, 0.0)

        order = np.argsort(-y, kind="stable")  # one class after the other
        x, y, s = x[order], y[order], s[order]
        for arrays, own in groups:
            width = np.array([[widths[i]] for i in own])
            for part, rows in _pieces(x, arrays, middle):
                signs, weights = y[part], s[part]
                ups = int((signs > 0).sum())
                margins = 1.0 - signs * (np.stack([points[i] for i in own]) @ rows.T)
                duals = np.clip(margins / width, 0.0, 1.0)
                helds = weights * duals
                up_rows, down_rows = helds[:, :ups] @ rows[:ups], helds[:, ups:] @ rows[ups:]
                out[own, 0] += (duals * (margins - 0.5 * width * duals)) @ weights
                out[own, 1] += np.maximum(margins, 0.0) @ weights
                out[own, 2] += up_rows[:, -1]
                out[own, 3] += down_rows[:, -1]
                out[own, 4:n + 3] += up_rows[:, :-1]
                out[own, n + 3:2 * n + 2] += down_rows[:, :-1]
                band = (margins > 0) & (margins < width)
                for place, i in enumerate(own):
                    at = np.flatnonzero(band[place])
                    if len(at):
                        close = rows[at]
                        out[i, 2 * n + 2:3 * n + 2] += (helds[place, at] * signs[at]) @ close
                        close *= np.sqrt(weights[at])[:, None]
                        near.setdefault(i, []).append(close)
                        if sum(map(len, near[i])) >= PIECE:  # a matrix for many rows at a time
                            bend(i)
            for i in [*near]:
                bend(i)
            for i in [*bends]:
                out[i, 3 * n + 2:] = bends.pop(i)[upper] / widths[i]
        return out.ravel()

    return measure, len(points) * each


def _sums_along(machines: Sequence[Machine], directions: Sequence[np.ndarray], middle: np.ndarray) -> tuple[Callable, int]:
    """The measure that gives the rounded loss of each machine at all step lengths along its direction."""
    groups = _by_mapping(machines)
    points = [m.point for m in machines]
    widths = [m.width for m in machines]
    steps = STEPS

    def measure(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
        out = np.zeros((len(points), len(steps)))
        for arrays, own in groups:
            width = np.array([[widths[i]] for i in own])
            for part, rows in _pieces(x, arrays, middle):
                signs, weights = y[part], s[part]
                here = 1.0 - signs * (np.stack([points[i] for i in own]) @ rows.T)
                slopes = signs * (np.stack([directions[i] for i in own]) @ rows.T)
                there = here - steps[0] * slopes  # at the longest step: a margin in between lies between both
                least, most = np.minimum(here, there), np.maximum(here, there)
                straight = weights * (least >= width)  # above the corner the loss is a line, below it is none
                out[own] += (straight * (here - 0.5 * width)).sum(axis=1)[:, None] - (straight * slopes).sum(axis=1)[:, None] * steps
                bent = (most > 0) & (least < width)
                for place, i in enumerate(own):
                    at = np.flatnonzero(bent[place])
                    for begin in range(0, len(at), SLICE):
                        some = at[begin:begin + SLICE]
                        z = here[place, some, None] - slopes[place, some, None] * steps
                        dual = z * (1.0 / widths[i])
                        np.maximum(dual, 0.0, out=dual)
                        np.minimum(dual, 1.0, out=dual)
                        z -= (0.5 * widths[i]) * dual
                        z *= dual
                        out[i] += weights[some] @ z
        return out.ravel()

    return measure, len(points) * len(steps)


@dataclass
class _Here:
    """What the sums say of a point: the excess of the rounded loss over the bound it proves, gradient, the part of the
    gradient and of the curvature that the rounded corner makes."""

    excess: float
    loss: float
    gradient: np.ndarray
    corner: np.ndarray
    bend: np.ndarray
    penalty: float

    def narrowed(self, factor: float) -> _Here:
        """The parabola at a narrower width for the same rows on the corner: their dual values rise by the factor."""
        return _Here(self.excess, self.loss, self.gradient - (1 / factor - 1) * self.corner, self.corner / factor, self.bend / factor, self.penalty)


def _prove(machine: Machine, sums: np.ndarray, total: float, penalty: float) -> _Here:
    """Takes the loss and the bound that the sums prove."""
    n = len(machine.point)
    rounded, plain, up, down = sums[:4] / total
    ups, downs = sums[4:n + 3] / total, sums[n + 3:2 * n + 2] / total
    w = machine.point[:-1]
    norm = 0.5 * penalty * (w @ w)
    if norm + plain < machine.loss:
        machine.loss, machine.coefficients, machine.intercept = norm + plain, w.copy(), float(machine.point[-1])
    # the free intercept asks for dual values of equal sum on both sides: the heavier side is scaled down
    even = min(up, down)
    row = (ups * (even / up) if up else ups * 0) - (downs * (even / down) if down else downs * 0)
    # any fraction of a feasible point is feasible: the best one has a closed form
    square = float(row @ row) / penalty
    share = min(1.0, 2.0 * even / square) if square > 0 else 1.0
    bound = max(0.0, 2.0 * even * share - 0.5 * share * share * square)
    machine.bound = max(machine.bound, bound)
    gradient = np.concatenate([penalty * w - ups + downs, [down - up]])
    bend = np.zeros((n, n))
    bend[np.triu_indices(n)] = sums[3 * n + 2:] / total
    bend = np.triu(bend) + np.triu(bend, 1).T
    return _Here(norm + rounded - bound, norm + rounded, gradient, sums[2 * n + 2:3 * n + 2] / total, bend, penalty)


def _newton(here: _Here, damping: float) -> np.ndarray:
    """The step to the minimum of the local parabola, damped in proportion to each curvature."""
    curvature = here.bend.copy()
    inner = np.arange(len(curvature) - 1)
    curvature[inner, inner] += here.penalty
    # without rows on the corner nothing bends along the intercept: its slope then limits the step to one
    if curvature[-1, -1] <= 0:
        curvature[-1, -1] = max(abs(float(here.gradient[-1])), 1e-12)
    scale = np.sqrt(np.diag(curvature))
    scaled = curvature / np.outer(scale, scale)
    scaled[np.arange(len(scale)), np.arange(len(scale))] += damping
    values, vectors = np.linalg.eigh(scaled)
    inverse = np.where(values > 1e-15 * values[-1], 1.0 / np.maximum(values, 1e-300), 0.0)
    return vectors @ (inverse * (vectors.T @ (-here.gradient / scale))) / scale


def solve(blocks: Blocks, machines: list[Machine], tolerance: float = 1e-4, max_rounds: int = 200, near: float = NEAR_ENOUGH) -> list[Machine]:
    """Moves all machines to within ``tolerance`` of the best loss, as a share of it, or ``near``, in rounds of two
    passes that they share. A machine that is not there after ``max_rounds`` keeps its best point and its
    gap, and a warning says so."""
    if not machines:
        return []
    counted = summed(blocks, lambda x, y, s: np.array([s.sum(), float(len(y)), float(x.shape[1] * len(y))]), 3)
    total, rows = counted[0], counted[1]
    if not rows:
        raise ValueError("no rows to fit on")
    inputs = int(round(counted[2] / rows))
    middle = summed(blocks, lambda x, y, s: x.sum(axis=0), inputs) / rows
    for machine in machines:
        size = machine.mapping.size if machine.mapping else inputs
        machine.point = np.zeros(size + 1)
        machine.coefficients = np.zeros(size)
    together = max(1, int(SUM_BYTES // (8 * max(len(m.point) for m in machines) ** 2)))
    for begin in range(0, len(machines), together):
        _solve_together(blocks, machines[begin:begin + together], middle, total, tolerance, max_rounds, near)
    for machine in machines:
        if machine.mapping is None:
            machine.intercept -= float(machine.coefficients @ middle)
    return machines


def _step(machine: Machine, sums: np.ndarray, total: float, penalty: float, tolerance: float, near: float) -> tuple[np.ndarray, bool] | None:
    """Takes what the sums prove and finds the direction of the next step, and whether it is below the digits of the loss; None if
    the machine is there."""
    machine.rounds += 1
    machine.at_width += 1
    here = _prove(machine, sums, total, penalty)
    if machine.gap <= max(tolerance * machine.loss, near) or machine.width < LEAST_WIDTH:
        return None
    # the minimum of the rounded loss lies below the bound that it proves
    if machine.at_width > 1 and (here.excess <= CENTRED * machine.width or machine.at_width > MOST_AT_WIDTH):
        here = here.narrowed(SHRINK)
        machine.width, machine.at_width, machine.damping = machine.width * SHRINK, 0, 1e-12
    direction = _newton(here, machine.damping)
    return direction, abs(float(here.gradient @ direction)) <= 1e-13 * here.loss


#: What a step changes of a machine.
CHANGED = ("coefficients", "intercept", "loss", "bound", "rounds", "width", "damping", "at_width")


def _steps(blocks: Blocks, machines: list[Machine], middle: np.ndarray, total: float, penalties: list[float], tolerance: float, near: float) -> list[tuple[np.ndarray, bool] | None]:
    """One step of each machine: its sums meet in one task, which takes it, or in the driver while they are small."""
    measure, length = _sums_at(machines, middle)
    if 8 * length * blocks.readers <= SMALL_SUMS:
        sums = summed(blocks, measure, length).reshape(len(machines), -1)
        return [_step(machine, own, total, penalty, tolerance, near) for machine, own, penalty in zip(machines, sums, penalties)]
    sums = _task_sums(blocks, measure, length, len(machines))

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, own in _added(batches):
            machine = replace(machines[part])
            step = _step(machine, own, total, penalties[part], tolerance, near)
            found = pickle.dumps(({name: getattr(machine, name) for name in CHANGED}, step))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([found], pa.binary())], ["part", "step"])

    spread = min(len(machines), blocks.rows.sparkSession.sparkContext.defaultParallelism)
    steps = sums.repartition(spread, "part").sortWithinPartitions("part", "task").mapInArrow(taken, "part int, step binary")
    found: list[tuple[np.ndarray, bool] | None] = [None] * len(machines)
    for row in steps.collect():  # a few numbers per feature and machine
        changed, found[row["part"]] = pickle.loads(row["step"])
        for name, value in changed.items():
            setattr(machines[row["part"]], name, value)
    return found


def _solve_together(blocks: Blocks, machines: list[Machine], middle: np.ndarray, total: float, tolerance: float, max_rounds: int, near: float) -> None:
    penalties = {id(m): max(LEAST_PENALTY, 0.0 if np.isinf(m.c) else 1.0 / ((m.rows or total) * m.c)) for m in machines}
    active = list(machines)
    for _ in range(max_rounds):
        steps = _steps(blocks, active, middle, total, [penalties[id(m)] for m in active], tolerance, near)
        active = [machine for machine, step in zip(active, steps) if step]
        if not active:
            return
        directions, known = zip(*[step for step in steps if step])
        measure, length = _sums_along(active, directions, middle)
        along = summed(blocks, measure, length).reshape(len(active), -1) / total
        for machine, direction, tiny, values in zip(active, directions, known, along):
            points = machine.point + STEPS[:, None] * direction
            values = values + 0.5 * penalties[id(machine)] * (points[:, :-1] ** 2).sum(axis=1)
            best = int(np.argmin(values))
            if tiny:  # below the digits of the loss: the gradient alone is to be believed
                machine.point = machine.point + direction
            elif STEPS[best] > 0:
                machine.point = points[best]
                machine.damping = max(1e-12, machine.damping / 10) if STEPS[best] >= 0.5 else machine.damping
            else:
                machine.damping = min(1.0, machine.damping * 100)
    late = [m for m in active if m.gap > max(tolerance * m.loss, near)]
    if late:
        warnings.warn(f"{len(late)} machines stopped before the gap closed; the widest is {max(m.gap for m in late):.3g}", stacklevel=3)


def fit_machines(df: DataFrame, x: Column, c_values: Sequence[float], mappings: Sequence[FourierMap | None] = (None,), label: str = "label",
                 weight: str | None = None, tolerance: float = 1e-4, max_rounds: int = 200, rows: float | None = None, near: float = NEAR_ENOUGH) -> list[Machine]:
    """Machines for each mapping and each c, mapping by mapping, on rows that are packed once and read by all."""
    ship(df.sparkSession)
    blocks = packed(df, x, label, weight).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return solve(Blocks(blocks, blocks.rdd.getNumPartitions()), [Machine(float(c), mapping, np.zeros(0), rows=rows) for mapping in mappings for c in c_values], tolerance, max_rounds, near)
    finally:
        blocks.unpersist()


def accuracies(df: DataFrame, x: Column, machines: Sequence[Machine], label: str = "label") -> list[float]:
    """The share of rows that each machine puts on the side of their label, all from one pass."""
    ship(df.sparkSession)
    groups = _by_mapping(machines)
    lines = [np.concatenate([m.coefficients, [m.intercept]]) for m in machines]

    def measure(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
        out = np.zeros(len(lines) + 1)
        out[-1] = len(y)
        for arrays, own in groups:
            for part, rows in _pieces(x, arrays, np.zeros(x.shape[1])):
                scores = np.stack([lines[i] for i in own]) @ rows.T
                out[own] += ((scores > 0) == (y[part] > 0)).sum(axis=1)
        return out

    found = summed(Blocks(packed(df, x, label), df.sparkSession.sparkContext.defaultParallelism), measure, len(lines) + 1)
    return [float(v) for v in found[:-1] / found[-1]] if found[-1] else [float("nan")] * len(lines)
