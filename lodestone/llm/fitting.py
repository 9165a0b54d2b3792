"""Smooth loss minimisation where each pass over the training rows is a Spark job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partitions of a training sample: each gives back one loss and one gradient per pass.
SAMPLE_PARTITIONS = 6


def labelled_sample(labels: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows at most, those with the smallest hash of their key.

    The share that is kept follows from the number of rows; all tables take this path.
    """
    share = int(min(1.0, most / max(labels.count(), 1)) * (1 << 30))
    return labels.filter(F.pmod(F.xxhash64(key, F.lit("training sample")), F.lit(1 << 30)) < share)


def minimise(
    loss: Callable[[np.ndarray], tuple[float, np.ndarray]],
    start: np.ndarray,
    *,
    passes: int,
    memory: int = 8,
    tolerance: float = 1e-5,
) -> np.ndarray:
    """L-BFGS with step halving; at most ``passes`` evaluations of the loss."""
    weights, steps = start.astype(float), []
    value, gradient = loss(weights)
    used = 1
    while used < passes:
        direction = _direction(gradient, steps[-memory:])
        slope = float(direction @ gradient)
        if -slope < tolerance * max(1.0, abs(value)):
            break
        rate = 1.0 if steps else min(1.0, 1.0 / np.abs(gradient).sum())
        while used < passes:
            moved = weights + rate * direction
            new_value, new_gradient = loss(moved)
            used += 1
            if new_value <= value + 1e-4 * rate * slope:
                break
            rate *= 0.4
        else:
            break
        change, turn = moved - weights, new_gradient - gradient
        if change @ turn > 1e-10:
            steps.append((change, turn))
        weights, value, gradient = moved, new_value, new_gradient
    return weights


def _direction(gradient: np.ndarray, steps: list) -> np.ndarray:
    """Minus the gradient times the inverse curvature that the last steps imply."""
    direction, scales = -gradient.copy(), []
    for change, turn in reversed(steps):
        scale = (change @ direction) / (change @ turn)
        direction -= scale * turn
        scales.append(scale)
    if steps:
        change, turn = steps[-1]
        direction *= (change @ turn) / (turn @ turn)
    for (change, turn), scale in zip(steps, reversed(scales), strict=True):
        direction += change * (scale - (turn @ direction) / (change @ turn))
    return direction


def summed_loss(
    rows: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch], np.ndarray], tuple[float, np.ndarray]]
) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """A loss that adds up what ``kernel`` gives for each partition of ``rows``."""

    def loss(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            value, gradient = kernel(batches, weights)
            yield pa.RecordBatch.from_arrays(
                [pa.array([float(value)]), pa.array([gradient.astype("<f8").tobytes()], pa.binary())],
                names=["loss", "gradient"],
            )

        parts = rows.mapInArrow(one, "loss double, gradient binary").collect()
        value = sum((part["loss"] for part in parts), 0.0)
        gradient = sum((np.frombuffer(part["gradient"], "<f8") for part in parts), np.zeros(len(weights)))
        return value, gradient

    return loss
