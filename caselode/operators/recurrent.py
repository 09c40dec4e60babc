"""Recurrent layers over a patient's admissions: an ordered fold with vector states, and the fusion that predicts from them.

Rows go as a sorted stream, so that a key of any length needs its states only.  Within a batch all keys advance together,
one place of each at a time; the last key's states go on in the next batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselode.operators.attention import Linear, relu
from caselode.operators.vector_sums import lists, matrix
from caselode.sources.shipping import ship


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


@dataclass
class GatedUnit:
    """A gated recurrent unit: reset, update and new part, each from the input and from the state."""

    reset: tuple[Linear, Linear]
    update: tuple[Linear, Linear]
    new: tuple[Linear, Linear]

    @property
    def size(self) -> int:
        return self.reset[1].w.shape[0]

    def __call__(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        r = sigmoid(self.reset[0](x) + self.reset[1](h))
        z = sigmoid(self.update[0](x) + self.update[1](h))
        n = np.tanh(self.new[0](x) + r * self.new[1](h))
        return (1 - z) * n + z * h


@dataclass
class AdmissionModel:
    """Clinical and medicine sequences, their fusion, a joint sequence, and attention to it with a residual.

    Attention is to the one joint context of the same admission, so that its weight is 1 and what is left of it are the
    projections of values and output.
    """

    clinical: GatedUnit
    medicine: GatedUnit
    fusion: tuple[Linear, Linear]
    joint: GatedUnit
    value: Linear
    out: Linear
    predict: tuple[Linear, Linear]

    @property
    def sizes(self) -> tuple[int, int, int]:
        return self.clinical.size, self.medicine.size, self.joint.size

    def step(self, x: list[np.ndarray], states: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        clinical, medicine = self.clinical(x[0], states[0]), self.medicine(x[1], states[1])
        joint = self.joint(self.fusion[1](relu(self.fusion[0](np.hstack([clinical, medicine])))), states[2])
        seen = x[0] + self.out(self.value(joint))
        centred = seen - seen.mean(1, keepdims=True)
        normal = centred / np.sqrt((centred**2).mean(1, keepdims=True) + 1e-5)
        return [clinical, medicine, joint], self.predict[1](relu(self.predict[0](normal)))


def sequence_logits(rows: DataFrame, key: str, order: list[str], inputs: list[str], model) -> DataFrame:
    """``key``, ``order`` columns and ``logits`` of every row: the model's output after it has read the key's rows up to here.

    ``model`` has ``sizes`` of its states and a ``step`` from inputs and states to new states and output.  ``key`` is a whole
    number that isn't null; inputs of a kind have one length.
    """
    ship(rows.sparkSession)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            x = [matrix(batch.column(len(order) + 1 + i)) for i in range(len(inputs))]
            head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            lengths = np.diff(np.append(head, len(keys)))
            states = [np.zeros((len(head), n)) for n in model.sizes]
            if last is not None and keys[0] == last:
                for s, h in zip(states, held, strict=True):
                    s[0] = h
            out = None
            for place in range(int(lengths.max())):
                live = np.flatnonzero(lengths > place)
                at = head[live] + place
                new, made = model.step([v[at] for v in x], [s[live] for s in states])
                for s, n in zip(states, new, strict=True):
                    s[live] = n
                out = np.zeros((len(keys), made.shape[1])) if out is None else out
                out[at] = made
            last, held = keys[-1], [s[-1] for s in states]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(order) + 1], lists(out)], names=[key, *order, "logits"])

    vectors = [F.col(c).cast("array<double>").alias(c) for c in inputs]
    dealt = rows.select(key, *order, *vectors).repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in (key, *order)) + ", logits array<double>")
