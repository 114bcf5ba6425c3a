"""Sequence models' inference on given emissions: Viterbi paths and forward-backward marginals, many sequences at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _total(x: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp.reduce(x, axis=axis)


def batch_marginals(emissions: np.ndarray, transitions: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Probability of each tag at each position of sequences of one length (n, length, tags), in log space."""
    length = emissions.shape[1]
    ahead, behind = np.empty_like(emissions), np.empty_like(emissions)
    ahead[:, 0], behind[:, -1] = start + emissions[:, 0], end
    for t in range(1, length):
        ahead[:, t] = emissions[:, t] + _total(ahead[:, t - 1, :, None] + transitions[None], 1)
        back = length - 1 - t
        behind[:, back] = _total(transitions[None] + (emissions[:, back + 1] + behind[:, back + 1])[:, None, :], 2)
    joint = ahead + behind
    return np.exp(joint - _total(joint, 2)[:, :, None])


def batch_viterbi(emissions: np.ndarray, transitions: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The best path (n, length) of each sequence."""
    n, length, _ = emissions.shape
    score, back = start + emissions[:, 0], []
    for t in range(1, length):
        paths = score[:, :, None] + transitions[None]
        back.append(paths.argmax(1))
        score = paths.max(1) + emissions[:, t]
    out = np.empty((n, length), np.int64)
    out[:, -1] = (score + end).argmax(1)
    for t in range(length - 2, -1, -1):
        out[:, t] = back[t][np.arange(n), out[:, t + 1]]
    return out


def marginals(emissions: np.ndarray, transitions: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return batch_marginals(emissions[None], transitions, start, end)[0]


def viterbi(emissions: np.ndarray, transitions: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[int]:
    return batch_viterbi(emissions[None], transitions, start, end)[0].tolist()


def decode(emissions: DataFrame, transitions: np.ndarray, start: np.ndarray, end: np.ndarray) -> DataFrame:
    """sequence_id, position, tag, probability of emissions (sequence_id, position, emission array<double>).

    Sequences of one length are decoded together; a sequence has to fit in memory, a task has many.
    """
    kinds = {f.name: f.dataType.simpleString() for f in emissions.schema}
    whole = emissions.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("position", "emission"))).alias("s"))
    whole = whole.select("sequence_id", F.transform("s", lambda x: x["position"]).alias("positions"), F.flatten(F.transform("s", lambda x: x["emission"])).alias("emissions"))

    def run(batches):
        for batch in batches:
            lengths = np.array([len(p) for p in batch.column(1)], np.int64)
            tags, odds = [None] * batch.num_rows, [None] * batch.num_rows
            for length in np.unique(lengths[lengths > 0]).tolist():
                rows = np.flatnonzero(lengths == length)
                e = batch.column(2).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), length, -1)
                path = batch_viterbi(e, transitions, start, end)
                p = np.take_along_axis(batch_marginals(e, transitions, start, end), path[:, :, None], 2)[:, :, 0]
                for r, a, b in zip(rows.tolist(), path, p, strict=True):
                    tags[r], odds[r] = a, b
            own = pa.array(np.repeat(np.arange(batch.num_rows), lengths))
            join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *(x for x in parts if x is not None)]).astype(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).flatten(), pa.array(join(tags, np.int32)), pa.array(join(odds, float))], ["sequence_id", "position", "tag", "probability"])

    return whole.mapInArrow(run, f"sequence_id {kinds['sequence_id']}, position {kinds['position']}, tag int, probability double")
