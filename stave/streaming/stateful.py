"""Live rules with state of their own: import batches, remaining times, meters.

Each is a function for ``applyInPandasWithState`` with a watermark: rows behind it are late
and dropped by Spark, and the state of a key leaves once the watermark is ``ttl_ms`` past
its last row. Keys are dealt to slots by their hash, and a slot is one group: its keys' states
are one Arrow table, and all its rows of a micro-batch are handled side by side. A call of
Python costs as much as thousands of rows, so one for each key in each micro-batch would
grow faster than the input. The runner keeps state in RocksDB, so it is bounded by the
executors' disks, and a slot holds its share of the living keys. The rows of a micro-batch
are handled in the order of their moments; their number is bounded by the trigger's input limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming.state import GroupState

from stave.operators import telemetry as T

DAY_MS = 24 * 3600 * 1000
#: Slots that keys are dealt to, at most as many tasks; fixed for the life of a checkpoint.
SLOTS = 512
SLOT_STATE = "known binary"


def _known(state: GroupState, kind: pa.Schema) -> pd.DataFrame:
    """The states of a slot's keys."""
    if not state.exists:
        return kind.empty_table().to_pandas()
    return pa.ipc.open_stream(bytes(state.get[0])).read_all().to_pandas(use_threads=False)


def _keep(state: GroupState, kind: pa.Schema, known: pd.DataFrame, last: np.ndarray, ttl_ms: int) -> None:
    """Put a slot's states back until the first of its keys has had no row for ``ttl_ms``."""
    if not len(known):
        state.remove()
        return
    made = pa.RecordBatch.from_pandas(known, kind, preserve_index=False, nthreads=1)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, kind) as out:
        out.write_batch(made)
    state.update((sink.getvalue().to_pybytes(),))
    state.setTimeoutTimestamp(int(max(last.min() + ttl_ms, state.getCurrentWatermarkMs() + 1)))


SUMMARY = "batch_id string, settled boolean, completed bigint, failed bigint"


def summarize(order: list[str], ttl_ms: int) -> Callable:
    """Counts of a batch's jobs in their latest state, and whether all expected ones are settled, told at each change.

    A job's states may come out of order; the highest of the numbers ``order`` counts, the first of them first.
    """
    names = ["batch_id", "job_id", "state", *order]
    kind = pa.schema([*((n, pa.string()) for n in names[:3]), *((n, pa.int64()) for n in order), ("last", pa.int64())])

    def run(slot: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, mark = _known(state, kind), state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            left = known[known["last"] + ttl_ms >= mark]
            _keep(state, kind, left, left["last"].to_numpy(), ttl_ms)
            return
        frame = pd.concat(list(frames))
        # What is known stands behind the new rows, so it stays where they are equal.
        rows = pd.concat([frame[names], known[names]], ignore_index=True)
        batch, ids = pd.factorize(rows["batch_id"], use_na_sentinel=False)
        last = np.full(len(ids), np.iinfo(np.int64).min)
        np.maximum.at(last, batch, np.append(frame["ts_ms"], known["last"]).astype(np.int64))
        told = np.zeros(len(ids), bool)
        told[batch[: len(frame)]] = True

        line = np.lexsort([rows[n].to_numpy() for n in reversed(order)])
        arrived = line[line < len(frame)]
        expected = np.zeros(len(ids))
        expected[batch[arrived]] = frame["expected"].to_numpy(np.float64)[arrived]
        job = pd.factorize(rows["job_id"], use_na_sentinel=False)[0].astype(np.int64)
        latest = np.zeros(len(rows), bool)
        newest = pd.Series(batch.astype(np.int64) * (job.max() + 1) + job)[line]
        latest[newest.index[~newest.duplicated(keep="last")]] = True

        stood = rows["state"].to_numpy(object)
        jobs, completed, failed = (np.bincount(batch[x], minlength=len(ids)) for x in (latest, latest & (stood == "completed"), latest & (stood == "failed")))
        stays = latest & (told | (last + ttl_ms >= mark))[batch]
        _keep(state, kind, rows[stays].assign(last=last[batch[stays]]), last[batch[stays]], ttl_ms)
        settled = (jobs == expected) & (completed + failed == jobs)
        ids = np.where(pd.isna(ids), None, ids)
        yield pd.DataFrame({"batch_id": ids[told], "settled": settled[told], "completed": completed[told], "failed": failed[told]})

    return run


def _stepping(key: str, order: list[str], walk: Callable, kind: pa.Schema, blank: tuple, ttl_ms: int) -> Callable:
    """States walked over the rows of their keys in order; rows older than a key's last one handled give nothing."""
    names = [n for n in kind.names if n != key]

    def run(slot: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, mark = _known(state, kind), state.getCurrentWatermarkMs()
        living = known["seen"].to_numpy(np.int64) + ttl_ms >= mark
        if state.hasTimedOut:
            _keep(state, kind, known[living], known["seen"].to_numpy()[living], ttl_ms)
            return
        frame = pd.concat(list(frames), ignore_index=True)
        # A known key's code is its place among the known ones.
        codes, ids = pd.factorize(pd.concat([known[key], frame[key]], ignore_index=True), use_na_sentinel=False)
        codes = codes[len(known):]
        living[codes[codes < len(known)]] = True
        seen = np.full(len(ids), np.iinfo(np.int64).min)
        seen[: len(known)] = known["seen"]
        line = np.lexsort([*(frame[n].to_numpy() for n in reversed(order)), codes])
        line = line[frame["ts_ms"].to_numpy()[line] >= seen[codes[line]]]
        made = None
        if len(line):
            frame, codes = frame.iloc[line], codes[line]
            starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            mine, old = codes[starts], codes[starts] < len(known)
            before = pd.concat([known[names], pd.DataFrame([blank], columns=names)], ignore_index=True) if len(known) else pd.DataFrame([blank], columns=names)
            after, made = walk(before.iloc[np.where(old, mine, len(known))], ~old, frame, starts)
            living[mine[old]] = False
            after[key] = frame[key].to_numpy(object)[starts]
            known = pd.concat([known[living], after], ignore_index=True) if living.any() else after
        else:
            known = known[living]
        _keep(state, kind, known, known["seen"].to_numpy(), ttl_ms)
        if made is not None:
            yield made

    return run


def meter(response: str, hold: str, ttl_ms: int) -> Callable:
    kind = pa.schema([("track_id", pa.string()), ("level", pa.float64()), ("peak", pa.float64()), ("held", pa.int64()), ("seen", pa.int64())])
    return _stepping("track_id", ["ts_ms", "event_id"], T.meter_walk(response, T.HOLD_MS[hold]), kind, T.METER_BLANK, ttl_ms)


def eta(ttl_ms: int) -> Callable:
    kind = pa.schema([("job_id", pa.string()), ("stage", pa.string()), ("started", pa.int64()), ("first", pa.int64()), ("pace", pa.float64()), ("remaining", pa.float64()), ("seen", pa.int64())])
    return _stepping("job_id", ["ts_ms", "seq"], T.eta_walk, kind, T.ETA_BLANK, ttl_ms)
