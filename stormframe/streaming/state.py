"""Keyed state of streams: frame histories, delivery outcomes and failure streaks.

Each processor keeps a few rows per key, so a batch costs what it brings, whatever came before; only
deliveries share a state with the others of their bucket.  What was stored before a stream began enters once, as its initial state.  Stateful processors need the
RocksDB state store, which ``stateful`` asks for while it defines the stream.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stormframe.operators.catalog import recent_frames
from stormframe.operators.rules import FAILURE_STREAK, INITIAL_BACKOFF_SECONDS, MAX_ATTEMPTS

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(
    rows: DataFrame,
    key: Sequence[str],
    processor: StatefulProcessor,
    schema: str,
    mode: str,
    initial: DataFrame | None = None,
) -> DataFrame:
    """``rows`` through a processor per key; ``initial`` rows seed the state before the first batch."""
    rows.sparkSession.conf.set(STATE_STORE, ROCKSDB)
    seeds = initial.groupBy(*key) if initial is not None else None
    return rows.groupBy(*key).transformWithStateInPandas(processor, schema, mode, "None", seeds)


# --- frame histories ------------------------------------------------------------------------

_FRAME = ("file_key", "at", "n_rows", "n_cols")
_FRAME_STATE = "file_key string, at long, n_rows int, n_cols int"
_HISTORY = "product string, level string, file_key string, at long, n_rows int, n_cols int, history array<struct<file_key: string, n_rows: int, n_cols: int>>, exact boolean"


class FrameHistory(StatefulProcessor):
    """Names of a group's latest frames; each new frame comes out with the ``n - 1`` before it."""

    def __init__(self, n: int, kept: int) -> None:
        self.n, self.kept = max(n, 1), max(n, kept, 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.frames = handle.getListState("frames", _FRAME_STATE)
        self.lost = handle.getValueState("lost", "any boolean")

    def _keep(self, frames: list[tuple]) -> None:
        if len(frames) > self.kept:
            self.lost.update((True,))
        self.frames.put([(f[0], int(f[1]), int(f[2]), int(f[3])) for f in frames[-self.kept :]])

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:  # noqa: N802, N803
        stored = list(self.frames.get()) if self.frames.exists() else []
        rows = [*stored, *initialState[list(_FRAME)].itertuples(index=False, name=None)]
        self._keep(sorted(rows, key=lambda f: (f[1], f[0])))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(f) for f in self.frames.get()] if self.frames.exists() else []
        known, new = {f[0] for f in held}, []
        for part in rows:
            for f in part[list(_FRAME)].itertuples(index=False, name=None):
                if f[0] not in known:
                    known.add(f[0])
                    new.append(f)
        if not new:
            return
        fresh, lost = {f[0] for f in new}, self.lost.exists()
        frames = sorted([*held, *new], key=lambda f: (f[1], f[0]))
        out = []
        for i, f in enumerate(frames):
            if f[0] in fresh:
                past = [{"file_key": p[0], "n_rows": p[2], "n_cols": p[3]} for p in frames[max(0, i - self.n + 1) : i + 1]]
                # With fewer than n names at hand, forgotten ones may belong between.
                out.append((*key, *f, past, not lost or len(past) == self.n))
        self._keep(frames)
        yield pd.DataFrame(out, columns=["product", "level", *_FRAME, "history", "exact"])

    def close(self) -> None:
        pass


def frame_histories(grids: DataFrame, n: int, stored: DataFrame | None = None, kept: int | None = None) -> DataFrame:
    """A stream of grids with ``history``: itself and the ``n - 1`` frames of its product and level before it, oldest first.

    ``stored`` frames count as history from the first batch on; the table is read then, and not
    again, also not after a restart.  Frames sent again are silent.  ``kept`` names a group (four times
    ``n``) are remembered; a frame so late that names before it are forgotten is not ``exact``.
    """
    kept = kept or 4 * max(n, 1)
    named = ["product", "level", "file_key", F.unix_micros("valid_at").alias("at"), "n_rows", "n_cols"]
    seeds = recent_frames(stored, kept).select(*named) if stored is not None else None
    made = stateful(grids.select(*named), ["product", "level"], FrameHistory(n, kept), _HISTORY, "append", initial=seeds)
    return made.withColumn("valid_at", F.timestamp_micros("at")).drop("at")


# --- deliveries -------------------------------------------------------------------------------

_OUTCOME = "delivery_id string, subscription_id string, created_at long, attempt int, status string, response_status int"
_OUTCOME_COLUMNS = [c.split()[0] for c in _OUTCOME.split(", ")]
#: State of a bucket: its finished deliveries, and the open ones field by field.
_HELD = "done array<string>, ids array<string>, last array<int>, subscription array<string>, created array<long>, due array<long>"
#: Buckets that deliveries are dealt to.
DELIVERY_BUCKETS = 4096


def delivery_stream(
    attempts: DataFrame,
    max_attempts: int = MAX_ATTEMPTS,
    backoff_seconds: float = INITIAL_BACKOFF_SECONDS,
    buckets: int = DELIVERY_BUCKETS,
) -> DataFrame:
    """Attempts (delivery_id, subscription_id, created_at, attempt, response_status) as they are made, to outcomes.

    One ``ok`` or ``failed`` row a delivery, when its first final attempt is known; attempts that
    are reported again, come after that, or come after a later one change nothing.  After an attempt
    that may be repeated, a ``due`` row follows when its wait, doubled each time, is over; the next
    attempt's report cancels it.  Waits go by the clock of the stream and survive restarts.  A stream
    that waits never runs out of batches, so it needs a trigger that comes round, or
    ``jobs.run_available(..., waits=True)``, which ends with the input.

    A call and a state per delivery would cost far more than what is done in them, so deliveries are
    dealt to ``buckets`` by a hash of their id.  A batch rewrites the state of the buckets that it
    touches: a stream of small batches over very many deliveries wants more of them.
    """

    def status(response: int | None, attempt: int) -> str:
        if response is not None and 200 <= response <= 299:
            return "ok"
        if response is not None and 400 <= response <= 499 or attempt >= max_attempts:
            return "failed"
        return "retrying"

    def known(value: object) -> object:
        return None if pd.isna(value) else value

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, *fields = state.get if state.exists else ([],) * 6
        done, held = set(done), {i: rest for i, *rest in zip(*fields, strict=True)}
        now, out = state.getCurrentProcessingTimeMs(), []
        seen: dict[str | None, dict[int, tuple]] = {}
        if not state.hasTimedOut:
            for part in parts:
                for i, attempt, response, subscription, at in zip(*(part[c] for c in told), strict=True):
                    # The same attempt twice counts by its first report.
                    if (i := known(i)) not in done:
                        seen.setdefault(i, {}).setdefault(int(attempt), (response, subscription, at))
        for i, reports in seen.items():
            last = held[i][0] if i in held else 0
            for attempt in sorted(a for a in reports if a > last):
                response, subscription, at = map(known, reports[attempt])
                response, at = None if response is None else int(response), None if at is None else int(at)
                found = status(response, attempt)
                if found != "retrying":
                    held.pop(i, None)
                    done.add(i)
                    out.append((i, subscription, at, attempt, found, response))
                    break
                held[i] = [attempt, subscription, at, now + int(backoff_seconds * 2 ** (attempt - 1) * 1000)]
        for i, (last, subscription, at, due) in held.items():
            if due is not None and due <= now:
                held[i][3] = None
                out.append((i, subscription, at, last + 1, "due", None))
        state.update((list(done), list(held), *([h[k] for h in held.values()] for k in range(4))))
        # Each call clears the timer, so the bucket's first wait is set again for what is left of it.
        waits = [h[3] for h in held.values() if h[3] is not None]
        if waits:
            state.setTimeoutDuration(min(waits) - now)
        if out:
            yield pd.DataFrame(out, columns=_OUTCOME_COLUMNS, dtype=object)

    told = ["delivery_id", "attempt", "response_status", "subscription_id", "created_at"]
    slim = attempts.withColumn("created_at", F.unix_micros("created_at")).select(*told, F.pmod(F.xxhash64("delivery_id"), F.lit(buckets)).alias("bucket"))
    made = slim.groupBy("bucket").applyInPandasWithState(advance, _OUTCOME, _HELD, "append", GroupStateTimeout.ProcessingTimeTimeout)
    return made.withColumn("created_at", F.timestamp_micros("created_at"))


class FailureStreak(StatefulProcessor):
    """The latest ``n`` finished deliveries of a subscription."""

    def __init__(self, n: int) -> None:
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "at long, id string, failed boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ring = {(int(at), i, bool(failed)) for at, i, failed in self.ring.get()} if self.ring.exists() else set()
        for part in rows:
            found = ring.union((int(r.at), r.id, r.status == "failed") for r in part.itertuples(index=False))
            ring = set(heapq.nlargest(self.n, found))
        latest = sorted(ring)
        self.ring.put(latest)
        failing = len(latest) == self.n and all(f for *_, f in latest)
        yield pd.DataFrame([(key[0], failing, latest[-1][0] if failing else None)], columns=["subscription_id", "failing", "at"]).astype({"at": "Int64"})

    def close(self) -> None:
        pass


def streak_stream(finished: DataFrame, n: int = FAILURE_STREAK) -> DataFrame:
    """Finished deliveries (id, subscription_id, status, created_at) to the state of their subscriptions' breakers.

    One row per batch and subscription that it touches: ``failing``, whether the last ``n`` by time all
    failed, and then ``last_failed_at``.  ``n`` rows a subscription are kept, so order of arrival does
    not matter; a delivery reported again counts once.
    """
    if n < 1:
        raise ValueError("a streak needs at least one delivery")
    done = finished.where(F.col("status").isin("ok", "failed")).select("subscription_id", "id", "status", F.unix_micros("created_at").alias("at"))
    made = stateful(done, ["subscription_id"], FailureStreak(n), "subscription_id string, failing boolean, at long", "update")
    return made.select("subscription_id", "failing", F.timestamp_micros("at").alias("last_failed_at"))
