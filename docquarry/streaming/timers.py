"""Reservations and calls that end by themselves: stateful processing with event-time timers."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTCOME = "key string, request_id long, holder long, ts timestamp, outcome string, seconds double"
_STATE = "held string, pending string"


class _Holder:
    """Who holds a key, since when (microseconds), and what its rows gave."""

    def __init__(self, key: str, timeout: int, final: bool, opened: int | None, holder: int | None, ready: bool):
        self.key, self.timeout, self.final = key, timeout, final
        self.opened, self.holder, self.ready = opened, holder, ready
        self.out: list[tuple] = []

    def _tell(self, request: int | None, at: int, outcome: str) -> None:
        ends = outcome in ("done", "failed", "timed_out")
        self.out.append((self.key, request, self.holder, at, outcome, (at - self.opened) / 1e6 if ends else None))

    def passed(self, now: int, included: bool) -> None:
        """Time out what is due by ``now``."""
        if self.opened is not None:
            due = self.opened + self.timeout
            if due < now or (included and due == now):
                self._tell(None, due, "timed_out")
                self.opened = self.holder = None

    def row(self, at: int, request: int, kind: str, token: int | None) -> None:
        self.passed(at, True)
        if kind == "start":
            if self.ready:
                self._tell(request, at, "ready")
            elif self.opened is not None:
                self._tell(request, at, "busy")
            else:
                self.opened, self.holder = at, request
                self._tell(request, at, "reserved")
        elif self.opened is None or (token is not None and token != self.holder):
            self._tell(request, at, "refused")
        else:
            self._tell(request, at, kind)
            self.opened = self.holder = None
            self.ready = self.final and kind == "done"


def _packed(value: object) -> str:
    return base64.b64encode(zlib.compress(json.dumps(value, separators=(",", ":")).encode(), 1)).decode()


def _unpacked(text: str):
    return json.loads(zlib.decompress(base64.b64decode(text)))


def timed(requests: DataFrame, timeout_seconds: int, late: str = "0 seconds", final: bool = True, buckets: int = 1024) -> DataFrame:
    """What a stream of requests (key string, request_id long, ts, kind, token long) gives: rows of ``OUTCOME``.

    ``start`` asks for a key: reserved if it is free, busy while another request holds it, ready once it was done
    (``final``; else the key is free again). ``done`` and ``failed`` end what is held, if ``token`` is null or the
    holder's request_id; else they are refused. What is held for ``timeout_seconds`` ends as timed_out at that very
    time, whether a request comes or not; a request at the border finds the key free. ``seconds`` is how long it
    was held.

    Rows wait until the watermark (``late`` behind the newest ts) has passed them and are then taken in order of ts
    and request_id, so order within ``late`` does not matter; rows that come later than that are Spark's late rows.
    What the watermark has not passed is not told yet. Rows with a null key, request_id, ts or another kind give
    nothing. State is kept by bucket of keys, as a call for each key costs far more than its rows: the waiting rows of
    its keys (one batch's, and those of ``late``) and who holds them. A bucket is in one task, and each of its batches
    writes all of its state.
    """
    timeout = timeout_seconds * 1_000_000

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waiting = (_unpacked(x) for x in state.get) if state.exists else ({}, [])
        if not state.hasTimedOut:
            for b in batches:
                tokens = (None if pd.isna(t) else int(t) for t in b["token"])
                waiting += zip(b["key"].tolist(), b["at"].tolist(), b["request_id"].tolist(), b["kind"].tolist(), tokens, strict=True)
        passed = state.getCurrentWatermarkMs() * 1000
        ripe = sorted((r for r in waiting if r[1] < passed), key=lambda r: (r[0], r[1], r[2], r[3]))
        waiting = [r for r in waiting if r[1] >= passed]
        holders = {k: _Holder(k, timeout, final, *x) for k, x in held.items()}
        for key, *rest in ripe:
            if key not in holders:
                holders[key] = _Holder(key, timeout, final, None, None, False)
            holders[key].row(*rest)
        out = []
        for h in holders.values():
            h.passed(passed, False)
            out += h.out
        # A key that is free and not ready is as one never seen.
        held = {k: (h.opened, h.holder, h.ready) for k, h in holders.items() if h.opened is not None or h.ready}
        state.update((_packed(held), _packed(waiting)))
        due = min((r[1] for r in waiting), default=None)
        ends = min((h.opened + timeout for h in holders.values() if h.opened is not None), default=None)
        if dues := [x for x in (due, ends) if x is not None]:
            state.setTimeoutTimestamp(max(min(dues), passed + 1000) // 1000)
        told = pd.DataFrame(out, columns=["key", "request_id", "holder", "ts", "outcome", "seconds"])
        told["ts"] = pd.to_datetime(told["ts"].astype("int64"), unit="us")
        yield told.astype({"request_id": "Int64", "holder": "Int64", "seconds": "float64"})

    known = F.col("kind").isin("start", "done", "failed") & F.col("key").isNotNull() & F.col("request_id").isNotNull() & F.col("ts").isNotNull()
    rows = requests.where(known).withWatermark("ts", late).select("key", "ts", "request_id", "kind", "token", F.unix_micros("ts").alias("at"), F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
    return rows.groupBy("bucket").applyInPandasWithState(step, OUTCOME, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
