"""The request correlation as a stateful stream.

Events wait in the state of their key until the watermark has passed them, and are then applied in event order: so
a response that arrives a micro-batch before its request finds it. State beyond that is one open request per
connection. It is bounded by time: a request nothing closes is flushed, unanswered or half-read, once the
watermark passes its timeout (the batch plan and a count-limited agent would keep or evict it by count instead).
When a drained stream is known to have ended, ``end_of_requests`` applies what still waits and flushes what is open.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = (
    "conn string, seq bigint, ts_ns bigint, verb string, req_seq bigint, http_status int, content_length bigint, ttfb_ns bigint, "
    "download_ns bigint, total_ns bigint, partial boolean, delimitation string, flushed boolean"
)
_NEW = (0, False, 0, 0, "", 0, False, None, None, None, None, None, True, 0)


def _emit(conn: str, s: dict, done: int | None, flushed: bool) -> tuple:
    first = s["interim"] if s["interim"] is not None else s["head_ts"]
    ttfb = max(first - s["ts_ns"], 0) if first is not None else None
    return (
        conn, s["seq"], s["ts_ns"], s["verb"], s["req_seq"], s["status"], s["length"], ttfb or None,
        None if done is None else max(done - s["head_ts"], 0), None if done is None else max(done - s["ts_ns"], 0),
        not s["whole"], "ambiguous" if s["ambiguous"] else "clean", flushed,
    )


def _step(conn: str, s: dict, e, out: list) -> None:
    """Advance one connection by one event."""
    if e.kind in ("request", "link"):
        racing = False
        if s["open"]:
            racing = e.kind == "request" and s["head_ts"] is None
            s["ambiguous"] = s["ambiguous"] or racing
            out.append(_emit(conn, s, None, False))
        if e.kind == "link":
            s.update(open=False, next_seq=0)
            return
        s.update(
            open=True, seq=int(e.seq), ts_ns=int(e.ts_ns), verb=e.verb, req_seq=s["next_seq"], next_seq=s["next_seq"] + 1, ambiguous=racing,
            interim=None, head_ts=None, status=None, length=None, need=None, whole=True,
        )
        return
    if not s["open"]:
        return
    if s["head_ts"] is not None:
        s["need"] -= int(e.bytes)
    elif e.kind == "body" or e.http_status is None:
        return
    elif e.http_status < 200:
        s["interim"] = int(e.ts_ns) if s["interim"] is None else s["interim"]
        return
    else:
        length = None if e.content_length is None else int(e.content_length)
        s.update(head_ts=int(e.ts_ns), status=int(e.http_status), length=length, whole=bool(e.head_complete))
        if not length or s["verb"] == "HEAD" or s["status"] in (204, 304) or not s["whole"]:
            out.append(_emit(conn, s, None, False))
            s["open"] = False
            return
        s["need"] = length - max(int(e.bytes) - int(e.head_bytes), 0)
    if s["need"] <= 0:
        out.append(_emit(conn, s, int(e.ts_ns), False))
        s["open"] = False


def _due(waiting: list[tuple], watermark_ms: int) -> tuple[list[tuple], list[tuple]]:
    """The events that the watermark has passed, in event order, and those that still wait."""
    due = sorted((e for e in waiting if e[0] // 1_000_000 < watermark_ms), key=lambda e: (e[0], e[1]))
    return due, [e for e in waiting if e[0] // 1_000_000 >= watermark_ms]


class InEventOrder(StatefulProcessor):
    """Holds the events of a key until the watermark has passed them, then advances the key's state by them in event order.

    The state is typed: a list of waiting events, to which a micro-batch only appends, and one value for what is open.
    Event-time timers bound both. One wakes the key when its first waiting event is due, one when what is open has
    been silent for ``timeout_ms``; then the value is flushed or dropped. A key without either has no state at all.
    Each subclass says what it does with an event (``advance``) and with a state that has timed out (``expire``).
    """

    event: str
    value: str
    out: str

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.event)
        self.open = handle.getValueState("open", self.value)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [tuple(r[c] for c in _names(self.event)) for r in rows]
        self.waiting.appendList(new)
        self._wake(min(e[0] for e in new) // 1_000_000 + 1, timerValues)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        known = list(self.waiting.get()) if self.waiting.exists() else []
        due, rest = _due(known, now)
        out: list[tuple] = []
        state = self.open.get() if self.open.exists() else None
        if due:
            state = self.advance(key[0], state, due, out)
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        if rest:
            self._wake(min(e[0] for e in rest) // 1_000_000 + 1, timerValues)
        if state is not None and not rest and self.last_ms(state) + self.timeout_ms < now:
            self.expire(key[0], state, out)
            state = None
        if state is None:
            self.open.clear()
        else:
            self.open.update(state)
            if not rest:
                self._wake(self.last_ms(state) + self.timeout_ms + 1, timerValues)
        row = Row(*_names(self.out))
        return iter([row(*r) for r in out])

    def _wake(self, at_ms: int, timerValues) -> None:
        self.handle.registerTimer(max(at_ms, timerValues.getCurrentWatermarkInMs() + 1))

    def advance(self, key: str, state: tuple | None, events: list[tuple], out: list[tuple]) -> tuple | None:
        """The state after the events; None if nothing is worth keeping."""
        raise NotImplementedError

    def expire(self, key: str, state: tuple, out: list[tuple]) -> None:
        """What a state that has timed out leaves behind."""

    @staticmethod
    def last_ms(state: tuple) -> int:
        return state[-1]


def _names(ddl: str) -> list[str]:
    return [f.split(" ")[0] for f in ddl.split(", ")]


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def _table(out: list[tuple], ddl: str) -> pa.Table:
    """Rows as an Arrow table, so that large numbers beside nulls stay whole."""
    fields = [f.split(" ") for f in ddl.split(", ")]
    columns = list(zip(*out, strict=True)) if out else [[] for _ in fields]
    return pa.table({n: pa.array(list(c), _ARROW[kind]) for c, (n, kind) in zip(columns, fields, strict=True)})


def state_table(checkpoint: str, spark: SparkSession, name: str) -> DataFrame:
    """A state variable of a stopped stream as a table: the key, and the value or an element of the list a row."""
    rows = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    return rows.select("key.*", "list_element.*" if "list_element" in rows.columns else "value.*")


def _finish(checkpoint: str, spark: SparkSession, key: str, of: InEventOrder, ddl: str) -> DataFrame:
    """After the end of the stream: what the waiting events and the end itself make of the states it left."""
    names, events = _names(of.value), _names(of.event)
    open_ = state_table(checkpoint, spark, "open").select(key, F.struct(*names).alias("open"), F.lit(None).alias("event"))
    waits = state_table(checkpoint, spark, "waiting").select(key, F.lit(None).alias("open"), F.struct(*events).alias("event"))

    def last(rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        states = [tuple(x[n] for n in names) for x in rows["open"].to_pylist() if x]
        due = _due([tuple(x[n] for n in events) for x in rows["event"].to_pylist() if x], 1 << 62)[0]
        k = rows[key][0].as_py()
        state = of.advance(k, states[0] if states else None, due, out)
        if state is not None:
            of.expire(k, state, out)
        return _table(out, ddl)

    return open_.unionByName(waits).groupBy(key).applyInArrow(last, ddl)


def _timed(events: DataFrame, key: str, columns: list[str], late_by: str) -> DataFrame:
    return events.select(key, *columns, F.timestamp_micros(F.expr("ts_ns div 1000")).alias("at")).withWatermark("at", late_by)


class Requests(InEventOrder):
    """One open request per connection; see ``plans.correlate.correlate_requests`` for what closes it."""

    event = "ts_ns bigint, seq bigint, kind string, verb string, http_status int, content_length bigint, bytes bigint, head_bytes bigint, head_complete boolean"
    # next_seq and last_ms outlive a request; the others are its own
    value = (
        "next_seq bigint, open boolean, seq bigint, ts_ns bigint, verb string, req_seq bigint, ambiguous boolean, interim bigint, "
        "head_ts bigint, status bigint, length bigint, need bigint, whole boolean, last_ms bigint"
    )

    out = OUT

    def advance(self, key: str, state: tuple | None, events: list[tuple], out: list[tuple]) -> tuple | None:
        fields, columns = _names(self.value), _names(self.event)
        s = dict(zip(fields, state or _NEW, strict=True))
        for e in events:
            _step(key, s, SimpleNamespace(**dict(zip(columns, e, strict=True))), out)
            s["last_ms"] = e[0] // 1_000_000
        return tuple(s[n] for n in fields)

    def expire(self, key: str, state: tuple, out: list[tuple]) -> None:
        s = dict(zip(_names(self.value), state, strict=True))
        if s["open"]:
            out.append(_emit(key, s, None, True))


def correlate_stream(events: DataFrame, *, late_by: str = "10 seconds", timeout_ms: int = 600_000) -> DataFrame:
    """Streaming twin of ``plans.correlate.correlate_requests`` over the same columns."""
    timed = _timed(events, "conn", _names(Requests.event), late_by)
    return timed.groupBy("conn").transformWithState(Requests(timeout_ms), OUT, "append", "EventTime")


def end_of_requests(checkpoint: str, spark: SparkSession) -> DataFrame:
    """After the end of the stream: the requests that its remaining events close, and the open ones, flushed."""
    return _finish(checkpoint, spark, "conn", Requests(0), OUT)


CONN_OUT = "sock_cookie string, seq bigint, connect_ts bigint, close_ts bigint, lifetime_ns bigint, pid bigint, partial boolean"


class Connections(InEventOrder):
    """Connect opens the state of a socket, close emits it; a close without one is partial."""

    event = "ts_ns bigint, seq bigint, kind string, pid bigint"
    value = "connect_ts bigint, pid bigint, last_ms bigint"
    out = CONN_OUT

    def advance(self, key: str, state: tuple | None, events: list[tuple], out: list[tuple]) -> tuple | None:
        for ts, seq, kind, pid in events:
            if kind == "connect":
                state = (ts, pid, ts // 1_000_000)
            else:
                at, own, _ = state or (None, None, 0)
                out.append((key, seq, at, ts, None if at is None else max(ts - at, 0), own or 0, at is None))
                state = None
        return state


def connection_stream(events: DataFrame, *, late_by: str = "10 seconds", timeout_ms: int = 7 * 86_400_000) -> DataFrame:
    """Streaming twin of ``plans.correlate.connect_close``: one row for each close."""
    timed = _timed(events, "sock_cookie", _names(Connections.event), late_by)
    return timed.groupBy("sock_cookie").transformWithState(Connections(timeout_ms), CONN_OUT, "append", "EventTime")


def end_of_connections(checkpoint: str, spark: SparkSession) -> DataFrame:
    """After the end of the stream: the connections that its remaining events close."""
    return _finish(checkpoint, spark, "sock_cookie", Connections(0), CONN_OUT)
