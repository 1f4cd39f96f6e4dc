"""Event-time stateful processors. Rows wait until the watermark has passed them, are sorted
by (time, id) and then run through the rules; so a stream gives what a batch over the same
rows gives. Rows later than the watermark are dropped by Spark."""

from __future__ import annotations

import heapq
import itertools
import json
from collections.abc import Iterator
from dataclasses import asdict
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framegate.operators.stages import SessionState
from framegate.presets import Band, StageRules


class Ordered(StatefulProcessor):
    """Holds the rows of a group of keys back and hands them in order to step() once the
    watermark has passed them. What is known of the keys and what waits is one value, read and
    written once a batch, so that neither a row nor a key costs calls to the store; where more
    than chunk_rows wait, they lie in chunks beside it, in order of time, of which only those
    that the watermark has reached are read. So the work on a row does not grow with what else
    waits, nor does memory."""

    columns: tuple[str, ...] = ()
    #: Rows that wait beside what is known of keys before they go into a chunk of their own.
    chunk_rows = 1000
    #: A key starts afresh with a row so long after its last one, and is forgotten when the
    #: watermark says so; None keeps keys for good.
    idle_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "j string")
        self.waiting = handle.getMapState("waiting", "chunk long", "rows string")

    def start(self) -> dict:
        return {}

    def step(self, memory: dict, key: tuple, row: dict) -> Iterator[tuple]:
        raise NotImplementedError

    def rank(self, row: list) -> tuple:
        """The order of waiting rows: time, id, values."""
        return row[0], row[1], json.dumps(row[2:])

    def names(self) -> list[str]:
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self._held()
        for batch in rows:
            held["rows"] += map(list, zip(*(_plain(batch[c]) for c in ("us", "id", *self.columns, "key")), strict=True))
            self._cut(held)
        self._keep(held)
        yield from ()  # rows that come are never below the watermark, so timers tell them

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held = self._held()
        if held["timer"] is not None and held["timer"] < watermark:
            held["timer"] = None
            for ready in self._ready(held, watermark):
                out = self._told(held["known"], ready)
                if out:
                    yield pd.DataFrame(out, columns=self.names())
            self._cut(held)
        if self.idle_ms is not None:
            over = {k: known["last_ms"] + self.idle_ms for k, known in held["known"].items()}
            held["known"] = {k: known for k, known in held["known"].items() if over[k] >= watermark}  # what waits or comes is later
            if held["known"]:
                self.handle.registerTimer(min(over[k] for k in held["known"]))
        self._keep(held)

    def _held(self) -> dict:
        """known: what step() remembers by key; rows: what waits outside chunks; chunks: the
        first millisecond and number of each; timer: when the first row that waits can be told."""
        stored = self.memory.get()
        held = json.loads(stored[0]) if stored else {"known": [], "rows": [], "chunks": [], "next": 0, "timer": None}
        return held | {"known": dict(held["known"])}

    def _keep(self, held: dict) -> None:
        first = min([r[0] // 1000 for r in held["rows"]] + [ms for ms, _ in held["chunks"]], default=None)
        if first is not None and (held["timer"] is None or first < held["timer"]):
            held["timer"] = first
            self.handle.registerTimer(first)  # it fires when the watermark is beyond it
        if first is None and not held["known"]:
            self.memory.clear()
        else:
            self.memory.update((json.dumps(held | {"known": list(held["known"].items())}),))

    def _cut(self, held: dict) -> None:
        n = self.chunk_rows
        if len(held["rows"]) <= n:
            return
        rows = sorted(held["rows"], key=self._rank)
        whole = len(rows) // n * n
        for k in range(0, whole, n):
            self.waiting.updateValue((held["next"],), (json.dumps(rows[k : k + n]),))
            held["chunks"].append((rows[k][0] // 1000, held["next"]))
            held["next"] += 1
        held["rows"] = rows[whole:]

    def _ready(self, held: dict, watermark: int) -> Iterator[list]:
        """The rows below the watermark in order, some at a time: those before the next chunk
        are told before it is read. The others stay."""
        due = sorted(c for c in held["chunks"] if c[0] < watermark)
        held["chunks"] = [c for c in held["chunks"] if c[0] >= watermark]
        n = itertools.count()
        heap = sorted((self._rank(r), next(n), r) for r in held["rows"])
        for first, chunk in [*due, (watermark, None)]:
            ready = []
            while heap and heap[0][2][0] // 1000 < first:
                ready.append(heapq.heappop(heap)[2])
            if ready:
                yield ready
            if chunk is not None:
                for row in json.loads(self.waiting.getValue((chunk,))[0]):
                    heapq.heappush(heap, (self._rank(row), next(n), row))
                self.waiting.removeKey((chunk,))
        held["rows"] = [row for _, _, row in heap]

    def _rank(self, row: list) -> tuple:
        return self.rank(row[:-1])

    def _told(self, every: dict, rows: list) -> list[tuple]:
        out: list[tuple] = []
        for us, id_, *values, key in rows:
            ms, known = us // 1000, every.get(key)
            if known is None or (self.idle_ms is not None and ms - known["last_ms"] > self.idle_ms):
                known = every[key] = {"memory": self.start()}
            known["last_ms"] = ms
            out += self.step(known["memory"], (key,), {"us": us, "id": id_, **dict(zip(self.columns, values, strict=True))})
        return out

    def close(self) -> None:
        pass


def _plain(column: pd.Series) -> list:
    """Python values, None for what is missing."""
    return [None if v is None or v != v else v for v in column.tolist()]


class Hysteresis(Ordered):
    columns = ("value",)

    def __init__(self, band: Band):
        self.band = band

    def start(self) -> dict:
        return {"on": False}

    def names(self) -> list[str]:
        return ["key", "id", "state"]

    def step(self, memory: dict, key: tuple, row: dict) -> Iterator[tuple]:
        v, m = row["value"], self.band.margin if memory["on"] else 0.0
        if v is not None and v == v:
            memory["on"] = self.band.low - m <= v <= self.band.high + m
        yield key[0], row["id"], "pass" if memory["on"] else "fail"


class Stages(Ordered):
    columns = ("iris_diameter", "is_raised", "centering_ratio", "sharpness", "brightness", "return_to")

    def __init__(self, rules: StageRules):
        self.rules = rules

    def start(self) -> dict:
        return asdict(SessionState())

    def names(self) -> list[str]:
        return ["key", "id", "stage"]

    def step(self, memory: dict, key: tuple, row: dict) -> Iterator[tuple]:
        state = SessionState(**memory)
        if row["return_to"]:
            state.back_to(row["return_to"])
        told = state.step(row, self.rules)
        memory.update(asdict(state))
        yield key[0], row["id"], told


class Countdown(Ordered):
    """An attempt ends in order with the rows: captured is told with the first row that comes
    no earlier than its due time."""

    columns = ("good",)

    def __init__(self, frames: int, wait_us: int):
        self.frames, self.wait_us = frames, wait_us

    def start(self) -> dict:
        return {"run": 0, "due": None, "done": False}

    def names(self) -> list[str]:
        return ["key", "started_us", "outcome", "ended_us"]

    def step(self, memory: dict, key: tuple, row: dict) -> Iterator[tuple]:
        if memory["done"]:
            return
        if memory["due"] is not None and row["us"] >= memory["due"]:
            memory["done"] = True
            yield key[0], memory["due"] - self.wait_us, "captured", memory["due"]
            return
        if row["good"]:
            memory["run"] += 1
            if memory["run"] == self.frames:
                memory["due"] = row["us"] + self.wait_us
        else:
            if memory["due"] is not None:
                yield key[0], memory["due"] - self.wait_us, "aborted", row["us"]
            memory.update(run=0, due=None)


class BurstCountdown(Ordered):
    """countdown_bursts row by row: a capture is told with the first row after its burst, and
    that row may start the next attempt."""

    columns = ("good", "sharpness")

    def __init__(self, frames: int, wait_us: int, burst_us: int, least: float):
        self.frames, self.wait_us, self.burst_us, self.least = frames, wait_us, burst_us, least

    def start(self) -> dict:
        return {"run": 0, "due": None, "best": None, "done": False}

    def names(self) -> list[str]:
        return ["key", "started_us", "outcome", "ended_us", "best_sharpness"]

    def step(self, memory: dict, key: tuple, row: dict) -> Iterator[tuple]:
        if memory["done"]:
            return
        due, best, us = memory["due"], memory["best"], row["us"]
        if due is not None and us >= due + self.burst_us:
            memory.update(due=None, best=None, done=best is not None and best >= self.least)
            if memory["done"]:
                yield key[0], due - self.wait_us, "captured", due, best
                return
            yield key[0], due - self.wait_us, "rejected", due + self.burst_us, best
            due = None
        elif due is not None and us >= due and row["sharpness"] is not None and row["sharpness"] == row["sharpness"]:
            memory["best"] = row["sharpness"] if best is None else max(best, row["sharpness"])
        if row["good"]:
            memory["run"] += 1
            if due is None and memory["run"] >= self.frames:
                memory["due"] = us + self.wait_us
        else:
            memory["run"] = 0
            if due is not None and us < due:
                memory["due"] = None
                yield key[0], due - self.wait_us, "aborted", us, None


class GapSampler(Ordered):
    """min_gap_sample row by row. A key whose last row is gap_us old begins anew anyway."""

    def __init__(self, gap_us: int):
        self.gap_us = gap_us
        self.idle_ms = -(-gap_us // 1000)

    def start(self) -> dict:
        return {"at": None}

    def names(self) -> list[str]:
        return ["key", "us", "id"]

    def step(self, memory: dict, key: tuple, row: dict) -> Iterator[tuple]:
        if memory["at"] is None or row["us"] - memory["at"] >= self.gap_us:
            memory["at"] = row["us"]
            yield key[0], row["us"], row["id"]


class Throttle(Ordered):
    """throttle_repeats row by row. After same_us without a row nothing of a key matters."""

    columns = ("text",)

    def __init__(self, any_us: int, same_us: int):
        self.any_us, self.same_us = any_us, same_us
        self.idle_ms = -(-max(any_us, same_us) // 1000)

    def start(self) -> dict:
        return {"at": None, "text": None}

    def names(self) -> list[str]:
        return ["key", "us", "id", "text"]

    def step(self, memory: dict, key: tuple, row: dict) -> Iterator[tuple]:
        since = None if memory["at"] is None else row["us"] - memory["at"]
        if since is None or since >= self.any_us and (row["text"] != memory["text"] or since >= self.same_us):
            memory.update(at=row["us"], text=row["text"])
            yield key[0], row["us"], row["id"], row["text"]


class LatestReading(Ordered):
    """An as-of join of two streams in one: side 0 holds readings, side 1 frames. Each frame
    gets the latest known reading; readings at the same time come before it."""

    columns = ("side", "value")

    def start(self) -> dict:
        return {"value": None}

    def rank(self, row: list) -> tuple:
        us, id_, side, value = row
        return us, side, id_, json.dumps(value)

    def names(self) -> list[str]:
        return ["key", "id", "reading"]

    def step(self, memory: dict, key: tuple, row: dict) -> Iterator[tuple]:
        if row["side"]:
            yield key[0], row["id"], memory["value"]
        elif row["value"] is not None and row["value"] == row["value"]:
            memory["value"] = row["value"]


class RunningTotals(Ordered):
    """Counts and sums of windows added up since the last reset; a reset window begins anew."""

    columns = ("n", "total", "reset")

    def start(self) -> dict:
        return {"n": 0, "total": None}

    def names(self) -> list[str]:
        return ["key", "window_us", "n", "n_so_far", "total_so_far"]

    def step(self, memory: dict, key: tuple, row: dict) -> Iterator[tuple]:
        if row["reset"]:
            memory.update(self.start())
        memory["n"] += row["n"]
        if row["total"] is not None:
            memory["total"] = row["total"] + (memory["total"] or 0.0)
        yield key[0], row["us"], row["n"], memory["n"], memory["total"]


class RateLimit(Ordered):
    """key: route and client as one string."""

    def __init__(self, n: int, window_us: int):
        self.n, self.window_us = n, window_us
        self.idle_ms = window_us // 1000  # a later row lies in another window

    def start(self) -> dict:
        return {"window": None, "count": 0}

    def names(self) -> list[str]:
        return ["key", "id", "admitted"]

    def step(self, memory: dict, key: tuple, row: dict) -> Iterator[tuple]:
        window = row["us"] // self.window_us
        if window != memory["window"]:
            memory.update(window=window, count=0)
        memory["count"] += 1
        yield key[0], row["id"], memory["count"] <= self.n


SCHEMAS = {
    Hysteresis: "key {k}, id long, state string",
    Stages: "key {k}, id long, stage string",
    Countdown: "key {k}, started_us long, outcome string, ended_us long",
    RateLimit: "key {k}, id long, admitted boolean",
    BurstCountdown: "key {k}, started_us long, outcome string, ended_us long, best_sharpness double",
    GapSampler: "key {k}, us long, id long",
    Throttle: "key {k}, us long, id long, text string",
    LatestReading: "key {k}, id long, reading double",
    RunningTotals: "key {k}, window_us long, n long, n_so_far long, total_so_far double",
}


def run_ordered(df: DataFrame, processor: Ordered, key_type: str = "long", idle_ms: int | None = None, groups: int | None = None) -> DataFrame:
    """df: key, us, id, the processor's columns, and a watermarked event time. idle_ms: see
    Ordered; without it the processor's own. groups: keys share so many states, by hash; each
    state is read and written whole, so a few thousand serve streams of many keys whose batches
    bring rows of most of them. None gives each key a state of its own, for batches that touch
    few of very many keys. Rows and rules are the same either way."""
    if idle_ms is not None:
        processor.idle_ms = idle_ms
    df = df.withColumn("key", F.col("key").cast("string"))  # pandas holds no null among whole numbers
    group = F.col("key") if groups is None else F.pmod(F.xxhash64("key"), F.lit(groups))
    out = df.withColumn("_group", group).groupBy("_group").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=SCHEMAS[type(processor)].format(k="string"), outputMode="append", timeMode="EventTime"
    )
    return out.withColumn("key", F.col("key").cast(key_type))


class LiveQuota(StatefulProcessor):
    """admitted: among the first n of its key in a window that begins with the first request,
    by the clock. The count is a state of the window's length to live: Spark drops it, so an
    idle key leaves nothing and no timer is set."""

    def __init__(self, n: int, window_ms: int):
        self.n, self.window_ms = n, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Time to live runs from the last write, so the window's start is kept beside the count.
        self.seen = handle.getValueState("seen", "since long, n long", self.window_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        since, n = self.seen.get() if self.seen.exists() else (now, 0)
        if now - since >= self.window_ms:
            since, n = now, 0
        for batch in rows:
            ids = sorted(batch["id"].tolist())
            yield pd.DataFrame({"key": key[0], "id": ids, "admitted": [n + k < self.n for k in range(len(ids))]})
            n += len(ids)
        self.seen.update((since, n))

    def close(self) -> None:
        pass


def live_quota(df: DataFrame, n: int, window_ms: int, key_type: str = "string") -> DataFrame:
    """df: key and id. Requests in the order of a batch's ids; what comes later in the same
    window than the n-th is not admitted."""
    return df.groupBy("key").transformWithStateInPandas(
        statefulProcessor=LiveQuota(n, window_ms), outputStructType=f"key {key_type}, id long, admitted boolean", outputMode="append", timeMode="ProcessingTime"
    )
