"""Streams that keep state by key: sessions that report late turns, and guided question rounds."""

from __future__ import annotations

import contextlib
import datetime as dt
import itertools
import json
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that are started within keep their state in RocksDB, which state by key with timers needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class SessionKeeper(StatefulProcessor):
    """A key's open sessions, and until when its closed ones reach.

    A turn joins the open sessions that are less than the gap away, as
    session windows do. A session closes when the watermark reaches its last
    turn and the gap; a timer is set for that. A turn is late if the watermark
    has passed its own gap, or if a session it belongs to is closed; the key is
    forgotten when the first is true of all such turns.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start long, last long, n long")
        self.closed = handle.getValueState("closed", "start long, end long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        turns = sorted(int(x) for part in rows for x in part["ms"])
        sessions, reach = self._state()
        before = self._due(sessions, reach)
        sessions, reach, out = self._close(sessions, reach, now)
        for ms in turns:
            if ms + self.gap_ms <= now:
                out.append(("late", ms, ms, 1, "its time has passed"))
            elif reach and reach[0] - self.gap_ms < ms < reach[1]:
                out.append(("late", ms, ms, 1, "its session is closed"))
            else:
                near = [s for s in sessions if s[0] - self.gap_ms < ms < s[1] + self.gap_ms]
                sessions = [s for s in sessions if s not in near] + [(min([ms, *(s[0] for s in near)]), max([ms, *(s[1] for s in near)]), 1 + sum(s[2] for s in near))]
        self._keep(sessions, reach, before)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        sessions, reach, out = self._close(*self._state(), now)
        if reach and reach[1] + self.gap_ms <= now:
            reach = None
        self._keep(sessions, reach, None)
        yield self._rows(key, out)

    def _state(self) -> tuple[list[tuple], tuple | None]:
        return [tuple(x) for x in self.open.get()] if self.open.exists() else [], tuple(self.closed.get()) if self.closed.exists() else None

    def _due(self, sessions: list[tuple], reach: tuple | None) -> int | None:
        """When the key is to be looked at next: it has one timer."""
        return min([last + self.gap_ms for _, last, _ in sessions] + ([reach[1] + self.gap_ms] if reach else []), default=None)

    def _close(self, sessions: list[tuple], reach: tuple | None, now: int) -> tuple[list[tuple], tuple | None, list[tuple]]:
        """The sessions that stay open, the closed one that reaches furthest, and rows for those that close."""
        done = [s for s in sessions if s[1] + self.gap_ms <= now]
        reach = max([*([reach] if reach else []), *((start, last + self.gap_ms) for start, last, _ in done)], key=lambda x: x[1], default=None)
        return [s for s in sessions if s not in done], reach, [("session", start, last + self.gap_ms, n, None) for start, last, n in done]

    def _keep(self, sessions: list[tuple], reach: tuple | None, before: int | None) -> None:
        if sessions:
            self.open.put(sessions)
        else:
            self.open.clear()
        if reach:
            self.closed.update(reach)
        else:
            self.closed.clear()
        due = self._due(sessions, reach)
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)

    @staticmethod
    def _rows(key, out: list[tuple]) -> pd.DataFrame:
        out = sorted(out, key=lambda x: (x[1], x[0]))
        return pd.DataFrame({"key": [key[0]] * len(out), **{n: pd.Series([x[k] for x in out], dtype=kind) for k, (n, kind) in enumerate((("kind", object), ("start_ms", "Int64"), ("end_ms", "Int64"), ("n_turns", "Int64"), ("reason", object)))}})

    def close(self) -> None:
        pass


def kept_sessions(turns: DataFrame, gap: dt.timedelta = dt.timedelta(hours=6), delay: str = "1 hour", key: str = "user_id") -> DataFrame:
    """A stream of turns (key, ts) as sessions that end after `gap` without one, and the turns that came too late for theirs.

    Columns: key, kind ("session" or "late"), start, end, n_turns and reason (of
    late turns, whose start and end are their time). Sessions come out once the
    watermark has passed their end; turns without key or time are left out. The watermark follows ts;
    turns behind it still reach the state, as only a copy of their time goes there.
    Start the query within `rocksdb`.
    """
    watched = turns.withWatermark("ts", delay)
    kind = turns.schema[key].dataType.simpleString()
    timed = watched.select(F.col(key).alias("key"), F.unix_millis("ts").alias("ms")).filter("ms is not null and key is not null")
    found = timed.groupBy("key").transformWithStateInPandas(SessionKeeper(int(gap.total_seconds() * 1000)), f"key {kind}, kind string, start_ms long, end_ms long, n_turns long, reason string", "Append", "EventTime")
    return found.select(F.col("key").alias(key), "kind", F.timestamp_millis("start_ms").alias("start"), F.timestamp_millis("end_ms").alias("end"), "n_turns", "reason")


# Guided question rounds.

_VEHICLE = ("make", "model", "year")
_EASE = (*_VEHICLE, "mpn", "brand")


def remaining(candidates: list[dict], turns: list[dict]) -> list[dict]:
    """The candidates that every answer allows, the likeliest first."""
    allowed = [set(t["skus"]) for t in turns if not t["skipped"]]
    return sorted((c for c in candidates if all(c["sku"] in x for x in allowed)), key=lambda c: (-c["similarity"], c["sku"]))


def _contradicts(row: dict, turn: dict) -> bool:
    if turn["facet"] == "year":
        return row["year_start"] > turn["year_end"] or row["year_end"] < turn["year_start"]
    return turn["facet"] in _VEHICLE and row[turn["facet"]] != turn["label"]


def open_question(candidates: list[dict], fitment: list[dict], turns: list[dict]) -> tuple[str, list[dict]] | None:
    """The facet to ask next and its options (label, skus and, of years, year_start and year_end), as `next_question` and
    `facet_options` have them for many sessions; None if fewer than two candidates are left or nothing tells them apart."""
    left = {c["sku"]: c for c in remaining(candidates, turns)}
    if len(left) < 2:
        return None
    answers = [t for t in turns if not t["skipped"] and t["facet"] in _VEHICLE]
    rows = [r for r in fitment if r["sku"] in left and not (answers and any(_contradicts(r, t) for t in answers))]
    own = {
        "make": lambda: _options((r["make"], r["sku"]) for r in rows), "model": lambda: _options((r["model"], r["sku"]) for r in rows), "year": lambda: _year_runs(rows),
        "mpn": lambda: _options((c["mpn"], sku) for sku, c in left.items() if c["mpn"]), "brand": lambda: _options((c["brand"], sku) for sku, c in left.items()),
    }
    fits = left.keys() <= {r["sku"] for r in fitment}
    asked = {t["facet"] for t in turns}
    for facet in _EASE:  # the easiest comes first, so the others' options are not needed
        if facet not in asked and (fits or facet not in _VEHICLE):
            options = own[facet]()
            if len(options) > 1 and min(len(o["skus"]) for o in options) < len(left):
                return facet, options
    return None


def _options(pairs) -> list[dict]:
    skus = defaultdict(set)
    for label, sku in pairs:
        skus[label].add(sku)
    return [{"label": x, "skus": sorted(skus[x])} for x in sorted(skus)]


def _year_runs(rows: list[dict]) -> list[dict]:
    """Years in a row that the same SKUs fit are one option."""
    skus = defaultdict(set)
    for r in rows:
        for year in range(r["year_start"], r["year_end"] + 1):
            skus[year].add(r["sku"])
    runs = itertools.groupby(enumerate(sorted(skus)), key=lambda x: (x[1] - x[0], sorted(skus[x[1]])))
    spans = [(own, [y for _, y in years]) for (_, own), years in runs]
    return [{"label": str(y[0]) if len(y) == 1 else f"{y[0]}–{y[-1]}", "skus": own, "year_start": y[0], "year_end": y[-1]} for own, y in spans]


class QuestionRounds(StatefulProcessor):
    """A session's candidates and fitment, and its turns so far; each pick answers the question that is open then.

    It works on rows, as a data frame a session takes far longer than the session itself, and asks the state as little
    as it can. What remains and the open question are found once at the start and after each turn.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.fresh = handle, None
        self.seed = handle.getValueState("seed", "seed string")
        self.made = handle.getValueState("made", "seq long, ms long, turns string")  # of the last pick, and the turns as JSON

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seed.update((initialState.seed,))
        self.fresh = key, (initialState.seed,)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        picks = sorted(((int(r.seq), int(r.ms), r.option, bool(r.skip)) for r in rows), key=lambda p: (*p[:2], p[2] is not None, p[2] or 0, p[3]))
        fresh, self.fresh = self.fresh, None
        kept, made = (fresh[1], None) if fresh and fresh[0] == key else (self.seed.get(), self.made.get())
        seed = json.loads(kept[0]) if kept else None
        last, last_ms, turns = (made[0], made[1], json.loads(made[2])) if made else (None, None, [])
        before, now = last_ms, timerValues.getCurrentWatermarkInMs()
        left, question = self._open(seed, turns)
        for seq, ms, option, skip in picks:
            if ms + self.gap_ms <= now:
                reason = "the session has expired"
            elif last is not None and seq <= last:
                reason = "repeated pick"
            elif not question:
                reason = "no open question"
            elif (option is None) != skip:
                reason = "exactly one of option and skip"
            elif option is not None and not 0 <= option < len(question[1]):
                reason = "no such option"
            else:
                chosen = {"label": None, "skus": None} if skip else question[1][option]
                turns.append({"turn_no": len(turns), "facet": question[0], "skipped": skip, **chosen})
                left, question = self._open(seed, turns)
                reason = None
            if reason not in ("the session has expired", "repeated pick"):
                last, last_ms = seq, max(ms, last_ms or ms)
            yield self._row(key, seq, left, question, turns, reason)
        if last is not None:
            self.made.update((last, last_ms, json.dumps(turns)))
            if seed and last_ms != before:
                if before is not None:
                    self.handle.deleteTimer(before + self.gap_ms)
                self.handle.registerTimer(last_ms + self.gap_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for state in (self.seed, self.made):
            state.clear()
        return iter(())

    @staticmethod
    def _open(seed: dict | None, turns: list[dict]) -> tuple[list[dict], tuple[str, list[dict]] | None]:
        return (remaining(seed["candidates"], turns), open_question(seed["candidates"], seed["fitment"], turns)) if seed else ([], None)

    @staticmethod
    def _row(key, seq: int, left: list[dict], question: tuple[str, list[dict]] | None, turns: list[dict], reason: str | None) -> Row:
        turn = turns[-1] if turns and reason is None else {}
        return Row(
            session_id=key[0], seq=seq, reason=reason, turn_no=turn.get("turn_no"), asked=turn.get("facet"), label=turn.get("label"), skus=turn.get("skus"), year_start=turn.get("year_start"), year_end=turn.get("year_end"), skipped=turn.get("skipped"),
            status="resolved" if len(left) == 1 else "asking" if question else "exhausted", n_remaining=len(left), remaining=",".join(c["sku"] for c in left), facet=question[0] if question else None,
        )

    def close(self) -> None:
        pass


ROUNDS = "session_id string, seq long, reason string, turn_no int, asked string, label string, skus array<string>, year_start int, year_end int, skipped boolean, status string, n_remaining int, remaining string, facet string"


def session_seeds(candidates: DataFrame, fitment: DataFrame) -> DataFrame:
    """candidates and fitment of each session as one row (session_id, seed), the state that question_rounds starts with."""
    own = candidates.groupBy("session_id").agg(F.collect_list(F.struct("sku", "brand", "mpn", "similarity")).alias("candidates"))
    rows = fitment.groupBy("session_id").agg(F.collect_list(F.struct("sku", "make", "model", "year_start", "year_end")).alias("fitment"))
    none = F.array().cast(rows.schema["fitment"].dataType)
    whole = own.join(rows, "session_id", "left").select("session_id", F.struct("candidates", F.coalesce("fitment", none).alias("fitment")).alias("s"))
    return whole.select("session_id", F.to_json("s", {"ignoreNullFields": "false"}).alias("seed"))


def question_rounds(picks: DataFrame, seeds: DataFrame, gap: dt.timedelta = dt.timedelta(hours=6), delay: str = "1 hour") -> DataFrame:
    """A stream of picks (session_id, seq, ts, option from 0 or skip) against sessions that start as `session_seeds`.

    Each pick comes out once: with the turn it made (asked, label, skus, skipped)
    or the reason why it made none, and with the session's state after it
    (status, what remains, the facet that is asked next). Picks of a session
    count in the order of seq; one whose seq was there before makes no turn. A
    session is forgotten `gap` after its last pick. What is kept of a session is
    bounded by its candidates (25 by the seeds' check) and the five facets.
    Start the query within `rocksdb`.
    """
    watched = picks.withWatermark("ts", delay)
    timed = watched.select("session_id", F.col("seq").cast("long").alias("seq"), F.unix_millis("ts").alias("ms"), F.col("option").cast("long").alias("option"), F.coalesce("skip", F.lit(False)).alias("skip")).filter("session_id is not null and seq is not null and ms is not null")
    return timed.groupBy("session_id").transformWithState(QuestionRounds(int(gap.total_seconds() * 1000)), ROUNDS, "Append", "EventTime", seeds.groupBy("session_id"))
