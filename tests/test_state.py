"""Streams with state by key: late turns, question rounds, restarts from a checkpoint."""

import datetime as dt
import json
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from skuscope.operators import questions as qu
from skuscope.plans.stateful import in_turns
from skuscope.streaming import jobs, state

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
TURNS = "user_id long, ts timestamp"


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def shown(rows):
    hours = lambda x: round((x.replace(tzinfo=dt.timezone.utc) - T0).total_seconds() / 3600, 3)
    return sorted((r.user_id, r.kind, hours(r.start), hours(r.end), r.n_turns, r.reason) for r in rows)


def test_late_turns_are_reported(spark):
    first = spark.createDataFrame([(1, at(0)), (1, at(2)), (1, at(20)), (2, at(1)), (2, at(30)), (None, at(3)), (3, None)], TURNS)  # the watermark gets to hour 29
    second = spark.createDataFrame([(1, at(1)), (1, at(25.5)), (1, at(23.5)), (2, at(29.5)), (3, at(24)), (3, at(22))], TURNS)
    third = spark.createDataFrame([(1, at(60)), (2, at(31))], TURNS)
    fourth = spark.createDataFrame([(2, at(34))], TURNS)
    got = shown(in_turns(spark, [first, second, third, fourth], state.kept_sessions, "late").collect())
    assert got == sorted([
        (1, "session", 0.0, 8.0, 2, None), (1, "session", 20.0, 26.0, 1, None), (2, "session", 1.0, 7.0, 1, None),
        (1, "late", 1.0, 1.0, 1, "its time has passed"), (3, "late", 22.0, 22.0, 1, "its time has passed"), (1, "late", 23.5, 23.5, 1, "its session is closed"), (1, "late", 25.5, 25.5, 1, "its session is closed"),
        (3, "session", 24.0, 30.0, 1, None), (2, "session", 29.5, 37.0, 3, None), (2, "late", 34.0, 34.0, 1, "its time has passed"),
    ])


def test_on_time_sessions_are_those_of_session_windows(spark):
    r = random.Random(3)
    rows = [(r.randrange(5), at(r.random() * 300)) for _ in range(200)]
    turns = spark.createDataFrame([*rows, (9, at(900))], TURNS)
    got = {x[:5] for x in shown(in_turns(spark, [turns], state.kept_sessions, "same").collect())}
    want = jobs.sessions(turns.filter("user_id < 9")).select("user_id", F.lit("session").alias("kind"), F.col("session_start").alias("start"), F.col("session_end").alias("end"), "n_turns", F.lit(None).alias("reason"))
    assert got == {x[:5] for x in shown(want.collect())} and len(got) > 20


CAND = "session_id string, sku string, brand string, similarity double, mpn string"
FIT = "session_id string, sku string, make string, model string, year_start int, year_end int"
PICK = "session_id string, seq long, ts timestamp, option int, skip boolean"


def made(r, sessions=40):
    candidates, fitment = [], []
    for s in range(sessions):
        for k in range(r.randrange(1, 8)):
            sku = f"{s}-{k}"
            candidates.append((f"s{s}", sku, r.choice("AB"), r.randrange(100) / 100, r.choice([None, "", "M1", "M2"])))
            for _ in range(r.randrange(0 if s % 3 == 0 else 1, 3)):
                a = 2000 + r.randrange(8)
                fitment.append((f"s{s}", sku, r.choice(["Ford", "Audi"]), r.choice("xyz"), a, a + r.randrange(4)))
    return candidates, fitment


def test_question_rounds_end_as_the_batch_over_all_turns(spark):
    r = random.Random(8)
    c, f = made(r)
    candidates, fitment = spark.createDataFrame(c, CAND), spark.createDataFrame(f, FIT)
    sessions = sorted({x[0] for x in c})
    picks = [(s, k, at(k), *r.choice([(0, False), (1, None), (None, True), (0, True), (None, False), (50, False), (-1, False)])) for s in sessions for k in range(5)]
    again = [(s, 1, at(2), 0, False) for s in sessions[:5]]  # a seq that was there before
    parts = [spark.createDataFrame([p for p in picks if p[1] < 2], PICK), spark.createDataFrame([*(p for p in picks if p[1] >= 2), *again, ("ghost", 0, at(1), 0, False)], PICK)]
    seeds = state.session_seeds(candidates, fitment)
    rows = in_turns(spark, parts, lambda x: state.question_rounds(x, seeds), "rounds").collect()
    assert len(rows) == len(picks) + len(again) + 1
    assert {x.reason for x in rows} == {None, "no open question", "exactly one of option and skip", "no such option", "repeated pick"}
    assert sum(x.reason == "repeated pick" for x in rows) == 5 and [x.reason for x in rows if x.session_id == "ghost"] == ["no open question"]
    turns = [(x.session_id, x.turn_no, x.asked, "?", x.label, x.skus, x.label if x.asked == "make" else None, x.label if x.asked == "model" else None, x.year_start, x.year_end, x.skipped) for x in rows if x.reason is None]
    table = spark.createDataFrame(turns, "session_id string, turn_no int, facet string, prompt string, label string, skus array<string>, make string, model string, year_start int, year_end int, skipped boolean")
    want = {x.session_id: (x.status, x.n_remaining, x.remaining, x.facet) for x in qu.session_state(candidates, fitment, table).collect()}
    last = {}
    for x in sorted(rows, key=lambda x: (x.seq, x.reason == "repeated pick")):
        if x.session_id != "ghost" and x.reason != "repeated pick":
            last[x.session_id] = (x.status, x.n_remaining, x.remaining, x.facet)
    assert last == want
    assert len({x[2] for x in turns}) == 5 and sum(x[10] for x in turns) > 5


def test_sessions_expire(spark):
    c, f = made(random.Random(2), 6)
    seeds = state.session_seeds(spark.createDataFrame(c, CAND), spark.createDataFrame(f, FIT))
    first = spark.createDataFrame([("s1", 0, at(0), None, True), ("s2", 0, at(20), None, True)], PICK)
    second = spark.createDataFrame([("s1", 1, at(1), None, True), ("s1", 2, at(21), None, True), ("s2", 1, at(22), None, True)], PICK)
    rows = in_turns(spark, [first, second], lambda x: state.question_rounds(x, seeds), "expired").collect()
    reasons = {(x.session_id, x.seq): x.reason for x in rows}
    assert reasons["s1", 1] == "the session has expired" and reasons["s1", 2] == "no open question" and reasons["s2", 1] != "the session has expired"


def test_year_runs_end_where_no_part_fits():
    rows = [{"sku": "a", "year_start": 2018, "year_end": 2022}, {"sku": "b", "year_start": 2018, "year_end": 2024}, {"sku": "a", "year_start": 2026, "year_end": 2027}, {"sku": "c", "year_start": 2030, "year_end": 2029}]
    assert [(x["label"], x["skus"]) for x in state._year_runs(rows)] == [("2018–2022", ["a", "b"]), ("2023–2024", ["b"]), ("2026–2027", ["a"])]


def test_a_session_takes_few_calls(monkeypatch):
    calls, asked = [], []

    class Value:
        def __init__(self, name):
            self.name, self.now = name, None

        def get(self):
            calls.append(f"get {self.name}")
            return self.now

        def update(self, now):
            calls.append(f"update {self.name}")
            self.now = now

    class Handle:
        def getValueState(self, name, schema):
            return Value(name)

        def registerTimer(self, ms):
            calls.append(f"timer {ms}")

        def deleteTimer(self, ms):
            calls.append(f"no timer {ms}")

    class Timers:
        def getCurrentWatermarkInMs(self):
            return 0

    monkeypatch.setattr(state, "open_question", lambda *a, f=state.open_question: asked.append(len(a[2])) or f(*a))
    candidates = [{"sku": x, "brand": b, "mpn": m, "similarity": 0.5} for x, b, m in (("a", "A", "M1"), ("b", "B", "M1"), ("c", "B", "M2"), ("d", "B", "M2"))]
    seed = json.dumps({"candidates": candidates, "fitment": []})
    rounds = state.QuestionRounds(100)
    rounds.init(Handle())
    pick = lambda seq, option, skip=False: Row(session_id="s", seq=seq, ms=1000 + seq, option=option, skip=skip)
    rounds.handleInitialState(("s",), Row(session_id="s", seed=seed), Timers())
    first = list(rounds.handleInputRows(("s",), iter([pick(2, 9), pick(1, None, True), pick(2, None, True)]), Timers()))
    assert [(x.seq, x.reason, x.facet) for x in first] == [(1, None, "brand"), (2, None, None), (2, "repeated pick", None)]
    assert calls == ["update seed", "update made", "timer 1102"] and asked == [0, 1, 2]
    calls.clear(), asked.clear()
    second = list(rounds.handleInputRows(("s",), iter([pick(3, 0)]), Timers()))
    assert [(x.reason, x.n_remaining, x.status) for x in second] == [("no open question", 4, "exhausted")]
    assert calls == ["get seed", "get made", "update made", "no timer 1102", "timer 1103"] and asked == [2]
