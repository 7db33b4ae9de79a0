"""Tables kept by batches, vectors of new images, sketches, recorded rows and pages by cursor."""

import datetime as dt
import glob
import os
import random
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skuscope.operators import audit as au
from skuscope.operators import evaluate as ev
from skuscope.operators import maintained as mt
from skuscope.operators import search as se
from skuscope.operators import sketches as sk
from skuscope.sources import catalog as src
from skuscope.sources.buckets import BucketedTable
from skuscope.sources.scratch import shared_path
from skuscope.streaming import jobs

PRODUCTS = "sku string, product_name string, brand string"


def local(path):
    return urlparse(path).path


@pytest.fixture
def table(spark):
    made = BucketedTable(spark, shared_path(spark, "t"), ["sku"], StructType.fromDDL(PRODUCTS), buckets=16)
    mt.upsert_into(made, "first", spark.createDataFrame([(f"s{i}", f"name {i}", "A") for i in range(200)], PRODUCTS))
    return made


def test_only_touched_buckets_are_rewritten(spark, table):
    before = table.files()
    assert mt.upsert_into(table, "second", spark.createDataFrame([("s3", "other", "B"), ("new", "fresh", "B")], PRODUCTS))
    after = table.files()
    kept = before & after
    assert len(before) == 16 and len(before - kept) <= 2 and len(after - kept) <= 2
    rows = {r.sku: r.product_name for r in table.read().collect()}
    assert len(rows) == 201 and rows["s3"] == "other" and rows["s4"] == "name 4"
    assert not mt.upsert_into(table, "second", spark.createDataFrame([("s3", "again", "B")], PRODUCTS)) and table.files() == after


def test_a_batch_that_broke_off_goes_on_from_what_is_staged(spark, table, monkeypatch):
    changes = spark.createDataFrame([("s1", "update", {"brand": "Z"}), ("s2", "delete", {}), ("zz", "create", {"brand": "Z"}), ("s3", "create", {}), ("nobody", "update", {})], "sku string, op string, fields map<string,string>")
    place = BucketedTable._place

    def broken(self, *parts):
        if parts[0] == "done" and not broken.over:
            broken.over = True
            raise OSError("lost")
        return place(self, *parts)

    broken.over = True
    monkeypatch.setattr(BucketedTable, "_place", broken)
    real = BucketedTable._exists

    def exists(self, *parts):  # the batch isn't done yet; it breaks off where that is to be noted
        found = real(self, *parts)
        if parts[:2] == ("done", "c"):
            return found
        broken.over = parts[0] != "staged"
        return found

    monkeypatch.setattr(BucketedTable, "_exists", exists)
    with pytest.raises(OSError):
        mt.change_in(table, "c", changes)
    monkeypatch.undo()
    new, _ = mt.change_in(table, "c", changes)  # "create" would now be a conflict if it were worked out again
    assert new
    rows = {r.sku: (r.product_name, r.brand) for r in table.read().collect()}
    assert rows["s1"] == ("name 1", "Z") and "s2" not in rows and rows["zz"] == (None, "Z") and len(rows) == 200
    assert not mt.change_in(table, "c", changes)[0]


def test_rejects_and_emptied_buckets(spark, table):
    delete = table.read().select("sku", F.lit("delete").alias("op"), F.create_map().cast("map<string,string>").alias("fields"))
    new, rejects = mt.change_in(table, "all", delete.unionByName(spark.createDataFrame([("nobody", "delete", {})], "sku string, op string, fields map<string,string>")))
    assert new and [tuple(r) for r in rejects.collect()] == [("nobody", "delete", "not found")]
    assert table.read().count() == 0 and table.read([0, 1]).count() == 0


def test_confirmations_by_bucket(spark):
    schema = "id long, top_sku string, confirmed_sku string, confirmed_at timestamp, disambiguation string"
    at = lambda h: dt.datetime(2024, 1, 1, h)
    table = BucketedTable(spark, shared_path(spark, "audit"), ["id"], StructType.fromDDL(schema), buckets=4)
    table.merge("import", spark.createDataFrame([(i, "a", None, None, None) for i in range(20)], schema), lambda old, new: old.unionByName(new))
    some = "id long, confirmed_sku string, confirmed_at timestamp, disambiguation string"
    mt.confirm_in(table, "one", spark.createDataFrame([(1, "a", at(1), "[1]"), (2, "b", at(1), None), (99, "x", at(1), None)], some))
    mt.confirm_in(table, "two", spark.createDataFrame([(2, "c", at(2), "[2]"), (3, "a", at(2), None)], some))
    rows = {r.id: (r.confirmed_sku, r.disambiguation) for r in table.read().filter("confirmed_sku is not null").collect()}
    assert rows == {1: ("a", "[1]"), 2: ("c", "[2]"), 3: ("a", None)} and table.read().count() == 20


VECTORS = "category_slug string, backend string, remove_bg boolean, sku string, row_pos long, embedding array<float>"


def test_sums_after_deltas_are_those_of_a_rebuild(spark):
    rng, r = np.random.default_rng(1), random.Random(1)
    rows = [("c", "dinov2", True, f"s{i % 7}", i, rng.normal(size=4).tolist()) for i in range(60)] + [("c", "dinov2", True, "gone", 100, [1.0] * 4), ("d", "openclip", True, "s1", 101, [0.0] * 4)]
    frame = lambda x: spark.createDataFrame(x, VECTORS)
    table = BucketedTable(spark, shared_path(spark, "sums"), [*se.KEY, "sku"], StructType.fromDDL(mt.SUMS), buckets=4)
    here, todo = [], rows[:]
    for k in range(3):
        added, todo = todo[:25], todo[25:]
        removed = r.sample(here, min(8, len(here))) + ([x for x in here if x[3] == "gone"] if k == 2 else [])
        removed = list({x[4]: x for x in removed}.values())
        here = [x for x in here if x not in removed] + added
        for _ in range(2):  # each batch comes twice
            mt.update_sums(table, str(k), frame(added), frame(removed), vectors=frame(here))
    shown = lambda df: sorted((x.category_slug, x.sku, x.n_vectors, x.first_pos, [round(y, 9) for y in x.centroid]) for x in df.collect())
    assert shown(se.centroids_of(table.read())) == shown(se.sku_centroids(frame(here)))


def calls(path):
    return sum(int(open(f).read()) for f in glob.glob(f"{path}/*"))


def loader(folder):
    def load():
        def encode(batch, mirrored):
            if any(x == b"bad" for x in map(bytes, batch)):
                raise ValueError("unreadable")
            if not mirrored:
                with open(f"{folder}/{os.urandom(8).hex()}", "w") as out:
                    out.write(str(len(batch)))
            return [[float(len(x)), 1.0 + mirrored] for x in batch]

        return encode

    return load


def test_a_second_run_encodes_what_is_new(spark, tmp_path):
    schema = "image_id long, backend string, remove_bg boolean, data binary"
    first = [(1, "a", True, b"one"), (2, "a", True, b"one"), (3, "b", True, b"one"), (4, "a", False, b"one"), (5, "a", True, b"bad"), (6, "none", True, b"x"), (7, "a", True, None), (8, "a", True, b"")]
    path = shared_path(spark, "done")
    run = lambda rows: mt.embed_into(spark.createDataFrame(rows, schema), path, {"a": loader(tmp_path), "b": loader(tmp_path)}, width=3)
    assert run(first) == {"encoded": 4, "failed": 2} and calls(tmp_path) == 4
    assert run([*first, (9, "a", True, b"new"), (1, "a", True, b"changed")]) == {"encoded": 2, "failed": 2} and calls(tmp_path) == 6
    assert run(first) == {"encoded": 0, "failed": 2} and calls(tmp_path) == 6
    found = {r.image_id: r.embedding for r in mt.with_vectors(spark.createDataFrame(first, schema), spark.read.parquet(path)).collect()}
    assert found[1] == found[2] == found[3] == found[4] and found[5] is found[6] is found[7] is None and abs(np.linalg.norm(found[8]) - 1) < 1e-6
    reasons = {r.digest: r.reason for r in mt.embed_new(spark.createDataFrame(first, schema), spark.read.parquet(path), {"a": loader(tmp_path)}).collect()}
    assert sorted(map(str, reasons.values())) == ["ValueError: unreadable", "no encoder for the backend"]


def test_sketches_merge_and_bound_quantiles(spark):
    r = random.Random(7)
    values = [r.choice([-1, 1]) * 10 ** r.uniform(-6, 5) for _ in range(3000)] + [0.0, 1e-12, 0.0, 5.0, -5.0]
    rows = spark.createDataFrame([(i % 9, float(v)) for i, v in enumerate(values)] + [(0, None), (0, float("nan"))], "day int, v double")
    parts = sk.sketch(rows, ["day"], "v")
    points = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)
    whole = parts.withColumn("all", F.lit(1))
    got = sk.quantiles(whole, ["all"], points).first()
    ordered = sorted(values)
    assert got.n == len(values)
    for p, q in zip(points, got.q):
        exact = ordered[int(p * (len(values) - 1))]
        assert abs(q - exact) <= sk.ACCURACY * abs(exact) * 1.0001 + sk.TINY
    merged = {x.slot: x.n for x in sk.merge(whole, ["all"]).collect()}
    assert merged == {x.slot: x.n for x in sk.sketch(rows.withColumn("all", F.lit(1)), ["all"], "v").collect()}
    assert sk.quantiles(parts.limit(0), ["day"], (0.5,)).count() == 0


def test_sweep_of_sketches(spark):
    r = random.Random(9)
    rows = spark.createDataFrame([("b", r.choice([True, False]), r.random()) for _ in range(2000)], "backend string, ok boolean, score double")
    by = sk.sketch(rows, ["backend", "ok"], "score")
    side = lambda ok: sk.scores_of(by.filter(F.col("ok") == ok), ["backend"])
    exact = {x.threshold: x for x in ev.threshold_sweep(rows.filter("ok"), rows.filter("not ok"), stop_above=100).collect()}
    for x in ev.threshold_sweep(side(True), side(False), stop_above=100).collect():
        assert abs(x.rejected - exact[x.threshold].rejected) < 2 and abs(x.caught - exact[x.threshold].caught) < 2


AUDIT = "id long, created_at timestamp, predicted_category string, confidence double, top_sku string, confirmed_sku string"


def audit_rows(n=60):
    t0 = dt.datetime(2024, 1, 1)
    return [(i, t0 + dt.timedelta(hours=3 * (i % 40), minutes=i), f"c{i % 3}", i / n, None if i % 4 == 0 else "a", "a" if i % 3 == 0 else None) for i in range(n)]


def test_bad_rows_go_aside_and_replays_add_nothing(spark):
    rows = audit_rows()
    bad = [(None, rows[0][1], "c", 0.5, None, None), (100, None, "c", 0.5, None, None), (101, rows[0][1], "  ", 0.5, None, None), (102, rows[0][1], "c", float("nan"), None, None)]
    source, out, dead, check = (shared_path(spark, x) for x in ("s", "o", "d", "c"))

    def run():
        jobs.record_audit(spark.readStream.schema(AUDIT).parquet(source), out, dead, check).awaitTermination()
        return sorted(r.id for r in spark.read.parquet(out).collect()), sorted((str(r.id), r.reason) for r in spark.read.parquet(dead).collect())

    spark.createDataFrame(rows[:40] + bad + rows[:3], AUDIT).write.mode("append").parquet(source)
    ids, reasons = run()
    assert ids == list(range(40)) and reasons == sorted([("None", "no id"), ("100", "no time"), ("101", "no category"), ("102", "no confidence")])
    spark.createDataFrame(rows[30:], AUDIT).write.mode("append").parquet(source)
    assert run()[0] == list(range(60))
    os.remove(f"{local(check)}/commits/1")  # as if the driver was lost before the batch was noted
    for crc in glob.glob(f"{local(check)}/commits/.1.crc"):
        os.remove(crc)
    assert run() == (list(range(60)), reasons)


def test_quality_adds_up_over_batches_and_windows(spark):
    rows = audit_rows(200)
    source, out, check = (shared_path(spark, x) for x in ("qs", "qo", "qc"))
    for part in (rows[100:], rows[:100]):  # the earlier rows come later
        spark.createDataFrame(part, AUDIT).write.mode("append").parquet(source)
        jobs.stream_quality(spark.readStream.schema(AUDIT).parquet(source), out, check).awaitTermination()
    partials = spark.read.parquet(out)
    got = {x.window_start: x for x in jobs.quality_of(partials).collect()}
    exact = {x.window_start: x for x in jobs.windowed_quality(spark.createDataFrame(rows, AUDIT)).collect()}
    assert got.keys() == exact.keys() and len(got) > 4
    for k, x in got.items():
        assert (x.n, x.refusal_rate) == (exact[k].n, exact[k].refusal_rate) and abs(x.mean_confidence - exact[k].mean_confidence) < 1e-9
    whole = jobs.quality_of(partials, F.date_trunc("year", "window_start")).collect()
    assert len(whole) == 1 and whole[0].n == 200 and abs(whole[0].median - 99 / 200) < 0.01


def test_pages_by_cursor(spark):
    rows = [(r[0], r[1]) for r in audit_rows(90)] + [(500 + i, dt.datetime(2024, 1, 3)) for i in range(12)] + [(900, None)]
    frame = spark.createDataFrame(rows, "id long, created_at timestamp")
    path = shared_path(spark, "days")
    src.append_audit(frame, path, "b")
    src.append_audit(frame, path, "b")  # again: nothing more
    table = spark.read.parquet(path)
    assert table.count() == len(rows)
    cursor, seen = None, []
    while page := au.history_after(table, cursor, 17).collect():
        seen += [r.id for r in page]
        cursor = (page[-1].created_at, page[-1].id)
    assert seen == [r.id for r in au.history(frame.filter("created_at is not null"), 200).collect()]
    for f in glob.glob(f"{local(path)}/batch=b/day=2024-01-01/*.parquet"):
        with open(f, "w") as out:
            out.write("not read")
    assert len(au.history_after(table, None, 17).collect()) == 17
    assert au.history_after(table.limit(0), None).count() == 0
