"""Search, evaluation, fitment, questions, catalog, audit and streaming jobs."""

import math

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skuscope.functions import images as im
from skuscope.functions import vectors as v
from skuscope.operators import audit as au
from skuscope.operators import catalog as ca
from skuscope.operators import evaluate as ev
from skuscope.operators import fitment as fi
from skuscope.operators import identify as ident
from skuscope.operators import questions as qu
from skuscope.operators import search as se
from skuscope.sources import catalog as src
from skuscope.streaming import jobs

VECTORS = "category_slug string, backend string, remove_bg boolean, sku string, row_pos long, embedding array<float>"


def vectors(spark, rows):
    return spark.createDataFrame([("c", "dinov2", True, s, i, [float(x) for x in e]) for i, (s, e) in enumerate(rows)], VECTORS)


def test_normalize(spark):
    got = spark.range(1).select(v.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))).alias("a"), v.l2_normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("z")).first()
    assert got["a"] == [0.6, 0.8] and got["z"] == [0.0, 0.0]


def test_top_k(spark):
    c = se.sku_centroids(vectors(spark, [("BP001", [1, 0, 0]), ("BP002", [0, 1, 0]), ("BP003", [0, 0, 1])]))
    q = spark.createDataFrame([("c", "dinov2", True, 1, [0.1, 0.9, 0.0])], "category_slug string, backend string, remove_bg boolean, query_id long, embedding array<float>")
    rows = se.search_topk(q, c, 2).orderBy("rank").collect()
    assert [r["sku"] for r in rows] == ["BP002", "BP001"] and 0.9 <= rows[0]["similarity_score"] + 1e-6 <= 1.001
    assert se.search_topk(q, c, 0).count() == 0 and se.search_topk(q, c, None).count() == 3
    assert se.search_topk(q.withColumn("backend", F.lit("openclip")), c, 2).count() == 0


def test_leave_one_out(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i % 4}", rng.normal(size=5)) for i in range(13)] + [("only", rng.normal(size=5)), ("zero", [0] * 5), ("zero", [0] * 5)]
    got = {r["row_pos"]: (r["rank"], round(r["own_score"], 4)) for r in se.loo_ranks(vectors(spark, rows)).collect()}
    m = np.array([np.float32(e) for _, e in rows], float)
    skus = [s for s, _ in rows]
    unit = lambda x: x / np.linalg.norm(x) if np.linalg.norm(x) else x
    want = {}
    for i, s in enumerate(skus):
        if skus.count(s) < 2:
            continue
        scores = {o: m[i] @ unit(sum(m[j] for j in range(len(skus)) if skus[j] == o and j != i)) for o in dict.fromkeys(skus)}
        order = sorted(scores, key=lambda o: (-scores[o], skus.index(o)))
        want[i] = (order.index(s) + 1, round(scores[s], 4))
    assert got == want


def test_sweep_and_recommendation(spark):
    correct = spark.createDataFrame([("b", 0.5), ("b", 0.6)], "backend string, score double")
    impostor = spark.createDataFrame([("b", 0.4), ("b", 0.55)], "backend string, score double")
    sweep = ev.threshold_sweep(correct, impostor)
    rows = {round(r["threshold"], 2): (r["rejected"], r["caught"]) for r in sweep.collect()}
    assert rows[0.5] == (0.0, 50.0) and rows[0.51] == (50.0, 50.0) and max(rows) == 0.51  # a score at the threshold isn't below it
    assert tuple(ev.recommend_threshold(sweep).first()) == ("b", 0.5, 50.0)
    none = ev.threshold_sweep(correct, impostor.limit(0)).first()
    assert none["caught"] is None


def test_collapse_and_year_options(spark):
    years = spark.createDataFrame([("a", "Ford", "Focus", y) for y in (2012, 2013, 2014, 2016, 2016)], "sku string, make string, model string, year int")
    got = sorted((r["year_start"], r["year_end"]) for r in fi.collapse_fitment_years(years).collect())
    assert got == [(2012, 2014), (2016, 2016)]
    rows = spark.createDataFrame([("s", "a", 2018, 2022), ("s", "b", 2018, 2024), ("s", "a", 2026, 2027)], "session_id string, sku string, year_start int, year_end int")
    assert sorted((r["label"], tuple(r["skus"])) for r in fi.year_options(rows).collect()) == [("2018–2022", ("a", "b")), ("2023–2024", ("b",)), ("2026–2027", ("a",))]


CAND = "session_id string, sku string, brand string, similarity double, mpn string"
FIT = "session_id string, sku string, make string, model string, year_start int, year_end int"
TURN = "session_id string, turn_no int, facet string, prompt string, label string, skus array<string>, make string, model string, year_start int, year_end int, skipped boolean"


def chat(spark, fitted=("BP-HONDA", "BP-TOYOTA", "BP-BMW"), turns=()):
    cand = spark.createDataFrame([("s", "BP-HONDA", "Bosch", 0.91, None), ("s", "BP-TOYOTA", "Akebono", 0.80, None), ("s", "BP-BMW", "Bosch", 0.79, None)], CAND)
    fit = spark.createDataFrame([("s", k, m, x, a, b) for k, m, x, a, b in (("BP-HONDA", "Honda", "Civic", 2018, 2022), ("BP-TOYOTA", "Toyota", "Camry", 2018, 2022), ("BP-BMW", "BMW", "X3", 2019, 2023)) if k in fitted], FIT)
    return cand, fit, spark.createDataFrame(list(turns), TURN)


def test_questions(spark):
    state = lambda **k: qu.session_state(*chat(spark, **k)).first()
    first = state()
    assert (first["status"], first["facet"], first["n_remaining"]) == ("asking", "make", 3)
    assert state(fitted=("BP-HONDA",))["facet"] == "brand"
    skip = [("s", 0, "make", "", "", None, None, None, None, None, True), ("s", 1, "model", "", "", None, None, None, None, None, True)]
    assert state(turns=skip)["facet"] == "year"
    toyota = state(turns=[("s", 0, "make", "", "Toyota", ["BP-TOYOTA"], "Toyota", None, None, None, False)])
    assert (toyota["status"], toyota["resolved_sku"], toyota["leader_sku"], toyota["best_survivor_sku"]) == ("resolved", "BP-TOYOTA", "BP-HONDA", "BP-TOYOTA")
    cand, _, turns = chat(spark, turns=skip)
    assert {tuple(r["skus"]) for r in qu.transcript(cand, turns).collect()} == {("BP-BMW", "BP-HONDA", "BP-TOYOTA")}
    kept, bad = qu.undo(turns, spark.createDataFrame([("s", 1)], "session_id string, keep int"))
    assert kept.count() == 1 and bad.count() == 0
    assert qu.undo(turns, spark.createDataFrame([("s", 3)], "session_id string, keep int"))[1].count() == 1
    options = spark.createDataFrame([("s", "make", "?", [("Honda", ["BP-HONDA"])])], "session_id string, facet string, prompt string, options array<struct<label:string,skus:array<string>>>")
    good, wrong = qu.apply_turns(options, spark.createDataFrame([("s", 0, False), ("s", 5, False), ("s", 0, True), ("x", 0, False)], "session_id string, option int, skip boolean"))
    assert good.first()["label"] == "Honda" and good.count() == 1 and wrong.count() == 3


PROD = "sku string, product_name string, brand string, category string, replacement_sku string, alternative_skus array<string>, accessory_skus array<string>"


def test_recommendations(spark):
    p = spark.createDataFrame([("a", "A", "x", "c", "b", ["b", "a", "ghost", "d"], ["d", "d", "a"]), ("b", "B", "x", "c", None, None, None), ("d", "D", "y", "c", None, [], [])], PROD)
    got = sorted((r["kind"], r["position"], r["related_sku"]) for r in ca.recommend(p).collect() if r["sku"] == "a")
    assert got == [("accessory", 0, "d"), ("accessory", 1, "d"), ("accessory", 2, "a"), ("alternative", 0, "b"), ("alternative", 2, "d")]


def test_upsert_and_changes(spark):
    old = spark.createDataFrame([("a", "A", 1), ("b", "B", 2)], "sku string, product_name string, kept int")
    new = spark.createDataFrame([("b", "BB"), ("c", "C")], "sku string, product_name string")
    assert sorted(map(tuple, ca.upsert_products(old, new).collect())) == [("a", "A", 1), ("b", "BB", 2), ("c", "C", None)]
    with pytest.raises(Exception, match="duplicate sku"):
        ca.upsert_products(old, new.union(new)).collect()
    changes = spark.createDataFrame([("a", "create", {"product_name": "X"}), ("b", "update", {"product_name": "Y"}), ("z", "delete", {})], "sku string, op string, fields map<string,string>")
    kept, rejects = ca.apply_product_changes(old, changes)
    assert sorted(map(tuple, kept.collect())) == [("a", "A", 1), ("b", "Y", 2)]
    assert sorted(map(tuple, rejects.collect())) == [("a", "create", "conflict"), ("z", "delete", "not found")]


def test_gate_and_routing(spark):
    rows = spark.createDataFrame([(1, 0.48, False), (2, 0.50, True), (3, None, False), (4, 0.52, True)], "query_id int, top_score double, uncertain boolean").withColumn("backend", F.lit("dinov2"))
    assert {r["query_id"]: r["no_match"] for r in ident.no_match_verdict(rows).collect()} == {1: False, 2: True, 3: True, 4: False}
    available = spark.createDataFrame([("brake_pads",), ("oil_filter",)], "category_slug string")
    p = spark.createDataFrame([(1, [("brake_pad", 0.4), ("brake_pads", 0.3)]), (2, [("Oil Filter", 0.3), ("brake_pads", 0.2)]), (3, [("ghost", 0.9)])], "query_id int, ranking array<struct<label:string,probability:double>>")
    routes = ident.route_categories(p, available)
    assert sorted((r["query_id"], r["category"]) for r in routes.collect()) == [(1, "Brake Pads"), (2, "Brake Pads"), (2, "Oil Filter")]
    assert ident.unroutable(p, routes).count() == 1


def test_audit(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, None), (3, "y", None)], "id int, top_sku string, confirmed_sku string").withColumn("confirmed_at", F.lit(None).cast("timestamp"))
    c = spark.createDataFrame([(1, "x", "2024-01-01"), (3, "q", "2024-01-01"), (3, "z", "2024-01-02"), (9, "z", "2024-01-01")], "id int, confirmed_sku string, t string").select("id", "confirmed_sku", F.col("t").cast("timestamp").alias("confirmed_at"))
    done, unknown = au.apply_confirmations(a, c)
    assert {r["id"]: (r["confirmed_sku"], r["corrected"]) for r in done.collect()} == {1: ("x", False), 2: (None, False), 3: ("z", True)}
    assert [r["id"] for r in unknown.collect()] == [9]
    left, ghosts = au.delete_audit(a, spark.createDataFrame([(1,), (7,)], "id int"))
    assert left.count() == 2 and ghosts.first()["id"] == 7


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('﻿sku,product_name,brand,category,compatible_vehicles,attributes\nA1,"Pad ""X""",,Brake Pads,Honda Civic (2018-2019),"{""b"": ""1"", ""a"": ""2""}"\n ,gone,,,,\n', encoding="utf-8")
    p = src.catalog_to_products(src.read_catalog_csv(spark, str(path))).collect()
    assert len(p) == 1 and p[0]["product_name"] == 'Pad "X"' and p[0]["brand"] == "Unknown" and len(p[0]["compatible_vehicles"]) == 2 and p[0]["attributes"] == {"a": "2", "b": "1"}


def test_images(spark):
    flat, board = np.full((32, 32, 3), 100.0), np.indices((32, 32)).sum(axis=0)[..., None] % 2 * np.full(3, 200.0)
    assert im.measures(flat) == (0.0, pytest.approx(100.0)) and im.measures(board)[0] > 120 and im.measures(None) == (None, None)
    assert im.mask_ok(np.array([255] * 2 + [0] * 98)) and not im.mask_ok(np.array([255] + [0] * 99))
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "image_id int, data array<double>")

    def load():
        return lambda batch, mirrored: np.array([list(x)[::-1] if mirrored else list(x) for x in batch])

    got = {r["image_id"]: r for r in im.embed(rows, load, "tiny").collect()}
    assert got[1]["embedding"][0] == pytest.approx(math.sqrt(0.5)) and got[2]["embedding"] is None and got[2]["reason"]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3} 0{i}:00:00") for i in range(6)] + [(0, "2024-01-01 00:00:00")], "id int, t string").select("id", F.col("t").cast("timestamp").alias("created_at"), F.lit("x").alias("top_sku"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    jobs.stream_audit(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    jobs.stream_identify(stream, lambda b: b.withColumn("y", F.lit(1)), str(tmp_path / "o2"), str(tmp_path / "c2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 7
    confirmations = rows.limit(1).select("id", (F.col("created_at") + F.expr("INTERVAL 1 HOUR")).alias("confirmed_at"), F.lit("z").alias("confirmed_sku"))
    assert jobs.join_confirmations(rows.dropDuplicates(["id"]), confirmations).filter("confirmed_sku is not null").count() == 1


def test_ranges_in_first_seen_order(spark):
    rows = [(1, "Ford", 2012), (2, "Audi", 2015), (3, "Ford", 2013), (4, "Ford", 2017), (5, "Audi", 2014), (0, "Seat", None)]
    years = spark.createDataFrame([("a", make, "M", year, at) for at, make, year in rows], "sku string, make string, model string, year int, at int")
    got = fi.collapse_fitment_years(years, order="at").orderBy("seen_at", "year_start").collect()
    assert [(r.make, r.year_start, r.year_end, r.seen_at) for r in got] == [("Ford", 2012, 2013, 1), ("Ford", 2017, 2017, 1), ("Audi", 2014, 2015, 2)]


def test_strict_ranking_rejects_unknown_places(spark):
    rows = spark.createDataFrame([(1, [0.2, 0.8]), (2, [0.1, 0.2, 0.7]), (3, [0.5, 0.5])], "query_id long, probabilities array<double>")
    shown = lambda df: {r.query_id: [x.label for x in r.ranking] for r in df.collect()}
    assert shown(ident.rank_categories(rows, ["a", "b"])) == {1: ["b", "a"], 2: ["class_2", "b", "a"], 3: ["a", "b"]}
    assert shown(ident.rank_categories(rows, ["a", "b"], strict=True)) == {1: ["b", "a"], 3: ["a", "b"]}


def test_a_much_asked_vehicle_is_several_tasks_and_runs_of_skus(spark):
    ranges = spark.range(20_000).select(F.nullif(F.col("id").cast("string"), F.lit("7")).alias("sku"), F.lit("Ford").alias("make"), F.lit("x").alias("model"), F.lit(1999).alias("year_start"), F.lit(2001).alias("year_end"))
    ranges = ranges.unionByName(ranges.limit(50)).unionByName(ranges.limit(9).withColumn("make", F.lit("Audi"))).unionByName(ranges.limit(1).withColumn("model", F.lit(None).cast("string")))
    asked = spark.range(150).select(F.col("id").alias("request_id"), F.lit("Ford").alias("make"), F.lit("x").alias("model"), F.lit(2000).alias("year"))
    asked = asked.unionByName(asked.limit(3)).unionByName(spark.createDataFrame([(None, "Ford", "x", 2001), (900, "Audi", "x", 2001), (901, "Audi", "x", 2002), (902, "Ford", None, 2000)], "request_id long, make string, model string, year int"))
    got = fi.products_for_vehicle(ranges, asked).select(F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at"), "request_id", "sku")
    by = got.groupBy("request_id").agg(F.count("*").alias("n"), F.countDistinct(F.coalesce("sku", F.lit("none"))).alias("skus")).collect()
    assert {r["request_id"]: (r["n"], r["skus"]) for r in by} == {**{k: (20_000, 20_000) for k in (*range(150), None)}, 900: (9, 9)}
    before = F.lag("sku").over(W.partitionBy("task").orderBy("at"))
    tasks = got.withColumn("fresh", (~F.col("sku").eqNullSafe(before)).cast("int")).groupBy("task").agg(F.count("*").alias("n"), F.sum("fresh").alias("runs")).collect()
    assert len(tasks) > 1 and max(t["n"] for t in tasks) < 3_000_000
    assert sum(t["runs"] for t in tasks) < 45_000  # a list of up to 256 requests for each SKU, not a SKU a row
    assert fi.products_for_vehicle(ranges.limit(0), asked).count() == fi.products_for_vehicle(ranges, asked.limit(0)).count() == 0
