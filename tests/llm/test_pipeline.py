"""The pipeline on a small corpus: decisions take effect, clean documents stay, whole tables go through."""

import os
import random

import corpus_pipeline
from skuscope.llm.shared import written

R = random.Random(3)


def sentence(n):
    return " ".join("".join(R.choice(["ka", "lo", "mi", "ru", "te", "so"]) for _ in range(R.randrange(2, 5))) for _ in range(n))


def test_stages(spark, tmp_path):
    bad = ["scumlord", "idiotic"]
    clean = [(i, sentence(60), "en", f"s{i % 3}", 1) for i in range(240)]
    toxic = [(1000 + i, sentence(30) + " " + " ".join(R.choice(bad) for _ in range(4)) + " " + sentence(30), "en", "s0", 1) for i in range(120)]
    passage = sentence(80)
    shared = [(2000, "one " + passage + " " + sentence(40), "en", "s1", 1), (2001, "two " + passage + " " + sentence(50), "en", "s2", 1)]
    copies = [(3000 + i, clean[7][1], "en", "s1", 1) for i in range(5)]
    odd = [(4000, None, "en", "s1", None), (None, sentence(20), None, None, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([*clean, *toxic, *shared, *copies, *odd], schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 1000)) for i in [*range(240), *range(1000, 1120)]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, columns, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), None, {}
    for name, stage in corpus_pipeline.STAGES:
        columns = columns or docs.columns
        docs = written(stage(spark, docs, str(tmp_path)), name)
        kept[name] = docs
        assert name == "best_fit_packing" or docs.columns == columns
    ids = lambda name: {r["doc_id"] for r in kept[name].select("doc_id").collect()}
    assert not ids("toxicity") & set(range(1000, 1120)) and len(ids("toxicity") & set(range(240))) >= 238
    near = ids("simhash_near_dedup")
    assert 7 in near and not near & set(range(3000, 3005)) and None in near
    texts = {r["doc_id"]: r["text"] for r in kept["suffix_array_dedup"].collect()}
    assert passage in texts[2000] and passage not in texts[2001] and texts[2001].startswith("two")
    assert {r["text"] for r in kept["mixing"].collect()} <= set(texts.values())
    bins = kept["best_fit_packing"].groupBy("sequence_id").sum("length").collect()
    assert bins and all(r[1] <= 2048 for r in bins)


CLASH = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, rid long, id long, place int, size long, node long, component_id long, fp long, bands string, component string, row string, label int"


def through(spark, folder, rows):
    spark.createDataFrame(rows, CLASH).repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, found = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), name)
        assert name == "best_fit_packing" or docs.columns == columns
        found[name] = docs
    return found


def test_clashing_columns_repeated_rows_and_long_texts(spark, tmp_path):
    extra = (0.25, 9, 1, 2, 3, 4, 5, 6, 7, "b", "c", "r", 8)
    long = sentence(20_000)
    rows = [(i, sentence(40), "en", "s0", 1, *extra) for i in range(8)]
    rows += [(100, long, "en", "s1", 1, *extra)] * 2 + [(3, rows[3][1], "en", "s0", 1, *extra), (None, None, None, None, None, *extra)]
    found = through(spark, str(tmp_path), rows)
    near = found["simhash_near_dedup"]
    assert {(r["score"], r["predicted"], r["row"]) for r in near.collect()} == {(0.25, 9, "r")}
    assert sorted(r["doc_id"] for r in near.filter("doc_id is not null").collect()) == [*range(8), 100]  # repeated rows stay once
    assert near.filter("doc_id is null").count() == 1
    assert {r["text"] for r in found["suffix_array_dedup"].filter("doc_id = 100").collect()} == {long}
    assert found["best_fit_packing"].count() > 20


def test_empty_table(spark, tmp_path):
    assert {name: docs.count() for name, docs in through(spark, str(tmp_path), []).items()} == dict.fromkeys([n for n, _ in corpus_pipeline.STAGES], 0)


def test_run_leaves_its_result_only(spark, tmp_path):
    rows = [(i, sentence(40), "en", "s0", 1, *[None] * 13) for i in range(6)]
    through(spark, str(tmp_path), rows)
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/skuscope"
    before = set(os.listdir(root))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert len([x for x in set(os.listdir(root)) - before if not x.startswith(".")]) == 1
