"""Near copies against brute force: every link is verified, and links out of SimHash's reach are found."""

import random

import corpus_pipeline
from skuscope.llm import nearcopies, simhash

R = random.Random(11)


def words(n):
    return ["".join(R.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def changed(base, places):
    return [f"x{R.random()}" if k in places else w for k, w in enumerate(base)]


def similarity(a, b):
    a, b = (nearcopies.shingles(x.encode().lower().split(), 5) for x in (a, b))
    return len(a & b) / len(a | b)


def test_links_are_verified(spark):
    texts = []
    for _ in range(12):
        base = words(150)
        texts += [" ".join(base), " ".join(changed(base, {40})), " ".join(changed(base, {20, 110})), " ".join(changed(base, set(range(3, 150, 9))))]
    # A chain: its ends are less similar than 0.8, its neighbours are not.
    chain = words(120)
    for k in range(5):
        texts.append(" ".join(chain))
        chain = changed(chain, {10 + 20 * k})
    # Swapped single words at the rate that SimHash forgives and the rule doesn't.
    near_only = words(300)
    texts += [" ".join(near_only), " ".join(changed(near_only, set(range(5, 300, 25))))]
    assert similarity(*texts[-2:]) < 0.8
    order = list(range(len(texts)))
    R.shuffle(order)
    texts = [texts[k] for k in order]
    component = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(texts[i], texts[j]) >= 0.8]
    for _ in texts:
        for i, j in pairs:
            component[i] = component[j] = min(component[i], component[j])
    assert any(bin((simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])) & (1 << 64) - 1).count("1") > 5 for i, j in pairs)
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (900, ""), (901, None)], "doc_id long, text string")
    got = dict(map(tuple, nearcopies.near_copies(docs).collect()))
    assert got == dict(enumerate(component)) | {900: 900, 901: 900}
    kept = [r["doc_id"] for r in corpus_pipeline.one_of_near_copies(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([*set(component), 900, None], key=str)
