"""Online packing, periodic runs and ranked search against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from skuscope.llm import online, periods, ranked
from skuscope.llm.tokens import tokenizer

R = random.Random(5)
WORDS = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta.", "Eta", "theta,", "iota!", "kappa2", "straße", "x_y"]
SCHEMA = "doc_id long, text string, n_words long, runs int, kept_text string, task long, window long, sequence_id long, term int, score long, rank int, item long, item_id long"


def text(n, words=WORDS):
    return " ".join(R.choice(words) for _ in range(n))


def looped(n, p):
    unit = [R.choice(WORDS) for _ in range(p)]
    return " ".join(unit[i % p] for i in range(n))


TABLE = [(i, text(R.randrange(1, 80))) for i in range(60)]
TABLE += [(70, None), (71, ""), (72, " \n\t\x0b "), (73, text(6000)), (74, looped(300, 7) + " end"), (75, "ha " * 5), (76, "ha " * 6), (77, "a\x0bb " * 4 + "c" + " d" * 40), (78, TABLE[3][1]), (78, TABLE[3][1]), (None, looped(50, 3)), (79, " x y " * 9), (80, text(900, ["a", "b"]))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 2, "k", 3, 4, 5, 6, 7, 8, 9, 10) for r in TABLE], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(x):
    return re.findall(r"[^\x20\x09-\x0D]+", x or "")


# periodic runs


def brute_runs(w):
    found = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > s and i + p - s >= max(6, 4 * p):
                found.setdefault((s, i + p - s), p)
            i += i == s
    return sorted((s, p, n) for (s, n), p in found.items())


def planted(doc_id, x):
    w = words_of(x)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def digests(doc_id, x):
    w = planted(doc_id, x)
    runs = brute_runs(w)
    gone = {i for s, p, n in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[2], r[0], r[1]), default=None)
    lines = "".join(f"{s},{n},{p}\n" for s, p, n in runs)
    kept = " ".join(y for i, y in enumerate(w) if i not in gone)
    sha = lambda y: hashlib.sha256(y.encode()).hexdigest()
    return (doc_id, len(runs), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4), sha(lines), sha(kept))


def test_periodic_runs_query(docs, none):
    got = Counter(map(tuple, periods.run_digests(periods.periodic_runs(periods.with_planted_runs(docs))).collect()))
    expected = Counter(digests(*r) for r in TABLE)
    assert got == expected
    assert sum(x[1] > 0 for x in expected) > 8
    assert periods.run_digests(periods.periodic_runs(periods.with_planted_runs(none))).count() == 0


def test_periodic_runs_keep_other_columns(docs, none):
    found = periods.periodic_runs(docs)
    assert found.columns == ["doc_id", *(c for c in docs.columns[5:]), "n_words", "runs", "kept_text"]
    row = found.filter("doc_id = 74").first()
    assert [tuple(x) for x in row.runs] == [(0, 300, 7)] and len(row.kept_text.split()) == 8 and row.n_words == 301 and row.task == 3
    assert {r.n_words for r in found.filter("doc_id in (70, 71, 72)").collect()} == {0}
    assert periods.periodic_runs(none).count() == 0


def test_runs_of_small_alphabets():
    for turn in range(60):
        many = [[R.randrange(k) for _ in range(R.randrange(0, 160))] for k in [R.choice([1, 2, 3, 5]) for _ in range(R.randrange(1, 9))]]
        for w in many:
            if len(w) > 9:
                a, p = R.randrange(len(w)), R.randrange(1, 12)
                for i in range(a + p, R.randrange(a, len(w))):
                    w[i] = w[i - p]
        doc, start, length, period = periods.runs_of(np.array([x for w in many for x in w], np.int64), np.array([len(w) for w in many], np.int64), most=R.choice([5, 1 << 19]))
        for k, w in enumerate(many):
            own = doc == k
            assert list(zip(start[own].tolist(), period[own].tolist(), length[own].tolist())) == brute_runs(w), turn


def test_extensions_of_the_grammar():
    text = np.array([-1, *(R.choice([1, 1, 2, 3]) for _ in range(90)), *([1, 2] * 40), *([4] * 30), -2], np.int64)
    grammar = periods.Grammar(text)
    pairs = [(R.randrange(1, 200), R.randrange(1, 200)) for _ in range(600)]
    pairs = [(i, j) for i, j in pairs if i != j]
    i, j = np.array(pairs).T

    def equal(a, b, step):
        n = 0
        while text[a] == text[b] and text[a] >= 0 and text[b] >= 0:
            a, b, n = a + step, b + step, n + 1
        return n

    assert grammar.extension(i, j).tolist() == [equal(a, b, 1) for a, b in pairs]
    assert grammar.extension(i, j, back=True).tolist() == [equal(a - 1, b - 1, -1) for a, b in pairs]


def test_a_word_repeated_needs_a_small_grammar():
    doc, start, length, period = periods.runs_of(np.zeros(200_000, np.int64), np.array([200_000]))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [200_000], [1])


# online packing


def checked_packing(rows, table, capacity, end_id=2):
    """Each id in one piece, sequences gapless, no padding; gives the number of sequences."""
    library = tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter()
    for doc_id, x in table:
        ids = [*library.encode(x or "", add_special_tokens=False).ids, end_id]
        expected[doc_id, struct.pack(f"<{len(ids)}I", *ids)] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.length > 0
        pieces[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
        sequences[r.sequence_id].append((r.offset, r.length))
    for (doc_id, tokens), found in pieces.items():
        whole = [k for k in expected if k[0] == doc_id and len(k[1]) == 4 * tokens]
        copies = sum(expected[k] for k in whole)
        assert len(whole) == 1 and sum(len(x) for _, x in found) == 4 * tokens * copies
        places = Counter()
        for start, x in found:
            assert whole[0][1][4 * start : 4 * start + len(x)] == x
            places.update(range(start, start + len(x) // 4))
        assert set(places.values()) == {copies} and len(places) == tokens
    assert {(k, len(x) // 4) for k, x in expected} == set(pieces)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
    return len(sequences)


@pytest.mark.parametrize("capacity, most, fan", [(64, 4, 2), (256, 32, 64), (50, 1, 2)])
def test_online_packing(docs, capacity, most, fan):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = online.pack_online(docs, path, capacity=capacity, open_windows=most, fan=fan).collect()
    if capacity & (capacity - 1) == 0:
        n = checked_packing(rows, TABLE, capacity)
        total = sum(r.length for r in rows)
        assert n <= total // capacity + capacity.bit_length()
    assert sum(r.length for r in rows) == sum({(r.doc_id, r.doc_tokens): r.doc_tokens * (2 if r.doc_id == 78 else 1) for r in rows}.values())


def test_online_packing_of_nothing(none):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert online.pack_online(none, path).count() == 0


def test_open_windows_are_bounded_and_best_fit():
    windows = online.OpenWindows(10, 2)
    assert windows.place(6) == [(0, 0, 6)] and windows.place(7) == [(1, 0, 7)]
    assert windows.place(3) == [(1, 7, 3)]  # the least room that holds it
    assert windows.place(9) == [(2, 0, 9)]
    assert windows.place(5) == [(2, 9, 1), (0, 6, 4)]  # none fits: the fullest is filled first, the rest fits then
    assert windows.place(25) == [(3, 0, 10), (4, 0, 10), (5, 0, 5)]
    for _ in range(500):
        windows.place(R.randrange(1, 14))
        assert len(windows.rooms) <= 2


def test_merging_keeps_every_place():
    for _ in range(50):
        contents = [[{"task": t, "window": w, "start": 0, "length": R.randrange(1, 16), "offset": 0}] for t in range(3) for w in range(R.randrange(1, 6))]
        found = online.merged(contents, 16, 3, last=True)
        assert not any(is_open for is_open, _ in found)
        sizes = [sum(s["length"] for s in x) for _, x in found]
        total = sum(s["length"] for x in contents for s in x)
        assert sum(sizes) == total and sum(n != 16 for n in sizes) == bin(total % 16).count("1")
        for _, x in found:
            assert [s["offset"] for s in x] == [sum(s["length"] for s in x[:k]) for k in range(len(x))]
        places = Counter((s["task"], s["window"], i) for _, x in found for s in x for i in range(s["start"], s["start"] + s["length"]))
        assert set(places.values()) == {1}


# ranked search

ITEMS = [(0, "alpha beta BETA kappa2"), (1, None), (2, ""), (3, "nowhere at all"), (4, "épsilon straße ÉPSILON"), (5, text(60)), (6, "x y"), (6, "x y"), (None, "theta!iota"), (7, "ha ha"), (8, "gamma")]


def brute_ranking(table, items, k):
    terms = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    counts = [(doc_id, Counter(terms(x))) for doc_id, x in table]
    counts = [x for x in counts if x[1]]
    documents, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, x in items:
        scored = []
        for doc_id, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * documents) // total
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(x) if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, gone, doc_id) in enumerate(sorted(scored)[:k], 1):
            out.append((item_id, rank, None if gone else doc_id, -score))
    return Counter(out)


@pytest.mark.parametrize("block_bytes, k", [(16 << 20, 10), (100, 3)])
def test_ranked_search(spark, docs, block_bytes, k):
    items = spark.createDataFrame([(*r, 1, 2, 3) for r in ITEMS], "item_id long, text string, rank int, doc_id long, score long").repartition(3)
    got = ranked.rank_documents(docs, items, k=k, block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute_ranking(TABLE, ITEMS, k)


def test_ranked_search_of_nothing(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked.rank_documents(none, items).count() == 0
    assert ranked.rank_documents(docs, items.limit(0)).count() == 0


def test_heaps_keep_ties_by_id():
    heaps = ranked._Heaps(2, 3)
    heaps.offer(np.array([[5, 0], [5, 1], [5, 0], [7, 0], [5, 2]]), np.array([9, 4, 6, 8, 1]), np.zeros(5, bool))
    heaps.offer(np.array([[5, 3], [6, 9]]), np.array([2, 3]), np.array([False, False]))
    found = list(zip(heaps.item.tolist(), heaps.score.tolist(), heaps.id.tolist()))
    assert found == [(0, 7, 8), (0, 6, 3), (0, 5, 1), (1, 9, 3), (1, 3, 2), (1, 2, 1)]
