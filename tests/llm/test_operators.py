"""The ten operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import io
import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from skuscope.llm import components, dedup, hamming, media, mixing, packing, shared, simhash, suffixes, tokens, toxicity, warc, wrappers

R = random.Random(11)
WORDS = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta.", "Eta", "theta,", "iota!", "kappa"]
PASSAGE = " ".join(R.choice(WORDS) for _ in range(40))


def text(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def made():
    base = [(i, text(R.randrange(1, 60)), "en", f"src{i % 4}", i) for i in range(30)]
    base += [(40, base[3][1], "en", "src0", 1), (41, PASSAGE + " one", None, None, 1), (42, "x " + PASSAGE, "en", None, 1), (43, None, None, "src1", None), (44, "", "en", "src1", 0), (45, " \n ", "en", "src2", 3)]
    base += [(46, text(9000), "en", "src2", 1), (47, base[5][1], "en", "src3", 1), (47, base[5][1], "en", "src3", 1), (None, base[6][1], "en", "src3", 1), (48, "aaaa" * 200, "de", "src3", 1), (49, "bb" + "aaaa" * 100, "de", "src3", 1)]
    return base


TABLE = made()


def rows():
    return TABLE


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rid long, id long, place int, size long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0.5, 7, 7, 7, 7) for r in rows()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def size_of(x):
    return len(re.findall(r"[^\x20\x09-\x0D]+", x or ""))


def test_mixing(docs, none):
    got = mixing.mix_sources(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((r[0] is None, r[0] or 0, size_of(r[1])) for r in rows())
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    total = sum(r["size"] for r in got)
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(1.5 * total)
    for v in by.values():
        assert v[0]["source_size"] == sum(r["size"] for r in v) and v[0]["target"] <= 2 * v[0]["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs).collect()))
    assert mixing.mix_sources(none).count() == 0
    mixed = mixing.repeated_documents(docs)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id", "text").count().count() <= docs.count() and mixing.repeated_documents(none).count() == 0


def test_targets_are_a_water_filling(spark):
    """Clamps the fullest sources at their cap, one after the other, and shares the rest by weight."""
    for seed in range(6):
        r = random.Random(seed)
        sizes = {f"s{k:02d}": r.choice([1, 3, 20, 200, 900]) for k in range(r.randrange(1, 12))}
        docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
        got = {x["source"]: x["target"] for x in mixing.mix_sources(docs).collect()}
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
        target, open_, total = {}, set(sizes), 1.5 * sum(sizes.values())
        while open_:
            left = total - sum(target.values())
            share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            over = {s for s in open_ if share[s] > 2 * sizes[s]}
            target |= {s: 2.0 * sizes[s] for s in over} if over else share
            open_ -= over or set(share)
        assert got == pytest.approx(target)


def test_damaged_archives():
    data = warc._gzip(b"a" * 5_000_000, 9) + warc._gzip(b"b", 1)
    parts = list(warc.inflated(io.BytesIO(data), 1000))
    assert b"".join(parts) == b"a" * 5_000_000 + b"b" and max(map(len, parts)) <= 1000
    for cut in (data[:-3], data[:2000], data[:9]):
        with pytest.raises(ValueError):
            list(warc.inflated(io.BytesIO(cut), 1000))


def brute_removal(table):
    first = {}
    out = []
    known = [(i, (t or "").encode()) for i, t, *_ in table]
    for i, raw in known:
        if i is not None:
            for k in range(len(raw) - 49):
                w = raw[k : k + 50]
                first[w] = min(first.get(w, i), i)
    for i, raw in known:
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49) if i is not None else ():
            if first[raw[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup(docs, none):
    got = dedup.remove_repeats(docs).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_removal(rows())
    assert dedup.remove_repeats(none).count() == 0
    left = dedup.without_repeats(docs)
    assert left.columns == docs.columns and left.count() == docs.count()


def common_prefix(a, b):
    return next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))


def test_suffix_sort_recurs_and_spills(monkeypatch):
    monkeypatch.setattr(suffixes, "_BASE", 4)  # so that names are sorted by induction, level by level
    for k in range(250):
        raw = bytes(R.choice(R.choice([b"ab", b"abc\x00", b"a", bytes(range(200))])) for _ in range(R.randrange(0, 200)))
        if k % 3 == 0:
            raw = (raw[:9] * 30)[:250] + raw
        order, common = suffixes.sorted_suffixes(raw, 9, memory=R.choice([40, 2000, 1 << 20]))
        cut = [raw[i : i + 9] for i in order]
        assert sorted(order.tolist()) == list(range(len(raw))) and cut == sorted(cut)
        assert all(common[k] == common_prefix(cut[k - 1], cut[k]) for k in range(1, len(cut)))


def test_suffix_sort_of_a_shard_far_larger_than_memory():
    words = [bytes(R.choice(b"abcdefghij") for _ in range(R.randrange(2, 9))) for _ in range(3000)]
    raw = np.frombuffer(b" ".join(R.choice(words) for _ in range(60_000)), np.uint8)
    memory = 1 << 14
    assert len(raw) > 20 * memory
    tracemalloc.start()
    want, _ = suffixes.sorted_suffixes(raw.tobytes(), 50, memory=1 << 28)
    whole = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    data, at = raw.tobytes(), len(raw)
    tracemalloc.start()
    for block, _ in suffixes.sorted_blocks(raw, 50, memory):
        for x, y in zip(block[::-1].tolist(), want[at - len(block) : at].tolist()):
            assert x == y or data[x : x + 50] == data[y : y + 50]
        at -= len(block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at == 0 and whole > 20 * len(raw) and peak < whole / 8, (peak, whole)


def test_oversized_places_are_cut_finer(spark):
    """One frequent string with many contexts, of which some repeat: places beyond 2,000 bytes are dealt again, twice."""
    frequent = "the very frequent string"
    contexts = [text(4)[:25].ljust(25, "x") for _ in range(12)]
    table = [(i, "".join(R.choice(contexts) + frequent + R.choice(contexts) for _ in range(R.randrange(1, 8))), "en", "s", 1) for i in range(60)]
    table += [(60 + i, contexts[0] + frequent * 9 + text(3), "en", "s", 1) for i in range(10)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for most in (2000, 1 << 25):
        got = dedup.remove_repeats(df, most=most).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted(map(tuple, got), key=str) == brute_removal(table)


def test_warc(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "ü" * 300_000, "x\r\n\r\nWARC/1.1", "<p>a</p>"]
    pages = spark.createDataFrame([(i if i < 6 else None, f"http://h/{i}" if i else None, h, 1, "z") for i, h in enumerate(html)], "page_id long, url string, html string, length int, archive string").repartition(2)
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert len(got) == 7
    for i, h in enumerate(html):
        raw = (h or "").encode()
        r = got[i if i < 6 else None]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert bytes(r["payload"]) == (raw if r["record_type"] == "response" else b"")
    assert [(got[i]["record_type"], got[i]["refers_to"]) for i in (0, 1, 2, 3)] == [("revisit", 1), ("response", None), ("revisit", 3), ("response", None)]
    assert got[None]["record_type"] == "response"
    assert warc.round_trip(pages.limit(0)).count() == 0


def page(body, nav="Home", foot="About us"):
    return f'<html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body><header class="site">Top</header><nav><ul><li><a href="/">{nav}</a></li></ul></nav><div class="ad-box">Buy!</div><article><h1>Head</h1>{body}</article><section id="comments"><p>first!</p></section><aside>side</aside><form><p>mail</p></form><footer>{foot}</footer></body></html>'


def test_html(spark):
    bodies = [f"<p>One&nbsp;&amp; <b>two</b>{i}<br>three\n\n four<p>five &lt;{i}" for i in range(8)]
    pages = [(i, f"http://h.example/{i}", page(b), "t", 3) for i, b in enumerate(bodies)] + [(20, None, None, "t", 3), (21, "bad url", "", "t", 3), (22, "http://x/", "plain text only", "t", 3), (23, "http://x/", "<p>cut &am", "t", 3), (24, "http://x/", page("<p>y</p>")[:-30] + "<a href='", "t", 3), (25, "http://q/", "<div>" * 300 + "deep", "t", 3)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string, host int")
    got = {r["page_id"]: r for r in wrappers.extract_main_text(df).collect()}
    for i in range(8):
        assert got[i]["text"] == f"One & two{i} three four five <{i}"  # the heading is the same on all pages
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert got[20]["text"] == "" and got[21]["text"] == "" and got[22]["text"] == "plain text only" and got[23]["text"] == "cut &am" and got[24]["text"] == "Head y" and got[25]["text"] == "deep"
    assert wrappers.extract_main_text(df.limit(0)).count() == 0


def test_wrapper_marks_constant_nodes(spark):
    html = [page(f"<p>text {i}</p><div>Read all our articles</div>") for i in range(6)]
    df = spark.createDataFrame([(i, "http://h/", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    texts = {r["text"] for r in wrappers.extract_main_text(df).collect()}
    assert texts == {f"text {i}" for i in range(6)}


def test_top_k(spark):
    vectors = [(i, [R.gauss(0, 1) for _ in range(64)]) for i in range(300)]
    vectors += [(300 + i, vectors[0][1]) for i in range(40)] + [(400, None), (401, []), (None, vectors[1][1]), (450, [None] * 64), (500, vectors[7][1]), (500, vectors[7][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    code = lambda v: [int(x is not None and x > 0) for x in (v or [])] + [0] * (64 - len(v or []))
    known = {i: code(v) for i, v in vectors if i is not None}
    want = []
    for q in known:
        if q % 50 == 0:
            near = sorted((sum(a != b for a, b in zip(known[q], known[o])), o) for o in known)[:10]
            want += [(q, k + 1, o, d) for k, (d, o) in enumerate(near)]
    assert sorted(map(tuple, hamming.top_k(df, shard=90).collect())) == sorted(want)
    assert sorted(map(tuple, hamming.top_k(df, shard=9).collect())) == sorted(want)
    assert hamming.top_k(df.limit(0)).count() == 0


def test_top_k_of_long_and_odd_vectors(spark):
    base = [[R.gauss(0, 1) for _ in range(n)] for n in (64, 65, 130, 1) for _ in range(40)]
    base += [base[0] + [1.0], base[0] + [-1.0], [float("nan")] * 3, [float("nan"), 1.0]]
    df = spark.createDataFrame([*enumerate(base)], "vec_id long, embedding array<double>")
    signs = lambda v: [int(x > 0) for x in v] + [0] * (130 - len(v))
    known = {i: signs(v) for i, v in enumerate(base)}
    want = []
    for q in known:
        if q % 50 == 0:
            want += [(q, r + 1, o, dist) for r, (dist, o) in enumerate(sorted((sum(a != b for a, b in zip(known[q], known[o])), o) for o in known)[:10])]
    assert sorted(map(tuple, hamming.top_k(df).collect())) == sorted(want)


def test_media(docs, none):
    got = {r["doc_id"]: r for r in media.stored_digests(docs).collect()}
    for i, t, *_ in rows():
        raw = (t or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert media.stored_digests(none).count() == 0
    long = media.to_media(bytes(range(192)) * 1000)
    found = media.probe(long)
    assert found["codec"] == "raw " and len(found["starts"]) == 1000 and media.samples(long, found) == bytes(range(192)) * 1000
    assert media.probe(None) is None and media.probe(long[:900]) is None and media.probe(b"junk") is None


def track_of(movie, kind=b"trak"):
    at = movie.index(kind) - 4
    return movie[at : at + int.from_bytes(movie[at : at + 4], "big")]


def test_tracks_are_read_apart():
    movie = media.to_media(b"x" * 192 * 30)
    track = track_of(movie)
    stss = track_of(track, b"stss")
    silent = track.replace(stss, len(stss).to_bytes(4, "big") + b"free" + stss[8:]).replace(b"vide", b"soun")
    head, moov = movie[: movie.index(b"moov") - 4], track_of(movie, b"moov")
    rest = moov[8:].replace(track, b"")
    both = lambda *tracks: head + media._box(b"moov", rest, *tracks)
    assert media.probe(both(silent, track))["keys"].tolist() == [0, 12, 24]  # the video track, though second
    assert media.probe(both(silent))["keys"].tolist() == list(range(30)) and media.probe(both(silent))["width"] is None
    # Compact sizes say the same.
    for bits, packed in ((8, bytes([192] * 30)), (16, b"\0\xc0" * 30)):
        compact = media._full(b"stz2", b"\0\0\0" + bytes([bits]), (30).to_bytes(4, "big"), packed)
        boxes = media._tracks(movie)[0]
        del boxes[b"stsz"]
        boxes[b"stz2"] = (len(movie) + 8, len(movie) + len(compact))
        assert media.samples(movie, media._read_track(movie + compact, boxes)) == b"x" * 192 * 30
    for field, value in ((b"mdhd", 12), (b"stts", 4), (b"stsz", 8), (b"stco", 4), (b"stsc", 4)):
        at = movie.index(field) + 4 + value
        assert media.probe(movie[:at] + b"\xff\xff\xff\xf0" + movie[at + 4 :]) is None or field == b"mdhd"
        zero = media.probe(movie[:at] + bytes(4) + movie[at + 4 :])
        assert zero is None


def test_damaged_containers_never_raise(spark):
    movie = media.to_media(bytes(range(192)) * 20)
    r = random.Random(9)
    damaged = []
    for _ in range(3000):
        raw = bytearray(movie[: r.randrange(len(movie))] if r.random() < 0.3 else movie)
        for _ in range(r.randrange(0, 12)):
            if raw:
                at = r.randrange(max(0, len(raw) - 700), len(raw)) if r.random() < 0.8 else r.randrange(len(raw))
                raw[at] = r.choice([0, 1, 255, r.randrange(256)])
        damaged.append(bytes(raw))
        found = media.probe(damaged[-1])
        if found is not None:
            assert len(found["starts"]) == len(found["ends"]) and (found["ends"] <= len(raw)).all() and (found["starts"] >= 0).all() and np.isfinite(found["duration"])
            media.samples(damaged[-1], found)
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(damaged[:200])] + [(None, None)], "id int, media binary")
    assert media.media_columns(df).count() == 201


def test_packing(docs, none):
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    encode = tokens.tokenizer(path).encode
    got = packing.pack_documents(docs, path, capacity=64).collect()
    ids = {}
    for i, t, *_ in rows():
        ids.setdefault(i, encode(t or "", add_special_tokens=False).ids + [0])
    bins, pieces = {}, 0
    for r in got:
        own = np.frombuffer(r["ids"], "<u4").tolist()
        assert own == ids[r["doc_id"]][r["start"] : r["start"] + 64] and r["start"] == 64 * r["piece"] and len(own) == r["length"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces += 1
    assert pieces == sum(-(-len(ids[i]) // 64) for i, *_ in rows())
    for v in bins.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 64
    shuffled = packing.pack_documents(docs, path, capacity=64, broadcast_tasks=0)
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, got))
    assert packing.pack_documents(none, path).count() == 0


def optimum(items, capacity):
    items = sorted(items, reverse=True)
    best = len(items)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for j in sorted(set(rooms)):
            if j >= items[k]:
                rest = list(rooms)
                rest.remove(j)
                go(k + 1, [*rest, j - items[k]])
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best


def test_dominance_keeps_an_optimum():
    for _ in range(150):
        items = [R.randrange(1, 20) for _ in range(R.randrange(1, 9))]
        counts = {x: items.count(x) for x in items}
        left = packing.Instance(counts)
        fixed = packing.reduce_by_dominance(left, 20)
        used = sum(n for _, n in fixed)
        rest = [x for x, n in left.counts.items() for _ in range(n)]
        assert all(sum(p) <= 20 for p, _ in fixed) and used + optimum(rest, 20) == optimum(items, 20)
        plan = packing.plan(counts, 20)
        assert all(sum(b - a for x, a, b, *_ in plan if x == y) == n for y, n in counts.items())
        bins = {first + k for _, a, b, first, each, _ in plan for k in range(-(-(b - a) // each))}
        assert optimum(items, 20) <= len(bins) <= optimum(items, 20) + 1


def test_token_counts(docs, none):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    encode = tokens.tokenizer(path).encode
    got = sorted(map(tuple, tokens.count_tokens(docs, path, limit=50).collect()), key=str)
    n = lambda t: len(encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((i, len((t or "").encode()), n(t), n(t) > 50) for i, t, *_ in rows()), key=str)
    assert tokens.count_tokens(none, path).count() == 0
    cut = tokens.splitter(tokens.tokenizer(path))
    for _ in range(2000):
        t = "".join(R.choice(["a", "b ", " ", "  ", "\n", " \n", "\t", "'s", "'S", "1", "é", ".", "<|endoftext|>", "\u00a0", "\u3000", "\x1c", "don't", "日本", "²"]) for _ in range(R.randrange(0, 12)))
        assert "".join(cut(t)) == t and sum(n(x) for x in cut(t)) == n(t), repr(t)
    assert len(cut("    if x:\n        return  y  ")) > 6  # indented text is no whole word
    with pytest.raises(ValueError):
        tokens.splitter(tokens.tokenizer(str(public_tokenizers.path("word_bpe_49k.json"))))
    empty = docs.filter("doc_id in (43, 44)").coalesce(1)
    assert [r["n_tokens"] for r in tokens.count_tokens(empty, path).collect()] == [0, 0]


def brute_fingerprint(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not words:
        return 0
    parts = [" ".join(words)] if len(words) < 3 else [" ".join(words[k : k + 3]) for k in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_simhash(docs, none):
    table = [(i, brute_fingerprint(t)) for i, t, *_ in rows()]
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    group = {f: {f} for _, f in table}
    for a in list(group):
        for b in list(group):
            if (a ^ b).bit_count() <= 3 and group[a] is not group[b]:
                both = group[a] | group[b]
                for x in both:
                    group[x] = both
    want = sorted(((i, f"{f:016x}", min(j for j, g in table if g in group[f] and j is not None)) for i, f in table), key=str)
    assert got == want
    assert simhash.near_duplicates(none).count() == 0


def test_crowded_cells_lose_no_link(spark):
    centre = R.getrandbits(64)
    prints = {centre}
    for _ in range(150):
        x = R.choice(sorted(prints))
        for _ in range(R.randrange(1, 4)):
            x ^= 1 << R.randrange(64)
        prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for crowded, grid in itertools.product((1, 16, 1000), ((2, 1), (6, 3), (8, 3), (10, 3))):
        links = simhash.near_links(df, crowded=crowded, grid=grid, chunk=20)
        if crowded == 1000:
            want = {(b, a) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
            assert {tuple(r) for r in links.collect()} == want
        found = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
        assert {found[x] for x in signed} == {min(signed)}  # each was made within three bits of another


def test_no_side_that_grows_is_broadcast_by_its_expected_size(spark, docs, monkeypatch):
    plans = []

    def noted(df, name, write=simhash.written):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(simhash, "written", noted)
    monkeypatch.setattr(components, "written", noted)
    found = simhash.near_duplicates(docs)
    assert found.count() == docs.count()
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    components.connected_components(spark.createDataFrame([(i, i + 1) for i in range(100)], "u long, v long"), task_links=30)
    assert sum(plan.count("SortMergeJoin") for plan in plans) >= 6
    for plan in plans:  # the sizes of crowded cells are broadcast behind a count
        assert plan.count("BroadcastHashJoin") == 2 * ("FlatMapGroupsInArrow" in plan)


def test_few_rows_are_broadcast_behind_a_count(spark):
    rows = spark.range(5000)
    joined = lambda most: rows.join(shared.broadcast_few(rows, most), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in joined(5000) and "SortMergeJoin" in joined(4999) and "BroadcastHashJoin" not in joined(4999)


def test_grids_follow_the_number_of_fingerprints():
    assert [simhash.grid_for(n, 3) for n in (0, 100_000, 1_000_000, 10_000_000, 10**9)] == [(2, 1), (2, 1), (8, 3), (10, 3), (20, 3)]
    assert simhash.reach_of(3, 2, 1) == 1 and simhash.reach_of(3, 8, 3) == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (300, 300), (200, 150)] + [(-5, k) for k in range(1000, 1100)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and got[200] == got[150] == 100 and got[1050] == -5 and 300 not in got
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_links_of_a_few_tasks_have_the_same_components(spark):
    r = random.Random(4)
    for n, k in ((400, 300), (60, 200), (500, 499)):
        links = [(r.randrange(-n, n), r.randrange(-n, n)) for _ in range(k)] + [(None, 1)] if n - k != 1 else [(i, i + 1) for i in r.sample(range(n), n)]
        least = {x: x for pair in links for x in pair if None not in pair and pair[0] != pair[1]}
        for _ in least:
            for a, b in links:
                if a in least and b in least:
                    least[a] = least[b] = min(least[a], least[b])
        for task_links in (50, 10**6):
            got = components.connected_components(spark.createDataFrame(links, "u long, v long"), task_links=task_links)
            assert {tuple(x) for x in got.collect()} == set(least.items())


def test_components_of_few_links_take_few_jobs(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    spark.sparkContext.setJobGroup("components", "components")
    try:
        components.connected_components(links)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 5


def test_toxicity(spark, none):
    bad = ["scumlord", "idiotic", "worthlessly"]
    table = []
    for i in range(600):
        words = text(R.randrange(5, 60)).split()
        toxic = i % 4 == 0
        for _ in range(R.randrange(1, 4)) if toxic else ():
            words.insert(R.randrange(len(words)), R.choice(bad))
        table.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in table] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in table] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train_on_labels(docs, labels)
    scored = {r["doc_id"]: r for r in toxicity.score_toxicity(docs.withColumn("score", F.lit("x")), model).collect()}
    held = [(i, y) for i, _, y in table if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(scored[i]["predicted"] == y for i, y in held) >= 0.97 * len(held)
    assert scored[900]["score"] == scored[901]["score"] and 0 <= scored[900]["score"] <= 1
    assert toxicity.score_toxicity(none, model).count() == 0
    # Labels of held-out rows don't reach any score.
    other = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in table] + [(None, 1), (5, None)], "doc_id long, toxic int")
    again = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, toxicity.train_on_labels(docs, other)).collect()}
    assert again == {i: r["score"] for i, r in scored.items()}
    # The scores are those of a plain classifier over the same n-grams: brute-force counts of texts by n-gram.
    grams = lambda t: set(toxicity.hashed(t).tolist())
    trained = [(t, y) for i, t, y in table if i != 5 and zlib.crc32(str(i).encode()) % 3 != 1] + [(table[5][1], 0)]
    texts = [sum(y == k for _, y in trained) for k in (0, 1)]
    counts = [Counter(g for t, y in trained if y == k for g in grams(t)) for k in (0, 1)]
    for g in list(counts[1])[:2000]:
        a, b = counts[1][g] + 1, counts[0][g] + 1
        ratio = math.log(a / (texts[1] + 2)) - math.log(b / (texts[0] + 2))
        silent = abs(ratio) <= 3 * math.sqrt(1 / a + 1 / b) or a + b < 5
        assert (model.weights[g] == 0) == silent
    long = spark.createDataFrame([(1, "word " * 200_000 + bad[0]), (1, "word " * 200_000 + bad[0]), (2, "")], "doc_id long, text string")
    assert len({r["score"] for r in toxicity.score_toxicity(long, model).collect()}) == 2
    untrained = toxicity.train_on_labels(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score_toxicity(docs, untrained).collect()} == {0.5}
    # A bound on bytes keeps the first rows of each label, and some of both.
    small = toxicity.train_on_labels(docs, labels, max_fit_bytes=20_000)
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, small).collect()}
    assert sum(found[i] == y for i, y in held) >= 0.95 * len(held)
    sample = spark.createDataFrame([(y, f"{i:03}", bytes(50 + i)) for i in range(40) for y in (0, 1)], "label int, turn string, places binary")
    for most, n in ((1 << 20, 80), (400, 6), (1, 2)):
        rows, marks = toxicity._bounded(sample, most)
        assert len(rows) == n and sorted(marks.tolist()) == [0] * (n // 2) + [1] * (n // 2) and (n == 2 or sum(map(len, rows)) <= most)


def test_media_columns_replace_columns_of_their_names(docs):
    stored = media.store_as_media(docs).withColumn("codec", F.lit(1)).withColumn("keyframes", F.lit("x"))
    row = media.media_columns(stored).filter("id = 41").select("codec", "keyframes", "n_samples").first()
    assert isinstance(row.codec, str) and row.keyframes and row.n_samples > 0


def test_warc_of_repeated_rows(spark):
    rows = [(5, "http://h/", "same"), (5, "http://h/", "same"), (3, "http://h/", "same"), (7, "http://h/", "other"), (7, "http://h/", "other"), (None, "http://h/", "same")]
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    # Rows with the payload's largest id are responses, however often they stand there, as are rows without an id.
    assert got == {(5, "response", None): 2, (3, "revisit", 5): 1, (7, "response", None): 2, (None, "response", None): 1}
