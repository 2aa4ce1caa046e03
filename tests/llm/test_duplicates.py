"""Near-duplicates and repeated strings against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ratelens.llm import common, near_embeddings, repeat_removal, simhash_dedup


def reached(n, links):
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def plain_fingerprint(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


@pytest.fixture(scope="module")
def near_texts(odd_texts):
    rnd = random.Random(1)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(3000)) for _ in range(3)]
    near = [b[:i] + "x" + b[i + 1 :] for b in base for i in rnd.sample(range(3000), 25)]
    return [*odd_texts[:60], *base, *near, base[0], None]


@pytest.mark.parametrize("block", [8192, 3])
def test_simhash_components(documents, near_texts, block, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "BLOCK", block)
    rows = {r.doc_id: r for r in simhash_dedup.simhash_components(documents(near_texts)).collect()}
    prints = [plain_fingerprint(t) for t in near_texts]
    links = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert [rows[i].fingerprint for i in range(len(prints))] == [f"{p:016x}" for p in prints]
    assert [rows[i].component_id for i in range(len(prints))] == reached(len(prints), links)


def plain_near(texts, radius, verify):
    """Links of texts whose own five-word prints are near in 64 and in 192 bits."""
    every = [simhash_dedup.wide_fingerprints([simhash_dedup.text_hashes((t or "").encode(), 5)]) for t in texts]
    prints, wide = np.array([x[0][0] for x in every]), np.array([[w[0] for w in x[1:]] for x in every])
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= radius
    near &= np.bitwise_count(wide[:, None] ^ wide[None]).astype(int).sum(axis=2) <= verify
    return [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a > b]


@pytest.mark.parametrize("block", [8192, 3])
def test_links_are_verified_on_further_bits(documents, near_texts, block, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "BLOCK", block)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    edited = [" ".join(rnd.choice("xyz") + w if rnd.random() < rate else w for w in words) for rate in (0.01, 0.02, 0.04, 0.08) for _ in range(12)]
    texts = [*near_texts, *edited, "one two", "one two", "one three"]
    links = {(radius, verify): plain_near(texts, radius, verify) for radius, verify in [(10, 192), (10, 36), (10, 20)]}
    assert len(links[10, 192]) > len(links[10, 36]) > len(links[10, 20]) > 0
    for (radius, verify), pairs in links.items():
        label = reached(len(texts), pairs)
        kept = simhash_dedup.representatives(documents(texts), radius=radius, shingle=5, verify=verify).collect()
        assert sorted(r.doc_id for r in kept) == [i for i, x in enumerate(label) if i == x], (radius, verify)


def test_texts_of_one_fingerprint_are_told_apart_by_further_bits(documents, monkeypatch):
    """With prints of three bits only, most texts share one; none is dropped that is far from all others."""
    own = simhash_dedup.wide_fingerprints
    monkeypatch.setattr(simhash_dedup, "wide_fingerprints", lambda hashes: [own(hashes)[0] & np.uint64(7), *own(hashes)[1:]])
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 4) for _ in range(60)) for _ in range(40)]
    texts += [t + " z" for t in texts[:10]] + texts[:5]
    every = [own([simhash_dedup.text_hashes(t.encode(), 5)]) for t in texts]
    wide = np.array([[w[0] for w in x[1:]] for x in every])
    near = np.bitwise_count(wide[:, None] ^ wide[None]).astype(int).sum(axis=2) <= 36
    label = reached(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if near[a, b]])
    kept = simhash_dedup.representatives(documents(texts), radius=10, shingle=5, verify=36).collect()
    assert sorted(r.doc_id for r in kept) == [i for i, x in enumerate(label) if i == x] and len(kept) >= 40


def test_further_bits_differ_from_the_fingerprint():
    hashes = [[int(x) for x in np.random.default_rng(i).integers(0, 1 << 63, 40, dtype=np.uint64) * 2] for i in range(200)]
    every = simhash_dedup.wide_fingerprints([*hashes, []])
    assert np.array_equal(every[0], simhash_dedup.fingerprints([*hashes, []])) and all(p[-1] == 0 for p in every)
    for i, p in enumerate(every):
        for q in every[:i]:
            assert abs(np.bitwise_count(p[:-1] ^ q[:-1]).mean() - 32) < 1


@pytest.mark.parametrize("radius", [4, 10])
def test_every_plan_covers_the_radius(radius):
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 63, 500, dtype=np.uint64) & np.uint64(0x0F0F0F0F0F0F0F0F)
    for total in (10, 10_000, 10**7, 10**10):
        plan = simhash_dedup.choose(prints, total, radius)
        for _ in range(200):
            bits = rng.choice(64, rng.integers(0, radius + 1), replace=False)
            change = sum(1 << int(b) for b in bits)
            assert any((mask & change).bit_count() <= t for mask, t in plan)


@pytest.mark.parametrize("radius", [4, 10])
@pytest.mark.parametrize("block", [8192, 40, 3])
def test_probes_find_all_near_prints(spark, radius, block, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "BLOCK", block)
    plans = []
    choose = simhash_dedup.choose
    monkeypatch.setattr(simhash_dedup, "choose", lambda prints, total, radius: plans.append(choose(prints, 10**8, radius)) or plans[-1])
    rng = random.Random(radius)
    prints = {0, (1 << 64) - 1}
    for size in (2, 2, 3, 5, 60):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius))) for _ in range(size)}
    prints = sorted(prints)
    rows = spark.createDataFrame([(p - (p >> 63 << 64),) for p in prints], "fp long")
    found = {r.node: r.component for r in common.components(simhash_dedup.linked_prints(rows, radius), "a", "b").collect()}
    assert max(t for _, t in plans[0]) >= 1  # else nothing probes
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]
    label = reached(len(prints), links)
    groups = {}
    for i, p in enumerate(prints):
        signed = p - (p >> 63 << 64)
        groups.setdefault(label[i], set()).add(found.get(signed, signed))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_representatives_keep_columns(documents):
    docs = documents(["a b c d e f", "a b c d e f", "", None, "q w e r t y"], [5, 3, 9, 8, None]).withColumn("fp", F.lit("own"))
    kept = simhash_dedup.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [3, 8] and kept.where("doc_id IS NULL").count() == 1
    assert simhash_dedup.simhash_components(docs.limit(0)).count() == 0


def test_repeated_rows_and_ids(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(5, text), (5, text), (5, "other words here"), (3, text), (3, text), (None, text), (9, "other words here"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_ID2", F.lit(1))
    got = simhash_dedup.simhash_components(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got if r.component_id is not None) == [(0, 3), (3, 3), (3, 3), (5, 3), (5, 3), (5, 5), (9, 5)]
    kept = simhash_dedup.representatives(docs).collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept) == sorted([(0, ""), (0, text), (3, text), (5, "other words here")])


def test_components(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)]
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = {r.node: r.component for r in common.components(df, "a", "b").collect()}
    wanted = reached(260, links)
    assert all(got.get(i, i) == wanted[i] for i in range(260))
    assert common.components(df.limit(0), "a", "b").count() == 0


def plain_removal(texts):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for t in raw:
        for p in range(len(t) - 199):
            seen[t[p : p + 200]] = seen.get(t[p : p + 200], 0) + 1
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p : p + 200] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def repeating_texts(odd_texts):
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choice("abcdé fg\n") for _ in range(n))
    passage = word(450)
    around = [word(rnd.randint(0, 300)) + passage[rnd.randint(0, 120) : rnd.randint(300, 450)] + word(rnd.randint(0, 300)) for _ in range(40)]
    mutated = [passage[:i] + "#" + passage[i + 1 :] for i in range(0, 450, 9)]
    return [None, "", word(199), word(200), *around, *mutated, passage * 2, "ab" * 300, "z" * 450, "z" * 201, word(900), around[0], around[0], *odd_texts[400:430]]


@pytest.mark.parametrize("in_task,gathered,chunk", [(16_384, 4096, 1 << 21), (2, 5, 700)])
def test_repeats(documents, repeating_texts, in_task, gathered, chunk, monkeypatch):
    monkeypatch.setattr(repeat_removal, "IN_TASK", in_task)
    monkeypatch.setattr(repeat_removal, "GATHERED", gathered)
    rows = repeat_removal.repeats_removed(documents(repeating_texts).repartition(3)).collect()
    wanted = plain_removal(repeating_texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert len(rows) == len(wanted) and all(got[i] == w for i, w in enumerate(wanted))


def test_window_ranks_follow_the_order_of_bytes():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 3, 900).astype(np.uint8)
    data[300:600] = data[:300]
    got = repeat_removal.window_ranks(data)[:701]
    windows = [data[i : i + 200].tobytes() for i in range(701)]
    assert sorted(range(701), key=lambda i: (windows[i], i)) == np.argsort(got, kind="stable").tolist()
    assert len(set(windows)) == len(set(got.tolist())) and got[0] == got[300]


def test_hashes_of_runs_don_t_depend_on_what_is_around():
    a, b = (np.frombuffer(x, np.uint8) for x in (b"xx run yy", b"run" * 9))
    assert common.run_hashes(a)(np.array([3]), np.array([6])) == common.run_hashes(b)(np.array([6]), np.array([9]))


def test_heavy_keys_join_like_others(spark):
    left = spark.createDataFrame([(i % 7 if i % 3 else 99, i) for i in range(200)], "k long, x long")
    right = spark.createDataFrame([(k, k * 10) for k in (1, 2, 3, 99, 500)], "k long, y long")
    got = common.heavy_join(left, right, ["k"], spark.createDataFrame([(99,)], "k long"))
    assert sorted(map(tuple, got.select("k", "x", "y").collect())) == sorted(map(tuple, left.join(right, "k").select("k", "x", "y").collect()))


def test_phrases_cover_each_window_once():
    rng = np.random.default_rng(1)
    data, offsets = rng.integers(97, 100, 5000).astype(np.uint8), np.array([0, 150, 150, 900, 5000])
    data[2000:3500] = np.resize(data[2000:2007], 1500)  # periodic
    text, start, n, times, _, _ = repeat_removal.phrases(data, offsets)
    assert times.max() > 1
    windows = sorted((t, p) for t, a, k in zip(text.tolist(), start.tolist(), (n * times).tolist()) for p in range(a, a + k))
    assert windows == [(t, p) for t in range(4) for p in range(max(0, offsets[t + 1] - offsets[t] - 199))]


def test_kept_texts_of_documents(documents):
    passage = "é" * 110
    docs = documents(["x" + passage + " tail", "head " + passage, "short", None], [1, 2, 3, None])
    docs = docs.withColumns({c: F.lit(c) for c in ("k1", "kept", "gram", "own_0", "runs")})
    out = repeat_removal.with_repeats_removed(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted((r.doc_id or 0, r.text, r.n_chars) for r in rows) == [(0, None, None), (1, "x tail", 6), (2, "head ", 5), (3, "short", 5)]
    assert all((r.k1, r.kept, r.own_0) == ("k1", "kept", "own_0") for r in rows)
    assert repeat_removal.repeats_removed(docs.limit(0)).count() == 0


VECTORS = "vec_id long, embedding array<double>, label int"


def plain_links(rows, threshold=0.93):
    good = [(i, np.array(v, float), l) for i, v, l in rows if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    return [(a, b) for a, x, l in good for b, y, m in good if a != b and l == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold]


@pytest.mark.parametrize("block", [2048, 16])
def test_embeddings(spark, block, monkeypatch):
    monkeypatch.setattr(near_embeddings, "COUNT_BLOCK", block)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + rng.standard_normal(16) * (0.05 if i % 3 else 0.35)).tolist(), int(i % 12 % 3)) for i in range(240)]
    rows += [(240 + i, rows[0][1], 0) for i in range(40)] + [(300, (np.array(rows[0][1]) * 1e200).tolist(), 0), (301, rows[0][1], None), (302, None, 0), (303, [0.0] * 16, 0), (304, [float("nan")] * 16, 0), (305, [None] * 16, 0), (306, [float("inf")] * 16, 0), (307, [1.0], 0), (308, [], 0)]
    links = [p for p in plain_links(rows[:280] + rows[281:])]
    got = {r.vec_id: r for r in near_embeddings.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert len(got) == len(rows)
    big = {(300, b) for a, b in links if a == 0} | {(b, 300) for a, b in links if a == 0} | {(0, 300), (300, 0)}
    every = links + list(big)
    label = reached(310, every)
    for i, _, _ in rows:
        assert got[i].n_links == sum(a == i for a, _ in every), i
        assert got[i].component_id == label[i] and got[i].kept == (label[i] == i)
    assert near_embeddings.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_links_between_dense_groups_are_kept(spark):
    rng = np.random.default_rng(11)
    a, b = np.linalg.qr(rng.standard_normal((32, 2)))[0].T
    other = 0.945 * a + np.sqrt(1 - 0.945**2) * b
    rows = [(i, ((a if i < 300 else other) + rng.standard_normal(32) * 0.01).tolist(), 0) for i in range(600)]
    links = plain_links(rows)
    found = {r.vec_id: r for r in near_embeddings.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert any(i < 300 <= j for i, j in links)
    label = [0] * 600  # one part: the dense groups are linked inside and across
    assert [(found[i].n_links, found[i].component_id) for i in range(600)] == [(sum(x == i for x, _ in links), label[i]) for i in range(600)]


def test_pairs_beside_a_hot_group_are_found(spark, monkeypatch):
    monkeypatch.setattr(near_embeddings, "SEED_BLOCK", 16)
    monkeypatch.setattr(near_embeddings, "SEARCHES", 1)
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    hot = unit(rng.standard_normal(64)) + rng.standard_normal((400, 64)) * 0.005
    first = unit(rng.standard_normal((800, 64)))
    side = unit(rng.standard_normal((800, 64)))
    side = unit(side - (side * first).sum(axis=1, keepdims=True) * first)
    pairs = np.stack([first, 0.932 * first + np.sqrt(1 - 0.932**2) * side], axis=1).reshape(1600, 64)
    rows = [(i, v.tolist(), 0) for i, v in enumerate([*hot, *pairs])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_embeddings.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got == {i: (399, 0) if i < 400 else (1, i - i % 2) for i in range(2000)}
