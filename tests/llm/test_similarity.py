"""SimHash, components, weighted sampling and repeats against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandex.llm import repeats, simhash, weighted_sampling
from strandex.llm.components import components
from tests.llm.conftest import prose


def union_find(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return [find(x) for x in range(n)]


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randint(0, 299), r.randint(0, 299)) for _ in range(180)] + [(i, i + 1) for i in range(300, 360)] + [(400, x) for x in range(401, 440)] + [(5, 5)]
    want = union_find(440, pairs)
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    touched = {x for p in pairs for x in p if p[0] != p[1]}
    assert got == {x: want[x] for x in touched}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_few_edges_are_joined_in_one_task(spark):
    """The same components, without the rounds: their plans and tasks filled the driver's memory in the pipeline."""
    r = random.Random(5)
    pairs = [(r.randrange(-400, 400), r.randrange(-400, 400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (-(2**63), 2**63 - 1)]
    edges, sc = spark.createDataFrame(pairs, "src long, dst long"), spark.sparkContext
    found, jobs = [], []
    for few in (0, 1 << 18):
        sc.setJobGroup(f"components-{few}", "")
        found.append(sorted(map(tuple, components(edges, few=few).collect())))
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"components-{few}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert found[0] == found[1] and found[0]
    assert jobs[1] < jobs[0] / 3, jobs
    assert components(spark.createDataFrame([], "src long, dst long"), few=9).count() == 0


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("hot", [2048, 4])
def test_links_between_fingerprints(spark, hot):
    r = random.Random(3)
    fps = {0, 1, 3, (1 << 64) - 1}
    for _ in range(60):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(r.randint(0, 8)):
            for _ in range(r.randint(1, 3)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    center = r.getrandbits(64)
    fps |= {center ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)}
    fps = sorted(fps)
    want = union_find(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {x.node: x.component for x in components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), hot)).collect()}
    at = {x: i for i, x in enumerate(signed)}
    groups = defaultdict(set)
    for x in signed:
        groups[got.get(x, x)].add(at[x])
    brute = defaultdict(set)
    for i, c in enumerate(want):
        brute[c].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_simhash_documents(make):
    texts = [prose(i % 12, 40 + i % 3) + (" tail" if i % 5 == 0 else "") for i in range(80)] + [None, "", "  ", "A", "a", "b c"]
    fps = [brute_fp(t) for t in texts]
    want = union_find(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    got = {x.doc_id: x for x in simhash.near_duplicates(make(texts)).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].fp % (1 << 64) for i in range(len(texts))] == fps
    kept = simhash.deduplicate(make(texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert kept.columns == make(texts).columns


def test_simhash_odd(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.doc_id in (0, 1, 2)} == {0} and {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    kept = simhash.deduplicate(odd).collect()
    assert sum(r.doc_id == 5 for r in kept) == 1 and sum(r.doc_id is None for r in kept) == 2
    assert simhash.near_duplicates(none).count() == 0


def test_long_texts_by_blocks():
    text = prose(4, 70_000)
    assert simhash.fingerprint(text) == brute_fp(text)


def shingles(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_fingerprints(make):
    texts = [prose(i, 30 + i % 20) + (" " + " ".join(["ha"] * 20)) * (i % 3) for i in range(150)] + [None, "", "one two", "one two"]
    ids = [3 * i * i - 50 for i in range(len(texts))]  # wide gaps and negative ids
    got = {r.doc_id: r for r in weighted_sampling.fingerprints(make(texts, ids), 16).collect()}
    seen, off = {}, []
    for k, (i, t) in enumerate(zip(ids, texts, strict=True)):
        t, after = t or "", texts[(k + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert seen.setdefault(t, got[i].fingerprint) == got[i].fingerprint
        assert seen.setdefault(edited, got[i].edited_fingerprint) == got[i].edited_fingerprint
        off.append(got[i].near_edited - jaccard(t, edited))
        if t == after:
            assert got[i].near_next == 1
    assert abs(np.mean(off)) < 0.03


def test_weights_count(spark):
    """The collision rate follows weights, not only which terms occur."""
    rows = [(1, h, 1 + h % 4) for h in range(20)] + [(2, h, 1 + (h + 1) % 4) for h in range(10, 30)]
    df = spark.createDataFrame(rows, "side int, h long, w int").withColumn("h", F.xxhash64("h")).withColumn("lw", F.log("w"))
    n = 600
    a, b = (r for r in df.groupBy("side").agg(*(F.min(F.expr(weighted_sampling.sample(k))).alias(f"m{k}") for k in range(n))).orderBy("side").collect())
    w = {s: {h: x for side, h, x in rows if side == s} for s in (1, 2)}
    want = sum(min(w[1].get(h, 0), w[2].get(h, 0)) for h in range(30)) / sum(max(w[1].get(h, 0), w[2].get(h, 0)) for h in range(30))
    assert sum(a[f"m{k}"] == b[f"m{k}"] for k in range(n)) / n == pytest.approx(want, abs=0.06)


def test_fingerprints_odd(odd, none, make):
    got = weighted_sampling.fingerprints(odd).collect()
    assert len(got) == odd.count()
    assert len({r.fingerprint for r in got if r.doc_id in (0, 1, 2)}) == 1
    assert {r.near_next for r in got if r.doc_id in (0, 1)} == {1.0}
    assert weighted_sampling.fingerprints(none).count() == 0
    (one,) = weighted_sampling.fingerprints(make(["a b c d"])).collect()
    assert one.near_next == 1.0


@pytest.mark.parametrize("bits", [18, 2])
def test_hosts(spark, bits):
    """Each block's guest goes to the block before it, however far apart, the first one's to the last."""
    r = random.Random(2)
    blocks = sorted({r.randint(-(2**53), 2**53 - 1) >> r.choice([0, 20, 40, 50]) for _ in range(300)} | {0, 1, 2, -1})
    df = spark.createDataFrame([(b, b * 3) for b in blocks], "block long, first_id long")
    got = {x.first_id: x.host for x in weighted_sampling.hosts(df, bits).collect()}
    assert got == {b * 3: blocks[i - 1] for i, b in enumerate(blocks)}
    assert weighted_sampling.hosts(df.where("false"), bits).count() == 0


def brute_repeats(docs, n):
    seen = Counter(x[p : p + n] for _, x in docs for p in range(len(x) - n + 1))
    out = defaultdict(set)
    for i, x in docs:
        hit = np.zeros(len(x) + 1, bool)
        for p in range(len(x) - n + 1):
            if seen[x[p : p + n]] > 1:
                hit[p : p + n] = True
        out[i].add((len(x), int(hit.sum()), int((np.diff(hit.astype(int), prepend=0) == 1).sum()), bytes(np.frombuffer(x, np.uint8)[~hit[:-1]])))
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
def test_repeats_fuzz(make, hot):
    r = random.Random(3)
    base = ["".join(r.choice("abcd ") for _ in range(r.randint(0, 300))) for _ in range(30)]
    texts = [None, "", "a" * 500, "a" * 39, "xy" * 25]
    for _ in range(120):
        x, y = r.choice(base), r.choice(base)
        texts.append(r.choice([x[r.randint(0, len(x)) :] + y[: r.randint(0, len(y))] + "zé" * r.randint(0, 3), x * r.randint(1, 3), "ab" * r.randint(0, 100) + y, y]))
    want = brute_repeats([(i, (t or "").encode()) for i, t in enumerate(texts)], 40)
    for row in repeats.remove_repeats(make(texts), 40, hot).collect():
        assert (row.n_bytes, sum(s.end - s.begin for s in row.spans), len(row.spans), bytes(row.kept)) in want[row.doc_id], texts[row.doc_id]


def test_repeats_across_pieces_and_odd(odd, none):
    got = repeats.remove_repeats(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0].n_bytes == 0 and by[9].kept == b"" and by[10].kept == b"" and by[8].spans == []
    assert repeats.remove_repeats(none).count() == 0


def brute_passages(docs, n):
    """For each text its words in runs of ``n`` or more words that start anywhere else too."""
    seen = Counter(tuple(w[p : p + n]) for _, w in docs for p in range(len(w) - n + 1))
    out = defaultdict(set)
    for i, w in docs:
        hit = np.zeros(len(w) + 1, bool)
        for p in range(len(w) - n + 1):
            if seen[tuple(w[p : p + n])] > 1:
                hit[p : p + n] = True
        out[i].add((int(hit.sum()), int((np.diff(hit.astype(int), prepend=0) == 1).sum())))
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
def test_passages_fuzz(make, hot):
    r = random.Random(5)
    base = [prose(i, r.randint(0, 60)) for i in range(25)]
    texts = [None, "", "a " * 200, "a\tb\n" * 30, prose(1, 11)]
    for _ in range(120):
        x, y = r.choice(base).split(), r.choice(base).split()
        texts.append(r.choice([" ", "\n", " \t"]).join([*x[r.randint(0, len(x)) :], *y[: r.randint(0, len(y))], *["zz", str(r.random())] * r.randint(0, 2)]))
    want = brute_passages([(i, (t or "").encode().split()) for i, t in enumerate(texts)], 12)
    for row in repeats.remove_repeats(make(texts), 40, hot, 12).collect():
        assert (sum(s.end - s.begin for s in row.passages), len(row.passages)) in want[row.doc_id], texts[row.doc_id]


def test_pieces_of_long_texts():
    """Texts cut into overlapping pieces have the windows of whole ones."""
    r = random.Random(9)
    raw = ["".join(r.choice("abcd ") for _ in range(n)).encode() for n in (5_000, 90, 3_000)]
    covers = lambda step: sorted((int(t), int(p)) for x in repeats._in_pieces(raw, 64, step=step) for b in x[:1] for t, s, e in zip(*(b.column(i).to_pylist() for i in (3, 5, 6)), strict=True) for p in range(s, e - 63))
    assert set(covers(200)) == set(covers(1 << 20))
    old, repeats.PIECE = repeats.PIECE, 100
    try:
        small = repeats.word_symbols(raw)
    finally:
        repeats.PIECE = old
    assert small == repeats.word_symbols(raw) and [len(x) // 4 for x in small] == [len(x.split()) for x in raw]


def test_column_sort():
    strings = [b"xxabcdefgh", b"yabcdefzz", b"abcdefgh", b"abcdefgh"]
    # anchors at "c": windows of 6 bytes
    assert repeats.column_sort(strings, np.array([4, 3, 2, 2]), np.array([0, 0, 0, 1]), 6) == [[(2, 10)], [(1, 7)], [(0, 8)], []]
