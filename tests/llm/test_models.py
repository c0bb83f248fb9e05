"""Language model, quality, toxicity and BPE."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from strandex.llm import bpe, kneser_ney, quality, toxicity
from tests.llm.conftest import prose


def brute_lm(train, texts):
    tok = lambda x: [*(x or "").encode().lower().split(), b"\n"]
    seqs = [tok(x) for x in train]
    c, pairs = Counter(w for s in seqs for w in s), Counter(p for s in seqs for p in zip([b"\r", *s], s, strict=False))
    kinds, total, spread = Counter(w for _, w in pairs), Counter(), defaultdict(lambda: [0, 0, 0])
    for (a, _), n in pairs.items():
        total[a] += n
        spread[a][min(n, 3) - 1] += 1
    d, e = (kneser_ney.discounts([sum(v == k for v in x.values()) for k in (1, 2, 3, 4)]) for x in (kinds, pairs))
    mass = sum(d[min(k, 3) - 1] for k in kinds.values()) / len(pairs)

    def p(a, w):
        low = (max(kinds[w] - d[min(kinds[w], 3) - 1], 0) if kinds[w] else 0) / len(pairs) + mass / (len(c) + 1)
        if not total[a]:
            return low
        n = pairs[a, w]
        return (max(n - e[min(n, 3) - 1], 0) if n else 0) / total[a] + sum(x * y for x, y in zip(e, spread[a], strict=True)) / total[a] * low

    n_all, v = sum(c.values()), len(c)
    out = []
    for x in texts:
        t = tok(x)
        out.append((len(t), sum(c[w] > 0 for w in t), sum(math.log10((c[w] + 0.5) / (n_all + 0.5 * (v + 1))) for w in t), sum(math.log10(p(a, w)) for a, w in zip([b"\r", *t], t, strict=False))))
    assert sum(p(b"an", w) for w in c) + p(b"an", b"?") == pytest.approx(1)
    return n_all, out


@pytest.mark.parametrize("bits", [0, 3])
def test_kneser_ney(make, bits):
    texts = [prose(i % 9, 20 + i) for i in range(60)] + [None, "", "New words ONLY"]
    train = texts[::2]
    n, want = brute_lm(train, texts)
    model = kneser_ney.train(make(train), bits)
    assert model.tokens == n
    got = {r.doc_id: r for r in kneser_ney.score(make(texts), model).collect()}
    for i, w in enumerate(want):
        assert (got[i].n_tokens, got[i].n_known) == w[:2]
        assert (got[i].base_score, got[i].score) == pytest.approx(w[2:], rel=1e-9)


def test_kneser_ney_odd(odd, none):
    model = kneser_ney.train(odd)
    got = kneser_ney.score(odd, model).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.score) for r in got)
    empty = kneser_ney.train(none)
    assert empty.tokens == 0 and all(r.n_known == 0 and math.isfinite(r.score) for r in kneser_ney.score(odd, empty).collect())
    assert kneser_ney.score(none, model).count() == 0


def test_tokens_follow_their_text():
    word, doc = kneser_ney.tokens([b"", b"a b", b"", b"a"])
    assert doc.tolist() == [0, 1, 1, 1, 2, 3, 3] and (word == kneser_ney.END).tolist() == [True, False, False, True, True, False, True]


def graded(n, seed=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        g = i % 4
        out.append((i, " ".join(r.choice(["junk%%"] * (4 - g) + ["Good"] * (g + 1) + ["the", "of"]) for _ in range(80)), g))
    return out


def test_quality_grades(spark, make):
    rows = graded(400)
    docs, labels = make([t for _, t, _ in rows]), spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert (np.diff(model[1]) > 0).all() and model[2].tolist() == [0, 1, 2, 3]
    got = quality.score(docs, model).collect()
    grade = {i: g for i, _, g in rows}
    held = [r for r in got if __import__("zlib").crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([abs(r.expected_grade - grade[r.doc_id]) for r in held]) < 0.4
    assert all(sum(r.probabilities) == pytest.approx(1) and 0 <= r.expected_grade <= 3 for r in got)
    means = [np.mean([r.tail_probability for r in held if grade[r.doc_id] == g]) for g in range(4)]
    assert means == sorted(means)


def test_quality_gradient():
    """The fit reaches a point where moving thresholds or weights doesn't help."""
    packed = [(g, *quality.pack([t])[0]) for _, t, g in graded(120, 1)]
    w, cut, grades = quality.fit(packed, steps=600)

    def loss(w, cut):
        z = np.array([sum(w[np.frombuffer(f, np.int32)] * np.frombuffer(s, np.float32)) for _, f, s in packed])
        p = quality.probabilities(z, cut)
        return -np.log(p[np.arange(len(packed)), [g for g, _, _ in packed]]).mean()

    best = loss(w, cut)
    assert all(loss(w, cut + d * np.eye(3)[k]) >= best - 1e-3 for k in range(3) for d in (-0.2, 0.2))
    assert loss(w * 0, cut) > best


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(0, 1), (5, None), (5, 0), (5, 1), (None, 1), (99, 0), (6, 0), (8, 1)], "doc_id long, quality int")
    got = quality.score(odd, quality.train(odd, labels)).collect()
    assert len(got) == odd.count() and all(0 <= r.tail_probability <= 1 for r in got)
    flat = quality.train(odd, labels.limit(0))
    assert {r.expected_grade for r in quality.score(odd, flat).collect()} == {0.0}
    assert quality.score(none, flat).count() == 0


def toxic_rows(n):
    r = random.Random(7)
    out = []
    for i in range(n):
        s = [prose(r.randint(0, 50), 8) for _ in range(r.randint(2, 8))]
        if bad := i % 4 == 0:
            s[r.randrange(len(s))] += " you " + r.choice(["IDIOT", "scumming", "scumbag", "moron"]) + " there"
        out.append((i, ". ".join(s) + ".", int(bad)))
    return out


def test_toxicity(spark, make):
    rows = toxic_rows(600)
    docs, labels = make([t for _, t, _ in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    mark = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == mark[r.doc_id] for r in held]) > 0.97
    for r in held:
        if r.predicted and mark[r.doc_id]:
            assert any(x in r.offending.lower() for x in ("idiot", "scum", "moron"))
        if not r.predicted:
            assert r.offending is None
    kept = {r.doc_id for r in toxicity.reject(docs, labels).collect()}
    assert kept == {r.doc_id for r in got if not r.predicted}


def test_noisy_or_is_one_minus_the_product():
    w = np.zeros(1 << toxicity.BITS, np.float32)
    _, _, f = toxicity.features(["bad"])
    w[f[0]] = 0.5
    s, (doc, sentence, p) = toxicity.noisy_or(["bad. fine! bad bad", ""], w, -3.0)
    assert s[0] == pytest.approx(1 - np.prod(1 - p[doc == 0])) and sentence[doc == 0].tolist() == [0, 1, 2]
    assert s[1] == pytest.approx(1 / (1 + math.exp(3)))


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (5, None), (8, 0), (None, 1), (77, 1), (3, 0), (3, 0)], "doc_id long, toxic int")
    got = toxicity.score(odd, toxicity.train(odd, labels)).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    flat = toxicity.train(odd, labels.limit(0))
    assert len({r.score for r in toxicity.score(odd.where("doc_id < 2"), flat).collect()}) == 1
    assert toxicity.score(none, flat).count() == 0
    assert toxicity.reject(odd, labels).columns == odd.columns


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_library(make, library):
    r = random.Random(1)
    texts = [prose(i, 40) for i in range(40)] + ["", None, "   ", "a\x1cb \x1f c", "<|endoftext|>x <|startoftext|><|endoftext|> y", "ΑΣ ΣΑΣ.", "İstanbul I'M you'Re 123abc ½²", "é ́x a​b c\x85d ﻿", "日本語 😀😀", "a" * 700, "ab" * 3000, "<|endoftext |> <|", "ﬁ Ǆ ẞ ͅ"]
    texts += ["".join(r.choice("aAbΣσς éÉ \x1c  'sSmM<|>12²½_.,-日😀‍İß") for _ in range(r.randint(1, 30))) for _ in range(500)]
    got = {x.doc_id: x for x in bpe.encode_documents(make(texts), lexicon_words=300).collect()}
    digest = {x.doc_id: x for x in bpe.encode_documents(make(texts), lexicon_words=0, with_ids=False).collect()}
    back = {x.doc_id: x.decoded for x in bpe.decode_documents(bpe.encode_documents(make(texts[:60]))).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        joined, decoded = " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids, got[i].decoded) == (len(ids), joined, decoded), repr(t)
        assert (digest[i].ids_sha256, digest[i].decoded_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (joined, decoded))
        assert back.get(i, decoded) == decoded


def test_lexicon_is_minimal_and_exact():
    words = sorted({w.encode() for i in range(20) for w in prose(i, 200).split()})
    entries = [(w, list(range(i, i + i % 4))) for i, w in enumerate(words)]
    r = random.Random(0)
    r.shuffle(entries)
    arrays = bpe.compile_lexicon(entries)
    lexicon = bpe.Lexicon(arrays)
    ranks = lexicon.rank(words)
    assert sorted(ranks.tolist()) == list(range(len(words)))
    assert [lexicon.get(k) for k in ranks.tolist()] == [dict(entries)[w] for w in words]
    assert (lexicon.rank([b"", b"zz", words[0] + b"!", b"x" * 99]) == -1).all()
    # no two states have the same final mark and transitions
    out = defaultdict(list)
    for key, to in zip(arrays["key"].tolist(), arrays["to"].tolist(), strict=True):
        out[key >> 8].append((key & 255, to))
    states = [(int(f), tuple(out[s])) for s, f in enumerate(arrays["final"].tolist())]
    assert len(set(states)) == len(states)


def test_merges_agree():
    v = bpe.vocabulary(bpe.default_vocabulary())
    r = random.Random(4)
    pieces = ["".join(r.choice("abcdefghthéé日!") for _ in range(r.randint(1, 24))) for _ in range(500)]
    raw = [p.encode() for p in pieces]
    raw = [x for x in raw if len(x) <= bpe.SHORT_PIECE]
    assert v.merge_many(raw) == [v.merge(x.decode()) for x in raw]


def test_bpe_odd(odd, none):
    got = bpe.encode_documents(odd).collect()
    assert len(got) == odd.count() and {r.n_tokens for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert bpe.encode_documents(none).count() == 0


def test_toxicity_fit_takes_little_of_the_driver():
    """At most 36 bytes for each word of the labelled documents, tables of the weights included."""
    import tracemalloc

    r = np.random.default_rng(3)
    packed = [(i % 3 == 0, 1, np.full(50, 20, np.int32).tobytes(), r.integers(0, 5000, 1000).astype(np.int32).tobytes()) for i in range(600)]
    lift = r.random(1 << toxicity.BITS)
    tracemalloc.start()
    toxicity.fit(packed, lift, steps=2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most <= 36 * 600_000, most
