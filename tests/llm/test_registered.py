"""Values of registered queries on the smallest tables, against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from strandex.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fingerprints(spark, texts):
    order = sorted(texts)
    got = {r.doc_id: r for r in queries.QUERIES["op4_fingerprints"](spark, SF).collect()}
    assert sorted(got) == order
    for i, after in zip(order, order[1:] + order[:1], strict=True):
        half = len(texts[i]) // 2
        assert (got[i].n_chars, got[i].edited_sha256) == (len(texts[i]), sha(texts[i][: len(texts[i]) - half] + texts[after][:half]))
        assert (got[i].fingerprint == got[after].fingerprint) == (got[i].near_next == 1)
        assert 0 <= got[i].near_edited <= 1


def test_lm_base_score(spark, texts):
    # None stands for the end
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    count = Counter(x for i, ws in tokens.items() if not held[i] for x in ws)
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in queries.QUERIES["op6_lm_scoring"](spark, SF).collect()}
    assert sorted(got) == sorted(texts)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(count[x] > 0 for x in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ws), rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_simhash(spark, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op5_simhash"](spark, SF).collect()}
    assert sorted(got) == sorted(texts)
    want = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        want[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[i].fingerprint == f"{want[i]:016x}"
    component = {i: i for i in want}
    for _ in want:
        lowest = {i: min(component[j] for j in want if (want[i] ^ want[j]).bit_count() <= 2) for i in want}
        if lowest == component:
            break
        component = lowest
    assert {i: r.component_id for i, r in got.items()} == component


def test_suffix_dedup(spark, texts):
    raw = {i: t.encode() for i, t in texts.items()}
    starts = lambda x: (xxhash.xxh3_128_digest(x[p : p + 400]) for p in range(len(x) - 399))
    seen = Counter(d for x in raw.values() for d in starts(x))
    got = {r.doc_id: r for r in queries.QUERIES["op8_suffix_dedup"](spark, SF).collect()}
    assert sorted(got) == sorted(texts)
    for i, x in raw.items():
        cover = bytearray(len(x))
        for p, d in enumerate(starts(x)):
            if seen[d] > 1:
                cover[p : p + 400] = b"\1" * 400
        kept = bytes(b for b, c in zip(x, cover, strict=True) if not c)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(x), sum(cover), len(re.findall(rb"\x01+", cover)))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_bpe(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    got = {r.doc_id: r for r in queries.QUERIES["op9_bpe"](spark, SF).collect()}
    assert sorted(got) == sorted(texts)
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
