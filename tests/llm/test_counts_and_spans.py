"""Token counts, decontamination and secret scans against plain Python."""

import random
import re

import pytest

from strandex.llm import decontamination, secret_scan, token_counts
from tests.llm.conftest import prose


def lengths(texts):
    encode = token_counts.encoding(token_counts.default_ranks()).encode_ordinary
    return [len(encode(t or "")) for t in texts]


def test_context_report(make):
    texts = [prose(i % 7, 5 * (i % 9)) for i in range(60)] + [None, "", prose(3, 3000)]
    size = lengths(texts)
    got = {r.n_tokens: r for r in token_counts.context_report(token_counts.length_histogram(make(texts))).collect()}
    assert set(got) == set(size)
    for limit, r in got.items():
        assert r.n_docs == size.count(limit)
        assert r.docs_at_least == sum(x >= limit for x in size)
        assert r.tokens_at_least == sum(x for x in size if x >= limit)
        assert r.truncated_total == sum(min(x, limit) for x in size)
        assert r.full_total == sum(size)
        assert r.quantile == pytest.approx(sum(x <= limit for x in size) / len(size))


def test_token_counts_odd(odd, none):
    got = token_counts.length_histogram(odd).collect()
    assert sum(r.n_docs for r in got) == odd.count()
    assert {r.n_tokens: r.n_docs for r in got}[0] == 3
    assert token_counts.context_report(token_counts.length_histogram(none)).count() == 0


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(texts, items, window=13):
    wins = {}
    for name, t in items:
        w = words(t)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(name)
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if got := wins.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= got
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block_words", [40, 1_000_000])
def test_decontamination_fuzz(spark, make, block_words):
    r = random.Random(5)
    items = [(str(i), " ".join(r.choice("aB cd é9 f-g h".split()) for _ in range(r.choice([0, 1, 3, 12, 13, 14, 30])))) for i in range(3, 25)]
    items += [("x", None), ("y", items[4][1]), ("z", "solo")]
    texts = [None, "", "solo", "SOLO!"]
    for _ in range(120):
        a, b = r.choice(items)[1] or "", r.choice(items)[1] or ""
        texts.append(" ".join([prose(r.randint(0, 9), 5), a[r.randint(0, 5) :], b[: r.randint(0, 60)], "cd é9"]))
    table = spark.createDataFrame(items, "item_id string, text string")
    want = brute_hits(texts, items)
    got = {x.doc_id: x for x in decontamination.matches(make(texts), table, block_words=block_words).collect()}
    for i, (n, hit, found) in enumerate(want):
        assert (got[i].n_words, got[i].n_hit, got[i].item_ids) == (n, hit, found), texts[i]
        assert got[i].contaminated == (hit > 0 and 20 * hit >= n)


def test_decontaminate_cuts_and_drops(spark, make):
    item = " ".join(f"w{i}" for i in range(13))
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    long = prose(1, 400)
    docs = make([item.upper(), f"{long} {item}, {long}", long, None])
    got = {r.doc_id: r.text for r in decontamination.decontaminate(docs, table).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1] == f"{long} , {long}" and got[2] == long and got[3] is None


def test_decontamination_odd(spark, odd, none):
    table = spark.createDataFrame([(1, None), (2, ""), (3, prose(1, 60)), (3, prose(1, 60)), (None, prose(1, 60))], "item_id long, text string")
    got = decontamination.matches(odd, table).collect()
    assert len(got) == odd.count()
    assert {r.doc_id: r.n_hit for r in got if r.doc_id in (0, 1, 2, 6)} == {0: 0, 1: 0, 2: 0, 6: 60}
    assert {tuple(r.item_ids) for r in got if r.doc_id == 6} == {("3",)}  # an item without an id hits, but has none to report
    assert decontamination.matches(none, table).count() == 0
    assert decontamination.matches(odd, table.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.decontaminate(odd, table).columns == odd.columns


def brute_base(text):
    out = []
    for kind, p, g, n in (("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)):
        out += [(kind, m.start(), m.end()) for m in re.finditer(p, text) if len(m[g]) >= n]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def test_secret_scan(make):
    r = random.Random(2)
    parts = ["password", "TOKEN", "api_key", "ApIkEy", " = ", ":", '"', "'", "AKIA", "ABCD1234", "f" * 20, "0123456789abcdef", " ", "é", "ſecret=", "x=", "secret", "abcdefgh", "."]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(400)]
    got = {x.doc_id: x for x in secret_scan.find_secrets(make(texts)).collect()}
    for i, t in enumerate(texts):
        want = brute_base(t)
        assert got[i].base_spans == ",".join(f"{k}:{s}:{e}" for k, s, e in want), t
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex"))
        assert set(filter(None, got[i].base_spans.split(","))) <= set(got[i].spans.split(","))


def test_token_efficiency(make):
    noise = "q7Zx9KfW2LmP0vTb8RsYc4Nd"
    plain = ["the quick brown fox", "d41d8cd98f00b204e9800998ecf8427e", "550e8400-e29b-41d4-a716-446655440000", "thtionstthblethinghandtionable", "12345678901234567890123", "src/main/java/org/example/readme", "2024-01-02-2024-01-02-2024"]
    got = {x.doc_id: x.spans for x in secret_scan.find_secrets(make([f"key {noise} end", *plain])).collect()}
    assert got[0] == f"random:4:{4 + len(noise)}"
    assert all("random" not in got[i] for i in range(1, len(plain) + 1))


def test_redaction(odd, make, none):
    docs = make(['é token = "0123456789abcdef0123456789abcdef" x', None, "plain"])
    got = {r.doc_id: r.text for r in secret_scan.redact_secrets(docs).collect()}
    assert got == {0: f"é {secret_scan.REDACTED}\" x", 1: None, 2: "plain"}
    assert secret_scan.redact_secrets(odd).columns == odd.columns
    found = secret_scan.find_secrets(odd).collect()
    assert len(found) == odd.count() and all(r.spans == "" for r in found if r.doc_id in (0, 1, 2))
    assert secret_scan.find_secrets(none).count() == 0

