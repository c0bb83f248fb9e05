"""The near-dedup stage against brute force over all pairs."""

import itertools
import random

import corpus_pipeline
from strandex.llm import simhash, similar
from tests.llm.conftest import prose


def test_near_dedup_stage_takes_all_pairs_of_five_word_jaccard(make, odd, none):
    base, r = [prose(s, 120).split() for s in range(300, 312)], random.Random(9)
    texts = [" ".join(w) for w in base]
    for w in base:
        for edits in (1, 2, 3, 5):
            new = list(w)
            for k in range(edits):
                new[r.randrange(len(new))] = f"edit{k}"
            texts.append(" ".join(new))
    texts += [" ".join([*base[0][:100], *(f"m{i}_{k}" for k in range(i))]) for i in range(40)]  # a chain of near copies in one bucket
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x.split() for x in texts)]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    fp = [simhash.fingerprint(x) for x in texts]
    far = 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        close = (fp[i] ^ fp[j]).bit_count() <= simhash.DISTANCE
        alike = 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])
        far += alike and not close
        if close or alike:
            a, b = sorted((root(i), root(j)))
            up[b] = a
    assert far > 20  # which fingerprints alone leave
    assert {r.doc_id: r.component_id for r in similar.near_duplicates(make(texts)).collect()} == {i: root(i) for i in range(len(texts))}
    stay = {r.doc_id for r in corpus_pipeline.near_dedup(None, make(texts), "").collect()}
    assert stay == {i for i in range(len(texts)) if root(i) == i}
    assert corpus_pipeline.near_dedup(None, odd, "").columns == odd.columns and corpus_pipeline.near_dedup(None, none, "").count() == 0
