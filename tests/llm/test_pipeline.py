"""The pipeline and the registered queries on the smallest tables."""

import pytest

import corpus_pipeline
from strandex.llm import bpe, decontamination, queries, secret_scan, token_counts

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    rows = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows.append({r.doc_id: r for r in docs.collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    toxic, single, clean, redacted, encoded = rows
    assert before > len(toxic) > len(single) >= len(clean) == len(redacted) == len(encoded)
    # brute force for what each stage leaves, judged on its own input
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    automaton = decontamination.build(items)
    for i, (n, spans, _) in zip(single, decontamination.scan([automaton], [r.text for r in single.values()]), strict=True):
        hit = sum(e - s for s, e in spans)
        assert (i in clean) == (not (hit and 20 * hit >= n))
        if i in clean:
            assert clean[i].text == (decontamination.remove(single[i].text, spans) if spans else single[i].text)
    encode = token_counts.encoding(token_counts.default_ranks()).encode_ordinary
    v = bpe.vocabulary(bpe.default_vocabulary())
    for i, r in clean.items():
        assert redacted[i].text == secret_scan.redact(r.text, secret_scan.all_spans(r.text, encode)[1])
        ids = [x for w in v.words(redacted[i].text) for x in (v.merge(w) if isinstance(w, str) else [w])]
        assert encoded[i].ids == " ".join(map(str, ids)) and encoded[i].n_tokens == len(ids)
    run = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {i: r.ids for i, r in run.items()} == {i: r.ids for i, r in encoded.items()}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, name):
    df = queries.QUERIES[name](spark, SF)
    n = df.count()
    assert n == (200 if "doc_id" in df.columns else n) and n > 0

