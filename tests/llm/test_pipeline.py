"""The pipeline's stages, each against a brute-force version of its decision."""

import re

import corpus_pipeline
from basewright.llm import common
from tests.llm.helpers import awkward, empty, frame
from tests.llm.test_contracts import brute_components


def test_stages(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, docs, sf_dir), name)
        seen.append((name, [r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()]))
        docs = out
    by = {name: (a, b) for name, a, b in seen}
    assert [n for n, *_ in seen] == ["toxicity", "exact_dedup", "ngram_join", "source_mix", "bpe"]
    for name, (_, after) in by.items():
        assert name == "bpe" or set(after[0]) == set(columns)

    before, after = by["toxicity"]
    assert 0.5 * len(before) < len(after) <= len(before) and all(r in before for r in after[:20])

    before, after = by["exact_dedup"]
    least = {}
    for r in before:
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
        least[text] = min(least.get(text, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(least.values())

    before, after = by["ngram_join"]
    want = brute_components([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert sorted(r["doc_id"] for r in after) == sorted({c for n, c in want.values() if n} | {d for d, (n, _) in want.items() if not n})

    before, after = by["source_mix"]
    ids = {r["doc_id"] for r in before}
    assert all(r["doc_id"] in ids for r in after)
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows)
    assert abs(words(after) - words(before)) < 0.1 * words(before)
    times = {d: sum(r["doc_id"] == d for r in after) for d in ids}
    assert max(times.values()) <= 3

    before, after = by["bpe"]
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before)


def test_awkward_rows(spark, sf_dir):
    for docs in (awkward(spark), empty(spark), frame(spark, [(1, None, None, None, None)])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = common.written(stage(spark, docs, sf_dir), name)
            assert out.columns == docs.columns
            docs = out
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()


def test_runs_keep_out_of_each_other(spark, sf_dir):
    """Results handed out before a pipeline run can still be read after it."""
    from basewright.llm.registry import QUERIES

    held = {name: QUERIES[name](spark, sf_dir) for name in ("op3_source_mix", "op6_kd_shards", "op7_exact_dedup", "op8_ngram_join")}
    docs = common.documents(spark, sf_dir)
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert all(df.count() == docs.count() for df in held.values())


def test_a_worker_keeps_the_tables_of_one_operator():
    """Spark reuses a worker for every stage; what one left stays out of the memory of the next."""
    from basewright.llm import bpe, similarity_join, toxicity, worker

    worker.works_for(bpe.__name__)
    bpe.encoder(bpe.vocabulary_path())
    worker.works_for(bpe.__name__)
    assert bpe._loaded
    worker.works_for(toxicity.__name__)
    assert toxicity.terms(["one two"], {}) and toxicity._hashes and not bpe._loaded
    worker.works_for(similarity_join.__name__)
    assert not toxicity._hashes


def test_toxicity_sends_a_text_once(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    sent = corpus_pipeline.drop_toxic(spark, docs, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    line = next(x for x in sent.split("\n") if "Project" in x and "struct(" in x)
    assert re.findall(r"\btext#\d+", line.replace("text, text#", "struct#", 1)) == []
