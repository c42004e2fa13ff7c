"""The pipeline beside plain Python, stage by stage on each stage's own input."""

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

import corpus_pipeline as cp  # noqa: E402
import test_decontam  # noqa: E402
import test_mixing  # noqa: E402
import test_near  # noqa: E402
import test_secrets  # noqa: E402
from panoloom.llm import common, toxicity  # noqa: E402


@pytest.fixture(scope="module")
def small():
    """Tables with some of everything the stages look for."""
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, small):
    """Rows before the first and after every stage."""
    docs = common.read(spark, small, "documents")
    out = [docs.collect()]
    for name, stage in cp.STAGES:
        docs = common.stored(stage(spark, docs, small), name)
        out.append(docs.collect())
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_copies", "decontaminate", "secrets", "mix"]
    for rows in stages[:-1]:
        assert list(rows[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(len(a) >= len(b) for a, b in zip(stages, stages[1:])) and len(stages[1]) < len(stages[0])


def test_toxicity(spark, small, stages):
    docs = common.read(spark, small, "documents")
    model = toxicity.train(docs, common.read(spark, small, "labels"))
    weight = dict(zip(model.hashes.tolist(), model.weights.tolist()))

    def toxic(text):
        import numpy as np
        import pyarrow as pa
        from panoloom.llm import words as wd
        found = set()
        for w in wd.words(pa.array([text or ""]), wd.LETTERS):
            found |= set(toxicity.features(w)[1].tolist())
        s = sum(weight.get(h, 0.0) for h in found)
        return 1 - 1 / (1 + np.exp(-(model.thresholds[0] - s))) >= 0.5
    assert sorted(r.doc_id for r in stages[1]) == sorted(r.doc_id for r in stages[0] if not toxic(r.text))


def test_near_copies(stages):
    rows = [(r.doc_id, r.text) for r in stages[1]]
    groups = {g for *_, g in test_near.brute(rows)}
    assert sorted(r.doc_id for r in stages[2]) == sorted(groups)


def test_leaks(spark, small, stages):
    items = [test_decontam.norm(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in stages[3]) == sorted(r.doc_id for r in stages[2] if not any(x in test_decontam.norm(r.text) for x in items))


def test_masked_secrets(stages):
    before = {r.doc_id: r for r in stages[3]}
    spans = {r[0]: r[5] for r in test_secrets.brute([(r.doc_id, r.text, r.source) for r in stages[3]])}
    assert len(stages[4]) == len(before) and any(spans.values())
    for r in stages[4]:
        if spans[r.doc_id]:
            assert "<secret>" in r.text and not test_secrets.base(r.text.replace("<secret>", "\n")) and r.n_chars == len(r.text)
        else:
            assert r.text == before[r.doc_id].text and r.n_chars == before[r.doc_id].n_chars


def test_mix(stages):
    want = test_mixing.brute([(r.doc_id, r.text, r.source) for r in stages[4]])
    got = sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in stages[5]), key=str)
    assert got == want
    kept = {r.doc_id: r for r in stages[4]}
    assert all(r.asDict() | kept[r.doc_id].asDict() == r.asDict() and len(r) == 9 for r in stages[5])


def test_clashing_columns(spark, small, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs = common.read(spark, small, "documents").where("doc_id < 60")
    docs = docs.selectExpr("*", "'a' as spans", "'b' as group_id", "doc_id as taken", "'c' as toxic", "'d' as item_id", "'e' as key")
    docs.union(docs.where("doc_id < 3")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = cp.run(spark, str(tmp_path)).collect()
    assert rows and {(r.spans, r.group_id, r.toxic, r.item_id, r.key) for r in rows} == {("a", "b", "c", "d", "e")}
    assert all(r.taken <= 2 * r.size for r in rows) and len({r.doc_id for r in rows}) == len(rows)


def test_run_gives_the_last_stage(spark, small, stages):
    assert sorted(map(str, cp.run(spark, small).collect())) == sorted(map(str, stages[5]))


def test_empty_documents(spark, small, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
