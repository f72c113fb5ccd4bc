"""The stages of the pipeline, each held against its own input."""

import importlib
from collections import Counter

import pytest

import __spark_entry__ as entry
from postmill.llm import decontaminate, mixing, queries, quality, sharding, simhash
from postmill.llm.common import materialise, read_table, with_place

pipeline = importlib.import_module("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = [read_table(spark, small, "documents")]
    for _, stage in pipeline.STAGES:
        docs.append(materialise(stage(spark, docs[-1], small), "stage"))
    return docs


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_names(stages):
    assert [name for name, _ in pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"
    ]
    assert all(df.columns == COLUMNS for df in stages[:-1])


def test_quality(spark, small, stages):
    model = quality.fit_classifier(stages[0], read_table(spark, small, "labels"))
    scores = {r.doc_id: r.score for r in quality.score_quality(stages[0].select("doc_id", "text"), model).collect()}
    assert ids(stages[1]) == Counter(i for i, s in scores.items() if s >= 0.5)
    labels = {r.doc_id: r.quality for r in read_table(spark, small, "labels").collect()}
    kept = ids(stages[1])
    assert sum(i in kept for i, q in labels.items() if q == 1) >= 0.98 * sum(labels.values())
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 0.1 * sum(q == 0 for q in labels.values())


def test_near_duplicates(stages):
    codes = {r.doc_id: simhash.fingerprint(r.text or "", 4) % (1 << 64) for r in stages[1].collect()}
    label = {i: i for i in codes}
    changed = True
    while changed:
        changed = False
        for i, a in codes.items():
            low = min(label[j] for j, b in codes.items() if (a ^ b).bit_count() <= 4)
            changed |= low != label[i]
            label[i] = low
    assert ids(stages[2]) == Counter(set(label.values()))


def test_benchmark(spark, small, stages):
    found = decontaminate.scan_documents(stages[2], read_table(spark, small, "benchmark"))
    assert ids(stages[3]) == Counter(r.doc_id for r in found.collect() if not r.contaminated)


def test_mixture_and_shards(stages):
    assert sorted(map(str, stages[4].collect())) == sorted(map(str, stages[3].collect()))
    rows = stages[5].collect()
    assert Counter(r.doc_id for r in rows) == ids(stages[4])
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == queries.SHARDS


def test_run_equals_the_stages(spark, small, stages):
    got = Counter((r.doc_id, r.size, r.text_crc32) for r in entry.queries()["pipeline"](spark, small).collect())
    assert got == Counter((r.doc_id, r.size, r.text_crc32) for r in stages[5].collect())


def test_empty_corpus(spark, small):
    docs = read_table(spark, small, "documents").where("doc_id < 0")
    for _, stage in pipeline.STAGES:
        docs = materialise(stage(spark, docs, small), "empty")
    assert docs.count() == 0


def test_shards_follow_the_mixture(spark, small, stages, monkeypatch):
    mixed = [r.doc_id for r in with_place(stages[4], "at").orderBy("at").collect()]
    schedule = mixing.mix_sources(stages[3], queries.WEIGHTS).orderBy("mix_position").collect()
    assert mixed == [r.doc_id for r in schedule], "files and rows are in the order of the schedule"
    want = {(i % queries.SHARDS, i // queries.SHARDS, doc) for i, doc in enumerate(mixed)}
    assert {(r.shard, r.slot, r.doc_id) for r in stages[5].collect()} == want
    monkeypatch.setattr(pipeline, "WEIGHTS", {"src0": 1, "src1": 9, "*": 2})
    other = materialise(pipeline.source_mixture(spark, stages[3], small), "other")
    assert {(r.shard, r.slot, r.doc_id) for r in pipeline.shards(spark, other, small).collect()} != want
    plain = pipeline.shards(spark, stages[3], small).collect()
    assert {(r.shard, r.slot, r.doc_id) for r in plain} != want, "the stage taken out changes the result"


def test_shards_in_a_given_order_with_copies(spark):
    rows = [(i, "hot" if i % 3 == 0 else "pair" if i in (1, 50) else f"t{i}", (i * 37) % 101) for i in range(101)]
    df = spark.createDataFrame([*rows, (None, None, 101)], "doc_id long, text string, at int").repartition(3)
    out = sharding.shard_documents(df, 5, order_col="at").collect()
    place = {i: at for i, _, at in rows} | {None: 101}
    sizes = Counter(r.shard for r in out)
    assert len(out) == 102 and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        own = sorted((r.slot, place[r.id]) for r in out if r.shard == shard)
        assert [s for s, _ in own] == list(range(n)) and [p for _, p in own] == sorted(p for _, p in own)
    assert len({r.shard for r in out if r.id in (1, 50)}) == 1
    assert pipeline.shards(spark, df, "").count() == 102, "a frame that is no written table"
