import corpus_pipeline
from parley.llm import near_dedup, packing, quality, substring_dedup, toxicity
from tests.llm.conftest import prose

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_pack_what_is_left(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    columns, steps = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(corpus_pipeline.written(stage(spark, steps[-1], FOLDER), name.replace(" ", "-")))
    assert all(step.columns == columns for step in steps[:-1])
    ids = [{r.doc_id for r in step.select("doc_id").collect()} for step in steps]
    assert ids[1] == {r.doc_id for r in quality.scored(docs, labels).filter("kept").collect()}
    assert ids[2] == {r.doc_id for r in toxicity.scored(steps[1], labels).filter("predicted = 0").collect()}
    assert ids[3] == {r.doc_id for r in near_dedup.linked(steps[2], near_dedup.STAGE_PERCENT, near_dedup.STAGE_BANDS, near_dedup.STAGE_ROWS).filter("kept").collect()}
    assert ids[4] == ids[3] == ids[5]
    cut = {r.doc_id: r.n_words - r.n_removed for r in substring_dedup.repeated_words_removed(steps[3]).collect()}
    assert {r.doc_id: len(r.text.split()) for r in steps[4].filter("text is not null").collect()} == cut
    found, again = steps[5], packing.packed(steps[4])
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, found.select(names).collect())) == sorted(map(tuple, again.select(names).collect()))


def test_an_empty_corpus_and_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (2, " ".join(prose(1)), None, "s", None), (2, None, "en", "s", 0)]
    odd = spark.createDataFrame(odd, docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        odd = corpus_pipeline.written(stage(spark, odd, str(tmp_path)), "odd")
    assert {"doc_id", "start", "length"} <= set(odd.columns)


def test_quality_runs_its_function_once_and_moves_no_text(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    kept = quality.accepted(docs, labels)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    wanted = sorted(r.doc_id for r in kept.collect())
    monkeypatch.setattr(quality, "MOST_GROUPS", 0)
    assert sorted(r.doc_id for r in quality.accepted(docs, labels).collect()) == wanted
    assert wanted == sorted(r.doc_id for r in quality.scored(docs, labels).filter("kept").collect())


def test_tables_of_a_stage_go_when_the_next_begins(spark, monkeypatch):
    import os

    from parley.session import shared_folder

    root = shared_folder(spark).removeprefix("file://")
    folders = lambda: {name for name in os.listdir(root) if name.startswith("parley-")}
    docs, before = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(200), folders()
    outputs, earlier = set(), set()
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, FOLDER)
        assert not earlier & folders()
        made = folders() - before - outputs
        docs = corpus_pipeline.written(found, "out")
        outputs |= folders() - before - outputs - made
        earlier = made
    corpus_pipeline.release(spark, docs)
    assert folders() - before == outputs
    # Rows that were not written before the next stage are still read from what the first one left.
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(200)
    first = corpus_pipeline.near_dedup_stage(spark, docs, FOLDER)
    wanted = first.count()
    assert corpus_pipeline.substring_stage(spark, first, FOLDER).count() == wanted
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[2:4])
    before = folders()
    result = corpus_pipeline.run(spark, FOLDER)
    assert result.count() and len(folders() - before) == 1
