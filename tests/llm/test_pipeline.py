import corpus_pipeline
from tests.llm.helpers import empty_table, odd_table


def test_stages_on_the_given_tables(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = []
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(place)))
        docs = spark.read.parquet(str(tmp_path / str(place)))
        seen.append((name, docs.count()))
        if name != "mix":
            assert docs.columns == before.columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert [n for n, _ in seen] == ["quality_rules", "near_duplicates", "decontaminate", "secret_scan", "mix"]
    assert seen[0][1] >= seen[1][1] >= seen[2][1] == seen[3][1] == seen[4][1] > 0
    first = sorted(map(tuple, docs.collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == first


def test_odd_rows(spark, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        for docs in (odd_table(spark), empty_table(spark)):
            out = stage(spark, docs, sf_dir)
            assert out.count() <= docs.count()
