"""The pipeline: every stage on all its predecessor kept, decisions in effect."""

import corpus_pipeline

from tarmac.llm.common import table

SF = "/root/testdata/sf0.01"


def test_stages_chain(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert name == "packing" or docs.columns == columns
    assert kept[1] <= kept[0] and kept[2] <= kept[1] and kept[3] <= kept[2] and kept[4] == kept[3]
    assert counts[1] < counts[0] and counts[2] < counts[1]
    toxic = {r["doc_id"] for r in table(spark, SF, "labels").where("toxic = 1").collect()}
    clean = {r["doc_id"] for r in table(spark, SF, "labels").where("toxic = 0").collect()}
    assert len(toxic & kept[0]) < 0.3 * len(toxic) and len(clean & kept[0]) > 0.97 * len(clean)


def test_run_is_registered(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()
    assert len([n for n in entry.queries() if n.startswith("op") and "_" in n]) == 13
    assert {r["offset"] >= 0 for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()} == {True}
