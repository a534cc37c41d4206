import os
import shutil

import corpus_pipeline as cp
from silverbrook.llm import decontaminate, line_dedup, quality, simhash_golay
from silverbrook.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_stage_on_its_input(spark, small):
    docs = table(spark, small, "documents")
    assert [name for name, _ in cp.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in cp.STAGES:
        after = cp.materialize(stage(spark, docs, small), name)
        before, kept = ({r.doc_id: r for r in d.select("doc_id", "text", "n_chars").collect()} if "text" in d.columns else {}
                        for d in (docs, after))
        if name == "quality":
            rated = {r.doc_id: r.predicted for r in quality.quality(docs, table(spark, small, "labels")).collect()}
            assert set(kept) == {d for d, p in rated.items() if p} and all(kept[d] == before[d] for d in kept)
        elif name == "line_dedup":
            rest = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
            assert set(kept) == {d for d, r in rest.items() if r.n_removed < r.n_lines}
            assert all(kept[d].text == rest[d].text and kept[d].n_chars == len(kept[d].text) for d in kept)
        elif name == "near_dedup":
            group = {r.doc_id: r.component_id for r in simhash_golay.near_duplicates(docs).collect()}
            assert sorted(kept) == sorted(set(group.values()))
        elif name == "decontamination":
            bad = {r.doc_id: r.contaminated for r in decontaminate.contamination(docs, table(spark, small, "benchmark")).collect()}
            assert set(kept) == {d for d, c in bad.items() if not c} and any(bad.values())
        else:
            assert {r.doc_id for r in after.select("doc_id").collect()} == set(before)
            assert max(r.n for r in after.groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n").collect()) <= 2048
            break
        assert after.columns == COLUMNS
        docs = after
    assert cp.run(spark, small).count() == after.count()


def test_odd_tables(spark, small, tmp_path):
    for name in ("benchmark", "labels"):
        shutil.copy(f"{small}/{name}.parquet", tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = str(tmp_path)
    for number, rows in enumerate([[], [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words here", None, "s", 15),
                                        (3, "some words here", "en", None, 15), (3, "some words here", "en", None, 15)]]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in cp.STAGES:
            docs = cp.materialize(stage(spark, docs, folder), f"odd-{number}")
            assert name == "packing" or docs.columns == COLUMNS
        assert docs.count() == 0 if not rows else docs.count() >= 2
    assert os.listdir(folder)
