import gc
import hashlib

import corpus_pipeline as pipeline
from tests.llm import test_op5, test_op7, test_op9
from tests.llm.test_op10 import _LIB

SF = "/root/testdata/sf0.001"


def units_kept(rows):
    """Brute-force removal of repeated passages of (doc_id, text) with distinct ids."""
    new = [(d, kept) for (d, _), (kept, _) in zip(rows, test_op5.brute(rows))]
    return [(d, kept) for (d, text), (_, kept) in zip(rows, new) if kept == text or kept.strip(" ")]


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = pipeline.quality_classifier(spark, docs, SF)
    assert good.columns == docs.columns
    rows = sorted((r.doc_id, r.text) for r in good.collect())
    assert 150 < len(rows) < 200
    rows = [(d, t) for (d, t), (_, _, c) in zip(rows, sorted(test_op7.brute(rows, 5, 4, 5))) if d == c]
    rows = units_kept(rows)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {r[0] for r in test_op9.brute(rows, items) if r[5] or r[2] >= 13}
    want = []
    for d, t in rows:
        if d not in hit:
            ids = _LIB().encode_ordinary(t)
            want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), ids))
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in pipeline.run(spark, SF).collect())
    assert len(hit) > 0 and got == sorted(want)


def test_edges_pass_every_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "The cat sat on the mat, and then it went to sleep. A dog came by; nobody else had seen it before, so far."
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, text, "en", "s", len(text)), (3, text, "en", None, len(text)), (3, text, "en", None, len(text)), (4, text + "\nOwn line of this text.", None, "s", 3), (5, " ".join(f"w{i}x" for i in range(30_000)) + ".", "en", "s", 1)]
    for rows in (rows, []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, SF).collect(), schema)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert pipeline.byte_bpe(spark, docs, SF).count() == docs.count()
        assert docs.count() >= (len(rows) > 0)


def test_copies_without_an_id_leave_one_of_each_class(spark):
    text = [" ".join(f"{c}{i}" for i in range(60)) for c in "ab"]
    rows = [(7, text[0]), (None, text[0]), (None, text[0] + " more"), (None, text[1]), (None, text[1]), (None, text[1] + " more"), (None, ""), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in pipeline.jaccard_join(spark, docs, SF).collect()]
    assert [r for r in got if r[1] and r[1][0] == "a"] == [(7, text[0])]
    assert len([r for r in got if r[1] and r[1][0] == "b"]) == 1
    assert sorted(str(r[1]) for r in got if not r[1]) == ["", "", "None"]


def test_a_later_stage_keeps_tables_of_frames_that_are_held(spark):
    text = "The cat sat on the mat, and then it went to sleep. A dog came by; nobody else had seen it before, so far."
    docs = spark.createDataFrame([(i, f"{i} {text}") for i in range(3)], "doc_id long, text string")
    first, second = (pipeline.substring_dedup(spark, docs, SF) for _ in range(2))
    folder = pipeline._read[-2][1].path
    pipeline.byte_bpe(spark, docs, SF)
    assert sorted(first.collect()) == sorted(second.collect()) and first.count() == 3
    del first
    gc.collect()
    pipeline.byte_bpe(spark, docs, SF)
    assert folder not in [held.path for _, held in pipeline._read] and second.count() == 3
