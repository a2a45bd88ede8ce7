import os

import pytest
from pyspark.sql import functions as F
from samples import edge_rows, prose, table

import corpus_pipeline as cp

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, prose(999, 30))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    body = [(i, prose(i, 60 + i % 9), "en", f"s{i % 4}") for i in range(80)]
    body[5] = (5, prose(5, 20) + " " + prose(999, 30), "en", "s1")
    body[6] = (6, body[6][1] + " write to me@home.example or +1 (017) 555-7713", "en", "s2")
    body += [(100, body[0][1], "en", "s0"), (101, body[1][1] + " more", "en", "s0"), (1, body[1][1], "en", "s1")]
    table(spark, body + edge_rows()).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_keep_what_is_clean(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    ids, texts = [], {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        ids.append(sorted(str(r.doc_id) for r in docs.collect()))
    bodies = {r.doc_id: r for r in docs.collect()}
    clean = {str(i) for i in range(80)}
    assert clean <= set(ids[0]) and not {"900", "901", "902", "903", "907"} & set(ids[0])
    assert set(ids[1]) == set(ids[0]) - {"100", "101"} and len(ids[1]) == len(set(ids[1]))
    assert set(ids[2]) == set(ids[1]) - {"5"} and ids[3] == ids[2]
    assert bodies[6].text.endswith("write to [EMAIL] or [PHONE]") and bodies[6].n_chars == len(bodies[6].text)
    assert bodies[7].text == prose(7, 67)


def test_extra_columns_may_have_any_name(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.select("*", *(F.lit(n).alias(n) for n in ("_gone", "_gone_", "_again", "_at", "_later", "_several", "_address", "_held")))
    plain, wide = docs, odd
    for _, stage in cp.STAGES[:-1]:
        plain, wide = stage(spark, plain, folder), stage(spark, wide, folder)
        assert wide.columns == odd.columns
        assert sorted(map(str, wide.select(*docs.columns).collect())) == sorted(map(str, plain.collect()))
    assert cp.mixed(spark, wide, folder).count() == cp.mixed(spark, plain, folder).count()


def test_run_is_repeatable_and_complete(spark, folder):
    a, b = (sorted(map(str, cp.run(spark, folder).collect())) for _ in range(2))
    assert a == b
    rows = cp.run(spark, folder)
    assert rows.filter(F.size(F.split("text", r"[\x20\x09-\x0D]+")) < F.col("n_words")).count() == 0


def test_empty_documents(spark, tmp_path, folder):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="benchmark tables not here")
def test_every_text_query_runs(spark):
    import __spark_entry__ as entry

    known = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in known} and "pipeline" in known
    for name in ("op1_quality_rules", "op6_url_filter"):
        assert known[name](spark, FOLDER).count() > 0


def test_near_duplicates_by_five_words_at_four_fifths(spark, folder):
    words = prose(4000, 100).split()
    near, far = list(words), list(words)
    for at in (30, 60):
        near[at] = f"new{at}"           # 86 of 106 runs of five words
    for at in (20, 50, 80):
        far[at] = f"new{at}"            # 81 of 111
    rows = [(1, " ".join(words), "en", "s"), (2, " ".join(near), "en", "s"), (3, " ".join(far), "en", "s")]
    kept = {r.doc_id for r in cp.one_of_each_group(spark, table(spark, rows), folder).collect()}
    assert kept == {1, 3}


def test_rows_with_a_null_or_shared_id_are_judged_one_by_one(spark, folder, tmp_path):
    leak = prose(999, 30)
    rows = [(i, prose(5000 + i, 40), "en", "s") for i in range(20)]
    rows += [(None, prose(6000, 40), "en", "s"), (None, prose(6001, 40), "en", "s"), (None, "12 34", "en", "s"),
             (None, prose(6002, 20) + " " + leak, "en", "s"), (None, prose(6003, 40) + " a", "en", "s"),
             (7, prose(6004, 40), "en", "s"), (8, prose(6005, 20) + " " + leak, "en", "s"), (9, "56", "en", "s"),
             (30, prose(6003, 40) + " b", "en", "s")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    clean = {(i, prose(5000 + i, 40)) for i in range(20)} | {(None, prose(6000, 40)), (None, prose(6001, 40)),
             (7, prose(6004, 40)), (30, prose(6003, 40) + " b")}
    assert {(r.doc_id, r.text) for r in docs.collect()} == clean
    mixed = cp.mixed(spark, docs, str(tmp_path)).collect()
    assert {(r.doc_id, r.text) for r in mixed} == clean
