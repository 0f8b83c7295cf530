import math
import re

import corpus_pipeline as C
from blkscope.llm import quality as Q
from blkscope.llm import secret_scan
from blkscope.llm.common import written
from test_exact_dedup import brute as brute_exact
from test_packing import check
from test_quality import brute_model
from test_similar import expected

FOLDER = "/root/testdata/sf0.001"


def plain_quality(rows, labels):
    """Which rows stay, by the model of test_quality in plain Python."""
    p = None
    trusted = {r.doc_id for r in labels if r.doc_id is not None}
    for r in labels:
        if r.quality != 1 or r.toxic == 1:
            trusted.discard(r.doc_id)
    keys = sorted(trusted)
    held = hashed(keys)
    p = brute_model([t or "" for i, t, _ in rows if i in trusted and i not in held])
    seen = {}

    def nll(t):
        own = Q.grams(t) if (t or "").strip() else []
        return -sum(math.log(seen.setdefault(g, p(g))) for g in own), len(own)

    scores = [(i, lang, *nll(t)) for i, t, lang in rows]
    rate = [x for x in scores if x[0] in held and x[3]]
    overall = sum(x[2] for x in rate) / sum(x[3] for x in rate)

    def limit(values):
        values = sorted(values)
        return values[math.ceil(Q.QUANTILE * len(values)) - 1] * (1 + Q.ROOM / math.sqrt(len(values)))

    def drawn(x, mean):
        return math.exp((x[2] + Q.PRIOR * mean) / (x[3] + Q.PRIOR))

    by = {}
    for lang in {x[1] for x in rate}:
        own = [x for x in rate if x[1] == lang]
        mean = sum(x[2] for x in own) / sum(x[3] for x in own)
        by[lang] = mean, limit([drawn(x, mean) for x in own])
    rest = overall, limit([drawn(x, overall) for x in rate])
    return {x[0] for x in scores if x[3] and drawn(x, by.get(x[1], rest)[0]) <= by.get(x[1], rest)[1]}


def hashed(keys):
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    df = SparkSession.getActiveSession().createDataFrame([(k,) for k in keys], "k long")
    return {r.k for r in df.filter(F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(Q.HOLD_OUT)) == 0).collect()}


def test_each_stage_against_plain_python(spark, documents):
    docs, columns = documents, documents.columns
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    for k, (_, stage) in enumerate(C.STAGES):
        out = written(stage(spark, docs, FOLDER), "t")
        before = {r.doc_id: r for r in docs.collect()}
        if k < 4:
            assert out.columns == columns
            after = {r.doc_id: r for r in out.collect()}
            assert out.count() == len(after)
        if k == 0:
            want = plain_quality([(r.doc_id, r.text, r.lang) for r in before.values()], labels.collect())
            clean = {r.doc_id for r in labels.filter("quality = 1").collect()}
            assert len(clean & set(before) - set(after)) <= 0.02 * len(clean)
        elif k == 1:
            want = {i for i, _, _, kept, _ in brute_exact([(r.doc_id, r.text) for r in before.values()]) if kept}
        elif k == 2:
            want = {i for i, c in expected([(r.doc_id, r.text) for r in before.values()]).items() if i == c}
        elif k == 3:
            want = set(before)
            found = [r for r in secret_scan.scan(docs, *secret_scan.trained(docs)).collect() if r.is_secret]
            for i, r in after.items():
                text = before[i].text
                for v in sorted({f.value for f in found if f.doc_id == i}, key=len, reverse=True):
                    text = text.replace(v, "[SECRET]")
                assert r.text == text
        if k < 4:
            assert set(after) == want
            assert all(after[i] == before[i] for i in after) or k == 3
        else:
            n, total = check([(r.doc_id, r.text) for r in before.values()], out.collect(), 2048)
            assert n <= -(-total // 2048) + 1
        docs = out


def test_rows_that_share_a_key_are_told_apart(spark, hard):
    rows = [(1, "the same words stand here again and again, all of them"), (1, None), (1, "the same words stand here again and again, all of them"), (2, "the same  words stand here again and again, all of them"), (None, "%%% ### @@@ &&& ^^^ " * 40)]
    labels = "/root/testdata/sf0.001"
    df = spark.createDataFrame([(i, t, "en", "s", 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __id long, sha long, key long")
    docs = hard.sparkSession.read.parquet(f"{labels}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars", "0L AS __id", "0L AS sha", "0L AS key").unionByName(df)
    left = C.quality_classifier(spark, docs, labels).filter("doc_id < 1000 OR doc_id IS NULL").collect()
    assert sorted(r.doc_id for r in left) == [1, 1, 2]
    once = C.exact_duplicates(spark, df, labels).collect()
    assert sorted(((r.doc_id, r.text) for r in once), key=str) == sorted({(1, rows[0][1]), (1, None), (None, rows[4][1])}, key=str)
    again = C.near_duplicates(spark, df, labels).collect()
    assert sorted(((r.doc_id, r.text) for r in again), key=str) == sorted([(1, rows[0][1]), (1, rows[0][1]), (1, None), (None, rows[4][1])], key=str)


def test_run_deletes_its_tables(spark):
    import pathlib

    from blkscope.llm.common import shared_dir

    folder = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    old = set(folder.iterdir())
    assert C.run(spark, FOLDER).count() > 100
    new = [p.name for p in set(folder.iterdir()) - old]
    assert len(new) == 1 and new[0].startswith("stage-4"), new


def test_hard_rows_go_through(spark, hard):
    docs = hard
    for _, stage in C.STAGES:
        docs = written(stage(spark, docs, FOLDER), "t")
    assert docs.count() > 5
    docs = hard.limit(0)
    for _, stage in C.STAGES:
        docs = written(stage(spark, docs, FOLDER), "t")
    assert docs.count() == 0


def test_operators_name_no_local_checkpoint():
    import pathlib

    for p in pathlib.Path(C.__file__).parent.glob("blkscope/llm/*.py"):
        assert not re.search(r"localCheckpoint\(", p.read_text())
