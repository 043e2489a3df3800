"""The registered queries on the driver's smallest tables: against SQL where there is some, else against plain Python."""

import glob
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from quarrylab.llm.queries import ORACLE_SQL, QUERIES

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return connection


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(spark, duck, name):
    df, want = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    rows = lambda got, names: sorted(str([r[names.index(c)] for c in order]) for r in got)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), want.columns)


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    """Stage by stage: what goes and what stays, and that every kept token is in the end in one piece."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stage(step(spark, docs, LARGER), name)
        assert after.columns == columns
        old, new = ({r.doc_id: r.text for r in d.collect()} for d in (docs, after))
        assert set(new) <= set(old)
        gone = set(old) - set(new)
        if name == "quality":
            bad = {r.doc_id for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect() if r.quality == 0 or r.toxic == 1}
            known = {r.doc_id for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
            assert len(bad & gone) > 0.7 * len(bad) and len((known - bad) & gone) < 0.02 * len(known - bad)
        if name == "near_duplicates":
            texts = Counter(new.values())
            assert max(texts.values()) == 1 and gone
        if name == "decontamination":
            passages = [" ".join(r.text.split()[:10]).lower() for r in spark.read.parquet(f"{LARGER}/benchmark.parquet").collect()]
            assert all(not any(p in " ".join(t.lower().split()) for p in passages) for t in new.values())
        if name == "personal_data":
            assert not gone and all("@mail" not in t for t in new.values())
            assert all(r.n_chars == len(r.text) for r in after.collect())
        docs = after
        sizes.append(len(new))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, LARGER).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()} and sizes == sorted(sizes, reverse=True)
    total = Counter()
    for r in pieces:
        total[r.doc_id] += r.length
    assert all(total[r.doc_id] == r.doc_tokens for r in pieces)


def test_stages_on_awkward_rows(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (1, "other words stand here now", "en", "s", 26), (2, None, None, None, None), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "mail me@x.example.com", "en", None, 21), (4, "a b c d e f g", "de", "t", 13)]
    docs = corpus_pipeline.stage(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "rows")
    kept = [tuple(r)[:2] for r in corpus_pipeline.deduplicated(spark, docs, SF).collect()]
    assert sorted(kept, key=str) == sorted([(1, "a b c d e f g"), (1, "other words stand here now"), (2, None), (2, None), (3, ""), (None, "mail me@x.example.com")], key=str)
    made = {tuple(r)[:2]: r.n_chars for r in corpus_pipeline.personal_data_redacted(spark, docs, SF).collect()}
    assert made[None, "mail [EMAIL]"] == 12 and made[2, None] is None
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), SF).count() == 0


def test_all_stages_on_awkward_rows(spark):
    """Nulls, empty, long and repeated texts, ties, and columns with the names that stages use inside: each stage gives rows of all columns."""
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, "x y z " * 50_000), (1, "x y z " * 50_000), (2, None), (3, ""), (None, None), (None, "some plain words of no doc"), (5, f"before {passage} after"), (5, "another text with that id"), (6, " \n\t"), (7, "12 ?!")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("_key_id", "_key_hash", "key_id", "key_hash", "KEY_ID_", "component", "kept", "text_hash", "label", "row"):
        docs = docs.withColumn(name, corpus_pipeline.F.lit("clash"))
    docs = corpus_pipeline.stage(docs, "rows")
    got = {name: corpus_pipeline.stage(step(spark, docs, SF), name) for name, step in corpus_pipeline.STAGES}
    assert all(got[n].columns == docs.columns for n, _ in corpus_pipeline.STAGES[:-1])
    texts = lambda n: Counter((r.doc_id, r.text) for r in got[n].collect())
    whole = Counter(rows)
    assert texts("decontamination") == whole - Counter([rows[6]]) and texts("near_duplicates") == whole - Counter([rows[0]]) and texts("personal_data") == whole
    kept = texts("quality")
    assert all(n in (0, whole[r]) for r, n in kept.items()) and not kept - whole
    pieces = got["packing"].collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(k for k, _ in rows) and sum(r.doc_tokens == 1 for r in pieces) >= 3


def test_op8_agrees_with_op7(spark):
    ids = {r.doc_id: r.n_tokens for r in QUERIES["op8_token_files"](spark, SF).collect()}
    assert ids == {r.doc_id: r.doc_tokens for r in QUERIES["op7_packing"](spark, SF).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.text_crc32 for r in QUERIES["op4_sharding"](spark, SF).collect()} == {k: zlib.crc32(t.encode()) for k, t in docs.items()}
    assert np.unique(list(ids)).size == len(docs)
