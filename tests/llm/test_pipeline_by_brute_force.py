"""Pipeline stages that SQL or all pairs can check, each on its own input; alike rows and odd ids in the mix; items
without an id; ids of long chats; workers that cannot import the library."""

import os
import random
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strata.llm import chat, decontaminate, queries

from test_corpus import brute_lines, text_of

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_quality_stage_keeps_what_the_sql_keeps(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    kept = {i for i, k in con.execute(f"select doc_id, kept from ({queries.ORACLE['op3_quality_rules']})").fetchall() if k}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r.doc_id for r in stage("quality_rules")(spark, docs, SF).select("doc_id").collect()} == kept


def test_line_stage_by_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 1500")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = {d: t for d, t, n, gone in brute_lines(spark, rows) if gone == 0 or gone < n}
    assert {r.doc_id: r.text for r in stage("line_dedup")(spark, docs, SF).collect()} == want


def test_mixing_stage_by_sql(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.withColumn("h", F.xxhash64("text")).write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    con.execute(f"create view labels as select * from '{SF}/labels.parquet'")
    sql = queries.ORACLE["op10_mix_sources"]
    for old, new in (("d AS (SELECT doc_id,", "d AS (SELECT doc_id, h,"), ("|| doc_id)", "|| '{' || doc_id || ', ' || h || '}')")):
        assert sql.count(old) == 1
        sql = sql.replace(old, new)  # the stage tells texts of one id apart
    want = {r[0]: r[1:] for r in con.execute(f"select doc_id, size, source_size, round(target, 6), taken from ({sql}) where taken > 0").fetchall()}
    got = {r.doc_id: (r["size"], r.source_size, round(r.target, 6), r.taken) for r in stage("mixing")(spark, docs, SF).collect()}
    assert got == want


@pytest.mark.parametrize("ids", [[None] * 3, [4] * 3, [None, None, 7]])
def test_alike_rows_share_every_word_of_the_mix(spark, ids):
    words = text_of(5, 20)
    rows = [(i, words, "a") for i in ids] + [(100 + i, text_of(100 + i, 31), "b") for i in range(3)] + [(200, words, "b")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = stage("mixing")(spark, docs, SF).collect()
    for s in "ab":
        own = [r for r in got if r.source == s]
        size = sum(20 if t == words else 31 for _, t, x in rows if x == s)
        assert sum(r.taken for r in own) == min(round(own[0].target), 3 * size)
    for i in set(ids):
        shares = [r.taken for r in got if r.source == "a" and r.doc_id == i]
        assert max(shares) - min(shares) <= 1


def test_words_inside_an_item_without_an_id_are_hit(spark):
    docs = spark.createDataFrame([(1, "x alpha beta gamma"), (2, "nothing"), (3, "one two")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "alpha beta gamma"), (9, "one two"), (None, "one two")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"], r.contaminated) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: (3, [], True), 2: (0, [], False), 3: (2, ["9"], True)}
    long = spark.createDataFrame([(1, text_of(1, 60_000) + " alpha beta gamma")], "doc_id long, text string")
    assert decontaminate.contamination(long, items).first().n_hit == 3


def test_ids_of_long_texts_are_those_of_the_whole_text():
    r = random.Random(3)
    codec = chat.Codec(chat.VOCABULARY)
    parts = ["word ", "don't ", "  two", "\n\n\n", "\t x", "12345678", "é ü", "!?!?", " " * 50, "漢字", "a" * 300]
    for n in (5_000, 30_000):
        text = "".join(r.choice(parts) for _ in range(n))
        assert len(text) > chat.PIECE and codec.encode(text) == codec.bpe.encode_ordinary(text)
        assert codec.bpe.decode_bytes(codec.encode(text)).decode() == text
    for text in ("x" * 100_000, " " * 100_000, "\n " * 40_000):
        assert codec.encode(text) == codec.bpe.encode_ordinary(text)


def test_workers_need_no_copy_of_the_library(tmp_path):
    script = tmp_path / "job.py"
    script.write_text(f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setCheckpointDir({str(tmp_path / 'ck')!r})
sys.path.insert(0, {ROOT!r})  # on the driver's path only
def absent(batches):
    import importlib.util
    assert importlib.util.find_spec("strata") is None
    yield from batches
spark.range(3).mapInArrow(absent, "id long").collect()
from strata.llm import queries
for name in ("op1_chat_formatting", "op2_toxicity", "op6_warc", "op9_personal_data", "op11_merkle_manifest", "op12_conversation_repair", "op13_substring_dedup"):
    print(name, queries.QUERIES[name](spark, {SF!r}).count(), flush=True)
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-2000:]
    assert out.stdout.count("op") >= 7
