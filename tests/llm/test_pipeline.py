"""Stages of the pipeline, each against a plain version on its own input; the queries against their SQL."""

import glob
import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute

import corpus_pipeline as P
from lectern.llm import queries as Q
from lectern.llm import toxicity as X

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for _, stage in P.STAGES:
        after = stage(spark, docs, DATA)
        out.append(([r.asDict() for r in docs.collect()], [r.asDict() for r in after.collect()], after.columns))
        docs = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in out[-1][1]], docs.schema) if after.columns == docs.columns else None
    return out


def test_columns_stay(kept):
    assert all(c == ["doc_id", "text", "lang", "source", "n_chars"] for _, _, c in kept[:-1])


def test_toxic_documents_go(spark, kept):
    before, after, _ = kept[0]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scores = X.toxicity(docs, X.train(docs, spark.read.parquet(f"{DATA}/labels.parquet")), spans=False)
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in scores.collect() if r["score"] < 0.5} and len(after) < len(before)


def test_toxic_documents_go_by_brute_force(spark, kept):
    """Scores told anew from the text alone, word by word, with the weights that the stage trains."""
    before, after, _ = kept[0]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = X.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    score = {r["doc_id"]: brute.noisy_or(r["text"], model) for r in before}
    assert {r["doc_id"] for r in after} >= {i for i, s in score.items() if s < 0.4999} and not {r["doc_id"] for r in after} & {i for i, s in score.items() if s > 0.5001}
    marked = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert sum((score[i] >= 0.5) == bool(y) for i, y in marked.items()) >= 0.97 * len(marked)


@pytest.mark.parametrize("stage", range(5))
def test_every_stage_takes_odd_rows(spark, stage):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, None, None, None, None), (None, "", "en", None, 0), (1, "a b c", None, "s", 5), (1, "a b c", None, "s", 5), (2, long, "en", "s", len(long)), (None, "a b c", "fr", "t", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for extra in ("score", "size", "_row", "items", "kept_text"):
        docs = docs.withColumn(extra, F.lit("x"))
    got = P.STAGES[stage][1](spark, docs, DATA)
    if stage < 4:
        assert got.columns == docs.columns
    want = {0: 6, 1: 4, 2: 6, 3: 6, 4: 6}[stage]  # of the three "a b c" the first with id 1 stays
    assert got.count() == want and all(r[c] == "x" for r in got.collect() for c in ("score", "_row") if c in got.columns)
    assert P.STAGES[stage][1](spark, docs.limit(0), DATA).count() == 0


def test_one_of_each_group_stays(kept):
    before, after, _ = kept[1]
    want, links = brute.linked([(r["doc_id"], r["text"]) for r in before], 5, 80, 100)
    assert links and {r["doc_id"] for r in after} == {i for i, (n, top) in want.items() if top == i or not n}


def test_one_of_each_group_stays_without_ids_and_with_repeated_ones(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "z"])
    same, other, alone = " ".join(words), " ".join(f"v{i}" for i in range(30)), " ".join(f"u{i}" for i in range(30))
    rows = [(None, same), (None, same), (None, near), (1, other), (1, other), (2, other), (None, other), (3, alone), (4, ""), (4, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in P.drop_near_copies(spark, docs, DATA).collect()]
    assert sorted(map(repr, got[:])) == sorted(map(repr, [x for x in got if x[0] is None and x[1] in (same, near)][:1] + [(1, other), (3, alone), (4, ""), (4, ""), (None, None)]))
    assert sum(t in (same, near) for _, t in got) == 1
    two = [(5, same), (5, near), (6, near)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in two], docs.schema)
    assert [r["doc_id"] for r in P.drop_near_copies(spark, docs, DATA).collect()] == [5]


def test_repeats_are_cut(kept):
    before, after, _ = kept[2]
    want = brute.removed([(r["doc_id"], r["text"]) for r in before], 50)
    texts = {r["doc_id"]: r["text"] for r in before}
    for r in after:
        n, gone, _ = want[r["doc_id"]]
        assert r["text"] == texts[r["doc_id"]] if not gone else len(brute.plain(r["text"])) == n - gone and r["n_chars"] == len(r["text"])


def test_benchmark_text_goes(spark, kept):
    before, after, _ = kept[3]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = brute.hits([(r["doc_id"], r["text"]) for r in before], items, 10)
    assert {r["doc_id"] for r in after} == {i for i, x in want.items() if not x[1]}


def test_mix_takes_the_targets(kept):
    before, after, _ = kept[4]
    sizes: dict = {}
    for r in before:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.plain(r["text"]))
    want = brute.levels(sizes)
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    assert all(r["target"] == pytest.approx(want[r["source"]]) and r["taken"] == r["copies"] * r["size"] for r in after)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = Q.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    r = db.execute(Q.ORACLES[name])
    names = [x[0] for x in r.description]
    want = [tuple(row[names.index(c)] for c in cols) for row in r.fetchall()]
    assert sorted(map(repr, (tuple(x[c] for c in cols) for x in df.collect()))) == sorted(map(repr, want))


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 11))
