"""Whole conversions, sinks, streams, and the queries beside their SQL."""

import glob
import math
import os

import duckdb
import pytest

from lectern.functions import text as T
from lectern.plans import convert as V
from lectern.plans import queries as Q
from lectern.sources import documents as D
from lectern.sources import html as W
from lectern.sources import sinks as X
from lectern.streaming.landing import run_on_arrival

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def norm(v):
    return (None if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, db, name):
    df = Q.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    r = db.execute(Q.ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = [tuple(norm(row[names.index(c)]) for c in cols) for row in r.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


LIKE_HEADINGS = ["block_items", "catalog_furniture", "clauses_of_lines", "layout_blocks", "page_paragraphs", "web_paragraphs"]


@pytest.mark.parametrize("name", LIKE_HEADINGS)
def test_query_equals_sql_where_lines_look_like_headings(spark, tmp_path, name):
    some = ["56.187.231.175 Keit in lich auf.", "Second line of it.", "4763047826333361 Of thnd", "on it goes", "Article 7 (Purpose) The purpose is this.", "Section 5", "ab", "4.2 Records kept", "12", "x y", "Annex B Forms"]
    texts = ["\n".join((some[3 * i % 11 :] + some[: 3 * i % 11])[: 1 + i % 13]) for i in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = Q.QUERIES[name](spark, str(tmp_path))
    r = c.execute(f"select {', '.join(df.columns)} from ({Q.ORACLES[name]})")
    assert sorted(repr(tuple(x)) for x in df.collect()) == sorted(map(repr, r.fetchall()))


def test_operators_of_turns_see_whole_turns(spark, db):
    want = db.execute("select conv_id, text from conversations where role <> 'user'").fetchall()
    assert max(len(t) for _, t in want) > 60
    for name in ("prose_items", "assessment_sheet"):
        assert sorted((r["doc_id"], r["text"]) for r in Q.QUERIES[name](spark, DATA).collect()) == sorted(want)
    heads = {t for (t,) in db.execute("select text from conversations where role = 'user'").fetchall()}
    assert max(map(len, heads)) > 60 and {r["section"] for r in Q.QUERIES["section_carry"](spark, DATA).collect()} <= heads | {""}


def page_words(doc, page, lines):
    out, n = [], 0
    for i, line in enumerate(lines):
        for j, w in enumerate(line.split()):
            out.append((doc, page, n, w, 50.0 + 40 * j, 85.0 + 40 * j, 60.0 + 20 * i, 70.0 + 20 * i, 10.0, "Serif", True))
            n += 1
    return out


def test_prose_conversion(spark):
    rows = []
    for p, body in ((1, ["1 Scope", "The parts shall"]), (2, ["fit together well."]), (3, ["All good."])):
        rows += page_words("d", p, ["Running header", *body, f"Page {p}"])
    words = spark.createDataFrame(rows, D.WORDS)
    pages = words.select("doc_id", "page").distinct()
    got = V.prose(words, pages, "numbered")
    assert [(r["kind"], r["text"]) for r in got.paragraphs.orderBy("para_id").collect()] == [("heading", "1 Scope"), ("body", "The parts shall fit together well."), ("body", "All good.")]
    assert [(r["clause_id"], r["title"], r["classification"]) for r in got.items.orderBy("item_no").collect()] == [("1", "Scope", "Requirement"), ("1", "Scope", "Information")]


def test_structured_conversion(spark):
    rows = page_words("d", 2, ["AC-1 POLICY", "The organization shall keep a written policy."]) + page_words("d", 3, ["AC-2 ACCOUNTS", "Accounts must be reviewed every year."])
    words = spark.createDataFrame(rows, D.WORDS)
    pages = spark.createDataFrame([("d", p, 600.0, 800.0, 0, 0, 0, 0, "plain words") for p in (2, 3)], D.PAGES)
    got = V.structured(V.layout_blocks(words, pages, spark.createDataFrame([], D.TABLES)), "nist80053")
    assert [(r["clause_id"], r["title"], r["text"]) for r in got.items.orderBy("item_no").collect()] == [
        ("AC-1", "POLICY", "The organization shall keep a written policy."), ("AC-2", "ACCOUNTS", "Accounts must be reviewed every year."),
    ]
    assert got.failures.count() == 0 and [r["clause"] for r in got.sheets["Assessment"].orderBy("sheet_row").collect()] == ["AC-1", "AC-2"]


def test_structured_conversion_broadcasts_no_pages(spark, monkeypatch):
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(V, "cut", lambda df, real=V.cut: (plan(df), real(df))[1])
    plan(Q.structured_conversion(spark, DATA))
    assert len(plans) == 7 and "SortMergeJoin" in "".join(plans) and "Broadcast" not in "".join(plans)


def test_web_conversion(spark):
    html = "<html><head><title> A &amp; B </title></head><body><nav><p>menu</p></nav><h1>1 Title</h1><p>First<p>Second <b>bold</b><div>direct<p>inner</p></div><ul><li>1.<li>item</ul></body>"
    assert W.walk(html) == [("heading", "1 Title"), ("body", "First"), ("body", "Second bold"), ("body", "direct"), ("body", "inner"), ("body", "1."), ("body", "item")]
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    got = V.web(W.html_blocks(pages))
    assert [r["text"] for r in got.paragraphs.where("doc_id = 1").orderBy("para_id").collect()][-1] == "1. item"


def test_decoding():
    import pandas as pd

    got = W.decode_bytes(pd.Series([b"caf\xe9", "한".encode("cp949"), "é".encode(), None, b"<meta charset=latin-1>\xe9"]), pd.Series(["text/html; charset=latin-1", "", "", "", ""]))
    assert got.tolist()[:3] == ["café", "한", "é"] and got[4].endswith("é")


def test_sheets_round_trip(spark, tmp_path):
    p = str(tmp_path / "x.xlsx")
    X.write_sheets(p, {"Paragraphs": spark.createDataFrame([(1, "a<b>", None), (2, "c", 0.5)], "n int, s string, x double"), "Paragraphs2": spark.createDataFrame([(["u", "v"],)], "l array<string>")})
    got = X.read_xlsx(p)
    assert got["Paragraphs"][0] == {"row": "1", "A": "n", "B": "s", "C": "x"} and got["Paragraphs"][1]["B"] == "a<b>"
    assert got["Paragraphs2"][1]["A"] == "u, v"


def test_titles_stay_unique():
    taken: set = set()
    assert [X.unique_title("a" * 40, taken), X.unique_title("a" * 40, taken), X.unique_title("x/y", taken)] == ["a" * 31, "a" * 29 + "_2", "x_y"]


def test_settings(tmp_path):
    p = str(tmp_path / "s.json")
    X.save_settings(p, {"keys": {"offline": "k"}})
    assert os.stat(p).st_mode & 0o777 == 0o600 and X.api_key(X.load_settings(p), "offline") == "k" and X.load_settings(p + "x") == {}


def test_word_source(spark, tmp_path, monkeypatch):
    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(__file__), "word_parser.py"))
    f = tmp_path / "a.txt"
    f.write_text("one two")
    D.register(spark)
    got = spark.read.format("lectern_words").option("parser", "word_parser:parse").load(str(f)).orderBy("word_no").collect()
    assert [r["text"] for r in got] == ["one", "two"]


def test_stream_runs_the_batch_plan(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs = spark.createDataFrame([(1, "a\nb"), (2, "c")], "doc_id long, text string")
    docs.write.parquet(src)
    from lectern.operators.lines import split_lines

    q = run_on_arrival(spark, src, "doc_id long, text string", split_lines, out, str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(out).count() == 3


def test_gate_raises(spark):
    rows = [("heading", "AC-2 ACCOUNTS"), ("paragraph", "Accounts must be reviewed every year.")]
    b = spark.createDataFrame([("d", i, 1, k, t, 0.95, [], None) for i, (k, t) in enumerate(rows)], "doc_id string, block_no int, page int, block_type string, text string, confidence double, issues array<string>, rows array<array<string>>")
    got = V.structured(b, "nist80053")
    assert got.items.count() == 0
    with pytest.raises(V.QualityGateError):
        V.check(got)
    assert V.structured(b, "nist80053", force=True).items.count() == 1


def test_deck(spark):
    box = "struct<x0: double, top: double, x1: double, bottom: double>"
    pages = spark.createDataFrame([("d", 1, 800.0, 600.0, 0, 0, 0, 0, "\nTitle\nmore"), ("d", 2, 800.0, 600.0, 0, 0, 0, 0, "")], D.PAGES)
    tables = spark.createDataFrame([("d", 1, 1, [["a", "b"], ["c", "d"]], (0.0, 0.0, 10.0, 10.0)), ("d", 3, 1, [["x", "y"], ["z", None]], (0.0, 0.0, 10.0, 10.0))], f"doc_id string, page int, table_no int, rows array<array<string>>, bbox {box}")
    got = [(r["clause_id"], r["title"], r["text"]) for r in V.deck(pages, tables).items.orderBy("pos").collect()]
    assert got == [("slide1", "Title", "a | b"), ("slide1", "Title", "c | d"), ("slide1", "Title", "Title\nmore"), ("slide2", "Slide 2", ""), ("slide3", "Slide 3", "x | y"), ("slide3", "Slide 3", "z | ")]


def test_fetch_names():
    assert D.file_name("https://a.b/c/d%20e.pdf?x=1") == "d e.pdf" and D.file_name("https://a.b/") == "download.pdf"


def test_preflight_types(spark):
    words = spark.createDataFrame(page_words("d", 2, ["a b c d e f g h i j k l"] * 5), D.WORDS)
    pages = spark.createDataFrame([("d", 1, 600.0, 800.0, 1, 0, 0, 0, ""), ("d", 2, 600.0, 800.0, 0, 0, 0, 0, "plain words")], D.PAGES)
    tables = spark.createDataFrame([("d", 2, 1, [["a"]], (0.0, 0.0, 600.0, 800.0))], D.TABLES)
    assert {r["page"]: r["page_type"] for r in V.preflight(words, pages, tables).collect()} == {1: "scanned", 2: "table"}


def test_noise_text_is_stable(spark):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([("",)], "s string").select(T.clean_noise(F.col("s")).alias("v")).first()["v"] == ""
