"""Whole conversions from a file, the command line, providers over HTTP, hooks and caches."""

import json
import os
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from page_parser import Counting, Frames, Reads, Xml

from lectern import __main__ as M
from lectern import shared
from lectern.functions import labels
from lectern.operators import blocks as B
from lectern.operators import enrich as E
from lectern.operators import items as I
from lectern.operators import providers as P
from lectern.plans import run as R
from lectern.plans.convert import QualityGateError
from lectern.shared import cut, scratch
from lectern.sources import documents as D
from lectern.sources import html as X
from lectern.sources import sinks as O

ARGS = {"parser": "page_parser"}


@pytest.fixture(scope="module", autouse=True)
def parser_on_workers(spark):
    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(os.path.abspath(__file__)), "page_parser.py"))


def saved(folder, name, *pages):
    to = folder / name
    to.write_text("%PDF-test\n" + "\f".join(pages), encoding="latin-1")
    return str(to)


def test_prose(spark, tmp_path):
    path = saved(tmp_path, "a.pdf", "1 Scope\nThe parts shall fit together well.", "2 Terms\nNothing here is binding.")
    got = R.convert(spark, path, str(tmp_path / "a.xlsx"), **ARGS)
    assert got.mode == "prose" and got.summary["n_items"] == 2 and got.summary["n_requirements"] == 1
    rows = O.read_xlsx(str(tmp_path / "a.xlsx"))["Paragraphs"]
    assert any("The parts shall fit together well." in r.values() for r in rows)


def test_deck(spark, tmp_path):
    path = saved(tmp_path, "b.pdf", "Title\nName | Size | Use\na | 1\nb | 2 | x", "Only text | here\nmore | rows")
    got = R.convert(spark, path, str(tmp_path / "b.xlsx"), **ARGS)
    assert got.mode == "tables"
    sheets = O.read_xlsx(str(tmp_path / "b.xlsx"))
    assert list(sheets) == ["slide1", "slide2", "slides_text"] and [r.get("C") for r in sheets["slide1"]] == ["Use", None, "x"]
    sizes = I.sheet_sizes(got.sheets["Tables"], got.sheets["slides_text"]).orderBy("sheet_name").collect()
    assert [tuple(r)[1:] for r in sizes] == [("slide1", 3, 3), ("slide2", 2, 2), ("slides_text", 2, 2)]


CONTROL = "*AC-{} {}\nThe organization shall keep a written policy and review it every year."


def catalog_file(folder, names=("POLICY", "ACCOUNTS")):
    front = ["NIST SP 800-53 Revision 5"] + ["front matter"] * 50
    return saved(folder, "c.pdf", *front, "CHAPTER THREE PAGE 1\n" + CONTROL.format(1, names[0]), CONTROL.format(2, names[1]))


def test_catalog(spark, tmp_path):
    path = catalog_file(tmp_path)
    got = R.convert(spark, path, str(tmp_path / "c.xlsx"), review_output=str(tmp_path / "r.xlsx"), **ARGS)
    assert got.mode == "nist80053" and got.summary["n_items"] == 2
    rows = O.read_xlsx(str(tmp_path / "c.xlsx"))["NIST 800-53 Controls"]
    assert [r["A"] for r in rows] == ["Clause ID", "AC-1", "AC-2"] and rows[1]["D"] == "52"
    review = O.read_xlsx(str(tmp_path / "r.xlsx"))["Review"]
    assert len(review[0]) - 1 == 8 and review[1]["F"] == review[1]["E"].__len__().__str__()


def test_catalog_as_assessment_and_verified(spark, tmp_path):
    out = str(tmp_path / "d.xlsx")
    got = R.convert(spark, catalog_file(tmp_path), out, fmt="standard", standard_id="S", standard_title="Title", show_issues=True, template={"A9": "Rows"}, **ARGS)
    rows = {r["row"]: r for r in O.read_xlsx(out)["Standard Assessment"]}
    assert rows["2"]["B"] == "S" and rows["3"]["B"] == "Title" and rows["9"]["A"] == "Rows" and rows["10"]["A"] == "S_1" and rows["10"]["B"] == "AC-1" and got.failures == []
    found = R.verify_sheet(spark, out)
    assert found == {"doc_id": "sheet", "n_rows": 2, "first_id": "AC-1", "n_blank": 0, "n_invalid": 0, "n_bad": 0, "n_one_letter": 0, "n_duplicates": 0}


def test_gate_stops_a_bad_catalog(spark, tmp_path):
    front = ["NIST SP 800-53 Revision 5"] + ["front matter"] * 50
    path = saved(tmp_path, "e.pdf", *front, "CHAPTER THREE PAGE 1\n" + CONTROL.format(7, "LATE"))
    with pytest.raises(QualityGateError):
        R.convert(spark, path, str(tmp_path / "e.xlsx"), fmt="standard", **ARGS)
    got = R.convert(spark, path, str(tmp_path / "e.xlsx"), fmt="standard", raise_on_quality_gate=False, **ARGS)
    assert got.failures == ["check 1: AC-7"] and not os.path.exists(tmp_path / "e.xlsx")
    R.convert(spark, path, str(tmp_path / "e.xlsx"), fmt="standard", force_export=True, **ARGS)
    assert R.verify_sheet(spark, str(tmp_path / "e.xlsx"))["first_id"] == "AC-7"


def test_standard_format_with_enrichment_and_cache(spark, tmp_path):
    path = saved(tmp_path, "f.pdf", "first page", "1.1 Scope\nThe operator shall test the pump.", "1.2 Terms\nA pump moves water.")
    seen = []
    options = dict(fmt="standard", profile="iso", cache=str(tmp_path / "cache"), **ARGS)
    got = R.convert(spark, path, str(tmp_path / "f.xlsx"), E.Config(workers=2), lambda *a: seen.append(a), **options)
    rows = O.read_xlsx(str(tmp_path / "f.xlsx"))["Standard Assessment"]
    assert got.mode == "standard" and seen[-1][0] == seen[-1][1] and any(str(r.get("G", "")).startswith("REQ-001") for r in rows)
    first = E.load_cache(spark, str(tmp_path / "cache")).count()
    assert first
    R.convert(spark, path, None, E.Config(workers=2), **options)
    assert spark.read.parquet(str(tmp_path / "cache")).count() == first


def test_no_action_asks_again(spark, tmp_path):
    items = spark.createDataFrame([("d", i, "t", f"text {i} shall", "") for i in range(1, 8)], "doc_id string, item_no int, title string, text string, classification string")
    done, new = E.enrich(items, E.Config(batch_size=3), provider=Counting(str(tmp_path)))
    for df in (done, done, new, new):
        df.collect()
    assert done.count() == 7 and len(os.listdir(tmp_path)) == 3
    again, none = E.enrich(items, E.Config(batch_size=3), cache=new, provider=Counting(str(tmp_path)))
    assert again.count() == 7 and none.count() == 0 and len(os.listdir(tmp_path)) == 3
    assert E.load_cache(spark, str(tmp_path / "none")) is None and not E.save_cache(new, "nowhere://x")
    assert [r["item_no"] for r in I.subset(items, (2, 5)).collect()] == [2, 5] and I.subset(items, first=3).count() == 3 and I.subset(items).count() == 7 and I.subset(items, ()).count() == 0


def test_prompt_and_schema():
    cfg = E.with_prompt(E.Config(vocabulary=("Alpha", "Beta")))
    keys = E.schema(cfg)["properties"]["results"]["items"]["required"]
    assert all(f'"{k}"' in cfg.system for k in keys) and "Alpha, Beta" in cfg.system and set(E.FIELDS) <= set(keys)
    assert E.prompt(cfg, "Base.", {"requirement": "own words"}).startswith("Base.") and "own words" in E.prompt(cfg, "Base.", {"requirement": "own words"})
    assert E.schema(cfg)["properties"]["results"]["items"]["properties"]["requirement_classification"]["enum"] == ["Alpha", "Beta", ""]


class Service(BaseHTTPRequestHandler):
    limited = 0

    def _send(self, body, code=200, **headers):
        self.send_response(code)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.end_headers()
        self.wfile.write(body if isinstance(body, bytes) else json.dumps(body).encode())

    def do_POST(self):
        sent = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        said = json.dumps([sorted(sent), self.headers.get("Authorization") or self.headers.get("x-api-key") or self.headers.get("x-goog-api-key")])
        if Service.limited:
            Service.limited -= 1
            return self._send(b"slow down", 429, Retry_After="0.1")
        if sent.get("model") == "bad":
            return self._send(b"no such model", 404)
        answers = {"/messages": {"content": [{"type": "text", "text": said}]}, "/chat/completions": {"choices": [{"message": {"content": said}}]}, "/models/m:generateContent": {"candidates": [{"content": {"parts": [{"text": said}]}}]}, "/api/chat": {"message": {"content": said}}}
        self._send(answers.get(self.path, b""), 200 if self.path in answers else 404)

    def do_GET(self):
        if self.path == "/denied":
            return self._send(b"", 401)
        if self.path == "/big":
            return self._send(b"x" * 5000)
        if self.path == "/files/a%20b":
            return self._send(b"%PDF-1.4 ...", Content_Type="application/pdf")
        if self.path == "/page.html":
            return self._send(b"<title>t</title><h1>1 Scope</h1><p>The user shall read this page to its very end.</p>", Content_Type="text/html; charset=utf-8")
        self._send({"models": [{"name": "models/z"}, {"name": "models/a"}], "data": [{"id": "whisper"}, {"id": "gpt-b"}, {"id": "gpt-a"}]})

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def service():
    s = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


@pytest.mark.parametrize("kind,models", [(P.Anthropic, ["gpt-a", "gpt-b", "whisper"]), (P.OpenAI, ["gpt-a", "gpt-b"]), (P.Gemini, ["a", "z"]), (P.Ollama, None)])
def test_http_providers(service, kind, models):
    p = kind(model="m", key="k", url=service, schema=E.schema(E.Config()))
    fields, key = json.loads(p.complete("sys", "user", 10))
    assert ("k" in key if p.needs_key else key is None) and fields
    assert p.list_models() == models if models else True
    Service.limited = 1
    with pytest.raises(E.RateLimitError) as e:
        p.complete("sys", "user", 10)
    assert e.value.retry_after == 0.1
    with pytest.raises(E.ProviderError):
        kind(model="bad", key="k", url=service + ("" if kind is not P.Gemini else "/nothing")).complete("s", "u", 1)
    if p.needs_key:
        os.environ.pop(p.env, None)
        with pytest.raises(E.ProviderError):
            kind(model="m", url=service).complete("s", "u", 1)
    assert p.name in P.provider_names()


def test_limits_are_waited_out(service):
    Service.limited = 2
    waited = []
    E.call(P.Ollama(model="m", url=service), E.Config(), [("t", "x")], waited.append)
    assert len(waited) == 2


def test_fetching(service, tmp_path):
    with pytest.raises(D.AccessError):
        D.fetch(service + "/denied")
    with pytest.raises(ValueError):
        D.fetch(service + "/big", most=100)
    assert len(D.fetch(service + "/big")[2]) == 5000
    path = D.download(service + "/files/a%20b", str(tmp_path))
    assert os.path.basename(path) == "a b.pdf" and open(path, "rb").read(5) == b"%PDF-"
    with pytest.raises(ValueError):
        D.download(service + "/page.html", str(tmp_path))
    with D.spooled(b"%PDF-", f"file://{tmp_path}") as p:
        assert os.path.getsize(p) == 5
    assert not os.path.exists(p)
    assert D.tls_context(True).check_hostname is False and D.tls_context().check_hostname is True


def test_web_page_and_renderer(spark, service, tmp_path):
    got = R.convert(spark, service + "/page.html", str(tmp_path / "w.xlsx"), fmt="standard")
    assert got.mode == "web" and got.summary["n_requirements"] == 1
    shown = R.convert(spark, service + "/page.html", None, renderer=Frames(), render="always")
    assert [r["text"] for r in shown.items.orderBy("item_no").collect()] == ["Rendered text that must be long enough.", "In a frame."]
    assert "render_unavailable" in R.convert(spark, service + "/page.html", None, render="always").warnings
    pages = spark.createDataFrame([(1, "http://bad/", "")], "page_id long, url string, html string")
    assert X.rendered(pages, Frames()).first()["render_error"] == "RuntimeError: no browser"


def test_extractors(spark):
    assert X.main_content("", Xml()) == [("heading", "H"), ("body", "a b"), ("body", "x | y"), ("body", "i")]
    assert X.walk_xml("<broken") == []
    html = "<p>" + "long text " * 30 + "</p><p>" + "more of it " * 30 + "</p>" + "<li>x</li>" * 6
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    assert [r["doc_id"] for r in X.main_blocks(pages, X.LineBlocks()).collect()][:2] == [1, 1] and X.main_blocks(pages, X.LineBlocks()).count() < X.html_blocks(pages).count()


def test_ocr(spark):
    pages = spark.createDataFrame([("d", 1, True), ("d", 2, False), ("d", 3, True), ("d", 4, True)], "doc_id string, page int, is_scanned boolean")
    images = spark.createDataFrame([("d", 1, b"one"), ("d", 2, b"two"), ("d", 3, b"bad")], "doc_id string, page int, image binary")
    got = [(r["ocr_text"], r["ocr_warning"]) for r in D.with_ocr(pages, images, Reads(), "detect").orderBy("page").collect()]
    assert got == [("one at 150", None), (None, None), (None, "ocr_failed: ValueError: blurred"), (None, "ocr_no_image")]
    assert D.with_ocr(pages, images, None, "detect").where("ocr_warning = 'ocr_unavailable'").count() == 3
    assert D.with_ocr(pages, images, Reads()).where("ocr_text is not null or ocr_warning is not null").count() == 0


def test_rows_of_blocks_and_warnings(spark):
    b = spark.createDataFrame([("d", 1, 1, "heading", "T", 0.5, ["a", "b"], (1.0, 2.0, 3.0, 4.0))], "doc_id string, page int, block_no int, block_type string, text string, confidence double, issues array<string>, bbox struct<x0:double,top:double,x1:double,bottom:double>")
    assert tuple(I.block_review_rows(b).first()) == ("d", 1, 1, "heading", "", "", "T", 0.5, "a, b", "[1.0, 2.0, 3.0, 4.0]")
    items = spark.createDataFrame([("d", 1, 2, ["x", "y"]), ("d", 2, 2, ["y", "x"]), ("d", 3, None, ["x"]), ("d", 4, 1, [])], "doc_id string, item_no int, page int, issues array<string>")
    assert [r["warning"] for r in I.page_warnings(items).orderBy("warning_no").collect()] == ["Page 2: x", "Page 2: y", "Page None: x"]


def test_labels():
    assert labels.choice("pci dss ", labels.PROFILES, "auto") == "pci" and labels.choice("x", labels.MODES, "auto") == "auto" and labels.choice("Standard Assessment (xlsx)", labels.FORMATS, "default") == "standard"
    assert labels.choice(None, labels.OCR, "off") == "off" and labels.choice("The default one", labels.FORMATS, "standard") == "default"


def test_command_line(spark, tmp_path, capsys):
    path, out = saved(tmp_path, "g.pdf", "1 Scope\nThe parts shall fit."), str(tmp_path / "g.xlsx")
    assert M.main(["convert", path, "-o", out, "--parser", "page_parser"], spark) == 0 and "prose: 1 items (1 requirements" in capsys.readouterr().out
    assert M.main(["convert", path, "-o", out, "--format", "standard", "--profile", "iso", "--ai-fill", "--ai-dry-run", "--parser", "page_parser", "--no-skip-cover"], spark) == 0
    assert M.main(["paragraphs", path, "-o", out, "--parser", "page_parser"], spark) == 0 and M.main(["deck", path, "-o", out, "--parser", "page_parser"], spark) == 0
    assert M.main(["convert", path], spark) == 1 and M.main(["convert", str(tmp_path / "none.pdf")], spark) == 1
    with pytest.raises(SystemExit):
        M.main(["convert", path, "--mode", "odd"], spark)
    with pytest.raises(ValueError):
        R.Options(mode="odd")


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda _: str(tmp_path))
    with scratch(spark):
        inner = cut(spark.range(3))
        kept = cut(inner.where("id > 0"), keep=True)
    assert kept.count() == 2 and len(os.listdir(tmp_path)) == 1


def test_words_without_upright_and_pages(spark, tmp_path):
    path = saved(tmp_path, "h.pdf", "a b", "c | d\ne | f")
    words, pages, tables = R.read_document(spark, path, "page_parser")
    assert words.where(F.col("upright").isNull()).count() == words.count() == 8 and pages.count() == 2 and tables.first()["rows"] == [["c", "d"], ["e", "f"]]


def test_plain_grouping(spark):
    said = ["Control A.1 of this", "It begins here", "and goes on.", "- one", "two more", "Note that this", "is a note", "NOTE 3", "B.2.1 Deep", "x"]
    rows = [("d", 1, "prose", i, t, 50.0, 500.0, 20.0 * i, 20.0 * i + 10, 10.0, False, 10.0) for i, t in enumerate(said)]
    lines = spark.createDataFrame(rows, "doc_id string, page int, page_type string, line_no int, text string, x0 double, x1 double, top double, bottom double, font_size double, is_bold boolean, median_size double")
    got = [(r["block_type"], r["text"], r["confidence"]) for r in B.group_blocks(lines, plain=True).orderBy("block_no").collect()]
    want = [("heading", "Control A.1 of this"), ("paragraph", "It begins here and goes on."), ("paragraph", "- one two more"), ("note", "Note that this is a note"), ("heading", "NOTE 3"), ("heading", "B.2.1 Deep"), ("paragraph", "x")]
    assert got == [(*w, 1.0) for w in want]
    assert "list_item" in {r["block_type"] for r in B.group_blocks(lines).collect()}
    blocks = B.group_blocks(lines, plain=True)
    assert I.block_review_rows(blocks).columns == ["doc_id", "page", "block_id", "block_type", "clause_id", "title", "text", "confidence", "issues", "bbox"] and I.block_review_rows(blocks).count() == 7
