"""Scenarios of documents, and properties against plain folds."""

import random
import statistics
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lectern.functions import profiles as P
from lectern.functions import text as T
from lectern.operators import blocks as B
from lectern.operators import catalog as C
from lectern.operators import enrich as E
from lectern.operators import items as I
from lectern.operators import lines as L
from lectern.operators import paragraphs as G
from lectern.operators import preflight as R
from lectern.operators import structure as S
from lectern.operators import tables as K
from lectern.operators import validate as V
from lectern.operators import web as H
from lectern.sources.documents import WORDS

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the providers below run on executors
BLOCKS = "doc_id string, block_no int, page int, block_type string, text string, confidence double, issues array<string>, rows array<array<string>>"


def blocks(spark, rows):
    return spark.createDataFrame([("d", i, 1, r[0], r[1], 0.95, [], r[2] if len(r) > 2 else None) for i, r in enumerate(rows)], BLOCKS)


def parse(spark, rows, profile="nist80053", **more):
    out = S.parse_clauses(blocks(spark, rows), P.resolve(profile), **more)
    return [r.asDict() for r in out.orderBy("item_no").collect()]


def done(rows):
    return [r for r in rows if r["export_status"] == "exported"]


def test_front_matter_exports_nothing(spark):
    got = parse(spark, [("paragraph", "JOINT TASK FORCE"), ("paragraph", "Some words before"), ("heading", "Abstract")])
    assert not done(got) and all("front_matter_skipped" in r["issues"] for r in got)


def test_control_keeps_its_labels(spark):
    got = done(parse(spark, [("heading", "AC-1 POLICY AND PROCEDURES"), ("paragraph", "Control: The organization must."), ("paragraph", "Discussion: why"), ("paragraph", "Related Controls: AC-2"), ("paragraph", "References: none")]))
    assert [r["clause_id"] for r in got] == ["AC-1"]
    assert all(s in got[0]["text"] for s in ("Control:", "Discussion:", "Related Controls:", "References:"))


def test_enhancements_in_order(spark):
    rows = [("heading", "AC-2 ACCOUNT MANAGEMENT"), ("paragraph", "text"), ("heading", "(1) AUTOMATED"), ("paragraph", "one"), ("paragraph", "(a) Mixed case stays"), ("heading", "(2) REMOVAL"), ("paragraph", "two")]
    got = done(parse(spark, rows))
    assert [r["clause_id"] for r in got] == ["AC-2", "AC-2(1)", "AC-2(2)"]
    assert got[1]["title"] == "ACCOUNT MANAGEMENT | AUTOMATED" and "(a) Mixed" in got[1]["text"]


def test_noise_is_never_exported(spark):
    got = parse(spark, [("heading", "AC-1 POLICY"), ("paragraph", "kept"), ("paragraph", "CHAPTER THREE PAGE 4"), ("paragraph", "https://doi.org/10.6028/NIST.SP.800-53r5"), ("header", "top")])
    assert [r["text"] for r in done(got)] == ["kept"]
    assert {tuple(r["issues"]) for r in got if r["export_status"] == "rejected"} == {("header_footer",), ("doi_footer",)}


def test_stop_ends_everything(spark):
    rows = [("heading", "1 Scope"), ("paragraph", "in"), ("heading", "REFERENCES"), ("paragraph", "after"), ("heading", "2 More"), ("paragraph", "x y")]
    assert [r["clause_id"] for r in done(parse(spark, rows, "generic"))] == ["1"]
    assert [r["clause_id"] for r in done(parse(spark, rows, "generic", references=True))] == ["1", "2"]


def test_table_closes_a_clause(spark):
    rows = [("heading", "1 Scope"), ("paragraph", "in"), ("table", "id | control", [["id", "control"], ["a", "must do"], ["", "more"]]), ("paragraph", "orphan"), ("heading", "2 Next"), ("paragraph", "z z")]
    got = parse(spark, rows, "generic")
    assert [(r["clause_id"], r["source_type"]) for r in done(got)] == [("1", "base_clause"), ("a", "table"), ("2", "base_clause")]
    assert [r["issues"] for r in got if r["raw_text"] == "orphan"] == [["orphan_block_not_exported"]]


ITEM = "doc_id string, item_no int, clause_id string, title string, text string, classification string, confidence double, issues array<string>, export_status string"


def test_validation_scenarios(spark):
    rows = [("4.2", "enough text here"), ("4.1", "other text there"), ("", "12"), ("", "Scope ......... 4"), ("5.1", "the same text"), ("5.2", "the same text")]
    x = spark.createDataFrame([("d", i, c, "T", t, "Information", 0.95, [], "exported") for i, (c, t) in enumerate(rows)], ITEM)
    got = {r["item_no"]: r for r in V.validate(x).collect()}
    assert "broken_clause_order" in got[1]["issues"]
    assert "page_number" in got[2]["issues"] and got[2]["confidence"] <= 0.2
    assert "toc_dot_leader" in got[3]["issues"] and got[3]["confidence"] <= 0.2
    assert all("duplicate_row" in got[i]["issues"] for i in (4, 5))


def test_validation_handles_nulls_and_nothing(spark):
    x = spark.createDataFrame([("d", 1, None, None, None, None, None, None, None)], ITEM)
    r = V.validate(x).first()
    assert r["issues"] == ["empty_text", "low_confidence"] and r["confidence"] == 0.1
    assert V.validate(x.limit(0)).count() == 0 and V.exportable(V.validate(x)).count() == 0


def test_duplicate_ids_block_every_copy(spark):
    x = spark.createDataFrame([("d", i, "A", "T", f"text number {i}", "Information", 0.95, [], "exported") for i in range(3)], ITEM)
    assert V.exportable(V.validate(x)).count() == 0


def test_gate_passes_a_clean_catalog(spark):
    x = spark.createDataFrame([("d", i, f"AC-{i + 1}", "T", f"long enough text {i}", "Requirement", 0.95, [], "exported") for i in range(3)], ITEM)
    assert V.quality_gate(x).count() == 0


def test_two_column_reading_order(spark):
    box = "struct<x0: double, top: double, x1: double, bottom: double>"
    rows = [("d", 1, 1, (50.0, 100.0, 280.0, 120.0)), ("d", 1, 2, (320.0, 90.0, 550.0, 110.0)), ("d", 1, 3, (50.0, 200.0, 280.0, 220.0)), ("d", 1, 4, (320.0, 190.0, 550.0, 210.0))]
    x = spark.createDataFrame(rows, f"doc_id string, page int, block_no int, bbox {box}")
    pages = spark.createDataFrame([("d", 1, 600.0, True)], "doc_id string, page int, width double, is_multi_column boolean")
    assert [r["block_no"] for r in B.reading_order(x, pages).orderBy("read_no").collect()] == [1, 3, 2, 4]


def test_side_by_side_tables_join(spark):
    box = "struct<x0: double, top: double, x1: double, bottom: double>"
    rows = [("d", 1, 1, [["a"], ["b"], ["c"], ["d"]], (60.0, 100.0, 360.0, 200.0)), ("d", 1, 2, [["1"], ["2"], ["3"]], (400.0, 100.0, 720.0, 200.0))]
    got = K.stitch(spark.createDataFrame(rows, f"doc_id string, page int, table_no int, rows array<array<string>>, bbox {box}")).collect()
    assert len(got) == 1 and got[0]["rows"] == [["a", "1"], ["b", "2"], ["c", "3"], ["d", ""]]


def test_wide_continuation_row_is_padded(spark):
    x = spark.createDataFrame([("d", 1, 1, [["id", "control"], ["A", "x"], ["", "y", "z"]])], "doc_id string, page int, table_no int, rows array<array<string>>")
    assert [(r["clause_id"], r["title"], r["text"]) for r in K.normalize(x).collect()] == [("A", "x\ny", "A | x y | z")]


def anchor_fold(words):
    """Line of each word, one by one."""
    out, anchor, n = {}, None, -1
    for w in sorted(words, key=lambda w: (round(w["top"], 1), w["x0"], w["word_no"])):
        if anchor is None or abs(w["top"] - anchor) > 0.6 * max(w["bottom"] - w["top"], 1):
            anchor, n = w["top"], n + 1
        out[w["word_no"]] = n
    return out


@pytest.mark.parametrize("seed", range(3))
def test_line_clustering_equals_a_fold(spark, seed):
    rng = random.Random(seed)
    words = [{"doc_id": "d", "page": 1, "word_no": i, "text": f"w{i}", "x0": float(rng.randint(0, 400)), "x1": 0.0, "top": rng.randint(0, 160) / 2, "bottom": 0.0, "size": 10.0, "fontname": "F", "upright": True} for i in range(120)]
    for w in words:
        w["bottom"], w["x1"] = w["top"] + rng.choice([8.0, 10.0, 12.0]), w["x0"] + 30
    got = {r["word_no"]: r["line_no"] for r in L.cluster_by_anchor(spark.createDataFrame([tuple(w.values()) for w in words], WORDS)).collect()}
    assert got == anchor_fold(words)


def paragraph_fold(lines):
    gaps = [b["top"] - a["bottom"] for a, b in zip(lines, lines[1:], strict=False)]
    gaps = [g for g in gaps if g > 0]
    median = statistics.median(gaps) if gaps else 0
    out, held, prev = [], [], None
    for x in lines:
        if x["text"][0].isdigit():
            if held:
                out.append(("body", " ".join(held)))
            held, prev = [], x
            out.append(("heading", x["text"]))
            continue
        if held and prev is not None and median and x["top"] - prev["bottom"] > 1.6 * median:
            out.append(("body", " ".join(held)))
            held = []
        held.append(x["text"])
        prev = x
    return out + ([("body", " ".join(held))] if held else [])


@pytest.mark.parametrize("seed", range(3))
def test_paragraphs_equal_a_fold(spark, seed):
    rng = random.Random(seed)
    top, lines = 60.0, []
    for i in range(60):
        text = f"{i + 1} Heading" if rng.random() < 0.15 else f"line{i}"
        lines.append({"doc_id": "d", "page": 1, "line_no": i, "text": text, "top": top, "bottom": top + 10})
        top += 10 + rng.choice([4, 5, 6, 14])
    df = spark.createDataFrame([tuple(x.values()) for x in lines], "doc_id string, page int, line_no int, text string, top double, bottom double")
    got = [(r["kind"], r["text"]) for r in G.page_paragraphs(df, "numbered").orderBy("pos").collect()]
    assert got == paragraph_fold(lines)


def test_headings_by_form_unless_asked_otherwise(spark):
    said = ["4.2 Records kept", "are whole"]
    rows = [("d", 1, "prose", i, t, 50.0, 500.0, 20.0 * i, 20.0 * i + 10, 10.0, False, 10.0) for i, t in enumerate(said)]
    lines = spark.createDataFrame(rows, "doc_id string, page int, page_type string, line_no int, text string, x0 double, x1 double, top double, bottom double, font_size double, is_bold boolean, median_size double")
    grouped = lambda **k: [(r["block_type"], r["text"]) for r in B.group_blocks(lines, **k).orderBy("block_no").collect()]
    assert grouped() == [("heading", "4.2 Records kept"), ("paragraph", "are whole")] and grouped(forms=False) == [("paragraph", "4.2 Records kept are whole")]
    web = lines.select("doc_id", F.col("line_no").alias("pos"), F.lit("body").alias("kind"), "text")
    kinds = lambda **k: [r["kind"] for r in H.web_paragraphs(web, **k).orderBy("para_id").collect()]
    assert kinds() == ["heading", "body"] and kinds(forms=False) == ["body", "body"]
    assert [r["clause_id"] for r in done(parse(spark, [("paragraph", t) for t in said], "generic"))] == ["4.2"]
    assert not done(parse(spark, [("paragraph", t) for t in said], "generic", typed=True))
    items = lambda **k: [(r["clause_id"], r["title"]) for r in I.block_items(blocks(spark, [("heading", said[0]), ("paragraph", said[1])]), **k).collect()]
    assert items() == [("4.2", "Records kept")] and items(split=False) == [("4.2 Records kept", "")]
    debris = lambda **k: [r["v"] for r in spark.createDataFrame([(" 12 ",)], "s string").select(T.is_catalog_furniture(F.col("s"), **k).alias("v")).collect()]
    assert debris() == [True] and debris(stripped=False) == [False]


def test_law_across_pages(spark):
    rows = [(1, 1, "heading", "Article 1 (Purpose)"), (1, 2, "body", "The sentence goes"), (2, 1, "body", "on over the page and"), (3, 1, "body", "ends here."), (3, 2, "body", "Next.")]
    x = spark.createDataFrame([("d", *r) for r in rows], "doc_id string, page int, pos int, kind string, text string")
    got = [(r["kind"], r["section"], r["text"]) for r in G.merge_across_pages(x).orderBy("para_id").collect()]
    assert got == [("heading", "Article 1 (Purpose)", "Article 1 (Purpose)"), ("body", "Article 1 (Purpose)", "The sentence goes on over the page and ends here."), ("body", "Article 1 (Purpose)", "Next.")]


def test_boilerplate_needs_three_pages(spark):
    lines = [("d", p, i, t) for p in (1, 2) for i, t in enumerate([f"Header {p}", "a", "b", "c", "foot"])]
    schema = "doc_id string, page int, line_no int, text string"
    pages = spark.createDataFrame([("d", 1), ("d", 2)], "doc_id string, page int")
    assert L.boilerplate(spark.createDataFrame(lines, schema), pages).count() == 0
    more = spark.createDataFrame(lines + [("d", 3, i, t) for i, t in enumerate(["Header 3", "x", "y", "z", "foot"])], schema)
    found = L.boilerplate(more, pages.union(spark.createDataFrame([("d", 3)], "doc_id string, page int")))
    assert {r["norm"] for r in found.collect()} >= {"Header #", "foot"}
    assert "foot" not in {r["text"] for r in L.strip_boilerplate(more, found).collect()}


def test_marker_folding(spark):
    rows = [("body", "1."), ("body", "(a)"), ("heading", "Title"), ("heading", "Title"), ("body", "ii)")]
    x = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "doc_id long, pos int, kind string, text string")
    got = [(r["kind"], r["text"]) for r in H.drop_repeats(H.fold_markers(x)).orderBy("pos").collect()]
    assert got == [("heading", "1. (a) Title"), ("heading", "Title"), ("body", "ii)")]


def test_profile_vote_breaks_ties_by_first_seen(spark):
    x = spark.createDataFrame([("d", 1, "unknown"), ("d", 2, "cis_controls"), ("d", 3, "legal_articles"), ("e", 1, "unknown")], "doc_id string, page int, hint string")
    assert {r["doc_id"]: r["profile"] for r in R.profile_vote(x).collect()} == {"d": "cis", "e": "generic"}


def test_withdrawn_control(spark):
    rows = [("d", 1, 0, "AC-3 ACCESS", 11.0, True), ("d", 1, 1, "[Withdrawn: Incorporated into AC-2].", 10.0, False), ("d", 1, 2, "AC-4 FLOW", 11.0, True), ("d", 1, 3, "shall enforce the flow of it", 10.0, False)]
    got = C.parse_controls(spark.createDataFrame(rows, "doc_id string, page int, line_no int, text string, size double, is_bold boolean")).orderBy("item_no").collect()
    assert [(r["clause_id"], r["classification"], r["confidence"]) for r in got] == [("AC-3", "Information", 0.9), ("AC-4", "Requirement", 0.95)]


CLAUSES = "doc_id string, item_no int, clause_id string, title string, text string, classification string"


def clauses(spark, n=5):
    return spark.createDataFrame([("d", i, f"{i}", "T", ("It shall be " if i % 2 else "It was ") + str(i), "Information") for i in range(1, n + 1)], CLAUSES)


class Limited:
    name = "limited"

    def list_models(self):
        return []

    def complete(self, system, user, max_tokens):
        raise E.RateLimitError("retry in 0s", 0.0)


class Shuffled:
    """Fenced, in reverse, one result missing."""

    name = "shuffled"

    def list_models(self):
        return []

    def complete(self, system, user, max_tokens):
        import json

        n = user.count("\n") + 1
        rows = [{"index": i, "classification": "Requirement", "requirement": f"r{i}", "requirement_classification": "nothing known"} for i in range(n, 0, -1) if i != 3]
        return "```json\n" + json.dumps({"results": rows}) + "\n```"


def test_enrichment_numbers_requirements(spark):
    out, new = E.enrich(clauses(spark), E.Config(batch_size=2))
    got = out.orderBy("item_no").collect()
    assert [r["detailed_description"][:7] for r in got if r["classification"] == "Requirement"] == ["REQ-001", "REQ-002", "REQ-003"]
    assert new.count() == 5


def test_enrichment_falls_back(spark):
    got = E.enrich(clauses(spark), E.Config(), provider=Shuffled())[0].orderBy("item_no").collect()
    assert [r["requirement"] for r in got] == ["r1", "r2", "", "r4", "r5"]
    assert got[2]["classification"] == "Requirement" and got[0]["requirement_classification"] == "Other"


def test_cache_spares_calls(spark):
    cfg = E.Config()
    _, new = E.enrich(clauses(spark), cfg)
    new = spark.createDataFrame(new.collect(), new.schema)
    out, again = E.enrich(clauses(spark), cfg, cache=new, provider=Limited())
    assert again.count() == 0 and out.count() == 5


def test_rate_limit_gives_up():
    waits = []
    with pytest.raises(E.ProviderError):
        E.call(Limited(), E.Config(retries=2), [("", "x")], waits.append)
    assert waits == [2.5, 4.5]


def test_loose_json_and_alignment():
    assert E.loads_loose('x {"a": 1} y') == {"a": 1} and E.loads_loose("none") is None
    assert E.align([{"index": 2, "v": 1}, {"index": 2, "v": 2}, {"v": 3}], 3) == [{"index": 2, "v": 2}, {"index": 2, "v": 1}, {"v": 3}]


def test_subset_merges_back(spark):
    x = clauses(spark)
    some, _ = E.enrich(x.where("item_no > 2"), E.Config())
    got = E.merge_back(x, some).orderBy("item_no").collect()
    assert [r["detailed_description"][:7] for r in got] == ["", "", "REQ-001", "", "REQ-002"]


def test_sparse_clause_column(spark):
    x = spark.createDataFrame([("d", i, c, "T", "t", "Information") for i, c in enumerate(["A", "A", "B", "A"])], CLAUSES)
    assert [r["clause"] for r in I.assessment_rows(x, "S").orderBy("sheet_row").collect()] == ["A", None, "B", "A"]


def test_multi_column_page(spark):
    cols = [("d", 1, i, "w", float(50 + 300 * (i % 2) + (i // 2 % 4) * 50), 0.0, float(60 + i // 8 * 15), 0.0, 10.0, "F", True) for i in range(64)]
    cols = [(*w[:5], w[4] + 45, w[6], w[6] + 10, *w[8:]) for w in cols]
    flat = [("e", 1, i, "w", float(50 + (i % 10) * 50), float(50 + (i % 10) * 50 + 48), float(60 + i // 10 * 15), float(70 + i // 10 * 15), 10.0, "F", True) for i in range(60)]
    assert {r["doc_id"]: r["is_multi_column"] for r in R.multi_column(spark.createDataFrame(cols + flat, WORDS)).collect()} == {"d": True, "e": False}


def test_heading_style(spark):
    x = spark.createDataFrame([("a", f"Article {i} (X)") for i in range(3)] + [("b", "Article 1 (X)")] * 3, "doc_id string, text string")
    assert {r["doc_id"]: r["style"] for r in G.heading_style(x).collect()} == {"a": "legal", "b": "numbered"}


def test_issues_keep_list_rows(spark):
    x = spark.createDataFrame([("d", i, 1, "c", "t", "x", 0.9, ["bad"] if i == 2 else []) for i in range(4)], "doc_id string, item_no int, page int, clause_id string, title string, text string, confidence double, issues array<string>")
    assert [(r["list_row"], r["issues"]) for r in I.issue_rows(x).collect()] == [(12, "bad")]


def test_word_boxes_outside(spark):
    words = [("d", 1, i, "w", float(x), float(x + 10), 100.0, 110.0, 10.0, "F", True) for i, x in enumerate((50, 150, 250))]
    t = spark.createDataFrame([("d", 1, (140.0, 90.0, 180.0, 120.0))], "doc_id string, page int, bbox struct<x0: double, top: double, x1: double, bottom: double>")
    assert [r["word_no"] for r in L.outside_tables(spark.createDataFrame(words, WORDS), t).select(F.col("w.word_no")).orderBy("word_no").collect()] == [0, 2]
