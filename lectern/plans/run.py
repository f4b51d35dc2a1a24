"""From a file or URL to a workbook: finds out what it is, picks a plan, writes the sheets."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C
from ..operators import enrich as E
from ..operators import items as I
from ..operators import lines as L
from ..operators import preflight as R
from ..operators import validate as V
from ..operators import web as H
from ..shared import cut, shared_dir
from ..sources import documents as D
from ..sources import html as X
from ..sources import sinks as O
from . import convert as P

MODES = ("auto", "prose", "tables", "nist80053", "standard")
PROFILES = ("auto", "generic", "nist80053", "iso", "legal", "pci", "cis", "control-catalog")
# Titles of pages before the controls.
FRONT = ("joint task force", "authority", "abstract", "errata", "foreword", "preface", "acknowledgments")
CATALOGS = ("nist80053", "control-catalog")


@dataclass(frozen=True)
class Options:
    """What a conversion may be told; names and defaults are those of the command line."""

    mode: str = "auto"
    fmt: str = "default"
    heading_style: str = "auto"
    gap_factor: float = 1.6
    standard_id: str = "MLSR"
    standard_title: str = ""
    standard_edition: str = ""
    document_id: str = ""
    document_name: str = ""
    document_revision: str = ""
    template: dict | None = None  # cells of the sheet's head: reference -> text
    insecure: bool = False
    ca_bundle: str | None = None
    render: str = "auto"
    review_output: str | None = None
    include_toc: bool = False
    skip_cover: bool = True
    ocr_mode: str = "off"
    min_confidence: float = 0.0
    show_issues: bool = False
    profile: str = "auto"
    include_front_matter: bool = False
    include_appendix: bool = False
    skip_references: bool = False
    force_export: bool = False
    export_low_confidence: bool = False
    include_references: bool = False
    raise_on_quality_gate: bool = True
    parser: str | None = None  # module with words, pages and tables functions of a path
    cache: str | None = None

    def __post_init__(self) -> None:
        for name, known in (("mode", MODES), ("profile", PROFILES), ("fmt", ("default", "standard")), ("render", ("auto", "always", "never")), ("ocr_mode", ("off", "detect")), ("heading_style", ("auto", "numbered", "legal"))):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} must be one of {', '.join(known)}")


@dataclass(frozen=True)
class Outcome:
    """What came out: frames are lazy, numbers were counted once."""

    mode: str
    out_path: str | None
    items: DataFrame
    sheets: dict[str, DataFrame]
    warnings: list[str] = field(default_factory=list)
    failures: list[str] = field(default_factory=list)
    summary: dict = field(default_factory=dict)


def _head(o: Options) -> dict[str, str]:
    """Cells above an assessment sheet's rows."""
    said = (("B2", o.standard_id), ("B3", o.standard_title), ("B4", o.standard_edition), ("B5", o.document_id), ("B6", o.document_name), ("B7", o.document_revision))
    return {**(o.template or {}), **{k: v for k, v in said if v}}


def _load(spark: SparkSession, source: str, o: Options) -> tuple[str, bytes | None, str, str]:
    """kind, bytes if fetched, content type and address of a source."""
    if "://" in source and not source.startswith("file:"):
        url = spark.createDataFrame([(source,)], "u string").select(T.clean_url(F.col("u"))).first()[0]
        if not url:
            raise ValueError(f"not an address: {source}")
        final, kind, data = D.fetch(url, insecure=o.insecure, ca_bundle=o.ca_bundle)
        return _kind(spark, data, kind), data, kind, final
    with open(source.removeprefix("file://"), "rb") as f:
        start = f.read(4096)
    if start[:5] == b"%PDF-" or source.lower().endswith(".pdf"):
        return "pdf", None, "", source
    with open(source.removeprefix("file://"), "rb") as f:
        data = f.read()
    return _kind(spark, data, "text/html" if source.lower().endswith((".html", ".htm")) else ""), data, "", source


def _kind(spark: SparkSession, data: bytes, content_type: str) -> str:
    return spark.createDataFrame([(data[:4096], content_type)], "d binary, c string").select(T.content_kind(F.col("d"), F.col("c"))).first()[0]


def read_document(spark: SparkSession, path: str, parser: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """words, pages and tables of a file."""
    D.register(spark)
    read = lambda kind, **more: cut(spark.read.format(f"lectern_{kind}").option("parser", f"{parser}:{kind}").options(**more).load(path))
    return read("words", attributes="upright"), read("pages"), read("tables")


def catalog(words: DataFrame, pages: DataFrame) -> DataFrame:
    """A control catalog's items, checked but not yet filtered."""
    upright = F.coalesce("upright", F.lit(True))
    margin = F.coalesce(T.is_side_margin(F.col("text"), F.col("x0"), F.col("upright")), F.lit(False))
    ranged = words.where(upright & ~margin).join(C.catalog_pages(pages), "doc_id").where("page >= first_page and page < end_page").drop("first_page", "end_page")
    lines = L.to_lines(L.cluster_by_bucket(ranged).withColumnRenamed("bucket", "line_no"), T.clean_block)
    lines = lines.where(~T.is_catalog_furniture(F.col("text"))).withColumnRenamed("font_size", "size")
    return C.check_controls(C.parse_controls(lines))


def web_blocks(pages: DataFrame, o: Options, extractor: X.Extractor | None, renderer: X.Renderer | None) -> tuple[DataFrame, list[str]]:
    """Blocks of pages (page_id, url, html): of the extractor or the walk, whichever has more; rendered where that is wanted."""
    blocks = X.html_blocks(pages)
    if extractor:
        blocks = H.arbitrate(X.main_blocks(pages, extractor), blocks)
    if o.render == "never" or renderer is None:
        return cut(blocks), (["render_unavailable"] if o.render == "always" and renderer is None else [])
    blocks = cut(blocks)
    known = H.incomplete(blocks)
    wanted = pages if o.render == "always" else pages.join(known.where("not is_incomplete").select("doc_id"), F.col("page_id") == F.col("doc_id"), "left_anti")
    shown = cut(X.rendered(wanted, renderer))
    more = cut(X.frame_blocks(shown))
    warnings = [f"render_failed: {r[0]}" for r in shown.where("render_error is not null").select("render_error").limit(20).collect()]
    done = more.select("doc_id").distinct()
    return cut(blocks.join(done, "doc_id", "left_anti").unionByName(more)), warnings


def _assessment(items: DataFrame, o: Options) -> DataFrame:
    """Columns A to I, in order."""
    return I.assessment_rows(items, o.standard_id).orderBy("sheet_row").drop("doc_id", "sheet_row")


def convert(
    spark: SparkSession, source: str, out_path: str | None = None, enrich_config: E.Config | None = None, progress: Callable[[int, int, str], None] | None = None,
    provider: E.Provider | None = None, extractor: X.Extractor | None = None, renderer: X.Renderer | None = None, ocr: D.Ocr | None = None, **options,
) -> Outcome:
    """Convert one source. Without out_path nothing is written and the sheets are only returned.

    Raises QualityGateError for a catalog whose checks fail, unless force_export or not raise_on_quality_gate.
    """
    o = Options(**options)
    kind, data, content_type, address = _load(spark, source, o)
    warnings: list[str] = []
    failures: list[str] = []
    found = review = None
    if kind == "html":
        html = spark.createDataFrame([(1, address, data, content_type)], "page_id long, url string, data binary, kind string").select("page_id", "url", X.decode(F.col("data"), F.col("kind")).alias("html"))
        blocks, warnings = web_blocks(html, o, extractor, renderer)
        result = P.web(blocks)
        warnings += [f"{r['code']}: {r['detail']}" for r in result.failures.collect()]
        mode, items, sheets = "web", result.items, result.sheets
        if o.fmt == "standard":
            found = items
    elif kind == "pdf":
        if not o.parser:
            raise ValueError("a PDF needs a parser: a module with words, pages and tables functions")
        if data is not None:
            with D.spooled(D.require_pdf(data, content_type), shared_dir(spark)) as path:
                words, pages, tables = read_document(spark, path, o.parser)
        else:
            words, pages, tables = read_document(spark, source, o.parser)
        mode, items, sheets, found, review, failures, more = _paged(words, pages, tables, o, ocr)
        warnings += more
    else:
        raise ValueError(f"can't convert {kind} content")
    if failures and not o.force_export and o.raise_on_quality_gate:
        raise P.QualityGateError([("document", 0, f) for f in failures])
    if found is not None:
        if enrich_config:
            cache = E.load_cache(spark, o.cache) if o.cache else None
            found, new = E.enrich(found, E.with_prompt(enrich_config), cache, provider, progress)
            if o.cache and not enrich_config.dry_run:
                E.save_cache(new, o.cache)
        sheets = {"Standard Assessment": _assessment(found, o)}
        if o.show_issues and "issues" in items.columns:
            sheets["Extraction_Issues"] = I.issue_rows(items)
        items = found
    if out_path and not (failures and not o.force_export):
        _write(out_path, sheets, o)
    if o.review_output and review is not None:
        O.write_sheets(o.review_output, {"Review": review})
    counted = items.agg(F.count("*").alias("n_items"), F.count_if(F.col("classification") == "Requirement").alias("n_requirements"), F.count_if(F.col("classification") == "Information").alias("n_information")).first().asDict()
    summary = {"mode": mode, **counted, "warnings_count": len(warnings), "quality_gate_passed": not failures, "review_output": o.review_output if review is not None else None}
    return Outcome(mode, out_path, items, sheets, warnings, failures, summary)


def _paged(words: DataFrame, pages: DataFrame, tables: DataFrame, o: Options, ocr: D.Ocr | None) -> tuple:
    """mode, items, sheets, items for the assessment sheet or None, review rows or None, failures, warnings."""
    seen = cut(P.preflight(words, pages, tables))
    warnings = [f"Page {r['page']}: {r['ocr_warning']}" for r in D.with_ocr(seen, _images(seen), ocr, o.ocr_mode).where("ocr_warning is not null").select("page", "ocr_warning").orderBy("page").limit(1000).collect()] if o.ocr_mode == "detect" else []
    voted = o.profile if o.profile != "auto" else R.profile_vote(seen).first()["profile"]
    is_catalog = R.is_catalog_document(pages).first()["is_catalog"]
    mode = o.mode
    if mode == "auto":
        mode = "nist80053" if is_catalog and o.profile in ("auto", *CATALOGS) else "standard" if o.fmt == "standard" else R.document_kind(seen).first()["kind"]
    if mode == "nist80053":
        checked = cut(catalog(words, pages).withColumn("page", F.col("source_page")))
        kept = C.keep_controls(checked, V.BLOCKING)
        if o.min_confidence > 0:
            kept = kept.where(F.coalesce("confidence", F.lit(1.0)) >= o.min_confidence)
        gate = [f"check {r['check_no']}: {r['offender']}" for r in V.quality_gate(kept).orderBy("check_no").limit(100).collect()] if o.fmt == "standard" else []
        more = [r["warning"] for r in I.page_warnings(checked, "source_page").orderBy("warning_no").limit(1000).collect()]
        sheets = {"NIST 800-53 Controls": I.catalog_rows(kept).orderBy("item_no").drop("doc_id", "item_no")}
        review = I.catalog_review_rows(checked).orderBy("item_no").drop("doc_id", "item_no")
        return mode, kept, sheets, kept if o.fmt == "standard" else None, review, gate, warnings + more
    if mode == "standard" or o.fmt == "standard":
        skip = {"cover": o.skip_cover, "toc": not o.include_toc, "appendix": not o.include_appendix, "references": o.skip_references or not o.include_references}
        blocks = P.layout_blocks(words, pages, tables, o.gap_factor, **skip)
        result = P.structured(
            blocks, voted, o.force_export, o.min_confidence, None, o.standard_id, front_matter=o.include_front_matter, appendix=o.include_appendix, references=o.include_references, export_low=o.export_low_confidence
        )
        gate = [f"check {r['check_no']}: {r['offender']}" for r in result.failures.orderBy("check_no").limit(100).collect()] if result.failures is not None else []
        more = [r["warning"] for r in I.page_warnings(result.validated).orderBy("warning_no").limit(1000).collect()]
        return "standard", result.items, result.sheets, result.items, result.sheets["Review"], gate, warnings + more
    if mode == "tables":
        result = P.deck(pages, tables)
        return mode, result.items.withColumn("item_no", F.col("pos")), result.sheets, None, None, [], warnings
    result = P.prose(words, pages, o.heading_style, o.gap_factor)
    return "prose", result.items, {"Paragraphs": result.paragraphs}, None, None, [], warnings


def _images(pages: DataFrame) -> DataFrame:
    """No parser gives images; a caller that has some uses with_ocr on the pages."""
    return pages.select("doc_id", "page", F.lit(None).cast("binary").alias("image")).limit(0)


def _write(out_path: str, sheets: dict[str, DataFrame], o: Options) -> None:
    if "Tables" in sheets:  # a sheet a table, and the slides' texts
        tables = I.padded_rows(sheets["Tables"]).select("page", "table_no", "sheet_name", "rows").orderBy("page", "table_no")
        texts = sheets["slides_text"].select("page", "text").orderBy("page")
        each = ((r["sheet_name"], None, [tuple(x) for x in r["rows"]]) for r in tables.toLocalIterator())
        O.write_xlsx(out_path, [*each, ("slides_text", ["slide", "text"], O.rows_of(texts))])
        return
    standard = "Standard Assessment" in sheets
    O.write_xlsx(out_path, [(name, df.columns, O.rows_of(df)) for name, df in sheets.items()], 10 if standard else 1, _head(o) if standard else None)


def verify_sheet(spark: SparkSession, path: str, id_pattern: str = r"^[A-Z]{2}-\d+(\(\d+\))?$", titles: tuple[str, ...] = FRONT, phrases: tuple[str, ...] = (T.DOI_TEXT, T.DOI_PATH), first_row: int = 10) -> dict:
    """Counts over a written assessment sheet, by reading it back; no rows give n_rows 0."""
    rows = [("sheet", int(r["row"]), r.get("B"), r.get("C"), r.get("D")) for r in O.read_xlsx(path).get("Standard Assessment", []) if int(r["row"]) >= first_row]
    found = I.sheet_check(spark.createDataFrame(rows, "doc_id string, sheet_row int, clause string, title string, text string"), id_pattern, titles, phrases).first()
    return found.asDict() if found else {"n_rows": 0}
