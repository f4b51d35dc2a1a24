import pytest
from pyspark.sql import functions as F

from lectern.functions import profiles as P
from lectern.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("v")).first()["v"]


def test_strip_is_unicode(spark):
    assert one(spark, "\n  a \t", T.strip) == "a"


def test_join_lines_fuses_split_words(spark):
    x = spark.createDataFrame([(["docu-", "ment is", "here"],)], "p array<string>").select(T.join_lines(F.col("p")).alias("v")).first()
    assert x["v"] == "document is here"


@pytest.mark.parametrize("s,yes", [("12", True), ("Page 12", True), ("- 12 -", True), ("Page 12 of 30", True), ("12a", False), ("", False)])
def test_page_number(spark, s, yes):
    assert one(spark, s, T.is_page_number) is yes


def test_spaced_header(spark):
    s = "N I S T S P 8 0 0 - 5 3 , R E V . 5 S E C U R I T Y A N D P R I V A C Y C O N T R O L S F O R I N F O R M A T I O N S Y S T E M S A N D O R G A N I Z A T I O N S"
    assert one(spark, s, T.has_header) is True
    assert one(spark, "NIST guidance", T.has_header) is False


def test_clean_noise(spark):
    assert one(spark, "Keep\nCHAPTER THREE PAGE 7\nhttps://doi.org/10.1/x\n text  here", T.clean_noise) == "Keep\ntext here"


@pytest.mark.parametrize(
    "s,clause,title",
    [("AC-1 POLICY AND PROCEDURES", "AC-1", "POLICY AND PROCEDURES"), ("AC-12 lower case", None, None), ("AC-17 REMOTE ACCESS — PLAN", "AC-17", "REMOTE ACCESS — PLAN")],
)
def test_base_heading(spark, s, clause, title):
    x = one(spark, s, lambda c: P.parse_heading(c, P.PROFILES["nist80053"]))
    assert (x["clause_id"] if x else None, x["title"] if x else None) == (clause, title)


def test_enhancement_needs_capitals(spark):
    f = lambda c: P.parse_heading(c, P.PROFILES["nist80053"])
    assert one(spark, "(1) AUTOMATED MANAGEMENT", f)["kind"] == "enhancement"
    assert one(spark, "(1) Automated management", f) is None


def test_legal_title_from_either_group(spark):
    f = lambda c: P.parse_heading(c, P.PROFILES["legal"])
    assert one(spark, "Article 1 (Purpose)", f)["title"] == "Purpose"
    assert one(spark, "Article 2: Scope", f)["title"] == "Scope"


def test_section_label_is_no_stop(spark):
    assert one(spark, "Related Controls: AC-2", T.section_label) == "Related Controls"
    assert one(spark, "Relations", T.section_label) is None


@pytest.mark.parametrize("s,want", [("<https://a.b/c>", "https://a.b/c"), ("'https://a.b' x", "https://a.b"), ("[https://a.b/c] x", "https://a.b/c"), ("mailto:x", None), (None, None), ("https://a.b/c [a.b]", "https://a.b/c")])
def test_clean_url(spark, s, want):
    assert one(spark, s, T.clean_url) == want


def test_cache_key_matches_python(spark):
    import hashlib

    x = spark.createDataFrame([("a", None)], "a string, b string").select(T.cache_key(F.col("a"), F.col("b")).alias("v")).first()["v"]
    assert x == hashlib.sha256(b"a\0").hexdigest()


def test_aliases():
    assert P.resolve("pci_requirement_table").name == "pci"
    assert P.resolve("no such").name == "generic"
