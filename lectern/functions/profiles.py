"""Kinds of standards: how their headings, boundaries and requirements look."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


@dataclass(frozen=True)
class Heading:
    """A pattern with the number of the group of the id and the groups of the title, the first non-empty one counts."""

    regex: str
    id_group: int = 1
    title_groups: tuple[int, ...] = (2,)


@dataclass(frozen=True)
class Profile:
    name: str
    headings: tuple[Heading, ...]
    keywords: tuple[str, ...]
    enhancements: tuple[Heading, ...] = ()
    table_headers: tuple[str, ...] = ()
    starts: tuple[str, ...] = ()
    stops: tuple[str, ...] = ()
    catalog: bool = False


# The heading grammars, boundary markers and keywords of each kind.
BASE_HEADING = r"^([A-Z]{2}-\d+)\s+([A-Z0-9][A-Z0-9 ,/\-—:&()]+)$"
ENHANCEMENT = r"^\((\d+)\)\s+([A-Z0-9][A-Z0-9 ,/\-—:&()|]+)$"
PROFILES: dict[str, Profile] = {
    p.name: p
    for p in (
        Profile(
            "nist80053", (Heading(BASE_HEADING),), ("shall", "must", "is required to", "are required to"), (Heading(ENHANCEMENT),),
            starts=(r"^AC-1\b",), stops=(r"(?i)^REFERENCES\b", r"(?i)^APPENDIX A\b", r"(?i)^APPENDIX B\b", r"(?i)^APPENDIX C\b"), catalog=True,
        ),
        Profile(
            "control-catalog",
            (Heading(BASE_HEADING), Heading(r"(?i)^((?:Control|Requirement)\s+\d+(?:\.\d+)*)\s*(?::|-)?\s*([A-Z0-9][A-Za-z0-9 ,/\-—:&()]+)$")),
            ("shall", "must", "required", "ensure", "implement"), (Heading(ENHANCEMENT),), catalog=True,
        ),
        Profile(
            "iso",
            (Heading(r"^([A-Z]?\.\d+(?:\.\d+)*|\d+(?:\.\d+)+)\s+(.+)$"), Heading(r"^(\d+)\s+([A-Z][A-Za-z0-9 ,/\-—:&()]+)$")),
            ("shall", "must", "ensure", "establish", "maintain", "document"),
            starts=(r"(?i)^1\s+Scope", r"(?i)^4\s+Context"), stops=("(?i)^Bibliography",),
        ),
        Profile(
            "legal",
            (
                Heading(r"(?i)^((?:Article|Section)\s+\d+)\s*(?::|-)?\s*(?:\(([^)]+)\)|(.+))?$", 1, (2, 3)),
                Heading(r"(?i)^((?:Chapter|Part|Schedule)\s+(?:[IVXLCDM\d]+))\s*(?::|-)?\s*(.*)$"),
            ),
            ("shall", "shall not", "must", "may not", "is required to", "prohibited", "permitted only", "responsible for"),
            starts=(r"(?i)^Article 1\b", r"(?i)^CHAPTER I\b"), stops=(r"(?i)^ANNEX\s+[A-Z]",),
        ),
        Profile(
            "pci", (Heading(r"(?i)^((?:Req\.?|Requirement)\s+\d+(?:\.\d+)*)\s+(.+)$"),), ("must", "shall", "examine", "verify", "confirm"),
            table_headers=("(?i)PCI DSS Requirement", "(?i)Testing Procedure"), starts=("(?i)PCI DSS Requirements",), stops=(r"(?i)^Appendix\s+[A-Z]",),
        ),
        Profile(
            "cis",
            (Heading(r"(?i)^(CIS\s+(?:Control|Safeguard)\s+\d+(?:\.\d+)*)\s+(.+)$"), Heading(r"(?i)^((?:Control|Safeguard)\s+\d+(?:\.\d+)*)\s+(.+)$")),
            ("ensure", "establish", "maintain", "restrict", "protect"), starts=("(?i)CIS Controls",), stops=(r"(?i)^Appendix\s+[A-Z]",),
        ),
        Profile(
            "generic",
            (
                Heading(r"^(\d+(?:\.\d+)*)\s+(.+)$"),
                Heading(r"(?i)^((?:Annex|Appendix|Schedule)\s+[A-Z0-9](?:\.\d+)*)\s+(.+)$"),
                Heading(r"(?i)^((?:Article|Chapter|Section|Part)\s+\d+)\s*(?::|-)?\s*(.*)$"),
            ),
            ("shall", "must", "ensure", "implement", "maintain"),
        ),
    )
}
ALIASES = {
    "nist_control_catalog": "nist80053", "iso_numbered_standard": "iso", "legal_articles": "legal", "pci_requirement_table": "pci", "cis_controls": "cis",
    "generic_numbered_guideline": "generic", "table-heavy": "generic", "unknown": "generic",
}
COMMON_TABLE_HEADERS = ("requirement", "control", "procedure", "guidance", "description", "status", "asset", "function")


def resolve(name: str) -> Profile:
    return PROFILES.get(ALIASES.get(name, name), PROFILES["generic"])


def resolve_name(name: Column) -> Column:
    """The profile's name of a hint or alias."""
    known = F.create_map(*[F.lit(x) for pair in ({p: p for p in PROFILES} | ALIASES).items() for x in pair])
    return F.coalesce(known[name], F.lit("generic"))


def _found(x: Column, h: Heading, kind: str | None) -> Column:
    clause = T.strip(F.regexp_extract(x, h.regex, h.id_group))
    title = F.lit("")
    for g in reversed(h.title_groups):
        one = T.strip(F.regexp_extract(x, h.regex, g))
        title = F.when(one != "", one).otherwise(title)
    level = F.lit(3) if kind else F.when(clause.contains("."), F.size(F.split(clause, r"\."))).otherwise(1)
    named = F.lit(kind) if kind else F.when(level > 1, "sub_clause").otherwise("base_clause")
    when = x.rlike(h.regex) & (T.is_upper_title(F.regexp_extract(x, h.regex, 2)) if kind else F.lit(True))
    return F.when(when, F.struct(named.alias("kind"), clause.alias("clause_id"), title.alias("title"), level.cast("int").alias("level")))


def parse_heading(c: Column, profile: Profile) -> Column:
    """struct(kind, clause_id, title, level) by the first pattern that fits, or null."""
    x = T.strip(c)
    return F.coalesce(*[_found(x, h, None) for h in profile.headings], *[_found(x, h, "enhancement") for h in profile.enhancements])


def parse_heading_any(c: Column) -> Column:
    return F.coalesce(*[parse_heading(c, p) for p in PROFILES.values()])


def is_any_heading(c: Column) -> Column:
    x, hit = T.strip(c), F.lit(False)
    for p in PROFILES.values():
        for h in p.headings:
            hit = hit | x.rlike(h.regex)
        for h in p.enhancements:
            hit = hit | (x.rlike(h.regex) & T.is_upper_title(F.regexp_extract(x, h.regex, 2)))
    return hit


def heading_spec(style: str) -> tuple[str, int]:
    """Pattern and length limit of a prose heading."""
    return {
        "numbered": (r"(?U)^\d+(\.\d+){0,4}\.?\s+\S", 90),
        "legal": (r"(?iU)^(chapter|article|section|part|annex|schedule)\s+\d+(\s*\(|\s+[A-Z]|\s*$)", 130),
    }[style]


def is_prose_heading(c: Column, style: str | Column) -> Column:
    """style: numbered, legal, or a Column that holds one of them."""
    def one(s: str) -> Column:
        p, most = heading_spec(s)
        return c.rlike(p) & (F.length(c) < most)

    return one(style) if isinstance(style, str) else F.when(style == "legal", one("legal")).otherwise(one("numbered"))
