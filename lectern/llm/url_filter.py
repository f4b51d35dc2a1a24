"""URL filters with dated lists: a temporal list join, in DataFrame operations only.

Entries of lists are added and dropped on dates; the events of one entry become validity intervals that don't overlap
(lead over time). A capture has a key for its host, each parent domain and each leading part of its path; it matches
an entry of that key that is valid when the page was fetched: an equality join with the time inside the interval, so
each capture is judged by the lists as they were.

List events of an entry are its own small group. A capture only brings the keys of a kind and depth (labels or path
segments) that some entry has, so bare suffixes don't gather all captures unless a list names one. Captures join by key
and one of ``spread`` salts, for each of which the intervals are repeated: a hot host's captures meet in many tasks. Only
id, time and key of a capture are shuffled.

Events: list, kind ('domain': the host and all below it; 'host': it alone; 'prefix': host and leading path segments),
entry, action ('add' or 'drop'), at. Of an entry's events at one time a drop holds; events that repeat the state change
nothing. Intervals are closed at the start and open at the end.

Cases: null or malformed URLs have no host and match nothing; null times match nothing. Null lists, kinds, entries,
actions or times of events are left out. Hosts are compared without case, credentials, port, leading 'www.' or a final
dot; paths with case, without query, fragment and final slash. URLs of any length. Repeated rows are judged each; columns
named like an added one give way to it. Empty lists block nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._run import Carried


def host(url: Column) -> Column:
    """Lower-case host without credentials, port, 'www.' and final dot; null if there is none."""
    found = F.lower(F.regexp_extract(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    found = F.regexp_replace(F.regexp_replace(found, r"\.$", ""), r"^www\.", "")
    return F.when(F.length(found) > 0, found)


def path(url: Column) -> Column:
    """Path without final slashes, query and fragment."""
    found = F.regexp_extract(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)
    return F.regexp_replace(F.coalesce(found, F.lit("")), "/+$", "")


def keys(url: Column) -> Column:
    """array<struct<kind, entry>> that can match the URL."""
    name = host(url)
    labels = F.split(name, r"\.")
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    struct = lambda kind, entry: F.struct(F.lit(kind).alias("kind"), entry.alias("entry"))
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: struct("domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    below = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: struct("prefix", F.concat(name, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    return F.when(name.isNotNull(), F.concat(F.array(struct("host", name)), above, below))


def intervals(events: DataFrame) -> DataFrame:
    """list, kind, entry, valid_from, valid_to (null: still valid) from dated adds and drops."""
    known = events.select("list", "kind", "entry", "action", "at").where(F.col("action").isin("add", "drop")).dropna()
    state = known.groupBy("list", "kind", "entry", "at").agg(F.max(F.col("action") == "drop").alias("drop"))  # one state a time
    own = Window.partitionBy("list", "kind", "entry").orderBy("at")
    changes = state.withColumn("was", F.lag("drop", 1, True).over(own)).where("drop != was")
    return changes.withColumn("valid_to", F.lead("at").over(own)).where("not drop").select("list", "kind", "entry", F.col("at").alias("valid_from"), "valid_to")


def depth(kind: Column, entry: Column) -> Column:
    """Labels of a domain, slashes of a prefix; 255 stands for more. So there are at most 3 x 256 kinds and depths."""
    return F.least(F.when(kind == "domain", F.size(F.split(entry, r"\."))).when(kind == "prefix", F.size(F.split(entry, "/"))).otherwise(0), F.lit(255))


def matches(captures: DataFrame, events: DataFrame, id_col: str, url_col: str = "url", at_col: str = "fetched", spread: int = 8) -> DataFrame:
    """id, list, kind, entry, valid_from of each entry active when the capture was fetched."""
    asked = captures.select(F.col(id_col).alias("id"), F.col(at_col).alias("fetched"), F.explode(keys(F.col(url_col))).alias("k")).select("id", "fetched", "k.kind", "k.entry")
    valid = intervals(events.where(F.col("kind").isin("host", "domain", "prefix")))
    listed = events.where(F.col("kind").isin("host", "domain", "prefix")).select("kind", depth(F.col("kind"), F.col("entry")).alias("depth")).distinct()
    asked = asked.withColumn("depth", depth(F.col("kind"), F.col("entry"))).join(F.broadcast(listed), ["kind", "depth"], "left_semi")
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(spread)).cast("int"))
    valid = valid.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    during = (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    return asked.join(valid, ["kind", "entry", "salt"]).where(during).select("id", "list", "kind", "entry", "valid_from")


def filtered(captures: DataFrame, events: DataFrame, url_col: str = "url", at_col: str = "fetched") -> DataFrame:
    """captures with lists (names of the lists that match, sorted), n_entries and blocked. Each URL and time is judged once."""
    own = Carried(captures, ("lists", "n_entries", "blocked"))
    rows = captures.select(own.packed, F.col(url_col).alias("_url"), F.col(at_col).alias("_at"))
    asked = rows.select("_url", "_at").where("_url is not null and _at is not null").distinct()
    per = matches(asked.withColumn("_k", F.struct("_url", "_at")), events, "_k", "_url", "_at")
    per = per.groupBy(F.col("id._url").alias("_u"), F.col("id._at").alias("_t")).agg(F.array_sort(F.collect_set("list")).alias("lists"), F.countDistinct("list", "kind", "entry").alias("n_entries"))
    out = rows.join(per, (F.col("_url") == F.col("_u")) & (F.col("_at") == F.col("_t")), "left")
    out = out.withColumn("lists", F.coalesce("lists", F.array().cast("array<string>"))).withColumn("n_entries", F.coalesce("n_entries", F.lit(0)).cast("long"))
    return own.unpacked(out.withColumn("blocked", F.col("n_entries") > 0), "lists", "n_entries", "blocked")
