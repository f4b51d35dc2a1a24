"""Passages of many words that an earlier document also has: found by prefix-partitioned suffix trees, and removed.

A window is ``window`` consecutive words. The part of the corpus's suffix tree below that depth is built in subtrees,
which a prefix of variable length deals out:

* The first of ``prefixes`` words first. Of the places in a window where such a prefix could be taken the one with the
  least code is used, so equal windows always meet, and neighbouring windows mostly share it: they travel as one run.
  A prefix that only one document has can hold no node with two documents and is dropped before any text moves.
* A subtree of more than ``group_windows`` windows, 8 bytes each, doesn't fit. Runs that are alike in it have the same
  nodes all the way down, so those of all but the least document are settled by a minimum, which combines before the
  shuffle; a passage in a third of all documents meets in no task. What is left is dealt again by the least prefix of
  the next length, and so on, and at last by all words of a window: such a node only wants its least document.

A suffix is written as the codes of its windows: two suffixes share the first window + k - 1 words if and only if their
first k codes agree. In a subtree the suffixes are sorted by doubling, neighbours give common prefixes, and intervals
of these are the internal nodes. Those that can't be extended to the left either are the maximal repeats. A
suffix is removed down to its lowest node that a smaller document shares.

Words are compared by 64-bit codes, windows by a 64-bit code below a 64-bit prefix code.

Cases: null text has no words. A null id counts as the largest; ids that are no integers raise TypeError. Rows of one id
are one document, so they never repeat each other. Fewer than ``window`` words: nothing is removed. Texts of any length.
Other columns are carried; one named like an added column gives way to it. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as W
from ._run import Carried, cut, lean, ship, whole_id

LAST = (1 << 63) - 1


def _least(g: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values, from running least values forth and back in blocks of w."""
    m = len(g) - w + 1
    x = np.concatenate([g, np.full(-len(g) % w, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, w)
    forth = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:m], forth[w - 1 : w - 1 + m])


def _prefix_runs(window: int, prefix: int):
    """Of each text, the runs of windows with one prefix: its code, the first window, how many."""
    span = window - prefix + 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for row, _, data, offsets in W.chunks(b.column(2)):
                w = W.words(data, offsets, W.PLAIN)
                at, g = w.grams(prefix)
                if len(at) < span:
                    continue
                least = _least(g, span)
                ok = w.doc[at[: len(least)]] == w.doc[at[span - 1 :]]
                start, least = at[: len(least)][ok], least[ok]
                doc = w.doc[start]
                if not len(start):
                    continue
                new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])]))
                doc = doc[new]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[row + doc]),
                        pa.array(hashes[row + doc]),
                        pa.array(W.signed(least[new])),
                        pa.array((start[new] - w.first[doc]).astype(np.int32)),
                        pa.array(np.diff(np.append(new, len(start))).astype(np.int32)),
                    ],
                    names=["_d", "_h", "prefix", "start", "n"],
                )

    return each


def _suffixes(window: int, longer: tuple[int, ...]):
    """For texts with the runs to look at: each run with the codes of its windows; large ones in pieces with one least prefix of each longer length."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            runs = b.column(3)
            ends = runs.offsets.to_numpy()
            held = runs.values
            prefix, start, n, large = (held.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            for row, rows, data, offsets in W.chunks(b.column(2)):
                w = W.words(data, offsets, W.PLAIN)
                at, g = w.grams(window)
                lo, hi = ends[row], ends[row + rows]
                doc = np.repeat(np.arange(rows), np.diff(ends[row : row + rows + 1]))
                begin = np.searchsorted(at, w.first[doc] + start[lo:hi])
                size = n[lo:hi].astype(np.int64)
                to = np.cumsum(size) - size
                run = np.repeat(np.arange(len(size)), size)
                inside = np.arange(len(run)) - to[run]
                pick = begin[run] + inside
                new, some = inside == 0, np.flatnonzero(large[lo:hi].astype(bool)[run])
                keys = np.zeros((len(longer), len(run)), dtype=np.uint64)
                for k, p in enumerate(longer if len(some) else ()):
                    where, grams = w.grams(p)
                    least = _least(grams, window - p + 1)  # from each gram on; a window's grams are neighbours
                    keys[k, some] = least[np.searchsorted(where, at[pick[some]])]
                    new[1:] |= keys[k, 1:] != keys[k, :-1]
                first = np.flatnonzero(new)
                run = run[first]
                codes = pa.ListArray.from_arrays(pa.array(np.append(first, len(pick)).astype(np.int32)), pa.array(W.signed(g[pick])))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[row + doc[run]]),
                        pa.array(hashes[row + doc[run]]),
                        pa.array(prefix[lo:hi][run]),
                        pa.array(large[lo:hi][run]),
                        pa.array((start[lo:hi][run] + inside[first]).astype(np.int32)),
                        codes,
                        *[pa.array(W.signed(x[first])) for x in keys],
                    ],
                    names=["_d", "_h", "prefix", "large", "start", "codes", *[f"longer{p}" for p in longer]],
                )

    return each


class _Ranges:
    """Least values of ranges of an array."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]
        while 2 << (len(self.levels) - 1) <= len(x):
            half = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of [lo, hi), not empty."""
        out = np.empty(len(lo), dtype=self.levels[0].dtype)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][lo[at]], self.levels[k][hi[at] - (1 << k)])
        return out

    def until(self, lo: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first place from lo on with a value below bound, or the end."""
        at = lo.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            ok = at < len(level)
            ok[ok] = level[at[ok]] >= bound[ok]
            at[ok] += 1 << k
        return at


class Subtrees:
    """The suffix trees, below the depth of a window, of runs (groups sorted): suffixes that have a node there, in sorted order."""

    def __init__(self, group: np.ndarray, doc: np.ndarray, text: np.ndarray, place: np.ndarray, code: np.ndarray):
        order = np.lexsort((place, text, doc, group))
        group, doc, text, place, code = group[order], doc[order], text[order], place[order], code[order]
        by = np.lexsort((code, group))
        new = np.ones(len(by), dtype=bool)
        new[1:] = (group[by][1:] != group[by][:-1]) | (code[by][1:] != code[by][:-1])
        name = np.empty(len(by), dtype=np.int64)
        name[by] = np.cumsum(new)
        twice = (np.bincount(name, minlength=1) > 1)[name]  # a window that is alone is no node and ends what runs over it
        before = np.append(0, name[:-1])
        follows = np.zeros(len(by), dtype=bool)
        follows[1:] = (group[1:] == group[:-1]) & (doc[1:] == doc[:-1]) & (text[1:] == text[:-1]) & (place[1:] == place[:-1] + 1)
        before = np.where(follows, before, -1 - np.arange(len(by)))[twice]  # unlike all others where a run starts
        kept = np.flatnonzero(twice)
        follows = follows[twice] & (np.diff(kept, prepend=-2) == 1)
        self.doc, self.text, self.place = doc[twice], text[twice], place[twice]
        m = len(kept)
        left = np.append(np.flatnonzero(~follows)[1:], m)
        left = np.repeat(left, np.diff(np.append(np.flatnonzero(~follows), m))) - np.arange(m) if m else np.empty(0, dtype=np.int64)  # windows to the end of the run
        ranks, reach = [np.unique(name[twice], return_inverse=True)[1] + 1], 1
        sa = np.argsort(ranks[0], kind="stable")
        while m and reach < left.max():
            r = ranks[-1]
            next_ = np.zeros(m, dtype=np.int64)
            more = np.flatnonzero(left > reach)
            next_[more] = r[more + reach]
            key = r * (m + 1) + next_
            sa = np.argsort(key, kind="stable")
            rank = np.empty(m, dtype=np.int64)
            rank[sa] = np.cumsum(np.append(True, key[sa][1:] != key[sa][:-1]))
            ranks.append(rank)
            reach *= 2
        self.sa = sa
        a, b = sa[:-1], sa[1:]
        common = np.zeros(max(m - 1, 0), dtype=np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            ok = (left[a] - common >= 1 << k) & (left[b] - common >= 1 << k)
            ok[ok] = ranks[k][a[ok] + common[ok]] == ranks[k][b[ok] + common[ok]]
            common[ok] += 1 << k
        self.common, self.before = common, before

    def earlier(self) -> np.ndarray:
        """Of each suffix in sorted order, how many windows deep its lowest node is that a smaller document shares; 0 if none."""
        n = len(self.sa)
        doc, common = self.doc[self.sa], _Ranges(self.common)
        out = np.zeros(n, dtype=np.int64)
        for back in (False, True):
            own = doc[::-1] if back else doc
            found = _Ranges(own).until(np.arange(n), own)  # the next suffix of a smaller document
            some = np.flatnonzero(found < n)
            lo, hi = (n - 1 - found[some], n - 1 - some) if back else (some, found[some])
            if len(some):
                at = hi if back else lo
                out[at] = np.maximum(out[at], common.least(lo, hi))
        return out

    def repeats(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The maximal repeats: windows deep, number of places, the first place (of the smallest document) as an index into doc, text and place."""
        m, n = len(self.common), len(self.sa)
        at = np.flatnonzero(self.common > 0)
        deep = self.common[at]
        hi = _Ranges(self.common).until(at, deep)
        lo = m - _Ranges(self.common[::-1]).until(m - 1 - at, deep)
        _, first = np.unique(lo * (n + 1) + hi, return_index=True)  # each interval once
        lo, hi, deep = lo[first], hi[first], deep[first]
        left = self.before[self.sa]
        open_ = _Ranges(left).least(lo, hi + 1) != -_Ranges(-left).least(lo, hi + 1)  # what comes before differs
        lo, hi, deep = lo[open_], hi[open_], deep[open_]
        return deep, hi - lo + 1, _Ranges(self.sa).least(lo, hi + 1)


def _spans(doc: np.ndarray, hash_: np.ndarray, start: np.ndarray, window: int) -> pa.RecordBatch:
    """Windows, by document and place, as spans of words; neighbours join."""
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hash_[1:] != hash_[:-1]) | (start[1:] != start[:-1] + 1)
    f = np.flatnonzero(new)
    last = np.append(f[1:], len(doc)) - 1 if len(doc) else f
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[f]), pa.array(hash_[f]), pa.array(start[f].astype(np.int32)), pa.array((start[last] + window).astype(np.int32))],
        names=["_d", "_h", "lo", "hi"],
    )


def _below(window: int, mode: str, windows_at_once: int = 200_000):
    """Runs sorted by prefix: what the subtrees of whole prefixes give, as spans to remove or as maximal repeats."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        doc, hash_, prefix, start = (t.column(i).to_numpy() for i in (0, 1, 2, 3))
        codes = t.column(4).combine_chunks()
        size = np.diff(codes.offsets.to_numpy())
        run = np.repeat(np.arange(len(doc)), size)
        into = np.cumsum(size) - size
        group = np.cumsum(np.append(True, prefix[1:] != prefix[:-1]))[: len(doc)]
        place = start[run].astype(np.int64) + np.arange(len(run)) - into[run]
        tree = Subtrees(group[run], doc[run], hash_[run], place, codes.flatten().to_numpy())
        if mode == "repeats":
            deep, places, first = tree.repeats()
            out = [pa.array(deep + window - 1), pa.array(places), pa.array(tree.doc[first]), pa.array(tree.text[first]), pa.array(tree.place[first].astype(np.int32))]
            return pa.RecordBatch.from_arrays(out, names=["words", "places", "_d", "_h", "lo"])
        gone = np.sort(tree.sa[tree.earlier() > 0])
        return _spans(tree.doc[gone], tree.text[gone], tree.place[gone], window)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        windows = 0
        for b in batches:
            held.append(b)
            windows += len(b.column(4).flatten())
            if windows < windows_at_once:
                continue
            t = pa.Table.from_batches(held)
            prefix = t.column(2).to_numpy()
            whole = int(np.searchsorted(prefix, prefix[-1]))  # the last prefix may go on
            if whole:
                yield solve(t.slice(0, whole))
                t = t.slice(whole)
            held = t.combine_chunks().to_batches()
            windows = sum(len(x.column(4).flatten()) for x in held)
        if held and sum(x.num_rows for x in held):
            yield solve(pa.Table.from_batches(held))

    return each


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(whole_id(docs, id_col), F.lit(LAST)).alias("_d"), F.xxhash64(text).alias("_h"), text.alias("_t"))


def _dealt(docs: DataFrame, id_col: str, text_col: str, window: int, prefixes: tuple[int, ...], group_windows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs of windows by prefix, so that a prefix's subtree fits; runs of which even all words are too many for that; and runs of large subtrees that a smaller document has alike, with it as least."""
    if not prefixes or not all(0 < p <= window for p in prefixes) or list(prefixes) != sorted(set(prefixes)):
        raise ValueError("prefixes must rise from 1 to window at most")
    spark = docs.sparkSession
    ship(spark)
    keyed = _keyed(docs, id_col, text_col)
    runs = cut(keyed.mapInArrow(lean(_prefix_runs(window, prefixes[0])), "_d long, _h long, prefix long, start int, n int"))
    two = F.min("_d") < F.max("_d")
    shared = runs.groupBy("prefix").agg(two.alias("two"), (F.sum("n") > group_windows).alias("large")).where("two").drop("two")
    wanted = runs.join(shared, "prefix").groupBy("_d", "_h").agg(F.collect_set(F.struct("prefix", "start", "n", "large")).alias("runs"))
    longer = [f"longer{p}" for p in prefixes[1:]]
    fields = "_d long, _h long, prefix long, large boolean, start int, codes array<long>" + "".join(f", {c} long" for c in longer)
    below = cut(keyed.join(wanted, ["_d", "_h"]).select("_d", "_h", "_t", "runs").mapInArrow(lean(_suffixes(window, prefixes[1:])), fields))
    fits = below.where("not large").select("_d", "_h", "prefix", "start", "codes")
    # alike runs are one below all their nodes, so only those of the least document have to be sorted
    large = below.where("large").drop("large").withColumn("alike", F.xxhash64("codes"))
    least = large.groupBy("prefix", "alike").agg(F.min("_d").alias("least"))
    large = large.join(least, ["prefix", "alike"])
    copies = large.where("_d > least").select("_d", "_h", "start", F.size("codes").alias("n"))
    large = large.where("_d = least").drop("least", "alike")
    for c in longer:
        large = large.withColumn("prefix", F.xxhash64("prefix", c)).drop(c)
        sizes = large.groupBy("prefix").agg((F.sum(F.size("codes")) > group_windows).alias("large"))
        large = large.join(sizes, "prefix")
        fits = fits.unionByName(large.where("not large").select("_d", "_h", "prefix", "start", "codes"))
        large = large.where("large").drop("large")
    return fits, large.select("_d", "_h", "prefix", "codes", "start"), copies


def _trees(spark: SparkSession, fits: DataFrame, window: int, mode: str, schema: str) -> DataFrame:
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return fits.repartition(parts, "prefix").sortWithinPartitions("prefix").mapInArrow(lean(_below(window, mode)), schema)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, prefixes: tuple[int, ...] = (16, 32), group_windows: int = 1 << 16) -> DataFrame:
    """Spans [lo, hi) of words, of the document _d whose text has the hash _h, that only consist of windows which a smaller document has too. Spans may overlap."""
    fits, large, copies = _dealt(docs, id_col, text_col, window, prefixes, group_windows)
    usual = _trees(docs.sparkSession, fits, window, "spans", "_d long, _h long, lo int, hi int")
    alike = copies.select("_d", "_h", F.col("start").alias("lo"), (F.col("start") + F.col("n") - 1 + window).alias("hi"))
    nodes = large.select("_d", "_h", "prefix", "start", F.posexplode("codes").alias("at", "code"))
    least = nodes.groupBy("prefix", "code").agg(F.min("_d").alias("least"))
    lo = F.col("start") + F.col("at")
    split = nodes.join(least, ["prefix", "code"]).where("_d > least").select("_d", "_h", lo.alias("lo"), (lo + window).alias("hi"))
    return usual.unionByName(alike).unionByName(split)


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, prefixes: tuple[int, ...] = (16, 32), group_windows: int = 1 << 16) -> DataFrame:
    """words, places, _d, _h, lo: passages of ``window`` words or more with several places, as long as all these agree; and the first place (words from lo of the text with hash _h of document _d).

    Passages that two documents share at least in a part. A passage is followed as far as its windows have one least
    prefix; in subtrees too large for that runs that are alike count as one place, that of the least document, and
    what is too large for any subtree is told as single windows.
    """
    fits, large, _ = _dealt(docs, id_col, text_col, window, prefixes, group_windows)
    usual = _trees(docs.sparkSession, fits, window, "repeats", "words long, places long, _d long, _h long, lo int")
    nodes = large.select("_d", "_h", "prefix", "start", F.posexplode("codes").alias("at", "code"))
    single = nodes.groupBy("prefix", "code").agg(F.count("*").alias("places"), F.min(F.struct("_d", "_h", (F.col("start") + F.col("at")).alias("lo"))).alias("first")).where("places > 1")
    return usual.unionByName(single.select(F.lit(window).cast("long").alias("words"), "places", "first._d", "first._h", "first.lo"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = b.column(1)
        for row, rows, data, offsets in W.chunks(b.column(0)):
            w = W.words(data, offsets, W.PLAIN)
            total, removed, texts = [], [], []
            for i in range(rows):
                a, z = w.first[i], w.first[i + 1]
                gone = np.zeros(z - a + 1, dtype=np.int32)
                found = spans[row + i].values if spans[row + i].is_valid else None
                if found is not None:
                    np.add.at(gone, found.field(0).to_numpy(), 1)
                    np.add.at(gone, found.field(1).to_numpy(), -1)
                keep = np.cumsum(gone[:-1]) == 0
                texts.append(b" ".join([data[s:e].tobytes() for s, e in zip(w.start[a:z][keep], w.end[a:z][keep], strict=True)]) if not keep.all() else b" ".join(data[offsets[i] : offsets[i + 1]].tobytes().split()))
                total.append(int(z - a))
                removed.append(int((~keep).sum()))
            yield pa.RecordBatch.from_arrays(
                [b.column(2).slice(row, rows), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])],
                names=["_row", "n_words", "n_removed", "kept_text", "kept_sha256"],
            )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, keep_text: bool = True, **options) -> DataFrame:
    """docs' columns with n_words, n_removed, kept_text (kept words joined by one space) and kept_sha256."""
    spans = repeated_spans(docs, id_col, text_col, window, **options).groupBy("_d", "_h").agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    added = ("n_words", "n_removed", "kept_text", "kept_sha256")
    own = Carried(docs, added, () if keep_text else (text_col,))
    keyed = docs.select(own.packed, text.alias("_t"), F.coalesce(whole_id(docs, id_col), F.lit(LAST)).alias("_d"), F.xxhash64(text).alias("_h"))
    joined = keyed.join(spans, ["_d", "_h"], "left").select("_t", "_spans", "_row")
    out = joined.mapInArrow(lean(_kept), own.schema(("n_words", "long"), ("n_removed", "long"), ("kept_text", "string"), ("kept_sha256", "string")))
    return own.unpacked(out, *[c for c in added if keep_text or c != "kept_text"])
