"""N-gram Jaccard self-join of whole texts: a size-aware heavy-light join.

A text's set is its distinct ``n``-word shingles (A-Z as a-z); a text with fewer words has the whole sequence as its
only shingle, one without words has the empty set, which links with nothing. Equal sets are one class from the start.

All sets are sorted in one global order: tokens by code, those known to be frequent last, so that a set's first tokens
are rare. Two sets of similarity t or more share a token among the first size - ceil(t size) + 1 of each.

* Heavy sets (more than ``boundary`` shingles) put these tokens into inverted lists, which are scanned.
* Light sets enumerate subsets of two tokens instead, from one token more; sets that are linked share a subset. Light
  sets near the boundary also put single tokens into the lists, for heavy partners.
* The boundary is the size at which the estimated cost (rows enumerated against rows and list entries scanned, from
  the histogram of small sizes and the mean length of lists) is least.

How often each token occurs is counted first, on 40 bits and more of its code. The counts reach the executors in
tables of fixed size: a bitmap of tokens that occur twice or more (the others need no list), a bitmap of those that
occur ``often`` times or more and the order of the most frequent ones. Collisions there cost time and never a link.

The lists are scanned a few times. The first scans give only pairs that are neighbours in a random order of a list and
not yet in one component; what is verified is contracted, and only links between components found before go into the
next contraction. The last scan gives every pair of a list that is still in different components and can reach the
threshold by size and position, so groups of near copies do not become all their pairs, and no link between components
is lost. Every candidate is verified on the whole sets. A list of more than ``list_rows`` members is cut into parts of
about that size; in the last scan every two parts meet in a task of their own.

Cases: null text has no words; a null id is a row of its own, and a component's id is the least id in it, null if
there is none; ids that are no integers raise TypeError. Texts of any length. Repeated rows are one class. Other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._run import cut, lean, scratch, ship, whole_id
from .components import followed, settled

U = np.uint64
SMALL = 200  # largest boundary that is considered
MOST_HELD = 400_000  # pairs that a task holds before it hands them on
MAP_BITS = 26  # of a code, for the bitmaps: 8 MB each


def _sets(w: W.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and code of each distinct shingle, sorted by row and code."""
    at, g = w.grams(n)
    doc = w.doc[at]
    count = np.diff(w.first)
    for short in range(1, n):
        if (count == short).any():
            at, more = w.grams(short)
            own = count[w.doc[at]] == short
            doc, g = np.concatenate([doc, w.doc[at][own]]), np.concatenate([g, more[own]])
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    if len(g):
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])])
        doc, g = doc[new], g[new]
    return doc, g


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    run = np.concatenate([np.zeros(1, dtype=U), np.cumsum(x, dtype=U)])
    return run[first[1:]] - run[first[:-1]]


def _count(n: int, bits: int):
    """Codes of each batch's distinct sets, dealt by their first ``bits`` bits: the next 32 bits, of codes seen once and more often. Bucket -1: the histogram of small sizes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, seen = [], np.empty(0, dtype=U)
            sizes = np.zeros(SMALL + 2, dtype=np.int64)
            for _, rows, data, offsets in W.chunks(b.column(0)):
                doc, g = _sets(W.words(data, offsets, W.FOLDED), n)
                first = np.searchsorted(doc, np.arange(rows + 1))
                key = _sums(W.mix(g), first)
                fresh = np.zeros(rows, dtype=bool)
                fresh[np.unique(key, return_index=True)[1]] = True
                fresh &= ~np.isin(key, seen)
                seen = np.concatenate([seen, key[fresh]])
                sizes += np.bincount(np.minimum(np.diff(first)[fresh], SMALL + 1), minlength=SMALL + 2)
                tokens.append(g[fresh[doc]] >> U(32 - bits))
            if not tokens:
                continue
            code, times = np.unique(np.concatenate(tokens), return_counts=True)
            once = times == 1
            edges = np.arange((1 << bits) + 1, dtype=U) << U(32)
            low = lambda x: (x & U(0xFFFFFFFF)).astype(np.uint32)
            parts = []
            for x, kind in ((low(code[once]), code[once]), (low(code[~once]), code[~once]), (times[~once].astype(np.uint32), code[~once])):
                at = np.searchsorted(kind, edges)
                parts.append([x[at[i] : at[i + 1]].tobytes() for i in range(1 << bits)])
            full = [i for i in range(1 << bits) if parts[0][i] or parts[1][i]]
            for lo in range(0, len(full), 4096):
                some = full[lo : lo + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array([q[i] for i in some], pa.binary()) for q in parts]], names=["bucket", "once", "more", "times"])
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *[pa.array([x], pa.binary()) for x in (sizes.tobytes(), b"", b"")]], names=["bucket", "once", "more", "times"])

    return each


def _tables(bits: int, often: int, most: int):
    """Rows sorted by bucket -> of each bucket: its slices of both bitmaps, sums over rare codes, the most frequent codes."""
    size = 1 << (MAP_BITS - bits)

    def solve(bucket: int, held: list[tuple[bytes, bytes, bytes]]) -> tuple:
        if bucket < 0:
            return bucket, b"", b"", 0.0, 0.0, [], sum(np.frombuffer(h[0], dtype=np.int64) for h in held).tolist()
        code = np.concatenate([np.frombuffer(x, dtype=np.uint32) for h in held for x in h[:2]])
        times = np.concatenate([t for a, _, c in held for t in (np.ones(len(a) // 4, dtype=np.int64), np.frombuffer(c, dtype=np.uint32).astype(np.int64))])
        order = np.argsort(code, kind="stable")
        code, times = code[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        code, times = code[first], np.add.reduceat(times, first)
        maps = []
        for least in (2, often):
            flags = np.zeros(size, dtype=np.uint8)
            flags[code[times >= least] >> np.uint32(32 - (MAP_BITS - bits))] = 1
            maps.append(np.packbits(flags, bitorder="little").tobytes())
        rare = times[times < often].astype(np.float64)
        top = np.flatnonzero(times >= 8 * often)
        top = top[np.argsort(-times[top], kind="stable")][:most]
        return bucket, *maps, float(rare.sum()), float((rare * rare).sum()), ((bucket << 32) + code[top].astype(np.int64)).tolist(), times[top].tolist()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "shared", "frequent", "s1", "s2", "top", "times"]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        now, held = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(solve(now, held), kinds, strict=True)], names=names)

        for b in batches:
            for bucket, *row in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if bucket != now:
                    if held:
                        yield out()
                    now, held = bucket, []
                held.append(tuple(row))
        if held:
            yield out()

    return each


class Frequency:
    """What the executors know of how often tokens occur; its size is fixed."""

    def __init__(self, rows: list, bits: int, top: np.ndarray):
        size = 1 << (MAP_BITS - bits - 3)
        self.shift = np.uint64(32 - bits)
        self.maps = [np.zeros(1 << (MAP_BITS - 3), dtype=np.uint8) for _ in (0, 1)]
        for r in rows:
            for m, x in zip(self.maps, (r["shared"], r["frequent"]), strict=True):
                m[r["bucket"] * size : (r["bucket"] + 1) * size] = np.frombuffer(x, dtype=np.uint8)
        by = np.argsort(top)
        self.top, self.place = top[by].astype(np.uint64), np.arange(len(top), 0, -1)[by]

    def _flag(self, which: int, code: np.ndarray) -> np.ndarray:
        at = code >> U(64 - MAP_BITS)
        return (self.maps[which][at >> U(3)] >> (at & U(7)).astype(np.uint8)) & 1 == 1

    def shared(self, code: np.ndarray) -> np.ndarray:
        return self._flag(0, code)

    def rank(self, code: np.ndarray) -> np.ndarray:
        """Place in the order besides the code: 0 for rare ones, 1 for frequent ones, more for the most frequent."""
        out = self._flag(1, code).astype(np.int64)
        some = np.flatnonzero(out)
        if len(some) and len(self.top):
            cut_ = code[some] >> self.shift
            i = np.minimum(np.searchsorted(self.top, cut_), len(self.top) - 1)
            out[some] += np.where(self.top[i] == cut_, self.place[i], 0)
        return out


def boundary(sizes: dict[int, int], list_length: float, t: tuple[int, int]) -> int:
    """The size up to which enumerating subsets costs less than scanning lists; 0 if none does."""
    best, best_cost, cost = 0, 0.0, 0.0
    for size in range(2, SMALL + 1):
        need = -(-t[0] * size // t[1])
        if need >= 2:
            one, two = size - need + 1, size - need + 2
            cost += sizes.get(size, 0) * (two * (two - 1) / 2 - one * (1 + max(list_length - 1, 0) / 2))
        if cost < best_cost:
            best, best_cost = size, cost
    return best


def _signatures(n: int, t: tuple[int, int], light: int, shared):
    """Of each text: id, hash, two codes of the set, its size, its signatures and the place of each in the set's order."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Frequency = shared.value
        for b in batches:
            for row, rows, data, offsets in W.chunks(b.column(2)):
                doc, g = _sets(W.words(data, offsets, W.FOLDED), n)
                first = np.searchsorted(doc, np.arange(rows + 1))
                size = np.diff(first)
                k1, k2 = _sums(W.mix(g), first), _sums(W.mix(g ^ U(0xA5A5A5A5A5A5A5A5)), first)
                g = g[np.argsort(doc * (len(known.top) + 2) + known.rank(g), kind="stable")]
                need = -(-t[0] * size // t[1])
                lists = (size > light) | (t[0] * (light + 1) <= t[1] * size) | (need < 2) | (t[0] * size < 2 * t[1])
                at = np.arange(len(g)) - first[doc]
                single = lists[doc] & (at < (size - need + 1)[doc])
                single[single] = known.shared(g[single])
                out_doc, out, place = [doc[single]], [g[single]], [at[single]]
                for s in range(2, light + 1):
                    own = np.flatnonzero((size == s) & (need >= 2))
                    if len(own):
                        two = s - int(need[own[0]]) + 2
                        i, j = np.triu_indices(two, 1)
                        m = g[first[own][:, None] + np.arange(two)]
                        both = known.shared(m)
                        both = (both[:, i] & both[:, j]).ravel()
                        out.append(W.mix(m[:, i] * U(0x9E3779B97F4A7C15) + W.mix(m[:, j])).ravel()[both])
                        out_doc.append(np.repeat(own, len(i))[both])
                        place.append(np.tile(i, len(own))[both])
                out_doc, out, place = np.concatenate(out_doc), np.concatenate(out), np.concatenate(place)
                order = np.argsort(out_doc, kind="stable")
                to = pa.array(np.searchsorted(out_doc[order], np.arange(rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(row, rows),
                        b.column(1).slice(row, rows),
                        pa.array(W.signed(k1)),
                        pa.array(W.signed(k2)),
                        pa.array(size),
                        pa.ListArray.from_arrays(to, pa.array(W.signed(out[order]))),
                        pa.ListArray.from_arrays(to, pa.array(place[order].astype(np.int32))),
                    ],
                    names=["_d", "_h", "k1", "k2", "n_shingles", "signatures", "places"],
                )

    return each


def _by_list(solve, rows_at_once: int = 100_000):
    """Runs solve on tables of rows sorted by the first column that hold all rows of a value."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < rows_at_once:
                continue
            tab = pa.Table.from_batches(held)
            s = tab.column(0).to_numpy()
            whole = int(np.searchsorted(s, s[-1]))
            if whole:
                yield from solve(tab.slice(0, whole))
                tab = tab.slice(whole)
            held, rows = tab.combine_chunks().to_batches(), tab.num_rows
        if rows:
            yield from solve(pa.Table.from_batches(held))

    return each


def _pairs(t: tuple[int, int], reach: int, block: int = 512):
    """Rows (list, cid, n, place, root, side) -> candidates (a, b, ra, rb), a < b, of different roots ra, rb.

    They are within reach in a random order of the list; or all if reach is 0, but then rows of sides 1 and 2 only pair
    with the other side.
    """

    def fits(n1, i1, n2, i2):
        by_size = (t[1] * n1 >= t[0] * n2) & (t[1] * n2 >= t[0] * n1)
        return by_size & (np.minimum(n1 - i1, n2 - i2) * (t[0] + t[1]) >= t[0] * (n1 + n2))

    def solve(tab: pa.Table) -> Iterator[pa.RecordBatch]:
        s, c, n, i, r, side = (tab.column(k).to_numpy() for k in range(6))
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        own = np.repeat(np.minimum.reduceat(r, first) != np.maximum.reduceat(r, first), np.diff(np.append(first, len(s))))
        s, c, n, i, r, side = s[own], c[own], n[own], i[own], r[own], side[own]
        # neighbours are drawn anew in every list, so near copies that share many lists meet many others
        order = np.lexsort((W.mix(c.view(U) ^ W.mix(s.view(U) + U(reach))), s)) if reach else np.lexsort((c, n, s))
        s, c, n, i, r, side = s[order], c[order], n[order], i[order], r[order], side[order]
        held: list[np.ndarray] = []
        rows = 0

        def batch() -> pa.RecordBatch:
            p, q = np.concatenate(held, axis=1)
            p, q = np.where(c[p] < c[q], p, q), np.where(c[p] < c[q], q, p)
            o = np.lexsort((c[q], c[p]))
            p, q = p[o], q[o]
            new = np.append(True, (c[p][1:] != c[p][:-1]) | (c[q][1:] != c[q][:-1]))[: len(p)]
            p, q = p[new], q[new]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (c[p], c[q], r[p], r[q])], names=["a", "b", "ra", "rb"])

        if reach:
            for k in range(1, min(reach, len(s) - 1) + 1):
                ok = (s[k:] == s[:-k]) & (r[k:] != r[:-k])
                if not ok.any():
                    break
                ok &= fits(n[k:], i[k:], n[:-k], i[:-k])
                at = np.flatnonzero(ok)
                held.append(np.stack([at, at + k]))
                rows += len(at)
                if rows > MOST_HELD:
                    yield batch()
                    held, rows = [], 0
        else:
            ends = np.append(np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])), len(s)) if len(s) else np.zeros(1, dtype=np.int64)
            for a, z in zip(ends[:-1], ends[1:], strict=True):
                for lo in range(a, z, block):  # sizes are sorted: partners of a block end where they are too large
                    hi = min(lo + block, z)
                    last = lo + int(np.searchsorted(n[lo:z], t[1] * n[hi - 1] // t[0], side="right"))
                    x, y = np.arange(lo, hi)[:, None], np.arange(lo, last)[None, :]
                    p, q = np.nonzero((x < y) & (r[x] != r[y]) & ((side[x] != side[y]) | (side[x] == 0)) & fits(n[x], i[x], n[y], i[y]))
                    if len(p):
                        held.append(np.stack([lo + p, lo + q]))
                        rows += len(p)
                        if rows > MOST_HELD:
                            yield batch()
                            held, rows = [], 0
        if held:
            yield batch()

    return _by_list(solve)


def _mixed(rows: DataFrame, list_rows: int) -> DataFrame:
    """The rows of lists whose members differ in root, with the number of parts that a long list is cut into."""
    lists = rows.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members")).where("lo < hi")
    return rows.drop("parts").join(lists.select("s", F.ceil(F.col("members") / list_rows).cast("int").alias("parts")), "s")


def _dealt(rows: DataFrame, reach: int) -> DataFrame:
    """Rows with the list that a task gets whole: a part of a long one if reach; else two parts of it or one, so every two parts meet once."""
    part = F.pmod(F.xxhash64("s", "cid"), F.col("parts")).cast("int")
    if reach:
        return rows.select(F.when(F.col("parts") > 1, F.xxhash64("s", part)).otherwise(F.col("s")).alias("list"), "cid", "n_shingles", "place", "root", F.lit(0).alias("side"))
    one = rows.where("parts = 1").select(F.col("s").alias("list"), "cid", "n_shingles", "place", "root", F.lit(0).alias("side"))
    long = rows.where("parts > 1").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
    return one.unionByName(long.select(F.xxhash64("s", F.least("part", "other"), F.greatest("part", "other")).alias("list"), "cid", "n_shingles", "place", "root", side.alias("side")))


def _verify(n: int, t: tuple[int, int]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            right = b.column(3)
            for row, rows, data, offsets in W.chunks(b.column(2)):
                doc, g = _sets(W.words(data, offsets, W.FOLDED), n)
                size = np.bincount(doc, minlength=rows)
                both = np.zeros(rows, dtype=np.int64)
                for r2, k, data2, offsets2 in W.chunks(right.slice(row, rows)):
                    doc2, g2 = _sets(W.words(data2, offsets2, W.FOLDED), n)
                    doc2 = doc2 + r2
                    size[r2 : r2 + k] += np.bincount(doc2 - r2, minlength=k)
                    part = slice(*np.searchsorted(doc, [r2, r2 + k]))
                    d, x = np.concatenate([doc[part], doc2]), np.concatenate([g[part], g2])
                    o = np.lexsort((x, d))
                    d, x = d[o], x[o]
                    both += np.bincount(d[1:][(d[1:] == d[:-1]) & (x[1:] == x[:-1])], minlength=rows)
                ok = pa.array(np.flatnonzero((both > 0) & (t[1] * both >= t[0] * (size - both))))
                yield pa.RecordBatch.from_arrays([b.column(i).slice(row, rows).take(ok) for i in (0, 1)], names=["a", "b"])  # roots

    return each


def _verified(pairs: DataFrame, texts: DataFrame, n: int, t: tuple[int, int]) -> DataFrame:
    """Roots (a, b) of the pairs of classes that are similar enough, judged on whole texts."""
    left = pairs.join(texts.select(F.col("cid").alias("a"), F.col("_t").alias("_ta")), "a")
    both = left.join(texts.select(F.col("cid").alias("b"), F.col("_t").alias("_tb")), "b")
    return both.select("ra", "rb", "_ta", "_tb").mapInArrow(lean(_verify(n, t)), "a long, b long")


def _frequency(keyed: DataFrame, n: int, often: int, most: int) -> tuple[Frequency, float, dict[int, int]]:
    """The fixed-size tables, the mean length of a rare token's list, and how many sets have each small size."""
    spark = keyed.sparkSession
    bits = min(max(int(keyed.count() / 1000).bit_length(), 6), 20)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    counted = (
        keyed.select("_t").mapInArrow(lean(_count(n, bits)), "bucket int, once binary, more binary, times binary")
        .repartition(parts, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(lean(_tables(bits, often, most)), "bucket int, shared binary, frequent binary, s1 double, s2 double, top array<long>, times array<long>")
    )
    counted = cut(counted)
    top = counted.where("bucket >= 0").select(F.explode(F.arrays_zip("top", "times")).alias("x")).select("x.top", "x.times").orderBy(F.desc("times"), "top").limit(most)
    codes = np.array([r["top"] for r in top.collect()], dtype=np.int64)
    rows = counted.where("bucket >= 0").select("bucket", "shared", "frequent").collect()  # two bitmaps in slices
    s1, s2 = counted.agg(F.sum("s1"), F.sum("s2")).first()
    sizes = {i: k for r in counted.where("bucket < 0").select("times").collect() for i, k in enumerate(r["times"])}
    return Frequency(rows, bits, codes), (s2 / s1 if s1 else 1.0), sizes


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: tuple[int, int] = (80, 100), often: int = 10, most: int = 50_000, reaches: tuple[int, ...] = (2, 16), list_rows: int = 4096
) -> DataFrame:
    """One row a row of docs: _d (its id), _h (its text's hash), n_shingles, class_id, component_id (the least id that links reach), group_id (a class that names the component, also without ids)."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.coalesce(whole_id(docs, id_col), F.lit((1 << 63) - 1)).alias("_d"), F.xxhash64(text).alias("_h"), text.alias("_t"))

    with scratch(spark):
        known, mean, sizes = _frequency(keyed, n, often, most)
        shared = spark.sparkContext.broadcast(known)
        light = boundary(sizes, mean, threshold)

        signed = cut(keyed.mapInArrow(lean(_signatures(n, threshold, light, shared)), "_d long, _h long, k1 long, k2 long, n_shingles long, signatures array<long>, places array<int>"))
        classes = cut(
            signed.groupBy("k1", "k2", "n_shingles").agg(F.min(F.struct("_d", "_h")).alias("rep"))
            .select("k1", "k2", "n_shingles", "rep._d", "rep._h", F.monotonically_increasing_id().alias("cid"))
        )
        sets = signed.where(F.size("signatures") > 0).join(classes.select("k1", "k2", "_d", "_h", "cid"), ["k1", "k2", "_d", "_h"])
        rows = sets.select("cid", "n_shingles", F.explode(F.arrays_zip("signatures", "places")).alias("x"))
        rows = cut(_mixed(rows.select(F.col("x.signatures").alias("s"), "cid", "n_shingles", F.col("x.places").alias("place"), F.col("cid").alias("root")), list_rows))
        need = rows.select("cid").distinct().join(classes, "cid").select("cid", F.col("_d").alias("_rd"), F.col("_h").alias("_rh"))
        texts = cut(keyed.join(need, (F.col("_d") == F.col("_rd")) & (F.col("_h") == F.col("_rh"))).select("cid", "_t").dropDuplicates(["cid"]))
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        named = classes.select("k1", "k2", "_d", "cid", F.col("cid").alias("root"))
        tested = None
        for reach in (*reaches, 0):
            dealt = _dealt(rows if reach else _mixed(rows, list_rows), reach)
            found = dealt.repartition(parts, "list").sortWithinPartitions("list").mapInArrow(lean(_pairs(threshold, reach)), "a long, b long, ra long, rb long").distinct()
            if tested is not None:
                found = found.join(tested, ["a", "b"], "left_anti")
            found = cut(found)
            tested = found.select("a", "b") if tested is None else tested.unionByName(found.select("a", "b"))
            labels = settled(cut(_verified(found, texts, n, threshold).distinct()))
            if labels is not None:
                rows, named = followed(rows, "root", labels), followed(named, "root", labels)
        named = cut(named, keep=True)
        own = cut(signed.select("_d", "_h", "k1", "k2", "n_shingles"), keep=True)

    least = named.groupBy("root").agg(F.min("_d").alias("component_id"))
    named = named.join(least, "root").select("k1", "k2", "cid", "root", "component_id")
    alone = F.col("n_shingles") == 0
    out = own.join(named, ["k1", "k2"])
    null_id = lambda c: F.when(F.col(c) != (1 << 63) - 1, F.col(c))
    return out.select(
        null_id("_d").alias("_d"), "_h", "n_shingles", F.col("cid").alias("class_id"),
        F.when(alone, null_id("_d")).otherwise(null_id("component_id")).alias("component_id"), F.col("root").alias("group_id"),
    )
