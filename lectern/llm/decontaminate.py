"""Benchmark decontamination with suffix arrays of the training documents.

Every chunk of documents (a shard that bounds memory) is sorted into a word suffix array, to ``window`` words deep.
Each suffix of every benchmark item, if the shard has its first two words side by side, is binary-searched in it, all
at once and one word deeper at a time, which gives its longest verbatim match up to that depth and the places where it
matches. A benchmark window is ``window`` consecutive words of an item; an item with fewer words, but not none, is one
window. Words of documents inside a place of a whole window are hit. Places of windows that follow each other in the
document and in the item join to a longest match; common stretches shorter than a window are none.

The items go to the executors in blocks of at most ``block_words`` words (a longer item in overlapping pieces, whose
matches come in parts), each read by its own pass over the documents, so what is broadcast is bounded whatever the
benchmark's size. Words are compared by 64-bit codes.

Cases: null texts have no words. An item without an id hits words and is in no list of items; its matches have a null
item_id. Texts of any length. Items and documents without words match nothing. Rows are judged by themselves, so
repeated rows or ids and null ids need no care. Other columns are carried. Empty tables give no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._run import Carried, cut, lean, ship

CHUNK = 3 << 19
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Targets:
    """The words of a block of items, one after another with a gap after each item; a suffix begins at each word."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.names = sorted({i for i, _ in items if i is not None})
        self.window = window
        rank = {n: k for k, n in enumerate(self.names)}
        text = pa.array([t or "" for _, t in items], pa.large_string())
        codes, pairs, sizes, whole, item, at, n = [], [], [], [], [], [], 0
        for row, rows, data, offsets in W.chunks(text):
            w = W.words(data, offsets, W.ALNUM)
            left = w.first[w.doc + 1] - np.arange(len(w.code))
            size = np.minimum(left, window)
            all_ = w.first[w.doc + 1] - w.first[w.doc]
            codes.append(w.code)
            first, pair = w.grams(2)
            two = np.zeros(len(w.code), dtype=np.uint64)
            two[first] = pair
            pairs.append(two)
            sizes.append(size)
            whole.append((size == window) | ((left == all_) & (all_ < window)))
            item.append(np.array([rank.get(items[row + r][0], -1) for r in range(rows)], dtype=np.int64)[w.doc])
            at.append(n + np.arange(len(w.code)) + w.doc)  # consecutive in an item, with a gap after it
            n += len(w.code) + rows
        self.codes, self.pairs = (np.concatenate(x) if x else np.empty(0, dtype=np.uint64) for x in (codes, pairs))
        self.sizes, self.whole, self.item, self.at = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (sizes, whole, item, at))
        self.whole = self.whole.astype(bool)

    def named(self, item: np.ndarray) -> pa.Array:
        return pa.array(self.names, pa.string()).take(pa.array(item, pa.int64(), mask=item < 0))


def suffix_array(code: np.ndarray, doc: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes; ranks of the words from 1, with 0 after each document; suffixes sorted by their first ``depth`` words."""
    known, rank = np.unique(code, return_inverse=True)
    last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) if len(doc) else np.empty(0, dtype=np.int64)
    text = np.insert(rank + 1, last + 1, 0)
    order, reach, level = text.astype(np.int64), 1, text.astype(np.int64)
    sa = None
    while reach < depth or sa is None:
        # names of `reach` words; two or more of them, as many as 62 bits hold, name a longer stretch
        bits = max(int(level.max(initial=0)).bit_length(), 1)
        many = max(2, min(62 // bits, -(-depth // reach)))
        key = level.copy()
        for j in range(1, many):
            key <<= bits
            if j * reach < len(level):
                key[: -j * reach or None] |= level[j * reach :]
        reach *= many
        sa = np.argsort(key, kind="stable")
        order = key[sa]
        level = np.empty(len(key), dtype=np.int64)
        level[sa] = np.concatenate([[0], np.cumsum(order[1:] != order[:-1])]) if len(order) else order
    return known, text, sa


def search(known: np.ndarray, text: np.ndarray, sa: np.ndarray, pairs: np.ndarray, t: Targets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each suffix of the items: the words that match, and the range of sa where so many match.

    pairs: codes of the shard's neighbouring words, sorted. A suffix whose first two words are none of them can't match a
    window and isn't searched; it counts as no match.
    """
    n = len(t.sizes)
    at = np.searchsorted(known, t.codes)
    rank = np.where(known[np.minimum(at, len(known) - 1)] == t.codes, at + 1, -1) if len(known) else np.full(n, -1)
    lo, hi, length = np.zeros(n, dtype=np.int64), np.full(n, len(sa), dtype=np.int64), np.zeros(n, dtype=np.int64)
    found = np.minimum(np.searchsorted(pairs, t.pairs), max(len(pairs) - 1, 0))
    live = np.flatnonzero((t.sizes < 2) | (pairs[found] == t.pairs if len(pairs) else False))
    padded = np.concatenate([text, np.zeros(t.window, dtype=text.dtype)])
    for j in range(t.window):
        live = live[t.sizes[live] > j]
        live = live[rank[live + j] > 0]
        if not len(live):
            break
        want, ends = rank[live + j], []
        for side in (0, 1):  # the first suffix whose word j is not less, or is more, than the wanted one
            a, z = lo[live].copy(), hi[live].copy()
            while (open_ := a < z).any():
                mid = (a + z) >> 1
                got = padded[sa[np.minimum(mid, len(sa) - 1)] + j]
                less = open_ & ((got < want) | (side == 1) & (got == want))
                z = np.where(open_ & ~less, mid, z)
                a = np.where(less, mid + 1, a)
            ends.append(a)
        some = ends[0] < ends[1]
        live = live[some]
        lo[live], hi[live] = ends[0][some], ends[1][some]
        length[live] = j + 1
    return length, lo, hi


def joined(place: np.ndarray, at: np.ndarray, doc: np.ndarray, item: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and item of the longest matches, by begin; place and at: where a window is in the documents and the items."""
    o = np.lexsort((place, place - at))
    place, at, doc, item, words = place[o], at[o], doc[o], item[o], words[o]
    new = np.ones(len(o), dtype=bool)
    new[1:] = (np.diff(place) != 1) | (np.diff(at) != 1) | (np.diff(doc) != 0)
    lo, item = place[new], item[new]
    hi = (place + words)[np.append(new[1:], True)] if len(o) else lo
    o = np.lexsort((-hi, lo, item))
    lo, hi, item = lo[o], hi[o], item[o]
    reach = np.maximum.accumulate(item * (int(hi.max(initial=0)) + 1) + hi)  # a match inside another one of its item is not a longest
    keep = np.append(True, reach[1:] > reach[:-1])[: len(o)]
    lo, hi, item = lo[keep], hi[keep], item[keep]
    o = np.lexsort((item, lo))
    return lo[o], hi[o], item[o]


def _scan(shared, mode: str, chunk: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Targets = shared.value
        for b in batches:
            for row, rows, data, offsets in W.chunks(b.column(0), chunk):
                w = W.words(data, offsets, W.ALNUM)
                known, text, sa = suffix_array(w.code, w.doc, t.window)
                length, lo, hi = search(known, text, sa, np.sort(w.grams(2)[1]), t)
                full = np.flatnonzero(t.whole & (length == t.sizes) & (length > 0))
                size = (hi - lo)[full]
                to = np.concatenate([[0], np.cumsum(size)])
                place = sa[np.repeat(lo[full] - to[:-1], size) + np.arange(to[-1])]
                place = place - (np.cumsum(text == 0)[place] if len(place) else 0)  # words alone, without the zeros
                doc, words, item = w.doc[place], np.repeat(t.sizes[full], size), np.repeat(t.item[full], size)
                rest = b.column(1).slice(row, rows)
                if mode == "places":
                    lo, hi, item = joined(place, np.repeat(t.at[full], size), doc, item, words)
                    doc = w.doc[lo]
                    begin = w.first[doc]
                    yield pa.RecordBatch.from_arrays([rest.take(pa.array(doc)), t.named(item), pa.array(lo - begin), pa.array(hi - begin)], names=["_row", "item_id", "lo", "hi"])
                    continue
                gone = np.zeros(len(w.code) + 1, dtype=np.int64)
                np.add.at(gone, place, 1)
                np.add.at(gone, place + words, -1)
                inside = np.concatenate([[0], np.cumsum(np.cumsum(gone[:-1]) > 0)])
                pairs = np.unique((doc * (len(t.names) + 1) + item)[item >= 0])
                by = np.searchsorted(pairs // (len(t.names) + 1), np.arange(rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(by.astype(np.int32)), t.named(pairs % (len(t.names) + 1)))
                yield pa.RecordBatch.from_arrays([rest, pa.array(np.diff(w.first)), pa.array(inside[w.first[1:]] - inside[w.first[:-1]]), lists], names=["_row", "n_words", "n_hit", "items"])

    return each


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items with a text, in blocks of about block_words words at most; they are read one by one, not all held.

    An item of more words comes in pieces that overlap by a window less a word, so each of its windows is in one.
    """
    held: list[tuple[str | None, str]] = []
    size = 0
    for r in benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).where(F.length(text_col) > 0).toLocalIterator():
        pieces = [r[1]]
        if len(r[1]) > 2 * block_words:  # a word and what separates it take two characters at least
            spans = [m.span() for m in WORD.finditer(r[1])]
            step = max(block_words - window + 1, 1)
            pieces = [r[1][spans[i][0] : spans[min(i + step + window - 1, len(spans)) - 1][1]] for i in range(0, max(len(spans) - window + 1, 1), step)] if spans else []
        for piece in pieces:
            n = len(piece) // 2 + 1
            if held and size + n > block_words:
                yield held
                held, size = [], 0
            held.append((r[0], piece))
            size += n
    yield held


def _passes(docs: DataFrame, benchmark: DataFrame, mode: str, fields: tuple, text_col: str, item_col: str, item_text_col: str, window: int, block_words: int, own: Carried) -> list[DataFrame]:
    spark = docs.sparkSession
    ship(spark)
    out = []
    for items in _blocks(benchmark, item_col, item_text_col, window, block_words):
        shared = spark.sparkContext.broadcast(Targets(items, window))
        found = docs.select(F.col(text_col).alias("_text"), own.packed).mapInArrow(lean(_scan(shared, mode, CHUNK)), own.schema(*fields))
        out.append(own.unpacked(found, *[n for n, _ in fields]))
    return out


PLACES = ("item_id", "string"), ("lo", "long"), ("hi", "long")
COUNTS = ("n_words", "long"), ("n_hit", "long"), ("items", "array<string>")


def longest_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = 1_000_000) -> DataFrame:
    """docs' columns but the text with item_id, lo, hi: each longest stretch of words that is verbatim in one item.

    It has a window at least, or the whole of a shorter item. A stretch inside a longer one of the same item is left
    out, and one that an item has more than once is one row.
    """
    own = Carried(docs, tuple(n for n, _ in PLACES), (text_col,))
    found = None
    for p in _passes(docs, benchmark, "places", PLACES, text_col, item_col, item_text_col, window, block_words, own):
        found = p if found is None else found.unionByName(p)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = 1_000_000) -> DataFrame:
    """docs' columns with n_words, n_hit (words inside a window's place), items (sorted ids with such a place).

    With one block of items, the usual case, this is one pass and no shuffle. With more, the places of all blocks
    are united for each document, which needs an id of the row: monotonically_increasing_id of a stable scan.
    """
    own = Carried(docs, tuple(n for n, _ in COUNTS))
    blocks = _passes(docs, benchmark, "counts", COUNTS, text_col, item_col, item_text_col, window, block_words, own)
    if len(blocks) == 1:
        return blocks[0]
    numbered = cut(docs.select(own.packed, F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_n")))
    counts = _passes(numbered, benchmark.limit(0), "counts", COUNTS, "_text", item_col, item_text_col, window, block_words, Carried(numbered, (), ("_text",)))[0]
    places = longest_matches(numbered.select("_n", "_text"), benchmark, "_text", item_col, item_text_col, window, block_words)
    runs = places.groupBy("_n").agg(F.array_sort(F.collect_set("item_id")).alias("_items"), F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("_places"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    covered = F.aggregate("_places", start, lambda a, p: F.struct((a.n + F.greatest(p.hi - F.greatest(p.lo, a.to), F.lit(0))).alias("n"), F.greatest(a.to, p.hi).alias("to")), lambda a: a.n)
    out = counts.select("_row", "_n", "n_words").join(runs.select("_n", "_items", covered.alias("_hit")), "_n", "left").select(
        "_row", "n_words", F.coalesce("_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("_items", F.array().cast("array<string>")).alias("items")
    )
    return own.unpacked(out, "n_words", "n_hit", "items")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the documents that hold a benchmark window."""
    own = Carried(docs, ())
    text = options.get("text_col", "text")
    found = contamination(docs.select(own.packed, F.col(text).alias("_text")), benchmark, **{**options, "text_col": "_text"})
    return own.unpacked(found.where("n_hit = 0"))


