"""Token counts with a whole-token shortcut.

Offline, for every string of the vocabulary that can be a pre-token, the merges are run once: those that end as one
token are whole, and no merge is run for them again. A text is normalized and split as its tokenizer does it; whole
pre-tokens count one, the rest is merged, and the counts of frequent ones are kept in a bounded table.

``.json`` (tokenizers): texts of ASCII and Latin letters take an equal normalization and splitting in Python if the
file has the pattern known here, others the library's own steps; a text with a special string is encoded by the
library. ``.tiktoken`` (ranks) is split by the pattern given. ``.model`` (sentencepiece) has no pre-tokens and is
encoded by its library.

The file is read by the driver and broadcast, so executors need not have it; its size is that of a vocabulary.

Cases: null text counts as empty: 0 bytes, 0 tokens. Every row is counted by itself; other columns are carried.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._run import Carried, ship

#: Fixed: the split pattern of the known file, and the same on lower-case text of ASCII and Latin up to U+017E.
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ž]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ž0-9²³¹¼½¾]+")
#: What LATIN and str.lower() are not known to treat as the library does.
BEYOND_LATIN = re.compile("[^\t\n\x0b\x0c\r -~¡-¬®-įı-ž]")
MOST_KEPT = 500_000


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next free one from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Counts(dict):
    """Tokens of a pre-token; what isn't known is merged and kept."""

    def __init__(self, whole: dict, merge: Callable):
        super().__init__(whole)
        self.whole, self.merge = whole, merge

    def __missing__(self, piece) -> int:
        if len(self) > len(self.whole) + MOST_KEPT:
            self.clear()
            self.update(self.whole)
        self[piece] = n = self.merge(piece)
        return n


def _json_counter(content: str, whole: list[str]) -> Callable[[str], int]:
    from tokenizers import Tokenizer

    t, spec = Tokenizer.from_str(content), json.loads(content)
    t.no_truncation()
    t.no_padding()
    stand_in = byte_alphabet()
    counts = Counts(dict.fromkeys(whole, 1), lambda p: len(t.model.tokenize(p)))
    latin = Counts({}, lambda p: counts["".join(map(stand_in.__getitem__, p.encode()))])
    special = [a["content"] for a in spec.get("added_tokens") or []]
    special = re.compile("|".join(map(re.escape, special))) if special else None
    known = _known(spec)

    def count(text: str) -> int:
        if special and special.search(text):
            return len(t.encode(text, add_special_tokens=False).ids)
        if known and not BEYOND_LATIN.search(text):
            return sum(map(latin.__getitem__, LATIN.findall(text.lower())))
        if t.normalizer:
            text = t.normalizer.normalize_str(text)
        if t.pre_tokenizer is None:
            return counts[text] if text else 0
        return sum(counts[p] for p, _ in t.pre_tokenizer.pre_tokenize_str(text))

    return count


def _known(spec: dict) -> bool:
    """Whether the file normalizes and splits as LATIN stands for."""
    steps = [(n["type"], n.get("pattern"), n.get("content")) for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        steps == [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]
        and [p["type"] for p in pre] == ["Split", "ByteLevel"]
        and pre[0].get("pattern") == {"Regex": KNOWN_PATTERN} and pre[0].get("behavior") == "Removed" and pre[0].get("invert") is True
        and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex", True)
    )


def whole_tokens(content: str) -> list[str]:
    """The vocabulary's pre-tokens that merge to one token when they stand alone, proved by merging each."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(content)
    model = json.loads(content)["model"]
    end = model.get("end_of_word_suffix") or ""
    found = []
    for s, i in model["vocab"].items():
        if s.endswith(end) and len(s) > len(end):
            piece = s[: len(s) - len(end)]
            got = t.model.tokenize(piece)
            if len(got) == 1 and got[0].id == i:
                found.append(piece)
    return found


def _ranks(content: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.split("\n") if line.strip())}


def _rank_counter(content: str, pattern: str) -> Callable[[str], int]:
    import regex
    import tiktoken

    ranks = _ranks(content)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    counts = Counts({}, lambda p: 1 if p.encode("utf-8", "surrogatepass") in ranks and len(own.encode_ordinary(p)) == 1 else len(own.encode_ordinary(p)))
    split = regex.compile(pattern)
    return lambda text: sum(map(counts.__getitem__, split.findall(text)))


def _piece_counter(content: bytes) -> Callable[[str], int]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=content)
    return lambda text: len(model.encode(text, num_threads=1))


def counter(kind: str, content, extra) -> Callable[[str], int]:
    """A function text -> tokens for a file's kind and content; extra: the whole tokens of .json, the pattern of .tiktoken."""
    if kind == "json":
        return _json_counter(content, extra)
    return _rank_counter(content, extra) if kind == "tiktoken" else _piece_counter(content)


def _count(shared):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(*shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [x or "" for x in part.column(0).to_pylist()]
                n_bytes = pa.array([len(x.encode()) for x in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(1), n_bytes, pa.array([count(x) for x in texts], pa.int64())], names=["_row", "n_bytes", "n_tokens"])

    return each


def token_counts(docs: DataFrame, path: str, text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """docs' columns but the text, with n_bytes (of UTF-8) and n_tokens. path: a .json, .tiktoken (with its pattern) or .model file."""
    spark = docs.sparkSession
    ship(spark)
    kind = path.rsplit(".", 1)[-1]
    with open(path, "rb") as f:
        content = f.read()
    if kind == "json":
        content = content.decode()
        extra = whole_tokens(content)
    elif kind == "tiktoken":
        content, extra = content.decode(), pattern
    elif kind == "model":
        extra = None
    else:
        raise ValueError(f"not a tokenizer file: {path}")
    shared = spark.sparkContext.broadcast((kind, content, extra))
    own = Carried(docs, ("n_bytes", "n_tokens"), (text_col,))
    counted = docs.select(F.col(text_col).alias("_text"), own.packed).mapInArrow(_count(shared), own.schema(("n_bytes", "long"), ("n_tokens", "long")))
    return own.unpacked(counted, "n_bytes", "n_tokens")
