"""Problem 6: encode every text with a public byte-level BPE tokenizer.

Texts of an Arrow batch are one array of code points. A table gives each its class; every class is
a transition function between the states of a small automaton that recognises the tokenizer's
word pattern. Composition of these functions is associative: fixed-length blocks are composed side
by side, a scan over the blocks gives the state at each block's start, and a second pass marks
where words begin. No regular expression runs. The words then go through byte-pair merging once
per distinct word (bounded cache); the offset of every token is kept on request, for decoding.

Defined results: null and empty texts have the empty list; texts are taken whole, whatever their
length; no text is a special token. Other columns of the input aren't read.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lakeloom.functions.runtime import spread

#: Where the public vocabularies lie.
TOKENIZERS = os.environ.get("LAKELOOM_TOKENIZERS", "/opt/tokenizers")

# --- words: classes, states, transitions ----------------------------------------------------------

#: Classes of code points: letters, numbers, others; white space that only stands (STAY) or is a
#: space that belongs to the word after it (JOIN); an apostrophe before a one- or two-letter ending.
LETTER, NUMBER, OTHER, STAY, JOIN, APOS1, APOS2 = range(7)
#: States: no word open; in a run of letters, numbers, others; after a joining space; within the
#: letters of an ending, with one or two to come.
FREE, IN_L, IN_N, IN_O, JOINED, END1, END2 = range(7)
_STATES = 7
#: The endings that stand apart after an apostrophe.
ENDINGS1, ENDINGS2 = "stmd", ("re", "ve", "ll")

#: NEXT[class, state] and BEGINS[class, state]: whether a word begins at a code point of class.
NEXT = np.zeros((7, _STATES), np.uint8)
BEGINS = np.ones((7, _STATES), bool)
for _c, _run in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O)):
    NEXT[_c] = _run
    BEGINS[_c, [_run, JOINED]] = False
NEXT[LETTER, [END1, END2]] = FREE, END1
BEGINS[LETTER, [END1, END2]] = False
NEXT[STAY], NEXT[JOIN] = FREE, JOINED
for _c, _end in ((APOS1, END1), (APOS2, END2)):
    NEXT[_c] = _end  # an ending only where a word begins; within a run of others it is one of them
    NEXT[_c, [IN_O, JOINED]] = IN_O
    BEGINS[_c, [IN_O, JOINED]] = False


@functools.cache
def class_table() -> np.ndarray:
    """Class of each code point before its neighbours are looked at; white space is STAY."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))
        if kind[0] == "L":
            table[cp] = LETTER
        elif kind[0] == "N":
            table[cp] = NUMBER
    # fixed values: the white space of the tokenizer's pattern
    table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = STAY
    return table


def word_starts(cps: np.ndarray, text_starts: np.ndarray, block: int = 512) -> np.ndarray:
    """For the code points of many texts end to end, whether a word begins at each."""
    n = len(cps)
    if not n:
        return np.zeros(0, bool)
    cls = class_table()[cps]
    first = np.zeros(n + 1, bool)
    first[text_starts[text_starts < n]] = True
    first[n] = True
    space = cls == STAY
    # a white-space run gives up its last character to what follows it in the same text
    after = np.r_[space[1:], False] | first[1:]
    lone_last = space & ~after
    follows = np.r_[False, space[:-1]] & ~first[:-1]
    cls[lone_last & (cps == 0x20)] = JOIN
    apos = np.flatnonzero(cps == 0x27)
    if len(apos):
        same1 = ~first[np.minimum(apos + 1, n)]
        one = np.where(same1, cps[np.minimum(apos + 1, n - 1)], 0)
        same2 = same1 & ~first[np.minimum(apos + 2, n)]
        two = np.where(same2, cps[np.minimum(apos + 2, n - 1)], 0)
        cls[apos[np.isin(one, [ord(c) for c in ENDINGS1])]] = APOS1
        for e in ENDINGS2:
            cls[apos[(one == ord(e[0])) & (two == ord(e[1]))]] = APOS2
    states = _scan_states(cls, np.flatnonzero(first[:-1]), block)
    begins = BEGINS[cls, states]
    begins[space] = (~follows | lone_last)[space]
    begins[first[:-1]] = True
    return begins


def _scan_states(cls: np.ndarray, resets: np.ndarray, block: int) -> np.ndarray:
    """The state before each code point; a text begins in FREE, whatever came before it."""
    n = len(cls)
    rows = -(-n // block)
    padded = np.full(rows * block, STAY, np.uint8)
    padded[:n] = cls
    reset = np.zeros(rows * block, bool)
    reset[resets] = True
    grid, reset = np.ascontiguousarray(padded.reshape(rows, block).T), np.ascontiguousarray(reset.reshape(rows, block).T)
    # compose each block's functions, all blocks side by side
    f = np.tile(np.arange(_STATES, dtype=np.uint8), (rows, 1))
    for k in range(block):
        if reset[k].any():
            f[reset[k]] = FREE
        f = NEXT[grid[k][:, None], f]
    # scan over the blocks: compose neighbours at doubled distances
    step = 1
    while step < rows:
        f[step:] = np.take_along_axis(f[step:], f[:-step].copy(), axis=1)
        step *= 2
    state = np.r_[np.uint8(FREE), f[:-1, FREE]]
    out = np.empty((block, rows), np.uint8)
    for k in range(block):
        state = np.where(reset[k], np.uint8(FREE), state)
        out[k] = state
        state = NEXT[grid[k], state]
    return out.T.reshape(-1)[:n]


# --- merging --------------------------------------------------------------------------------------


class Merger:
    """Byte-pair merging by rank, once per distinct word."""

    #: Distinct words kept per task, and the length up to which a word is kept: sizes of memory only.
    KEEP, KEEP_BYTES = 400_000, 64

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.cache: dict[bytes, list[int]] = {}

    def ids(self, word: bytes) -> list[int]:
        found = self.cache.get(word)
        if found is None:
            whole = self.ranks.get(word)
            found = [whole] if whole is not None else self._merge(word)
            if len(word) <= self.KEEP_BYTES:
                if len(self.cache) >= self.KEEP:
                    self.cache.clear()
                self.cache[word] = found
        return found

    def _merge(self, word: bytes) -> list[int]:
        """Merge the leftmost pair of the lowest rank until no pair has one: O(n log n)."""
        ranks, n = self.ranks, len(word)
        end = list(range(1, n + 1))  # end of the part that begins at i; 0 once it has been merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two parts isn't there any more
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            h = before[i]
            if h >= 0 and (r := ranks.get(word[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out


@functools.lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    return Merger(path)


# --- Arrow ----------------------------------------------------------------------------------------

#: Bytes of text taken through the arrays at once; texts stay whole.
BATCH_BYTES = 4_000_000


def _runs(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(ends):
        begin = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, begin + BATCH_BYTES, side="right")))
        yield at, to
        at = to


def encode_texts(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, tokens of each text, bytes of each token) of the texts, by byte offsets of words."""
    ids_of, ranks_cache = merger(path).ids, merger(path).cache
    raw = [t.encode("utf-8") if t else b"" for t in texts]
    ends = np.cumsum([len(b) for b in raw]) if raw else np.zeros(0, np.int64)
    all_ids: list[int] = []
    per_text = np.zeros(len(raw), np.int64)
    for at, to in _runs(np.zeros(0), ends):
        data = b"".join(raw[at:to])
        if not data:
            continue
        byte = np.frombuffer(data, np.uint8)
        lead = np.flatnonzero((byte & 0xC0) != 0x80)  # byte offset of each code point
        cps = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        own_ends = ends[at:to] - (ends[at - 1] if at else 0)
        own_starts = np.r_[0, own_ends[:-1]]
        text_starts = np.searchsorted(lead, own_starts)
        starts = lead[word_starts(cps, text_starts)]
        bounds = [*starts.tolist(), len(data)]
        get = ranks_cache.get
        lens = []
        for a, b in zip(bounds, bounds[1:]):
            word = data[a:b]
            got = get(word)
            if got is None:
                got = ids_of(word)
            all_ids += got
            lens.append(len(got))
        cum = np.r_[0, np.cumsum(lens)]
        per_text[at:to] = cum[np.searchsorted(starts, own_ends)] - cum[np.searchsorted(starts, own_starts)]
    return np.array(all_ids, np.int32), per_text, ends


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return f"{folder}/{name}.tiktoken"


def token_ids(text: Column | str, path: str | None = None) -> Column:
    """The ids of a text as an array of integers."""
    path = path or vocabulary()

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def encode(col: pa.Array) -> pa.Array:
        ids, per_text, _ = encode_texts(col.to_pylist(), path)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_text)].astype(np.int32)), pa.array(ids))

    return encode(F.col(text) if isinstance(text, str) else text)


def token_count(text: Column | str, path: str | None = None) -> Column:
    """The number of ids of a text."""
    path = path or vocabulary()

    @F.arrow_udf(T.LongType())
    def count(col: pa.Array) -> pa.Array:
        return pa.array(encode_texts(col.to_pylist(), path)[1])

    return count(F.col(text) if isinstance(text, str) else text)


def token_bytes(path: str | None = None) -> list[bytes]:
    """The bytes of each id: their concatenation over a text's ids is its UTF-8 form, and running
    sums of their lengths are the tokens' offsets."""
    ranks = merger(path or vocabulary()).ranks
    out = [b""] * (max(ranks.values()) + 1)
    for b, r in ranks.items():
        out[r] = b
    return out


@functools.lru_cache(maxsize=4)
def _token_sizes(path: str) -> np.ndarray:
    return np.array([len(b) for b in token_bytes(path)], np.int64)


def with_offsets(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, ends): the tokens of each text and the byte offset at which each ends, from the same
    pass over the text's words."""
    path = path or vocabulary()
    ints = T.ArrayType(T.IntegerType(), False)

    @F.arrow_udf(T.StructType([T.StructField("ids", ints, False), T.StructField("ends", ints, False)]))
    def encode(col: pa.Array) -> pa.Array:
        ids, per_text, _ = encode_texts(col.to_pylist(), path)
        offsets = np.r_[0, np.cumsum(per_text)]
        total = np.r_[0, np.cumsum(_token_sizes(path)[ids])]
        ends = total[1:] - np.repeat(total[offsets[:-1]], per_text)
        lists = pa.array(offsets.astype(np.int32))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(lists, pa.array(ids)), pa.ListArray.from_arrays(lists, pa.array(ends.astype(np.int32)))], ["ids", "ends"])

    return documents.select("doc_id", encode(F.col("text")).alias("t")).select("doc_id", "t.ids", "t.ends")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")).select("doc_id", token_ids("text").alias("ids"))


def p6_offsets(spark: SparkSession, d: str) -> DataFrame:
    return with_offsets(spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")))


QUERIES = {"p6_ids": p6_ids, "p6_offsets": p6_offsets}
SQL: dict[str, str] = {}
