"""Benchmark passages in documents: a prefix-filtered join of shingles, checked over windows.

Words are maximal runs of 0-9, a-z and characters from U+0080 on, after A-Z is lower-cased.  An item's
windows are its runs of ``window`` consecutive words; an item of fewer words, but not none, is one window.
A window of k shingles (runs of SHINGLE words, or the whole of a shorter window) stands in a document where at
least m = ceil(containment * k) of its shingles have their place; at containment 1 that is the window itself.

* Shingles are ordered by how often all documents hold them.  Wherever a window stands, one of its k - m + 1
  rarest shingles stands too, so only those, its prefix, are joined with the documents' shingles.
* A meeting tells where the window would begin; positions before the text's first word and windows
  that reach beyond its last are dropped.
* What is left is compared word by word over the window's whole length.  Words are compared as 64-bit
  hashes; a false window needs collisions of all words that count.

The windows go to the tasks in blocks of at most BLOCK rows (some 60 MB), whatever the size of the benchmark.  With one
block every document is answered where it is read, without a shuffle.  With several, each block gives
spans and items of the texts that it meets, which are merged by the text's digest.

Defined results: null texts have no words; items without words have no windows; repeated documents get equal
answers; several texts of one item_id are one item; the windows of an item of null item_id are hit, but it is not
counted or listed; empty tables and other columns are fine.  The order of item ids is that of strings.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkernel as K
from graphloom.llm.scratch import Scratch

SHINGLE = 3
#: Rows of (window, item) that go to the tasks at once.
BLOCK = 200_000
#: Meetings of a prefix shingle that are compared at once.
MEETINGS = 1 << 19
_FILTER_BITS = 22

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True

_ANSWER = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_PARTIAL = "digest string, n_words long, hits array<long>, items array<string>"


def _window_rows(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.byte_view(batch.column(1))
            hashes, _, _, first = K.words_of(data, offsets, _INSIDE)
            ids = batch.column(0).to_pylist()
            rows: dict[str, list] = {"item_id": [], "words": []}
            for i, name in enumerate(ids):
                own = hashes[first[i] : first[i + 1]].view(np.int64).tolist()
                for a in range(max(1, len(own) - window + 1) if own else 0):
                    rows["item_id"].append(name)
                    rows["words"].append(own[a : a + window])
            yield pa.RecordBatch.from_arrays([pa.array(rows["item_id"], pa.string()), pa.array(rows["words"], pa.list_(pa.int64()))], names=["item_id", "words"])

    return run


@dataclass
class Index:
    """Windows of one block, their prefix shingles and the items that hold them."""

    words: np.ndarray  # (windows, longest) word hashes
    length: np.ndarray
    need: np.ndarray  # shingles that must have their place
    shingle: np.ndarray  # words in a shingle of each window
    keys: np.ndarray  # prefix shingles, sorted
    window: np.ndarray  # of each key
    offset: np.ndarray  # of each key in its window
    first: np.ndarray  # items of each window, with an end
    item: np.ndarray
    names: list[str]  # of items, sorted

    @property
    def widths(self) -> list[int]:
        return sorted(set(self.shingle.tolist()))


def _shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Of each run of ``width`` columns; equal to those of texts."""
    n = words.shape[1] - width + 1
    out = np.zeros((len(words), n), np.uint64)
    for j in range(width):
        out += words[:, j : j + n] * K._MUL[j]
    return K.mix(out)


def _of_windows(words: np.ndarray, length: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, window, offset) of every shingle of every window."""
    parts = []
    for width in np.unique(shingle):
        own = np.flatnonzero(shingle == width)
        h = _shingle_hashes(words[own], int(width))
        row, col = np.nonzero(np.arange(h.shape[1]) <= (length[own] - width)[:, None])
        parts.append((h[row, col], own[row], col))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _prepare(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Distinct windows (words, length, shingle) and their items (first, item, names)."""
    lists = rows["words"].to_pylist()
    known: dict[tuple, int] = {}
    at = [known.setdefault(tuple(x), len(known)) for x in lists]
    length = np.array([len(x) for x in known], np.int64)
    words = np.zeros((len(known), int(length.max(initial=1))), np.uint64)
    for i, x in enumerate(known):
        words[i, : len(x)] = np.array(x, np.int64).view(np.uint64)
    items = rows["item_id"].to_pylist()
    names = sorted({x for x in items if x is not None})
    rank = {x: i for i, x in enumerate(names)}
    pairs = sorted({(w, rank[x]) for w, x in zip(at, items, strict=True) if x is not None})
    first = np.searchsorted([w for w, _ in pairs], np.arange(len(known) + 1))
    return words, length, np.minimum(length, SHINGLE), first, np.array([i for _, i in pairs], np.int64), names


def _filter(keys: np.ndarray) -> np.ndarray:
    flags = np.zeros(1 << _FILTER_BITS, bool)
    flags[keys & np.uint64((1 << _FILTER_BITS) - 1)] = True
    return flags


def _meetings(hashes: np.ndarray, first: np.ndarray, widths: list[int], flags: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word index, first key, end of keys) of the texts' shingles that are keys."""
    for width in widths:
        at, value = K.windows(hashes, first, width)
        maybe = np.flatnonzero(flags[value & np.uint64((1 << _FILTER_BITS) - 1)])
        at, value = at[maybe], value[maybe]
        low, high = np.searchsorted(keys, value), np.searchsorted(keys, value, "right")
        some = np.flatnonzero(high > low)
        yield at[some], low[some], high[some]


def _counter(keys: np.ndarray, widths: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How often the texts hold each of these shingles; rows of (place, n) a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, total = _filter(keys), np.zeros(len(keys), np.int64)
        for batch in batches:
            data, offsets = K.byte_view(batch.column(0))
            for _, _, part, offs in K.blocks(data, offsets):
                hashes, _, _, first = K.words_of(part, offs, _INSIDE)
                for _, low, _ in _meetings(hashes, first, widths, flags, keys):
                    total += np.bincount(low, minlength=len(keys))
            K.tidy()
        some = np.flatnonzero(total)
        for i in range(0, len(some), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 100_000]), pa.array(total[some[i : i + 100_000]])], names=["place", "n"])

    return run


def build_index(rows: pa.Table, texts: DataFrame, containment: float) -> Index:
    """The index of one block of windows; the documents tell which shingles are rare."""
    words, length, shingle, first, item, names = _prepare(rows)
    value, window, offset = _of_windows(words, length, shingle)
    keys, place = np.unique(value, return_inverse=True)
    often = np.zeros(len(keys), np.int64)
    if len(keys):
        counted = texts.mapInArrow(_counter(keys, sorted(set(shingle.tolist()))), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
        often[counted["place"].to_numpy()] = counted["n"].to_numpy()
    k = length - shingle + 1
    need = np.maximum(1, np.ceil(k * containment - 1e-9).astype(np.int64))
    order = np.lexsort((offset, often[place], window))
    begin = np.searchsorted(window[order], np.arange(len(length)))
    prefix = order[np.arange(len(order)) - begin[window[order]] < (k - need + 1)[window[order]]]
    prefix = prefix[np.argsort(value[prefix], kind="stable")]
    return Index(words, length, need, shingle, value[prefix], window[prefix], offset[prefix], first, item, names)


def _found(index: Index, flags: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every window that stands in a block of texts."""
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    wide = np.arange(index.words.shape[1])
    for at, low, high in _meetings(hashes, first, index.widths, flags, index.keys):
        ends = np.cumsum(high - low)
        for begin in range(0, int(ends[-1]) if len(ends) else 0, MEETINGS):
            nth = np.arange(begin, min(begin + MEETINGS, int(ends[-1])))
            meeting = np.searchsorted(ends, nth, "right")
            key = low[meeting] + nth - (ends[meeting] - (high - low)[meeting])
            window, start = index.window[key], at[meeting] - index.offset[key]
            text = np.searchsorted(first, at[meeting], "right") - 1
            fits = (start >= first[text]) & (start + index.length[window] <= first[text + 1])
            window, start = window[fits], start[fits]
            length = index.length[window][:, None]
            same = (hashes[np.minimum(start[:, None] + wide, len(hashes) - 1)] == index.words[window]) & (wide < length)
            whole, shingle = same.copy(), index.shingle[window][:, None]
            for j in range(1, SHINGLE):
                later = np.zeros_like(same)
                later[:, : same.shape[1] - j] = same[:, j:]
                whole &= later | (shingle <= j)
            stands = np.flatnonzero(whole.sum(axis=1) >= index.need[window])
            out.append((start[stands], window[stands]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _block_hits(index: Index, flags: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each text with an end, hit words as flags, texts and items of the pairs that meet)."""
    hashes, _, _, first = K.words_of(data, offsets, _INSIDE)
    start, window = _found(index, flags, hashes, first)
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + index.length[window], -1)
    text = np.searchsorted(first, start, "right") - 1
    pairs = np.unique(text * (len(index.length) + 1) + window)
    text, window = pairs // (len(index.length) + 1), pairs % (len(index.length) + 1)
    size = index.first[window + 1] - index.first[window]
    item = index.item[np.repeat(index.first[window] - np.cumsum(size) + size, size) + np.arange(size.sum())]
    held = np.unique(np.repeat(text, size) * (len(index.names) + 1) + item)
    return first, np.cumsum(edge[:-1]) > 0, held // (len(index.names) + 1), held % (len(index.names) + 1)


def _joined(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def _answers(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    none = _joined([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = _filter(index.keys)
        for batch in batches:
            data, offsets = K.byte_view(batch.column(1))
            for i, j, part, offs in K.blocks(data, offsets):
                first, hit, text, item = _block_hits(index, flags, part, offs)
                total = np.concatenate(([0], np.cumsum(hit)))
                n_hit = total[first[1:]] - total[first[:-1]]
                begin = np.searchsorted(text, np.arange(j - i + 1))
                digest = [_joined([index.names[x] for x in item[a:b]]) if b > a else none for a, b in zip(begin[:-1], begin[1:], strict=True)]
                columns = [pa.array(np.diff(first)), pa.array(n_hit), pa.array(np.diff(begin)), pa.array(digest, pa.string()), pa.array(n_hit > 0)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
            K.tidy()

    return run


def _partials(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What one of several blocks finds: hit words as numbers from the text's first, and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = _filter(index.keys)
        for batch in batches:
            data, offsets = K.byte_view(batch.column(1))
            for i, j, part, offs in K.blocks(data, offsets):
                first, hit, text, item = _block_hits(index, flags, part, offs)
                rows = []
                for t in range(j - i):
                    where = np.flatnonzero(hit[first[t] : first[t + 1]])
                    if len(where):
                        a, b = np.searchsorted(text, (t, t + 1))
                        rows.append((batch.column(0)[i + t].as_py(), int(first[t + 1] - first[t]), where.tolist(), [index.names[x] for x in item[a:b]]))
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["digest", "n_words", "hits", "items"])
            K.tidy()

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.byte_view(batch.column(2))
        for i, j, part, offs in K.blocks(data, offsets):
            first = K.words_of(part, offs, _INSIDE)[3]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(first))], names=["doc_id", "digest", "n_words"])


def _digest():
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)


def contaminated(docs: DataFrame, items: DataFrame, window: int = 10, containment: float = 1.0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``; see the module."""
    if window < 1 or not 0 < containment <= 1:
        raise ValueError("a window needs a word at least, and containment lies above 0 and up to 1")
    scratch = Scratch(docs.sparkSession, "decontamination")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = items.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text).alias("text"))
    held = scratch.save(held.mapInArrow(_window_rows(window), "item_id string, words array<long>").distinct(), "windows")
    blocks = max(1, math.ceil(held.count() / block))
    # A hash deals rows about evenly; the bound of a block is a mean.
    dealt = held.withColumn("block", F.pmod(F.xxhash64("words", "item_id"), F.lit(blocks)))
    texts = rows.select("text")
    if blocks == 1:
        return rows.mapInArrow(_answers(build_index(held.toArrow(), texts, containment)), _ANSWER)
    keyed, parts = rows.select(_digest().alias("digest"), "text"), []
    for i in range(blocks):
        index = build_index(dealt.filter(F.col("block") == i).select("item_id", "words").toArrow(), texts, containment)
        parts.append(scratch.save(keyed.mapInArrow(_partials(index), _PARTIAL).dropDuplicates(["digest"]), f"found-{i}"))
    found = scratch.spark.read.parquet(*[scratch.path(f"found-{i}") for i in range(blocks)])
    hits = found.select("digest", F.explode("hits").alias("h")).distinct().groupBy("digest").agg(F.count("*").alias("n_hit"))
    named = found.select("digest", F.explode_outer("items").alias("i")).groupBy("digest").agg(F.array_sort(F.collect_set("i")).alias("items"))
    hits = hits.join(named, "digest").select("digest", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    own = rows.select("doc_id", _digest().alias("digest"), "text").mapInArrow(_lengths, "doc_id long, digest string, n_words long")
    out, zero = own.join(hits, "digest", "left"), F.lit(0).cast("long")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.lit(_joined([]))).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
