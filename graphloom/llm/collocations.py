"""Collocations: phrases whose words meet more often than chance, per language.

A-Z is lower-cased; texts are cut at . , ; : ! ? and U+000A to U+000D into pieces, pieces at spaces and tabs into
words.  A candidate is a phrase of 2 to ``longest`` words within a piece that a language has ``least`` times or more.

* First pass: every task adds its phrases of 1 to ``longest`` words to a count-min sketch of two rows of
  cells.  What it has of a row goes out as sorted cells, packed by runs of cells; equal runs are added up
  on Spark, and all that is kept of the merged sketch is one bit a cell: whether it reaches ``least``.
  A cell counts all phrases that fall into it, so no frequent phrase can miss its bits.
* Second pass: only phrases whose two bits are set, and whose first and last words but one survived too,
  are counted, exactly, by their own words: in the task first, then by language and part, a part for 4 MB of text.
* Scores and subsumption are joins of the table of frequent phrases with itself, each part of a
  candidate being at least as frequent as the candidate.  Ranks come from a window in salted parts, then one over the parts' first rows.

The sketch grows with the input, a cell for 24 phrases, up to MOST_CELLS a row (two rows are 128 MB of bits for
every task).  An input of over some 20 GB of text loads the cells more, and above some 80 GB most of them are
full: results stay the same, but the sketch spares the exact aggregate less and less.

Defined results: a null language is ``und``; null texts are empty; repeated rows count again; an empty table, or one
without frequent phrases, gives an empty table; other columns are not read.  Within a block of 1 MB, two phrases of
one 64-bit hash would be taken for one (a chance of 1e-8).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm import textkernel as K
from graphloom.llm.scratch import Scratch

ROWS = 2
MOST_CELLS = 1 << 29
PHRASES_A_CELL = 24
#: Phrases that a task sorts at once, and those that it counts before it hands them on.
SORTED, COUNTED = 10_000_000, 400_000
#: Cells that are packed together, and bytes of text for a part of the exact counts.
RUN = 1 << 18
PART_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20
#: Parts in which each language is ranked first.
SALTS = 64
FEW_LANGUAGES = 10_000

_CUT = np.zeros(256, bool)
_CUT[[10, 11, 12, 13, *b".,;:!?"]] = True
_INSIDE = ~_CUT
_INSIDE[[9, 32]] = False


class Phrases:
    """Words of a block of texts, and hashes of its phrases level by level."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray):
        self.data = K._LOWER[data]
        self.hashes, self.start, self.stop, self.first = K.words_of(data, offsets, _INSIDE)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        piece = np.cumsum(_CUT[data])[self.start] if len(self.start) else np.zeros(0, np.int64)
        #: Words of one text and piece have one number.
        self.piece = piece + self.text * (int(piece[-1]) + 1 if len(piece) else 1)
        self.seed = seeds[self.text]

    def whole(self, n: int) -> np.ndarray:
        """First words of the phrases of n words."""
        if len(self.piece) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.piece[n - 1 :] == self.piece[: len(self.piece) - n + 1])

    def hash(self, at: np.ndarray, n: int) -> np.ndarray:
        out = self.seed[at] + K._MUL[14] * np.uint64(n)
        for j in range(n):
            out += self.hashes[at + j] * K._MUL[j]
        return K.mix(out)

    def strings(self, at: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The words of phrases, joined by single spaces."""
        last = at + n - 1
        size = np.concatenate(([0], np.cumsum(self.stop - self.start)))
        tabs = np.concatenate(([0], np.cumsum(self.data == 9)))
        begin, end = self.start[at], self.stop[last]
        plain = (end - begin == size[last + 1] - size[at] + n - 1) & (tabs[end] == tabs[begin])
        raw = self.data.tobytes()
        out = [raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        for i in np.flatnonzero(~plain):
            out[i] = b" ".join(w for w in out[i].replace(b"\t", b" ").split(b" ") if w)
        return out


def _cells(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    h = K.mix(h ^ K._MUL[13]) if row else h
    return (((h >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)).astype(np.uint32)


def _seeds(langs: list[str]) -> np.ndarray:
    known = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
    return np.array([known[x] for x in langs], np.uint64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], Phrases]]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        seeds = _seeds(langs)
        data, offsets = K.byte_view(batch.column(1))
        for i, j, part, offs in K.blocks(data, offsets, BLOCK_BYTES):
            yield langs[i:j], Phrases(part, offs, seeds[i:j])
        K.tidy()


def _pack(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Gaps between sorted cells and their counts, byte plane by byte plane."""
    both = np.stack((np.diff(values, prepend=np.uint32(0)), np.minimum(counts, 0xFFFFFFFF))).astype("<u4")
    return pa.compress(both.view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1).tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    gaps, counts = np.ascontiguousarray(planes.reshape(2, 4, n).transpose(0, 2, 1)).view("<u4").reshape(2, n)
    return np.cumsum(gaps, dtype=np.int64), counts


def _sketch(cells: int, longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def packed(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for row, own in enumerate(held):
            every = np.concatenate(own)
            own.clear()
            every.sort()
            edges = np.searchsorted(every, np.arange(0, cells + 1, RUN, dtype=np.int64))
            runs = np.flatnonzero(np.diff(edges)).tolist()
            parts = []
            for x in runs:
                part = every[edges[x] : edges[x + 1]]
                at = np.flatnonzero(np.diff(part, prepend=part[0] - np.uint32(1)))
                parts.append((len(at), _pack(part[at] - np.uint32(x * RUN), np.diff(np.append(at, len(part))))))
            yield pa.RecordBatch.from_arrays([pa.array([row] * len(runs), pa.int32()), pa.array(runs, pa.int32()), pa.array([n for n, _ in parts], pa.int32()), pa.array([d for _, d in parts], pa.binary())], names=["row", "run", "n", "data"])
            del every
        K.tidy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
        for _, x in _texts(batches):
            for n in range(1, longest + 1):
                h = x.hash(x.whole(n), n)
                for row in range(ROWS):
                    held[row].append(_cells(h, row, cells))
            if sum(map(len, held[0])) >= SORTED:
                yield from packed(held)
        if sum(map(len, held[0])):
            yield from packed(held)

    return run


def _merge(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of equal runs, which come one after another, as flags of the cells that reach ``least``."""
    def flags(key: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
        full = np.packbits(total >= least, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([full], pa.binary())], names=["row", "run", "full"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(RUN, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                if key != (row["row"], row["run"]):
                    if key is not None:
                        yield flags(key, total)
                    key, total[:] = (row["row"], row["run"]), 0
                cells, counts = _unpack(row["data"], row["n"])
                total[cells] += counts  # each cell is once in a run
        if key is not None:
            yield flags(key, total)

    return run


def sketch(rows: DataFrame, least: int, longest: int, cells: int) -> np.ndarray:
    """(ROWS, cells / 8) bytes: a bit for each cell of the merged sketch that reaches ``least``; cells is a multiple of RUN."""
    parts = rows.mapInArrow(_sketch(cells, longest), "row int, run int, n int, data binary").repartition("row", "run").sortWithinPartitions("row", "run")
    out = np.zeros((ROWS, cells // 8), np.uint8)
    found = parts.mapInArrow(_merge(least), "row int, run int, full binary").toArrow()
    for row, run, full in zip(found["row"].to_pylist(), found["run"].to_pylist(), found["full"], strict=True):
        out[row, run * RUN // 8 : (run + 1) * RUN // 8] = np.frombuffer(full.as_buffer(), np.uint8)
    return out


def _set(flags: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (flags[cells >> np.uint32(3)] >> (cells & np.uint32(7)).astype(np.uint8)) & np.uint8(1) > 0


def _survivors(x: Phrases, flags: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, first words, hashes) of phrases that may be frequent."""
    before: np.ndarray | None = None
    for n in range(1, longest + 1):
        at = x.whole(n)
        if before is not None:
            at = at[before[at] & before[at + 1]]
        h = x.hash(at, n)
        for row in range(ROWS):
            keep = _set(flags[row], _cells(h, row, 8 * flags.shape[1]))
            at, h = at[keep], h[keep]
        before = np.zeros(len(x.piece) + 1, bool)
        before[at] = True
        yield n, at, h


def _exact(flags: np.ndarray, longest: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of a task's survivors, packed by language and part; the empty phrase stands for the language's words."""

    def told(counts: dict[str, dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            dealt: dict[int, list[bytes]] = {}
            for phrase in own:
                dealt.setdefault(zlib.crc32(phrase) % parts, []).append(phrase)
            data = [_pack_phrases(x, [own[p] for p in x]) for x in dealt.values()]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(dealt), pa.string()), pa.array(list(dealt), pa.int32()), pa.array(data, pa.binary())], names=["lang", "part", "data"])
        counts.clear()
        K.tidy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[bytes, int]] = {}
        for langs, x in _texts(batches):
            for lang, n in zip(langs, np.diff(x.first).tolist(), strict=True):
                own = counts.setdefault(lang, {})
                own[b""] = own.get(b"", 0) + n
            found = list(_survivors(x, flags, longest))
            at = np.concatenate([a for _, a, _ in found])
            size = np.concatenate([np.full(len(a), n, np.int64) for n, a, _ in found])
            _, where, often = np.unique(np.concatenate([h for _, _, h in found]), return_index=True, return_counts=True)
            at, size = at[where], size[where]
            for t, phrase, c in zip(x.text[at].tolist(), x.strings(at, size), often.tolist(), strict=True):
                own = counts[langs[t]]
                own[phrase] = own.get(phrase, 0) + c
            if sum(map(len, counts.values())) >= COUNTED:
                yield from told(counts)
        yield from told(counts)

    return run


def _pack_phrases(phrases: list[bytes], counts: list[int]) -> bytes:
    """Phrases hold no line feed, so lines of them are followed by as many counts."""
    raw = np.array([len(phrases), *counts], "<i8").tobytes() + b"\n".join(phrases)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack_phrases(data: bytes) -> tuple[list[bytes], list[int]]:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    return raw[8 * n + 8 :].split(b"\n"), np.frombuffer(raw[8 : 8 * n + 8], "<i8").tolist()


def _add_up(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of equal phrases of a language and part, whose rows come one after another; those below ``least`` go."""

    def told(lang: str, counts: dict[bytes, int]) -> pa.RecordBatch:
        kept = [(p, n) for p, n in counts.items() if n >= least or not p]
        columns = [pa.array([lang] * len(kept), pa.string()), pa.array([p.count(b" ") + 1 if p else 0 for p, _ in kept], pa.int32()), pa.array([p for p, _ in kept], pa.binary()).cast(pa.string()), pa.array([n for _, n in kept], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "words", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, counts = None, {}
        for batch in batches:
            for lang, part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (lang, part):
                    if key is not None:
                        yield told(key[0], counts)
                    key, counts = (lang, part), {}
                for phrase, n in zip(*_unpack_phrases(data), strict=True):
                    counts[phrase] = counts.get(phrase, 0) + n
        if key is not None:
            yield told(key[0], counts)

    return run


def frequent_phrases(docs: DataFrame, scratch: Scratch, least: int = 100, longest: int = 5, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, words, phrase, n), saved: every phrase of 1 to ``longest`` words with n >= ``least``, and each language's number of words as words 0."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    asked = int(size) // 8 * longest // PHRASES_A_CELL  # eight bytes are about a word
    cells = RUN * max(1, min(MOST_CELLS, asked) // RUN)
    flags = sketch(rows, least, longest, cells)
    parts = 1 + int(size) // PART_BYTES
    counted = rows.mapInArrow(_exact(flags, longest, parts), "lang string, part int, data binary")
    counted = counted.repartition("lang", "part").sortWithinPartitions("lang", "part")
    return scratch.save(counted.mapInArrow(_add_up(least), "lang string, words int, phrase string, n long"), "frequent")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, subsume: int = 100, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's first ``top`` phrases by score: (lang, rank, phrase, a, l, r, n, score); see the module.

    The score of a cut into a first part of l and a rest of r occurrences is floor(1000 * a * n / (l * r)), n
    being the language's words; a phrase has that of its lowest cut, the earliest of equal ones.  A phrase
    goes if a longer candidate that holds it has ``subsume`` percent of its occurrences or more.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    known = frequent_phrases(docs, scratch, least, longest, lang_col, text_col)
    totals = scratch.save(known.filter("words = 0").select("lang", F.col("n").alias("total")), "totals")
    totals = F.broadcast(totals) if totals.count() <= FEW_LANGUAGES else totals
    part = known.filter("words > 0").select("lang", "phrase", "n")
    several = known.filter("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    begin = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    inner = several.filter("words > 2").select("lang", "words", "w", "a", begin.alias("size"))
    inner = inner.filter("size > 1").select("lang", "w", "a", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("i"))
    inner = inner.groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("size")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    own = several.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * subsume))

    cuts = own.select("lang", "phrase", "a", "w", "words", begin.alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("tail"))
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"]).join(totals, "lang")
    # Exact: decimals of 38 digits.
    wide = {x: F.col(x).cast("decimal(19,0)") for x in ("a", "l", "r", "total")}
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", "total", (F.lit(1000).cast("decimal(4,0)") * wide["a"] * wide["total"]).cast("decimal(38,0)").alias("x"), (wide["l"] * wide["r"]).cast("decimal(38,0)").alias("y"))
    best = cuts.select("lang", "phrase", F.struct(F.expr("x div y").alias("score"), "k", "l", "r", "a", F.col("total").alias("n")).alias("cut")).groupBy("lang", "phrase").agg(F.min("cut").alias("cut"))
    best = best.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = parts.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
