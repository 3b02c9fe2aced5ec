"""Near-duplicate documents: circulant MinHash, banding, exact check.

A document's set holds its distinct five-word shingles.  Two permutations make
all signature coordinates: the first scatters the shingles over 0..2^32-1, the
second orders them, and coordinate k uses the second shifted circularly by k.
Coordinates are cut into bands; documents that agree on a band are candidates,
and every link is confirmed on the full sets: 100 * common >= 75 * union.

How the work stays in proportion to the input:

* Documents of equal sets form one class (an aggregate by a 128-bit digest of
  the set); only its smallest id goes on.
* First each class is tried against one class of its buckets, the closest by a
  sketch of two bits per coordinate.  Components of those links fold groups of
  near copies, however large, by one check per class.
* What is left are buckets that still span several components.  Their pairs
  between different components, close by size and sketch, are checked in
  two passes: each class against the closest of one other class of each such
  bucket, picked by a hash, folding again, then all that are still apart.
  A bucket of more than CELL classes is cut into a square of cells for that, so that
  no task meets more than CELL by CELL of its pairs.
  Before the last pass the classes that still have a close partner get 3072
  coordinates of the same two permutations, as single bits, so that pairs well
  below the threshold need no check.  No partner is dropped by a cap.

Bounds of error: with 32 bands of 4, a pair at 0.75 shares no band with
probability 6e-6; the screen (at most 78 of 256 two-bit coordinates apart,
where a pair at 0.75 has 48 on average) loses one with probability 1e-6, and so
does the longer one (at most 472 of 3072 bits apart; 384 on average).

Defined results: null or blank texts have n_shingles 0 and link with nothing;
rows of a null id get a null component and are kept; repeated rows get equal
answers; of several texts under one id each goes by its own set; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkernel as K
from graphloom.llm.components import components
from graphloom.llm.scratch import Scratch, unused

BANDS, ROWS, WIDTH = 32, 4, 5
COORDINATES, SKETCH, APART = 256, 8, 78
LONG, LONG_APART = 48, 472
LAST = 2
CELL = 2000
SIMILAR = 75
#: Ids of candidates are sent to all executors up to this many (16 MB); beyond, the texts are shuffled to them.
BROADCAST_IDS = 1_000_000

_SIGNED = "doc_id long, body long, n_shingles long, fp_a long, fp_b long, sketch array<long>, bands array<long>"


def _order(x: np.ndarray) -> np.ndarray:
    """The second permutation of 0..2^32-1 (in place)."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def circulant(values: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Signature coordinates, shape (size, texts); every text must have a shingle."""
    scattered = (K.mix(values) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((size, len(first) - 1), np.uint32)
    for k in range(size):
        out[k] = np.minimum.reduceat(_order(scattered - np.uint32(k)), first[:-1])
    return out


def _sign_block(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    values, first = K.shingles(data, offsets, WIDTH)
    count = np.diff(first)
    some = np.flatnonzero(count)
    fps = np.zeros((2, len(count)), np.uint64)
    if not len(some):
        return count, fps, np.zeros((0, SKETCH), np.uint64), np.zeros((0, BANDS), np.uint64)
    starts = first[:-1][some]
    for j in range(2):
        fps[j, some] = np.add.reduceat(K.mix(values ^ K._MUL[12 + j]), starts)
    sig = circulant(values, np.append(starts, len(values)), COORDINATES)
    sketch, keys = np.zeros((len(some), SKETCH), np.uint64), np.empty((len(some), BANDS), np.uint64)
    for k in range(COORDINATES):
        sketch[:, k // 32] |= (sig[k] & np.uint32(3)).astype(np.uint64) << np.uint64(2 * (k % 32))
    for b in range(BANDS):
        h = np.full(len(some), b + 1, np.uint64)
        for r in range(ROWS):
            h = K.mix(h * K._MUL[0] + sig[b * ROWS + r].astype(np.uint64))
        keys[:, b] = h
    return count, fps, sketch, keys


def _lists(count: np.ndarray, rows: np.ndarray) -> pa.ListArray:
    """A list of equal length for each text that has one."""
    ends = np.concatenate(([0], np.cumsum((count > 0) * rows.shape[1]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel().view(np.int64)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.byte_view(batch.column(2))
        for i, j, part, offs in K.blocks(data, offsets):
            count, fps, sketch, keys = _sign_block(part, offs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(count.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in fps), _lists(count, sketch), _lists(count, keys)],
                names=["doc_id", "body", "n_shingles", "fp_a", "fp_b", "sketch", "bands"],
            )
        K.tidy()


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, hash of the text, set size, set digest, sketch, band keys."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("body"), F.col(text_col).alias("text")).mapInArrow(_sign, _SIGNED)


def _sign_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The longer sketch: one bit of each of 64 * LONG coordinates."""
    for batch in batches:
        data, offsets = K.byte_view(batch.column(1))
        for i, j, part, offs in K.blocks(data, offsets):
            values, first = K.shingles(part, offs, WIDTH)
            bits = np.zeros((j - i, LONG), np.uint64)
            some = np.flatnonzero(np.diff(first))
            if len(some):
                sig = circulant(values, np.append(first[:-1][some], len(values)), 64 * LONG)
                for k in range(64 * LONG):
                    bits[some, k // 64] |= (sig[k] & np.uint32(1)).astype(np.uint64) << np.uint64(k % 64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _lists(np.ones(j - i, int), bits)], names=["id", "wide"])
        K.tidy()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are similar enough."""
    for batch in batches:
        sides, keep = [K.byte_view(batch.column(2)), K.byte_view(batch.column(3))], np.zeros(batch.num_rows, bool)
        ids, sets = [batch.column(0).to_pylist(), batch.column(1).to_pylist()], ({}, {})
        for i in range(batch.num_rows):
            own = []
            for (data, offs), names, known in zip(sides, ids, sets, strict=True):
                key = (names[i], int(offs[i + 1] - offs[i]))
                if key not in known:
                    known.clear()  # pairs come mostly by the second id; one set at a time bounds memory
                    known[key] = K.shingles(data[offs[i] : offs[i + 1]], np.array([0, key[1]]), WIDTH)[0]
                own.append(known[key])
            x, y = own
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep[i] = len(x) and 100 * both >= SIMILAR * (len(x) + len(y) - both)
        yield batch.select([0, 1]).filter(pa.array(keep))
        K.tidy()


def _texts_of(ids: DataFrame, classes: DataFrame, texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """A text of each of these classes (id, text), saved; ids are broadcast only where few enough."""
    ids = scratch.save(classes.select("id", "doc_id", "body").join(ids.distinct(), "id"), f"{name}-ids")
    known = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return scratch.save(texts.join(known, ["doc_id", "body"]).select("id", "text"), f"{name}-texts")


def _confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Those (a, b) of a saved table whose texts' full sets are similar."""
    own = _texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), classes, texts, scratch, name)
    first = pairs.join(own.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = first.join(own.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    found = scratch.save(both.select("a", "b", "text_a", "text_b").mapInArrow(_compare, "a long, b long").distinct(), f"{name}-links")
    scratch.drop(f"{name}-texts")
    scratch.drop(f"{name}-ids")
    return found


def _apart(x: str, y: str) -> Column:
    """In how many coordinates two sketches differ."""
    total = F.lit(0)
    for k in range(SKETCH):
        d = F.col(x)[k].bitwiseXOR(F.col(y)[k])
        total = total + F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return total


def _close(x: str, y: str) -> Column:
    """Near enough in size and sketch to be worth a check."""
    n, m = F.col(f"n_{x}"), F.col(f"n_{y}")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * SIMILAR) & (_apart(f"s_{x}", f"s_{y}") <= APART)


def _still_apart(placed: DataFrame, of: Callable[[str], DataFrame], classes: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """All pairs (a, b), a > b, of (key, size, id, c) rows that share a bucket, not a component, and may be similar.

    A pair comes from the first bucket that it shares, not from each.
    """
    across = F.ceil(F.col("size") / CELL).cast("int")
    own, every = F.pmod(F.xxhash64("id"), across).cast("int"), F.explode(F.sequence(F.lit(0), across - 1))
    left = placed.select("key", own.alias("row"), every.alias("col"), F.col("id").alias("a"), F.col("c").alias("c_a")).join(of("a"), "a")
    right = placed.select("key", every.alias("row"), own.alias("col"), F.col("id").alias("b"), F.col("c").alias("c_b")).join(of("b"), "b")
    meet = (left["key"] == right["key"]) & (left["row"] == right["row"]) & (left["col"] == right["col"])
    fits = meet & (F.col("c_a") != F.col("c_b")) & _close("a", "b")
    near = left.join(right, fits, "left_semi").select(F.col("a").alias("id"))
    wide = _texts_of(near, classes, texts, scratch, "wide").mapInArrow(_sign_long, "id long, wide array<long>")
    wide = scratch.save(wide.dropDuplicates(["id"]), "wide")
    more = wide.join(classes.select("id", "bands"), "id")
    left = left.join(more.select(F.col("id").alias("a"), F.col("wide").alias("w_a"), F.col("bands").alias("bands_a")), "a")
    right = right.join(more.select(F.col("id").alias("b"), F.col("wide").alias("w_b"), F.col("bands").alias("bands_b")), "b")
    apart = sum((F.bit_count(F.col("w_a")[k].bitwiseXOR(F.col("w_b")[k])) for k in range(LONG)), F.lit(0))
    meet = (left["key"] == right["key"]) & (left["row"] == right["row"]) & (left["col"] == right["col"])
    fits = meet & (F.col("a") > F.col("b")) & (F.col("c_a") != F.col("c_b")) & _close("a", "b") & (apart <= LONG_APART)
    fits = fits & (F.element_at(F.array_intersect("bands_a", "bands_b"), 1) == left["key"])
    return left.join(right, fits).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``; see the module."""
    return _judged(docs, id_col, text_col).drop("body")


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "neardup")
    signed = scratch.save(signatures(docs, id_col, text_col), "signed")
    same = ["n_shingles", "fp_a", "fp_b"]
    classes = signed.filter("n_shingles > 0 and doc_id is not null").groupBy(*same)
    # Once saved, a class goes by a number of its own, since one id may have several texts.
    classes = classes.agg(F.min(F.struct("doc_id", "body")).alias("d"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    classes = scratch.save(classes.select(F.monotonically_increasing_id().alias("id"), *same, "d.doc_id", "d.body", "sketch", "bands"), "classes")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("body"), F.col(text_col).alias("text"))
    of = lambda x: classes.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))

    # Classes that share a bucket, each with the smallest class of that bucket.
    entries = classes.select(F.explode("bands").alias("key"), "id")
    heads = entries.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("size")).filter("size > 1")
    crowd = scratch.save(entries.join(heads.select("key", "head"), "key"), "crowd")
    pairs = crowd.filter("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    pairs = pairs.join(of("a"), "a").join(of("b"), "b").filter(_close("a", "b"))
    pairs = pairs.groupBy("a").agg(F.min_by("b", F.struct(_apart("s_a", "s_b"), "b")).alias("b"))
    pairs = tried = scratch.save(pairs, "tried-0")
    found = None
    for step in range(LAST + 1):
        if step:
            placed = crowd.select("key", "id").join(found.withColumnRenamed("node", "id"), "id", "left")
            placed = placed.select("key", "id", F.coalesce("component", "id").alias("c"))
            mixed = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min_by(F.struct("id", "c"), F.xxhash64("id", F.lit(step))).alias("head"), F.count("*").alias("size"))
            placed = placed.join(mixed.filter("low <> high").select("key", "head", "size"), "key")
            if step < LAST:
                pairs = placed.filter("c <> head.c").select(F.greatest("id", "head.id").alias("a"), F.least("id", "head.id").alias("b")).distinct()
                pairs = pairs.join(tried, ["a", "b"], "left_anti").join(of("a"), "a").join(of("b"), "b").filter(_close("a", "b"))
                ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("p"), _apart("s_a", "s_b").alias("d"))
                pairs = ends.groupBy("p").agg(F.min_by(F.struct("a", "b"), F.struct("d", "a", "b")).alias("e")).select("e.*").distinct()
            else:
                pairs = _still_apart(placed.select("key", "size", "id", "c"), of, classes, texts, scratch).join(tried, ["a", "b"], "left_anti")
            pairs = scratch.save(pairs.select("a", "b"), f"tried-{step}")
            tried = tried.unionByName(pairs)
        links = _confirmed(pairs, classes, texts, scratch, f"check-{step}")
        if found is None or not links.isEmpty():
            star = links if found is None else links.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
            found = scratch.save(components(star, scratch, f"fold-{step}"), f"components-{step}")
    scratch.drop("crowd")

    own = classes.select("id", "doc_id").join(found.withColumnRenamed("node", "id"), "id")
    least = own.groupBy("component").agg(F.min("doc_id").alias("least"))
    placed = classes.select(*same, "id", "doc_id").join(own.join(least, "component").select("id", "least"), "id", "left")
    placed = placed.select(*same, F.coalesce("least", "doc_id").alias("component_id"))
    out = signed.select("doc_id", "body", *same).join(placed, same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "body", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, one for each id and text; rows of a null id all stay."""
    same = unused(docs.columns, "_same")
    kept = _judged(docs, id_col, text_col).filter("kept and doc_id is not null").select(F.col("doc_id").alias(id_col), F.col("body").alias(same)).distinct()
    out = docs.filter(F.col(id_col).isNotNull()).withColumn(same, F.xxhash64(text_col)).join(kept, [id_col, same], "left_semi").dropDuplicates([id_col, same])
    return out.select(*docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))
