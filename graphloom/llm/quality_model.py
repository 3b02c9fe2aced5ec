"""Quality classifier: hashed word n-grams, logistic regression fitted by FTRL.

Texts are cut into runs of word characters and runs of other marks; single
tokens and pairs are hashed to ``1 << BITS`` buckets, and a token that follows
itself also counts as the pair of any token and its repeat.  A text is the vector of
1 + log of its counts, scaled to length 1, plus a constant.  Weights come from
follow-the-regularised-leader updates (per-coordinate, with L1 and L2), over at
most ``max_rows`` labelled texts, and as many of them as have ``max_values`` vector
entries together, in the order of a hash of their id; scoring is a sparse dot
product over whole texts where they lie, with weights of 2 MB.

Only the fit is bounded: its sample is the labelled rows with the smallest id
hashes.  It happens in one task that reads sparse vectors of 160 MB at most, never
texts, so that a lost executor costs one short task.

Defined results: a null or blank text scores by the constant alone; labels that
are null or without a document are ignored, repeated ones count as often as
they occur; with no labels every score is 0.5; texts of any length are read whole;
rows of equal text score equally; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkernel as K
from graphloom.llm.scratch import Scratch

BITS = 18
MAX_ROWS, MAX_VALUES = 20_000, 20_000_000
#: Labels are broadcast up to this many (16 MB); beyond, they meet their texts by a shuffled join.
BROADCAST_LABELS = 1_000_000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.1
PREDICT_AT = 0.3

_KIND = np.full(256, 2, np.uint8)
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[95] = 1
_KIND[0x80:] = 1
_KIND[K._SPACE] = 0


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, value, first index of each text with an end) of the texts' vectors."""
    n = len(offsets) - 1
    kind = _KIND[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(data))
    full = kind[start] > 0
    start, stop = start[full], stop[full]
    h = K.span_hashes(data, start, stop)
    first = np.searchsorted(start, offsets)
    at, pairs = K.windows(h, first, 2)
    owner = np.searchsorted(first, at, "right") - 1
    again = owner[h[at] == h[at + 1]] if len(at) else owner
    text = np.concatenate((np.repeat(np.arange(n), np.diff(first)), owner, again, np.arange(n)))
    bucket = np.concatenate((h >> np.uint64(64 - BITS), pairs >> np.uint64(64 - BITS), np.ones(len(again), np.uint64), np.zeros(n, np.uint64))).astype(np.int64)
    found, count = np.unique(text << BITS | bucket, return_counts=True)
    text, bucket = found >> BITS, found & ((1 << BITS) - 1)
    ends = np.searchsorted(text, np.arange(n + 1))
    value = 1 + np.log(count)
    value /= np.sqrt(np.add.reduceat(value * value, ends[:-1]))[text] if n else 1
    return bucket, value, ends


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.byte_view(batch.column(2))
        for i, j, part, offs in K.blocks(data, offsets):
            bucket, value, ends = _features(part, offs)
            lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x)) for x in (bucket.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *lists], names=["at", "label", "bucket", "value"])
        K.tidy()


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights from (label, buckets, values) in the order given."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for label, at, values in rows:
            x = values.astype(np.float64)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
    return weights(z, n)


def _trainer(max_values: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, values = [], 0
        for batch in batches:
            for label, bucket, value in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                values += len(bucket.values)
                if values > max_values and rows:
                    break
                rows.append((label.as_py(), bucket.values.to_numpy(), value.values.to_numpy()))
        w = ftrl(rows)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], names=["bucket", "weight"])

    return run


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS, max_values: int = MAX_VALUES) -> np.ndarray:
    """Weights from (id, label, text); rows with null label are ignored."""
    spark = labelled.sparkSession
    scratch = Scratch(spark, "quality")
    rows = labelled.filter("label is not null").select(F.xxhash64("id").alias("at"), F.col("label").cast("int"), "text")
    n = rows.count()
    if n > max_rows:  # hashes are uniform over the 64-bit range; a little over the bound, then the limit
        cut = int(-(1 << 63) + (1 << 64) * min(1.0, 1.05 * max_rows / n + 200 / n))
        rows = rows.filter(F.col("at") < min(cut, (1 << 63) - 1))
    vectors = scratch.save(rows.mapInArrow(_vectors, "at long, label int, bucket array<int>, value array<float>"), "vectors")
    order = ["at", "label", F.size("bucket"), "bucket", "value"]
    if n > max_rows:
        vectors = vectors.orderBy(*order).limit(max_rows)
    vectors = vectors.repartition(1).sortWithinPartitions(*order)
    found = vectors.mapInArrow(_trainer(max_values), "bucket int, weight double").collect()  # 1 << BITS rows at most
    scratch.drop("vectors")
    w = np.zeros(1 << BITS)
    for bucket, weight in found:
        w[bucket] = weight
    return w


def _scorer(w: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.byte_view(batch.column(1))
            for i, j, part, offs in K.blocks(data, offsets):
                bucket, value, ends = _features(part, offs)
                dots = np.add.reduceat(w[bucket] * value, ends[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(1 / (1 + np.exp(-np.clip(dots, -35, 35))))], names=["doc_id", "score"])
            K.tidy()

    return run


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row; score is the probability of label 1."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scorer(weights), "doc_id long, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """A fifth of ids, by CRC-32 of the id as text, is never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; learns ``quality`` from the other ids."""
    known = labels.filter("quality is not null").filter(~held_out()).select("doc_id", F.col("quality").alias("label"))
    n = known.count()
    if n > MAX_ROWS:  # cut before the join, so that few texts move; rows of a cut id stay together
        share = min(1.0, 2.0 * MAX_ROWS / n)
        known = known.filter(F.xxhash64("doc_id") < min(int(-(1 << 63) + (1 << 64) * share), (1 << 63) - 1))
        n = known.count()
    few = F.broadcast(known) if n <= BROADCAST_LABELS else known
    labelled = docs.select("doc_id", "text").join(few, "doc_id").select(F.col("doc_id").alias("id"), "label", "text")
    out = score(docs, fit(labelled))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
