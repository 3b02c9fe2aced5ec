"""Two tokenizers over the same texts: which tokens of one lie over which of the other.

A is a byte-level BPE file of the tokenizers library, B a SentencePiece model.  A text is taken as a space and itself.
Byte offsets at which tokens of both end cut the tokens into groups; a link is a pair of an A and a B token
whose bytes overlap, that is, each stretch between two neighbouring ends of either.

* Texts are cut before spaces that follow other characters than white space: there both tokenizers
  begin anew (where a model's rules do not grant that, texts stay whole).  Every distinct stretch is
  encoded and aligned once a worker; documents are sums over their stretches.
* A block of documents yields, per stripe of A ids, its distinct (document, pair) entries with their links, packed in sorted order and
  saved.  Stripes deal A ids by remainder, so that frequent ones spread.
* Counting: each task adds the entries of its part of the table to the dense matrix of one stripe after another
  (np.add.at, at most STRIPE_CELLS cells), and hands on the cells that it touched; those of a stripe are added up
  in rounds of at most FAN_IN.  Row maxima give each A id's highest count.
* Scoring: entries and counts meet by stripe and salt; a stripe has as many salts as its bytes ask for,
  so a hot id's entries are split.  Sums per document come back to its block.

Nothing but each stripe's byte total reaches the driver, and no task holds more than a stripe, a row of packed
entries and a block's sums.

Defined results: texts null, empty, or not given back by both tokenizers' bytes have zeros, an empty
groups_sha256 and no part in counts; repeated rows count each; other columns are not read; an empty table
gives an empty table.  Stretches are told apart by 64-bit hashes (a chance of 7e-9 for a full store).
"""

from __future__ import annotations

import hashlib
import json
import os
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkernel as K
from graphloom.llm.pieces import MARK, Model
from graphloom.llm.scratch import Scratch

#: Cells of the matrix of one stripe (8 bytes each), bytes of entries of one salt, and partial counts added at once.
STRIPE_CELLS, SALT_BYTES, FAN_IN = 8_000_000, 16 << 20, 256
BLOCK_BYTES = 2 << 20
STRETCHES_KEPT, LINKS_KEPT = 400_000, 6_000_000

_CODED = "block long, kind int, n int, data binary, ids array<long>, figures array<long>, digests array<string>"
_ANSWER = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def pack(*columns: np.ndarray) -> bytes:
    """Numbers of equal length, byte plane by byte plane; the first column is sorted and goes as gaps."""
    first = np.diff(columns[0].astype(np.uint64), prepend=np.uint64(0))
    both = np.stack([first, *(c.astype(np.uint64) for c in columns[1:])]).astype("<u8")
    return pa.compress(both.view(np.uint8).reshape(len(both), -1, 8).transpose(0, 2, 1).tobytes(), codec="zstd", asbytes=True)


def unpack(raw: bytes, n: int, columns: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=8 * n * columns, codec="zstd", asbytes=True), np.uint8)
    out = np.ascontiguousarray(planes.reshape(columns, 8, n).transpose(0, 2, 1)).view("<u8").reshape(columns, n).astype(np.int64)
    out[0] = np.cumsum(out[0])
    return out


def _unbyte() -> dict[str, int]:
    """The byte of each character of byte-level vocabularies: printable bytes stand for themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_WHITE_BEFORE = np.zeros(256, bool)
_WHITE_BEFORE[:33] = _WHITE_BEFORE[127] = True


def stretches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the stretches: each text's first byte and spaces after a character that is surely no white space."""
    new = data == 32
    new[1:] &= ~_WHITE_BEFORE[data[:-1]]
    at = np.flatnonzero(new)
    a, b, c = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))  # the last bytes before the space
    wide = (b == 0xC2) & ((a == 0x85) | (a == 0xA0)) | (c == 0xE1) & (b == 0x9A) & (a == 0x80) | (c == 0xE3) & (b == 0x80) & (a == 0x80)
    wide |= (c == 0xE2) & ((b == 0x80) & ((a >= 0x80) & (a <= 0x8A) | (a >= 0xA8) & (a <= 0xA9) | (a == 0xAF)) | (b == 0x81) & (a == 0x9F))
    new[at[wide]] = False
    new[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(new)


class Aligner:
    """Groups and links of stretches, kept for those already seen."""

    def __init__(self, a_file: str, b_model: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_model)
        rules, model = json.loads(a_file), Model(b_model)
        before = rules["pre_tokenizer"] or {}
        self.cut = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"] and rules["normalizer"] is None
        self.cut = self.cut and model.kind == "bpe" and model.cut and model.dummy_prefix and model.escape and not model.squeeze and not model.charsmap
        of = _unbyte()
        vocab = self.a.get_vocab()
        self.n_a, self.n_b = max(vocab.values()) + 1, len(model.pieces)
        self.a_bytes = [b""] * self.n_a
        for piece, i in vocab.items():
            self.a_bytes[i] = bytes(of[c] for c in piece) if all(c in of for c in piece) else piece.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if kind == 6 else p.replace(MARK, " ").encode() for p, _, kind in model.pieces]
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.alone = self.b.encode("a ")[len(self.b.encode("a")) :] if self.cut else []
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted; where each stretch is
        self.figures = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links
        self.sound = np.zeros(0, bool)
        self.begin, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.groups: list[bytes] = []

    def _add(self, texts: list[bytes]) -> None:
        """Encode and align new stretches."""
        words = [t.decode() for t in texts]
        a = [x.ids for x in self.a.encode_batch_fast(words, add_special_tokens=False)]
        b = self.b.encode([w[1:] for w in words], num_threads=1)
        b = [y if len(w) > 1 or not self.cut else self.alone for w, y in zip(words, b, strict=True)]
        sound = np.array([b"".join([self.a_bytes[i] for i in x]) == t == b"".join([self.b_bytes[i] for i in y]) for t, x, y in zip(texts, a, b, strict=True)], bool)
        a, b = ([x if ok else [] for x, ok in zip(side, sound.tolist(), strict=True)] for side in (a, b))
        own_a, own_b = (np.repeat(np.arange(len(texts)), [len(x) for x in side]) for side in (a, b))
        ids_a, ids_b = (np.array([i for x in side for i in x], np.int64) for side in (a, b))
        end_a, end_b = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b])  # of one row of all sound stretches
        both = np.intersect1d(end_a, end_b)
        ends = np.union1d(end_a, end_b)
        link_a, link_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)  # the token that a stretch up to here lies in
        count = lambda own: np.bincount(own, minlength=len(texts))
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        n_links = count(own_a[link_a])
        of_group = np.zeros(len(both), np.int64)
        of_group[group_a] = own_a
        figures = np.stack((count(own_a), count(own_b), count(of_group), n_links), axis=1)
        last_a, last_b = np.isin(end_a, both, assume_unique=True), np.isin(end_b, both)
        said = [b"%d|" % i if z else b"%d," % i for i, z in zip(ids_a.tolist(), last_a.tolist(), strict=True)]
        said += [b"%d;" % i if z else b"%d," % i for i, z in zip(ids_b.tolist(), last_b.tolist(), strict=True)]
        order = np.argsort(np.concatenate((group_a * 2, group_b * 2 + 1)), kind="stable")
        said = [said[i] for i in order.tolist()]
        cut = np.concatenate(([0], np.cumsum(figures[:, 0] + figures[:, 1]))).tolist()
        self.groups += [b"".join(said[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
        self.figures, self.sound = np.concatenate((self.figures, figures)), np.concatenate((self.sound, sound))
        self.links = np.concatenate((self.links, ids_a[link_a] * self.n_b + ids_b[link_b]))
        self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(n_links)))

    def look(self, whole: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each stretch, first stretch of each text with an end)."""
        data = np.frombuffer(whole, np.uint8)
        start = stretches(data, offsets) if self.cut else np.unique(offsets[:-1][np.diff(offsets) > 0])
        stop = np.append(start[1:], len(data))[: len(start)]
        found, first_seen, which = np.unique(K.span_hashes(data, start, stop), return_index=True, return_inverse=True)
        if len(self.hashes) + len(found) > STRETCHES_KEPT or len(self.links) > LINKS_KEPT:
            self._forget()
        at = np.searchsorted(self.hashes, found)
        new = self.hashes[np.minimum(at, len(self.hashes) - 1)] != found if len(self.hashes) else np.ones(len(found), bool)
        if new.any():
            number = len(self.groups) + np.arange(int(new.sum()))
            self._add([whole[start[i] : stop[i]] for i in first_seen[new].tolist()])
            self.hashes, self.place = np.insert(self.hashes, at[new], found[new]), np.insert(self.place, at[new], number)
            at = np.searchsorted(self.hashes, found)
        return self.place[at][which], np.searchsorted(start, offsets)


@lru_cache(1)
def _aligner(a_file: str, b_model: bytes) -> Aligner:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Aligner(a_file, b_model)


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... of each run."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


def _block(x: Aligner, texts: list[str], stripes: int) -> tuple[np.ndarray, list[str], Iterator[tuple[int, int, bytes]]]:
    """(four figures of each text, digests, packed entries by stripe) of some texts."""
    raw = [b" " + t.encode() if t else b"" for t in texts]
    number, first = x.look(b"".join(raw), np.cumsum([0, *map(len, raw)]))
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    bad = np.bincount(text[~x.sound[number]], minlength=len(texts)) > 0
    good = ~bad[text]
    text, number = text[good], number[good]
    figures = np.stack([np.bincount(text, weights=x.figures[number, k], minlength=len(texts)).astype(np.int64) for k in range(4)], axis=1)
    begin = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
    numbers = number.tolist()
    digests = [hashlib.sha256(b"".join([x.groups[i] for i in numbers[a:b]])[:-1]).hexdigest() if b > a else "" for a, b in zip(begin[:-1], begin[1:], strict=True)]

    def entries() -> Iterator[tuple[int, int, bytes]]:
        key, often = np.unique(text * len(x.groups) + number, return_counts=True)
        own, stretch = key // len(x.groups), key % len(x.groups)
        size = x.figures[stretch, 3]
        link = x.links[_ragged(x.begin[stretch], size)]
        a, b = link // x.n_b, link % x.n_b
        # Sorted by stripe, pair in the stripe, text.
        pair = (a // stripes) * x.n_b + b
        wide = math.ceil(x.n_a / stripes) * x.n_b
        key = ((a % stripes) * wide + pair) * len(texts) + np.repeat(own, size)
        order = np.argsort(key)
        key, often = key[order], np.repeat(often, size)[order]
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        key, often = key[at], np.add.reduceat(often, at) if len(at) else often
        edges = np.searchsorted(key, np.arange(stripes + 1) * (wide * len(texts)))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            i, j = edges[s], edges[s + 1]
            yield s, int(j - i), pack(key[i:j] - s * wide * len(texts), often[i:j])

    return figures, digests, entries()


def _coder(a_file: str, b_model: bytes, stripes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
    names = [c.split()[0] for c in _CODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_file, b_model)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = K.byte_view(batch.column(1))
            for i, j, _, _ in K.blocks(data, offsets, BLOCK_BYTES):
                ids, texts = (batch.column(k).slice(i, j - i).to_pylist() for k in (0, 1))
                figures, digests, entries = _block(aligner, texts, stripes)
                rows = [(block, s, n, d, [j - i], None, None) for s, n, d in entries]
                rows.append((block, -1, j - i, None, ids, figures.ravel().tolist(), digests))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                block += 1
            K.tidy()

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}


def _counted(cells: int, entries: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (kind, n, data) in order of their stripe: one row of (cells, counts) for each stripe that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, touched, stripe = np.zeros(cells, np.int64), [], None

        def told() -> pa.RecordBatch:
            at = np.unique(np.concatenate(touched))
            out = pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([len(at)], pa.int32()), pa.array([pack(at, total[at])], pa.binary())], names=["kind", "n", "data"])
            total[at] = 0
            touched.clear()
            return out

        for row in _rows(batches):
            if row["kind"] != stripe:
                if touched:
                    yield told()
                stripe = row["kind"]
            pair, count = unpack(row["data"], row["n"], 2)
            if entries:
                pair, count = pair // row["docs"], 1  # one for each document that holds it
            np.add.at(total, pair, count)
            touched.append(np.unique(pair))
        if touched:
            yield told()

    return run


def _counts(entries: DataFrame, cells: int, scratch: Scratch) -> DataFrame:
    """(kind, n, data), saved: the counts of each stripe's pairs."""
    kind = "kind int, n int, data binary"
    out = entries.select("kind", "n", "data", F.col("ids")[0].alias("docs")).sortWithinPartitions("kind").mapInArrow(_counted(cells, True), kind)
    out, step = scratch.save(out, "counts-0"), 0
    while True:
        many = out.groupBy("kind").count().agg(F.max("count")).first()[0] or 0
        if many <= 1:
            return out
        dealt = out.withColumn("part", F.pmod(F.xxhash64("data"), F.lit(math.ceil(many / FAN_IN))))
        dealt = dealt.repartition("kind", "part").sortWithinPartitions("kind", "part").select("kind", "n", "data")
        step += 1
        out = scratch.save(dealt.mapInArrow(_counted(cells, False), kind), f"counts-{step}")
        scratch.drop(f"counts-{step - 1}")


def _score(cells: int, n_b: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in order of stripe, salt and place: a stripe's counts (no block), then entries of its salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best, at = np.zeros(cells, np.int64), np.zeros(cells, bool), np.zeros(0, np.int64)
        for row in _rows(batches):
            if row["block"] is None:
                count[at], best[at] = 0, False
                at, often = unpack(row["data"], row["n"], 2)
                begin = np.flatnonzero(np.diff(at // n_b, prepend=-1))
                count[at] = often
                best[at] = often == np.repeat(np.maximum.reduceat(often, begin), np.diff(np.append(begin, len(at))))
                continue
            key, links = unpack(row["data"], row["n"], 2)
            pair, doc = key // row["docs"], key % row["docs"]
            sums, right = np.zeros(row["docs"], np.int64), np.zeros(row["docs"], np.int64)
            np.add.at(sums, doc, links * count[pair])
            np.add.at(right, doc, links * best[pair])
            some = np.unique(doc)
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([len(some)], pa.int32()), pa.array([pack(some, right[some], sums[some])], pa.binary())], names=["block", "n", "data"])

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of block: its documents, then the sums of its stripes."""
    names = [c.split()[0] for c in _ANSWER.split(", ")]
    docs, sums = None, np.zeros((2, 0), np.int64)

    def told() -> pa.RecordBatch:
        figures = np.array(docs["figures"], np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([pa.array(docs["ids"], pa.int64()), *(pa.array(figures[:, k]) for k in range(4)), *(pa.array(x) for x in sums), pa.array(docs["digests"], pa.string())], names=names)

    for row in _rows(batches):
        if row["ids"] is not None:
            if docs is not None:
                yield told()
            docs, sums = row, np.zeros((2, row["n"]), np.int64)
        else:
            doc, right, total = unpack(row["data"], row["n"], 3)
            sums[0, doc] += right
            sums[1, doc] += total
    if docs is not None:
        yield told()


class Alignment:
    """Texts coded by both tokenizers, and the counts of their pairs."""

    def __init__(self, docs: DataFrame, a_file: str, b_model: bytes, id_col: str = "doc_id", text_col: str = "text"):
        self.scratch = Scratch(docs.sparkSession, "alignment")
        self.n_b = len(Model(b_model).pieces)
        n_a = max([*json.loads(a_file)["model"]["vocab"].values(), *(t["id"] for t in json.loads(a_file)["added_tokens"])]) + 1
        stripes = max(1, math.ceil(n_a / max(1, STRIPE_CELLS // self.n_b)))
        self.stripes, self.cells = stripes, math.ceil(n_a / stripes) * self.n_b
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        self.coded = self.scratch.save(rows.mapInArrow(_coder(a_file, b_model, stripes), _CODED), "coded")
        self.entries = self.coded.filter("kind >= 0")
        self.counts = _counts(self.entries, self.cells, self.scratch)

    def pairs(self) -> DataFrame:
        """(a_id, b_id, n_docs, best): how many documents link two ids, and whether that is the A id's highest."""
        n_b, stripes = self.n_b, self.stripes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                at, often = unpack(row["data"], row["n"], 2)
                begin = np.flatnonzero(np.diff(at // n_b, prepend=-1))
                best = often == np.repeat(np.maximum.reduceat(often, begin), np.diff(np.append(begin, len(at))))
                yield pa.RecordBatch.from_arrays([pa.array(at // n_b * stripes + row["kind"]), pa.array(at % n_b), pa.array(often), pa.array(best)], names=["a_id", "b_id", "n_docs", "best"])

        return self.counts.mapInArrow(run, "a_id long, b_id long, n_docs long, best boolean")

    def documents(self) -> DataFrame:
        """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row."""
        sizes = {r[0]: r[1] for r in self.entries.groupBy("kind").agg(F.sum(F.octet_length("data"))).collect()}  # a row a stripe
        salts = F.array(*[F.lit(max(1, math.ceil(sizes.get(s, 0) / SALT_BYTES))) for s in range(self.stripes)])
        salts = F.element_at(salts, F.col("kind") + 1)
        known = self.counts.select("kind", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(None).cast("long").alias("block"), F.lit(0).cast("long").alias("docs"), "n", "data")
        own = self.entries.select("kind", F.pmod(F.xxhash64("block"), salts).cast("int").alias("salt"), "block", F.col("ids")[0].alias("docs"), "n", "data")
        met = own.unionByName(known).repartition("kind", "salt").sortWithinPartitions("kind", "salt", F.col("block").asc_nulls_first())
        sums = met.select("block", "docs", "n", "data").mapInArrow(_score(self.cells, self.n_b), "block long, n int, data binary")
        sums = self.scratch.save(sums, "sums").select("block", "n", "data", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("figures"), F.lit(None).cast("array<string>").alias("digests"))
        both = self.coded.filter("kind < 0").select("block", "n", "data", "ids", "figures", "digests").unionByName(sums)
        both = both.repartition("block").sortWithinPartitions("block", F.col("ids").isNull())
        return both.mapInArrow(_gather, _ANSWER)


def align(docs: DataFrame, a_file: str, b_model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's tokens, groups, links and scores; see the module."""
    return Alignment(docs, a_file, b_model, id_col, text_col).documents()
