"""SentencePiece models on the tokenizers library.

The model's protobuf is read field by field.  From it are rebuilt the
normaliser (its character map, white-space rules, dummy prefix), the metaspace
marker, and either a unigram model with its scores or a BPE model with merges in
the order of the pieces' scores, with byte fallback.  Batches are encoded by the
library's threads; decoding is its decoder.

Every row's ids are decoded, as the bytes of their pieces, and compared with its
text (``round_trip``).  Every row's whole text is also encoded by the sentencepiece
library as it stands, and ``sample_parity`` says whether the ids are equal; the name
is older than that.  Only where a caller asks for less, with ``verify_every`` other
than 1, is it null for the rows that were not chosen, by a checksum of the text.

Where no piece has the marker inside, a text may be cut before each run of
markers without changing any result; that lets the library reuse words.  Runs
of markers themselves have equal scores in some BPE models, which that library's
merges cannot express: words that begin with two markers or more are encoded here,
by merging the leftmost best pair.  Where all runs of markers have one score, below
every other, a run of n markers is as many of the longest run as fit, then what a
shorter run gives: merging from the left closes each longest run before it looks
further.  A run then costs no more than its ids.

Defined results: a null text counts as empty; empty texts have no ids; decoding
gives the text back except where the model itself does not (a marker in the
text turns into a space; what its normaliser folds).  Whole texts are encoded.
Rows that repeat get equal answers; other columns are not read.
"""

from __future__ import annotations

import heapq
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import textkernel as K
from graphloom.llm.scratch import lean

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BLOCK_BYTES = 1 << 20
WORDS_TOGETHER, WORDS_KEPT, IDS_KEPT = 2000, 400_000, 4_000_000
#: One row in so many is encoded by the sentencepiece library as well: each.
VERIFY_EVERY = 1


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = b[i]
        i += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: integers for varints, bytes for the rest."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            size, i = _varint(b, i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = b[i : i + size], i + size
        yield key >> 3, value


class Model:
    """What a model file says."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        norm: dict = {}
        for number, value in _fields(raw):
            if number == 1:
                d = dict(_fields(value))
                self.pieces.append((d[1].decode("utf-8"), struct.unpack("<f", d[2])[0] if 2 in d else 0.0, d.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        self.kind = {1: "unigram", 2: "bpe"}.get(trainer.get(3, 1))
        if self.kind is None or trainer.get(24, 0):
            raise ValueError("only unigram and BPE models with the marker in front are supported")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.charsmap = norm.get(2, b"")
        self.dummy_prefix, self.squeeze, self.escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        self.vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        self.scores = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER)}
        self.cut = not any(MARK in p.lstrip(MARK) for p in self.scores)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, best score first."""
        found = []
        for piece, score in self.scores.items():
            for i in range(1, len(piece)):
                left, right = piece[:i], piece[i:]
                if left in self.scores and right in self.scores:
                    found.append((-score, self.vocab[left], self.vocab[right], left, right))
        return [(x[3], x[4]) for x in sorted(found)]


def backend(model: Model):
    """A tokenizer of the tokenizers library that acts as the model does."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind == "bpe":
        own = models.BPE(vocab=model.vocab, merges=model.merges(), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        own = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    out = Tokenizer(own)
    steps = []
    if model.charsmap:
        mapped = normalizers.Precompiled(model.charsmap)
        if mapped.normalize_str("\r") == mapped.normalize_str("\n"):  # that library maps "\r\n" as one character
            steps.append(normalizers.Replace("\r\n", "\n\n"))
        steps.append(mapped)
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    if model.cut:
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    out.decoder = decoders.Sequence([*back, decoders.Strip(" ", 1, 0)] if model.dummy_prefix else back)
    return out


def merge_word(model: Model, word: str) -> list[int]:
    """Ids of one word by merging the best-scored pair, the leftmost among equals."""
    parts: list[str | None] = list(word)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    pairs: list[tuple[float, int, str]] = []

    def look(i: int) -> None:
        if i >= 0 and after[i] < len(parts):
            both = parts[i] + parts[after[i]]
            if both in model.scores:
                heapq.heappush(pairs, (-model.scores[both], i, both))

    for i in range(len(parts)):
        look(i)
    while pairs:
        _, i, both = heapq.heappop(pairs)
        j = after[i]
        if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j], after[i] = both, None, after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        look(before[i])
        look(i)
    ids: list[int] = []
    for p in parts:
        if p is None:
            continue
        if p in model.scores:
            ids.append(model.vocab[p])
        elif model.byte_fallback:
            ids += [model.vocab[f"<0x{b:02X}>"] for b in p.encode("utf-8")]
        elif not ids or ids[-1] != model.unknown:
            ids.append(model.unknown)
    return ids


class Runs:
    """Ids of words that begin with a run of markers; see the module."""

    def __init__(self, model: Model):
        self.model = model
        runs = [p for p in model.scores if p == MARK * len(p)]
        self.longest = max(map(len, runs), default=0)
        low = {model.scores[p] for p in runs if len(p) > 1}
        others = [(p, s) for p, s in model.scores.items() if p != MARK * len(p)]
        self.even = len(low) == 1 and MARK in runs and all(s > min(low) and not p.startswith(MARK * 2) for p, s in others)
        if self.even:
            self.short = [merge_word(model, MARK * n) for n in range(self.longest + 1)]
            self.even = len(self.short[-1]) == 1

    def encode(self, word: str) -> list[int]:
        rest = word.lstrip(MARK)
        if not self.even:
            return merge_word(self.model, word)
        n, tail = len(word) - len(rest), []
        if rest:  # its pieces are better than any run's, so they are merged first
            tail = merge_word(self.model, MARK + rest)
            if tail[0] == self.model.vocab[MARK]:
                tail = tail[1:]
            else:
                n -= 1
        return self.short[-1] * (n // self.longest) + self.short[n % self.longest] + tail


class Codec:
    """Encode and decode batches of whole texts.

    Where texts may be cut into words, the ids of words already seen are kept, up
    to ``WORDS_KEPT``, under 64-bit hashes of the words; of two words of
    one hash, a chance of 4e-9 for a full store, the later would get the ids of the first,
    and both checks of its row would be false.
    """

    def __init__(self, raw: bytes):
        self.raw = raw
        self.model = Model(raw)
        self.backend = backend(self.model)
        self.runs = Runs(self.model)
        m = self.model
        self.by_word = m.kind == "bpe" and m.cut and m.dummy_prefix and m.escape and not m.squeeze and not m.charsmap
        self.begins = np.array([p.startswith(MARK) for p, _, _ in m.pieces])
        spelt = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-Fa-f]{2}>", p) else p.replace(MARK, " ").encode() for p, _, _ in m.pieces]
        self.letters, self.spelt_size = np.frombuffer(b"".join(spelt), np.uint8), np.array([len(x) for x in spelt], np.int64)
        self.spelt_at = np.cumsum(self.spelt_size) - self.spelt_size
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted; the arrays below go along
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.backend.encode_batch_fast(texts, add_special_tokens=False)]

    def _code(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words, starts, sizes) of words without their first space."""
        runs = np.array([w[:1] in ("", " ") for w in words], bool)
        simple, odd = [w for w in words if w[:1] not in ("", " ")], [w for w in words if w[:1] in ("", " ")]
        # Every word begins with the only piece of it that begins with the marker.
        parts = [" ".join(simple[i : i + WORDS_TOGETHER]) for i in range(0, len(simple), WORDS_TOGETHER)]
        flat = np.concatenate([np.zeros(0, np.int32), *(np.array(x, np.int32) for x in self._whole(parts))])
        begin = np.append(np.flatnonzero(self.begins[flat]), len(flat))
        more = [self.runs.encode(MARK + w.replace(" ", MARK)) for w in odd]
        size = np.empty(len(words), np.int64)
        size[~runs], size[runs] = np.diff(begin), [len(x) for x in more]
        ids = np.concatenate([flat, *(np.array(x, np.int32) for x in more)])
        # Back to the order of the words.
        start = np.empty(len(words), np.int64)
        start[~runs], start[runs] = begin[:-1], len(flat) + np.cumsum([0, *size[runs]])[:-1]
        return ids, start, size

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first index of each text with an end)."""
        if not self.by_word:
            ids = self._whole(texts)
            return np.concatenate([np.zeros(0, np.int32), *(np.array(x, np.int32) for x in ids)]), np.cumsum([0, *map(len, ids)])
        # A marker of the text itself acts as a space does.
        raw = [(" " + t.replace(MARK, " ")).encode() if t else b"" for t in texts]
        whole = b"".join(raw)
        data = np.frombuffer(whole, np.uint8)
        offsets = np.cumsum([0, *map(len, raw)])
        new = data == 32
        new[1:] &= data[:-1] != 32
        new[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(data))[: len(start)]
        found, first_seen, which = np.unique(K.span_hashes(data, start, stop), return_index=True, return_inverse=True)
        if len(self.hashes) + len(found) > WORDS_KEPT or len(self.flat) > IDS_KEPT:
            self._forget()
        place = np.searchsorted(self.hashes, found)
        fresh = self.hashes[np.minimum(place, len(self.hashes) - 1)] != found if len(self.hashes) else np.ones(len(found), bool)
        if fresh.any():
            words = [whole[start[i] + 1 : stop[i]].decode() for i in first_seen[fresh]]
            ids, at, size = self._code(words)
            where = place[fresh]
            self.hashes = np.insert(self.hashes, where, found[fresh])
            self.at, self.size = np.insert(self.at, where, at + len(self.flat)), np.insert(self.size, where, size)
            self.flat = np.concatenate((self.flat, ids))
            place = np.searchsorted(self.hashes, found)
        entry = place[which]
        sizes = self.size[entry]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        out = self.flat[np.repeat(self.at[entry] - ends[:-1], sizes) + np.arange(ends[-1])]
        return out, ends[np.searchsorted(start, offsets)]

    def spelled(self, flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, start and end of each text) that ids decode to; what ``decode`` gives, where that is UTF-8."""
        size = self.spelt_size[flat]
        ends = np.concatenate(([0], np.cumsum(size)))
        data = self.letters[np.repeat(self.spelt_at[flat] - ends[:-1], size) + np.arange(ends[-1])]
        start, stop = ends[first[:-1]], ends[first[1:]]
        if self.model.dummy_prefix:
            some = np.flatnonzero(start < stop)
            start[some] += data[start[some]] == 32
        return data, start, stop

    def checked(self, texts: list[str], flat: np.ndarray, first: np.ndarray, verify_every: int) -> tuple[list[bool], list[bool | None]]:
        """(whether each text decodes to itself, parity of each or null) of whole texts."""
        data, start, stop = self.spelled(flat, first)
        same = [data[a:b].tobytes() == t.encode() for a, b, t in zip(start, stop, texts, strict=True)]
        agree: list[bool | None] = [None] * len(texts)
        asked = [i for i, t in enumerate(texts) if chosen(t, verify_every)]
        for i, own in zip(asked, _peer(self.raw).encode_as_numpy([texts[i] for i in asked], num_threads=1) if asked else (), strict=True):
            agree[i] = np.array_equal(own, flat[first[i] : first[i + 1]])
        return same, agree

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.backend.decode_batch(ids, skip_special_tokens=False)


def chosen(text: str, verify_every: int) -> bool:
    """Whether a text is among those of which parity is verified."""
    return verify_every == 1 or verify_every > 0 and zlib.crc32(text.encode("utf-8", "surrogatepass")) % verify_every == 0


@lru_cache(2)
def _codec(raw: bytes) -> Codec:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    os.environ.setdefault("RAYON_NUM_THREADS", "2")  # each thread keeps memory of its own
    return Codec(raw)


@lru_cache(2)
def _peer(raw: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=raw)


def _coder(raw: bytes, verify_every: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw)
        for batch in batches:
            _, offsets = K.byte_view(batch.column(1))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1)
                part = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                flat, first = codec.encode(part)
                same, agree = codec.checked(part, flat, first, verify_every)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(first)), lists, pa.array(same, pa.bool_()), pa.array(agree, pa.bool_())], names=["doc_id", "n_tokens", "ids", "round_trip", "sample_parity"])
                i = j
            K.tidy()

    return run


def read_model(spark: SparkSession, path: str) -> bytes:
    """A model file, by Spark's reader (any store) or, where the driver alone has it, from its disk."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def encode(docs: DataFrame, model: bytes, verify_every: int = VERIFY_EVERY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip, sample_parity) for every row.

    ``round_trip``: decoding gave the text; ``sample_parity``: the sentencepiece
    library has the same ids for the whole text, asked for every row; only a
    ``verify_every`` other than 1 leaves nulls (0 asks for none).  The model, under a
    MB, goes with the task.
    """
    lean(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_coder(model, verify_every), "doc_id long, n_tokens long, ids array<int>, round_trip boolean, sample_parity boolean")


def _decoder(raw: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw)
        for batch in batches:
            texts = codec.decode([x or [] for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(rows: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from ids; a null list decodes to an empty text."""
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(_decoder(model), "doc_id long, text string")
