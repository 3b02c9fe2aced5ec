import collections
import hashlib

import numpy as np
import pytest

from graphloom.llm import alignment
from graphloom.llm.queries import byte_tokenizer, sentencepiece_model
from tests.llm.data import documents, frame


def brute(rows, a_file, b_model):
    """Whole texts through both libraries, every pair of tokens compared."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    A, B = Tokenizer.from_str(a_file), SentencePieceProcessor(model_proto=b_model)
    A.encode_special_tokens = True
    byte = alignment._unbyte()
    docs, pairs = [], collections.Counter()
    for i, text in rows:
        s, links, groups = (" " + (text or "")).encode(), collections.Counter(), []
        a = [(x, bytes(byte[c] for c in A.id_to_token(x))) for x in A.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(x, bytes([int(B.id_to_piece(x)[3:5], 16)]) if B.is_byte(x) else B.id_to_piece(x).replace("▁", " ").encode()) for x in B.encode(text or "")]
        if not text or b"".join(x for _, x in a) != s or b"".join(x for _, x in b) != s:
            a, b = [], []
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
        j = k = 0
        for end in sorted(set(ends[0]) | set(ends[1])):
            at = [int(np.searchsorted(side, end)) for side in ends]
            links[a[at[0]][0], b[at[1]][0]] += 1
        for end in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(",".join(str(n) for n, _ in a[j:x]) + "|" + ",".join(str(n) for n, _ in b[k:y]))
            j, k = x, y
        pairs.update(links.keys())
        docs.append((i, len(a), len(b), groups, links))
    best = collections.Counter()
    for (x, _), n in pairs.items():
        best[x] = max(best[x], n)
    out = []
    for i, a, b, groups, links in docs:
        right = sum(n for p, n in links.items() if pairs[p] == best[p[0]])
        total = sum(n * pairs[p] for p, n in links.items())
        out.append((i, a, b, len(groups), sum(links.values()), right, total, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


def odd():
    texts = ["<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "  two  spaces ", " ", "\n \n", "tab\t x \x00\x1c y\x85 z", "x　 y  z\xa0 w  v", "“quoted” — dash … 日本語 テキスト。 次 한국어 글", "it's they'll we've 'd", "é ﬁ Å 😀👍🏽 \U0010ffff", "x" * 5000, " " * 3000 + "end", "a " * 3000, "١٢٣ 123 4.5e6", "\r\n\r\n  \tq"]
    return [(2000 + i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("cells", "fan_in", "salt", "block"), [(8_000_000, 256, 1 << 24, 1 << 21), (40_000_000, 2, 4000, 1 << 14)])
def test_alignment_equals_brute_force(spark, monkeypatch, cells, fan_in, salt, block):
    for k, v in (("STRIPE_CELLS", cells), ("FAN_IN", fan_in), ("SALT_BYTES", salt), ("BLOCK_BYTES", block)):
        monkeypatch.setattr(alignment, k, v)
    rows = [(i, t) for i, t in documents() if len(t or "") < 20000] + odd()
    a, b = byte_tokenizer(spark), sentencepiece_model(spark)
    got = alignment.align(frame(spark, rows).repartition(3), a, b).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, a, b)


def test_pairs_and_empty_tables(spark):
    a, b = byte_tokenizer(spark), sentencepiece_model(spark)
    own = alignment.Alignment(frame(spark, [(1, "the river"), (1, "the river"), (2, "the stone"), (3, None)]), a, b)
    by_best = {r.a_id: r.n_docs for r in own.pairs().filter("best").collect()}
    assert sorted(by_best.values()) == [1, 2, 3]
    assert alignment.align(frame(spark, []), a, b).collect() == []
    assert [tuple(r) for r in alignment.align(frame(spark, [(5, None), (None, "")]), a, b).orderBy("doc_id").collect()] == [(None, 0, 0, 0, 0, 0, 0, ""), (5, 0, 0, 0, 0, 0, 0, "")]
