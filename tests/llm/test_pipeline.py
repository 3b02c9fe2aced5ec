"""The pipeline against plain Python, stage by stage, and as a whole."""

import collections
import os

import pytest

from graphloom.llm import quality_rules, secret_scan
from graphloom.llm.queries import MIX_WEIGHTS
from tests.llm.data import documents, frame
from tests.llm.test_neardup import brute
from tests.llm.test_text_operators import draws, key_of, plain_spans

MODEL = os.environ.get("GRAPHLOOM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="needs the public model file")


def redacted(t, table):
    out, at = "", 0
    for a, _, b in plain_spans(t, table):
        if b > at:
            out, at = (out if a < at else out + t[at:a] + "[secret]"), b
    return out + t[at:]


def test_every_stage_equals_plain_python(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality rules", "MinHash near-dedup", "secret scans", "mixing sources", "SentencePiece"]
    rows = [(i, t + f"\napi_key: {'Ab3' * 5}{i}" if i is not None and i % 7 == 0 and t else t) for i, t in documents()]
    frame(spark, rows).drop("kept", "score").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    source = {(r.doc_id, r.text): r.source for r in docs.collect()}
    table = secret_scan.train(secret_scan.labelled_samples(spark))

    good = collections.Counter(r.doc_id for r in quality_rules.judge(docs).collect() if r.kept)
    want = collections.Counter({(i, t): n for (i, t), n in collections.Counter(rows).items() if good[i]})
    out = P.STAGES[0][1](spark, docs, str(tmp_path))
    assert out.columns == columns and collections.Counter((r.doc_id, r.text) for r in out.collect()) == want

    low = brute(list(want))
    want = {(i, t) for i, t in want if i is None or low[i][1] == i}
    out = P.STAGES[1][1](spark, out, str(tmp_path))
    assert out.columns == columns and sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, want))

    clean = {(i, redacted(t, table)): source[i, t] for i, t in want}
    assert any("[secret]" in t for _, t in clean)
    out = P.STAGES[2][1](spark, out, str(tmp_path))
    got = out.collect()
    assert out.columns == columns and {(r.doc_id, r.text) for r in got} == set(clean) and all(r.n_chars == len(r.text) for r in got)

    size = collections.Counter()
    for (_, t), s in clean.items():
        size[s] += len(t)
    weight = {s: MIX_WEIGHTS.get(s, 1.0) for s in size}
    rate = {s: sum(size.values()) * (weight[s] / sum(weight.values())) / size[s] for s in size}
    mixed = collections.Counter({(i, t): draws("pipeline", key_of(i, t), rate[s]) for (i, t), s in clean.items()})
    out = P.STAGES[3][1](spark, out, str(tmp_path))
    assert out.columns == columns and collections.Counter((r.doc_id, r.text) for r in out.collect()) == +mixed

    peer = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    coded = collections.Counter()
    for (i, t), n in mixed.items():
        coded[i, tuple(peer.encode(t))] += n
    got = P.STAGES[4][1](spark, out, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == +coded and all(r.sample_parity is not False and r.round_trip for r in got) and any(r.sample_parity for r in got)

    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in P.run(spark, str(tmp_path)).collect()) == +coded


def test_last_stage_asks_sentencepiece_about_every_row(spark):
    import corpus_pipeline as P

    docs = frame(spark, documents()).drop("kept", "score")
    got = P.STAGES[-1][1](spark, docs, "").collect()
    assert len(got) == len(documents()) and all(r.sample_parity is True for r in got)
