"""URL rules, shards, SentencePiece, HTML and neighbours against plain Python."""

import collections
import glob
import html
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import html_text, neighbours, pieces, shards, url_rules
from graphloom.llm.queries import op4_sentencepiece
from graphloom.llm.scratch import Scratch
from tests.llm.data import documents, frame

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def judged(url, rules, default="allow"):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    best = None
    for verdict, rule in rules:
        h, p = (rule.split("/", 1)[0], "/" + rule.split("/", 1)[1]) if "/" in rule else (rule, "")
        if (host == h or host.endswith("." + h)) and path.startswith(p) and host:
            best = max(best or (0, 0, "", ""), (len(rule), len(h), verdict, rule))
    return host, path, best[3] if best else None, best[2] if best else default


@pytest.mark.parametrize("bucket", [2000, 3])
def test_url_rules_equal_plain_python(spark, bucket, monkeypatch):
    monkeypatch.setattr(url_rules, "RULES_A_BUCKET", bucket)
    rng = random.Random(1)
    hosts = ["a.org", "b.a.org", "x.b.a.org", "org", "A.Org", "aa.org", "c.com", "", "a..org", "é.org"]
    paths = ["", "/", "/x", "/x/", "/x/y", "/x/y/z?q=/x", "/xy#f", "/é/😀", "?x", "/x\n/y"]
    urls = ["http://" + rng.choice(hosts) + rng.choice(paths) for _ in range(300)] + [None, "", "no url", "x://y://a.org/x", "://a.org/x"] + ["http://a.org/x/y"] * 50
    rules = [("block", "org/"), ("allow", "a.org/x"), ("block", "a.org/x/y"), ("allow", "b.a.org/"), ("block", "org/x/y"), ("allow", "com"), ("block", "a.org/x/"), ("allow", "é.org/é/"), ("block", "com"), ("allow", "a.org/x")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = url_rules.judge_urls(pages, url_rules.rule_table(spark, rules)).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in got) == sorted((i, h, p, r or "", v) for i, u in enumerate(urls) for h, p, r, v in [judged(u, rules)])
    assert url_rules.judge_urls(pages.limit(0), url_rules.rule_table(spark, rules)).collect() == []
    assert {r.verdict for r in url_rules.judge_urls(pages, url_rules.rule_table(spark, []), "block").collect()} == {"block"}


def test_url_rules_use_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    plan = url_rules.judge_urls(pages, url_rules.rule_table(spark, [("block", "org/")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_shard_store(spark):
    rows = documents()
    store = shards.ShardStore(spark, Scratch(spark, "store").base, target_bytes=1 << 20, fanout=3, smallest_bytes=4096)
    assert store.version() == 0 and store.shards() == []
    docs = frame(spark, rows)
    for part in range(5):
        store.append(docs.filter(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(5)) == part).repartition(2), rows_a_shard=4)
    assert store.version() == 5
    before = store.read().orderBy("doc_id", "text").collect()
    assert collections.Counter(before) == collections.Counter(docs.collect())
    many = len(store.shards())
    version = store.compact()
    assert version > 5 and len(store.shards()) < many
    assert collections.Counter(store.read().collect()) == collections.Counter(before)
    assert collections.Counter(store.read(5).collect()) == collections.Counter(before)
    assert store.vacuum() == 0 and collections.Counter(store.read(5).collect()) == collections.Counter(before)
    assert store.vacuum(older_than=0) >= many - len(store.shards()) and collections.Counter(store.read().collect()) == collections.Counter(before)
    tiers = collections.Counter(store.tier(s.bytes) for s in store.shards() if s.bytes < store.target // 2)
    assert all(n < 3 for n in tiers.values())
    on_disk = collections.Counter(r.p for r in store.read().select(F.substring_index("_metadata.file_path", "/", -2).alias("p")).collect())
    assert on_disk == {s.path: s.rows for s in store.shards()}
    assert all(os.path.getsize(f"{store.base.removeprefix('file://')}/{s.path}") == s.bytes for s in store.shards())
    store.append(docs.limit(0))
    assert store.version() == version + 1 and store.read().count() == len(rows)


def test_shards_by_arrivals_and_their_columns(spark):
    docs = frame(spark, documents()).repartition(6)
    parts = [docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == i) for i in range(3)]
    store, version = shards.shard_documents(parts, Scratch(spark, "store").base)
    assert version > 3 and len(store.shards()) == 1
    assert collections.Counter(store.read(version).collect()) == collections.Counter(docs.collect())
    store.append(docs.limit(2).select("doc_id", F.lit(1).alias("more")))
    store.append(docs.limit(3))
    assert store.read().count() == docs.count() + 5 and store.read().filter("more = 1 and text is null").count() == 2
    with pytest.raises(ValueError):
        store.append(docs.select(F.col("doc_id").cast("string").alias("doc_id")))
    assert store.version() == version + 2


def test_two_writers_commit_one_version_each(spark):
    from pyspark.sql.types import StructType

    base = Scratch(spark, "store").base
    one, two = shards.ShardStore(spark, base), shards.ShardStore(spark, base)
    schema = StructType()
    one._commit(1, [], set(), schema)
    with pytest.raises(shards.Conflict):
        two._commit(1, [shards.Shard("x", 1, 1)], set(), schema)
    assert one.shards(1) == [] and not [p for p in glob.glob(f"{base.removeprefix('file://')}/manifests/_*")]
    with pytest.raises(shards.Conflict):
        two._update([], {"gone"}, schema)


def test_a_late_writer_neither_loses_rows_nor_takes_an_old_version(spark, monkeypatch):
    """A writes its files; B appends twice, merges and vacuums; then A commits."""
    monkeypatch.setattr(shards, "SNAPSHOT_EVERY", 2)
    docs = frame(spark, documents())
    base = Scratch(spark, "store").base
    a, b = (shards.ShardStore(spark, base, target_bytes=1 << 20, fanout=2) for _ in range(2))
    a.append(docs)
    late = a._write(docs.limit(7), "run")
    for _ in range(2):
        b.append(docs)
    b.compact()
    b.vacuum()
    with pytest.raises(shards.Conflict):
        a._commit(2, late, set(), docs.schema)
    assert a._update(late, set(), docs.schema) == b.version()
    assert b.read().count() == 3 * docs.count() + 7
    lost = a._write(docs.limit(7), "run")
    b.append(docs)
    b.vacuum(older_than=0)
    version = b.version()
    with pytest.raises(shards.Conflict):  # its files are gone, and no version names them
        a._update(lost, set(), docs.schema)
    assert b.version() == version and b.read().count() == 4 * docs.count() + 7
    merged = a._write(a.read().coalesce(1), "merged")
    gone = {s.path for s in a.shards()}
    b.append(docs)
    assert b.compact() > version + 1
    with pytest.raises(shards.Conflict):
        a._update(merged, gone, docs.schema)
    assert a.read().count() == 5 * docs.count() + 7


@pytest.mark.skipif(not os.path.exists(MODEL), reason="needs the public model file")
def test_pieces_equal_sentencepiece(spark):
    import sentencepiece

    raw = pieces.read_model(spark, MODEL)
    rng = random.Random(7)
    texts = [t for _, t in documents()] + [" ", "  a", "a  ", "a   b", " " * 70 + "x", "▁▁", "<s></s><unk>", "a" * 3000, "日本語 😀", "tab\tnew\nline"]
    texts += ["".join(rng.choice("ab  e\n▁é😀tionh.<>s/0x") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    peer = sentencepiece.SentencePieceProcessor(model_proto=raw)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in pieces.encode(rows, raw).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].ids == peer.encode(t or "") and got[i].n_tokens == len(got[i].ids)
        assert got[i].sample_parity == (True if pieces.chosen(t or "", pieces.VERIFY_EVERY) else None)
        assert got[i].round_trip == ("▁" not in (t or ""))
    assert all(r.sample_parity for r in pieces.encode(rows, raw, verify_every=1).collect())
    assert all(r.sample_parity is None for r in pieces.encode(rows, raw, verify_every=0).collect())
    back = {r.doc_id: r.text for r in pieces.decode(spark.createDataFrame([(i, r.ids) for i, r in got.items()] + [(-1, None)], "doc_id long, ids array<int>"), raw).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts)) and back[-1] == ""
    assert pieces.encode(rows.limit(0), raw).collect() == []


@pytest.mark.skipif(not os.path.exists(MODEL), reason="needs the public model file")
def test_pieces_of_long_texts_and_runs(spark):
    import time

    raw = pieces.read_model(spark, MODEL)
    codec = pieces.Codec(raw)
    assert codec.runs.even
    rng = random.Random(5)
    odd = [" " * n for n in range(70)] + [" " * rng.randint(0, 200) + rng.choice(["", "the", "é", "😀", "'s"]) + " " * rng.randint(0, 40) + rng.choice(["", "a"]) for _ in range(500)]
    flat, first = codec.encode(odd)
    same, agree = codec.checked(odd, flat, first, 1)
    assert all(same) and all(agree)
    for w in (o.replace(" ", pieces.MARK) for o in odd):  # the general way gives the same
        assert not w.startswith(pieces.MARK * 2) or pieces.MARK in w.lstrip(pieces.MARK) or codec.runs.encode(w) == pieces.merge_word(codec.model, w)
    began = time.perf_counter()
    codec.encode([" " * 1_000_000 + "x"])
    assert time.perf_counter() - began < 1
    pieces.merge_word(codec.model, pieces.MARK * 20_000)
    assert time.perf_counter() - began < 3
    long = ["ab cd  " * 1_500_000, "x" + " " * 10_000_000, "abcde" * 200_000]
    rows = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    assert all(r.round_trip and r.sample_parity for r in pieces.encode(rows, raw, verify_every=1).select("round_trip", "sample_parity").collect())


@pytest.mark.skipif(not os.path.exists(MODEL), reason="needs the public model file")
def test_pieces_ask_sentencepiece_about_every_row(spark, tmp_path):
    frame(spark, documents()).drop("kept", "score").write.parquet(f"{tmp_path}/documents.parquet")
    got = op4_sentencepiece(spark, str(tmp_path)).collect()
    assert len(got) == len(documents()) and all(r.sample_parity is True for r in got)
    codec = pieces.Codec(pieces.read_model(spark, MODEL))
    texts = [t or "" for _, t in documents()] + ["", "a"]
    flat, first = codec.encode(texts)
    assert all(codec.checked(texts, flat, first, pieces.VERIFY_EVERY)[1])
    wrong = flat.copy()
    wrong[first[:-1][np.diff(first) > 0]] = codec.model.unknown  # the first id of each text
    same, agree = codec.checked(texts, wrong, first, pieces.VERIFY_EVERY)
    assert same == agree == [not t for t in texts] and not all(same)


@pytest.mark.skipif(not os.path.exists(MODEL), reason="needs the public model file")
def test_pieces_spelled_as_decoded(spark):
    codec = pieces.Codec(pieces.read_model(spark, MODEL))
    rng = random.Random(11)
    ids = [[i] for i in range(len(codec.model.pieces))] + [[rng.randrange(259, len(codec.model.pieces)) for _ in range(rng.randint(0, 9))] for _ in range(300)]
    texts = ["", " ", "  a", "日本語 😀", "<0x41>", "<s></s><unk>", "▁▁", "\ufffd", "\0\x7f"] + [t or "" for _, t in documents()]
    flat, first = codec.encode(texts)
    ids += [flat[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    data, start, stop = codec.spelled(np.array([i for x in ids for i in x], np.int32), np.cumsum([0, *map(len, ids)]))
    assert [data[a:b].tobytes().decode(errors="replace") for a, b in zip(start, stop, strict=True)] == codec.decode(ids)


def message(*parts):
    """A protobuf message of (field, value): bytes, floats or whole numbers."""
    import struct

    def size(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    out = b""
    for n, v in parts:
        if isinstance(v, bytes):
            out += size(n << 3 | 2) + size(len(v)) + v
        elif isinstance(v, float):
            out += size(n << 3 | 5) + struct.pack("<f", v)
        else:
            out += size(n << 3) + size(v)
    return out


@pytest.mark.skipif(not os.path.exists(MODEL), reason="needs the public model file")
@pytest.mark.parametrize("squeeze", [0, 1])
def test_pieces_large_unigram_with_character_map(spark, squeeze):
    """The public file's pieces as a unigram model, with the library's own NFKC map: scores, map, fallback."""
    import sentencepiece

    source = pieces.Model(pieces.read_model(spark, MODEL))
    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    charsmap = dict(pieces._fields(dict(pieces._fields(rule))[3]))[2]
    assert len(charsmap) > 10_000
    every = [message((1, message((1, p.encode()), (2, -(i + 1) ** 0.5 / 7), (3, kind)))) for i, (p, _, kind) in enumerate(source.pieces)]
    raw = b"".join(every) + message((2, message((3, 1), (35, 1))), (3, message((1, b"nmt_nfkc"), (2, charsmap), (3, 1), (4, squeeze), (5, 1))))
    peer = sentencepiece.SentencePieceProcessor(model_proto=raw)
    codec = pieces.Codec(raw)
    assert codec.model.kind == "unigram" and codec.model.charsmap and not codec.by_word
    texts = [t or "" for _, t in documents()] + ["ﬁne ½ Ⅷ ｆｕｌｌ", "a\u00a0b", "e\u0301", "①②", "the  cats", "日本語 😀", "tab\tnew\nline", "ÅÅ", "1 234,5"]
    flat, first = codec.encode(texts)
    got = [flat[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == peer.encode(texts)
    assert all(codec.checked(texts, flat, first, 1)[1])


def test_pieces_unigram_with_normaliser_and_fallback():
    """A hand-made unigram model: whole texts, squeezed spaces, byte fallback."""
    import sentencepiece

    piece = lambda p, score, kind: message((1, message((1, p.encode()), (2, float(score)), (3, kind))))
    words = ["▁the", "▁cat", "▁c", "at", "▁", "the", "s", "a", "t", "h", "e", "c"]
    raw = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3) + b"".join(piece(f"<0x{b:02X}>", 0, 6) for b in range(256))
    raw += b"".join(piece(w, -1.5 - i / 3, 1) for i, w in enumerate(words))
    raw += message((2, message((3, 1), (35, 1))), (3, message((1, b"identity"), (3, 1), (4, 1), (5, 1))))
    peer = sentencepiece.SentencePieceProcessor(model_proto=raw)
    codec = pieces.Codec(raw)
    assert codec.model.kind == "unigram" and codec.model.byte_fallback
    texts = ["the cat", "the  cats ", " cat é", "", "thecat", "ééé the"]
    flat, first = codec.encode(texts)
    assert all(codec.checked(texts, flat, first, 1)[1]) and [flat[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == peer.encode(texts)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li>News</ul></nav>
<div class="cookie-notice">We use cookies</div>{article}<aside>Side</aside><form><input name="q">Search</form><section class="comments"><article class="comment"><p>Nice!</p></article></section><footer>&copy; X</footer></body></html>"""


def test_html_by_wrappers(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for i in range(600):
        blocks = [f"Title {i}"] + [" ".join(rng.choice(["alpha", "beta &amp; co", "gamma", "a<b>b</b>c", "d<br>e"]) for _ in range(rng.randint(5, 30))) for _ in range(rng.randint(1, 6))]
        body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}" + ("</p>" if rng.random() < 0.6 else "\n") for b in blocks[1:])
        if i % 3 == 0:
            body += '<div class="ad-box">Buy</div><script>var x = "</p>";</script>'
        named = i % 4 != 3
        rows.append((i, f"http://h{0 if i < 70 else i % 5}.org/{i}", PAGE.format(article=f"<article>{body}</article>" if named else f'<div class="post-content">{body}</div>')))
        want[i] = "\n".join(" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks)
    rows += [(700, None, None), (701, "nothing", ""), (702, "http://h0.org/x", "<p>only this paragraph of text"), (703, "http://z.org/", "plain words"), (0, rows[0][1], rows[0][2])]
    want |= {700: "", 701: "", 702: "only this paragraph of text", 703: "plain words"}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).repartition(5)
    got = html_text.main_text(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)
    assert html_text.main_text(pages.limit(0)).collect() == []


def test_wrapper_has_options_repeats_and_slots():
    a = html_text.page_part("<div><h1>One</h1><p>x</p><p>y</p><b>z</b></div><span>Same</span>")
    b = html_text.page_part("<div><h1>Two</h1><ul><li>1<li>2</ul><p>w</p></div><span>Same</span>")
    whole = html_text.merge(a, b)
    assert whole.expression() == "<><div><h1>TEXT</>(<ul>(<li>SAME</>)+</>)?(<p>TEXT</>)+(SAME)?</>SAME</>"
    assert html_text.Part.unpack(whole.pack()).pack() == whole.pack()


def texts_of(pages, order=None):
    decisions = html_text.decide(html_text.wrapper_of(pages if order is None else [pages[i] for i in order]))
    return [html_text.extract(p, decisions) for p in pages]


def running(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_article_without_a_name_is_the_running_text():
    rng = random.Random(1)
    body = [running(rng, n) for n in (40, 50, 60, 70)]
    pages = [f"<body><div><a>Home</a></div><table><tr><td>{b}</td></tr><tr><td>Site of the year</td></tr></table></body>" for b in body]
    assert texts_of(pages) == [f"{b}\nSite of the year" for b in body]


def test_nothing_beside_the_paragraphs_is_lost():
    words = lambda n: " ".join(["words"] * n)
    page = lambda i: f"<html><body><header>Site</header><div><a>Home</a></div><h1>Title {i}</h1><p>{words(90 + i)}</p><p>more {i}</p><ul><li>one {i}<li>two</ul><blockquote>quote {i}</blockquote><p>end {i}<table><tr><td>cell {i}</table></body></html>"
    for i, got in enumerate(texts_of([page(i) for i in range(6)])):
        assert got.split("\n") == [f"Title {i}", words(90 + i), f"more {i}", f"one {i}", "two", f"quote {i}", f"end {i}", f"cell {i}"]
    split = [f"<body><div class=a><div class=x><p>{words(200 + i)}</div><div class=y>short {i}</div></div><div class=b>last {i}</div></body>" for i in range(2)]
    assert texts_of(split)[1].split("\n") == [words(201), "short 1", "last 1"]
    linked = f"<body><h2><a>Linked title</a></h2><p>{words(90)}</p></body>"
    assert html_text.extract(linked, None) == f"Linked title\n{words(90)}"


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, "http://c.org/", "<p>only this paragraph of text</p>") for i in range(5)]
    rows += [(10 + i, f"http://d.org/{i}", "<body><h1>Copied</h1><p>short</p><h2>Part</h2><p>" + "words " * 60 + "</p></body>") for i in range(6)]
    rows += [(20 + i, f"http://e.org/{i}", f"<body><div class=ad>Buy {i}</div><article><p>short</p><p>" + "words " * 60 + "</p></article></body>") for i in range(6)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "only this paragraph of text" for i in range(5))
    assert all(got[10 + i] == "Copied\nshort\nPart\n" + " ".join(["words"] * 60) for i in range(6))
    assert all(got[20 + i] == "short\n" + " ".join(["words"] * 60) for i in range(6))


def test_template_is_told_by_constant_slots():
    rng = random.Random(2)
    body = [[running(rng, 30), running(rng, 20)] for _ in range(5)]
    page = lambda b, more="": f"<body><article><p>Terms &amp; notes apply</p>{''.join(f'<p>{x}</p>' for x in b)}<h2>Summary</h2><p>{b[0][:9]}</p>{more}</article></body>"
    want = lambda b: "\n".join([*b, "Summary", b[0][:9]])
    assert texts_of([page(b) for b in body[:4]]) == [want(b) for b in body[:4]]  # a heading stays
    assert texts_of([page(b) for b in body[:3]]) == ["Terms & notes apply\n" + want(b) for b in body[:3]]  # too few pages to tell
    assert texts_of([page(body[i % 2]) for i in range(6)])[0] == "Terms & notes apply\n" + want(body[0])  # two pages, three times each
    other = page(body[4]).replace("Terms &amp; notes apply", "Something else")
    assert texts_of([*(page(b) for b in body[:4]), other])[0] == "Terms & notes apply\n" + want(body[0])  # not constant
    notice = "All rights of this site " * 20
    rows = [f"<body><div class=x>{notice}</div><div class=y><h1>Title {i}</h1>{'<h2>Summary</h2>' if i else ''}<p>{running(rng, 300)}</p><p>end</p><p>last {i}</p></div></body>" for i in range(5)]
    assert all(notice.strip() not in t and t.startswith(f"Title {i}") and t.endswith(f"last {i}") for i, t in enumerate(texts_of(rows)))


def test_few_texts_for_many_pages_are_adverts():
    rng = random.Random(3)
    body = [running(rng, 60) for _ in range(30)]
    ads = [running(rng, 6) for _ in range(4)]
    pages = [f"<body><div class=q>{ads[i % 4]}</div><div class=r><p>{b}</p><div class=s>{ads[i % 3]}</div><p>{b[::-1]}</p></div></body>" for i, b in enumerate(body)]
    assert texts_of(pages) == [f"{b}\n{b[::-1]}" for b in body]


def test_options_and_repeats_decide():
    """Lists that some pages lack, at the end, are comments; altering either flag keeps them."""
    rng = random.Random(4)
    body = [running(rng, 60) for _ in range(8)]
    comments = lambda i: f"<section>{''.join(f'<div><p>{running(rng, 5)}</p></div>' for _ in range(i % 3))}</section>" if i % 3 else ""
    pages = [f"<body><article><h1>T {i}</h1><p>{b}</p>{comments(i)}</article></body>" for i, b in enumerate(body)]
    wrapper = html_text.wrapper_of(pages)
    assert [html_text.extract(p, html_text.decide(wrapper)) for p in pages] == [f"T {i}\n{b}" for i, b in enumerate(body)]
    section = next(p for p in wrapper.walk() if p.sig == "section")
    item = section.children[0]
    assert section.optional and item.many
    for part, flag in ((section, "optional"), (item, "many")):
        setattr(part, flag, False)
        assert len(html_text.extract(pages[2], html_text.decide(wrapper)).split("\n")) > 2
        setattr(part, flag, True)


def test_steps_and_leads_are_no_comments_and_adverts():
    rng = random.Random(11)
    body = [running(rng, 60) for _ in range(9)]
    steps = [[running(rng, 12) for _ in range(3)] for _ in body]
    lead = [running(rng, 9) for _ in range(3)]
    shapes = {
        "bare": lambda x: f"<div class=steps>{''.join(f'<div>{y}</div>' for y in x)}</div>",
        "headed": lambda x: f"<section><h2>Steps</h2>{''.join(f'<div><p>{y}</p></div>' for y in x)}</section>",
        "alone": lambda x: "".join(f"<div>{y}</div>" for y in x),
    }
    for name, shape in shapes.items():
        for begin, end in (("<article>", "</article>"), ("<div class=c>", "</div>")):
            pages = [f"<body><nav>n</nav>{begin}<h1>T {i}</h1><p>{b}</p>{shape(steps[i]) if i % 2 else ''}{end}</body>" for i, b in enumerate(body)]
            want = ["\n".join([f"T {i}", b, *([*(["Steps"] if name == "headed" else []), *steps[i]] if i % 2 else [])]) for i, b in enumerate(body)]
            assert texts_of(pages) == want, name
    pages = [f"<body><article><h1>T {i}</h1><div class=lead>{lead[i % 3]}</div><p>{b}</p></article></body>" for i, b in enumerate(body)]
    assert texts_of(pages) == [f"T {i}\n{lead[i % 3]}\n{b}" for i, b in enumerate(body)]
    replies = lambda i: f"<section><h3>Comments</h3>{''.join(f'<div><p>{running(rng, 5)}</p><p>Reply</p></div>' for _ in range(1 + i % 3))}</section>"
    pages = [f"<body><article><h1>T {i}</h1><p>{b}</p>{replies(i) if i % 2 else ''}</article></body>" for i, b in enumerate(body)]
    assert texts_of(pages) == [f"T {i}\n{b}" for i, b in enumerate(body)]


def random_page(rng, words):
    """A page of random elements, few of which repeat from page to page."""
    def level(deep):
        out = []
        for _ in range(rng.randint(1, 4)):
            tag = rng.choice(["div", "section", "p", "h2", "ul", "div class=a", "div class=b"])
            inner = f"<li>{rng.choice(words)}" if tag == "ul" else level(deep + 1) if tag[0] in "ds" and deep < 3 and rng.random() < 0.7 else rng.choice(words)
            out.append(f"<{tag}>{inner}</{tag.split()[0]}>")
        return "".join(out)

    return f"<body>{level(0)}</body>"


def decisions_of(rows, held, monkeypatch):
    """Host to decision, by the same steps without Spark; ``held``: parts that a task holds."""
    import pyarrow as pa

    monkeypatch.setattr(html_text, "HELD_PARTS", held)
    out = list(html_text._fold_pages(iter([pa.RecordBatch.from_arrays([pa.array([u for _, u, _ in rows]), pa.array([p for *_, p in rows])], names=["host", "html"])])))
    for bits in html_text.BRANCH_BITS:
        table = pa.Table.from_batches(out).sort_by([("host", "ascending"), ("outline", "ascending")])
        out = list(html_text._fold_sorted(bits)(iter(table.to_batches(max_chunksize=7))))
    return {h: html_text.decide(html_text.Part.unpack(w)) for b in out for h, _, w in zip(*(c.to_pylist() for c in b.columns), strict=True)}


def test_texts_do_not_depend_on_files_and_tasks(spark, monkeypatch):
    """Hosts of random pages: any order, number of partitions and size of what a task holds."""
    rng = random.Random(12)
    words = [running(rng, rng.randint(1, 12)) for _ in range(12)]
    rows = [(200 * h + i, f"http://r{h}.org/{i}", random_page(rng, words)) for h in range(40) for i in range(6)]
    rows += [(10_000 + i, "http://hot.org/", random_page(rng, words)) for i in range(200)]
    rows += [(20_000 + i, u, p) for i, (_, u, p) in enumerate(rows[::7])]
    seen = []
    known = decisions_of(rows, 100_000, monkeypatch)
    assert len(known) == len({u for _, u, _ in rows})
    for parts in (1, 5, 3):
        rng.shuffle(rows)
        assert decisions_of(rows, 30 * parts, monkeypatch) == known
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        seen.append({r.page_id: r.text for r in html_text.main_text(pages).collect()})
        assert len(seen[-1]) == len(rows)
    assert seen[0] == seen[1] == seen[2]
    assert sum(map(bool, seen[0].values())) > 0.9 * len(rows)


def test_class_names_have_no_meaning():
    rng = random.Random(5)
    a, b, c = (running(rng, 20) for _ in range(3))
    page = f'<body><article><p>{a}</p><div class="social-history">{b}</div><section class="login-guide">{c}</section></article></body>'
    assert html_text.extract(page, None) == f"{a}\n{b}\n{c}" and texts_of([page] * 5)[4] == f"{a}\n{b}\n{c}"
    pages = [f'<body><div class="story-list"><a>x{i}</a></div><div class="text"><p>{running(rng, 50)}</p><p>end {i}</p></div></body>' for i in range(5)]
    assert all(t.endswith(f"end {i}") and not t.startswith("x") for i, t in enumerate(texts_of(pages)))


def test_what_markup_says():
    page = '<html><head><title>t</title><body><form action=x><div role=navigation>Menu</div><h1>Head</h1><p>a &lt; b<p>c<br>d<aside>side</aside><article>The <b>text</b>. <form>mail</form><article>comment</article><footer>by</footer></article></form>'
    assert html_text.extract(page, None) == "The text ."[:8] + "."
    assert html_text.extract("<body><div role=banner>x</div><main><h1>T</h1><p>y &amp;amp; z</p></main><div>other</div>", None) == "T\ny &amp; z"
    assert html_text.extract("<body><form><h1>T</h1><p>y</p></form></body>", None) == "T\ny"
    assert html_text.extract("<body><section class=c><article>Nice!</article></section><div><p>" + "words " * 40 + "</div>", None) == " ".join(["words"] * 40)


def test_pages_without_end_and_names_without_number():
    import time

    rng = random.Random(6)
    began = time.perf_counter()
    deep = "<div>" * 10_000 + "inside" + "</div>" * 10_000 + "<p>after"
    assert html_text.extract(deep, None) == "inside\nafter"
    mixed = "".join(rng.choice(["<div>", "<p>", "<b>", "<li>", "<ul>", "<form>", "<a href=x>"]) for _ in range(20_000)) + "x"
    html_text.extract(mixed, None)
    body = [[running(rng, 12) for _ in range(20)] for _ in range(300)]
    names = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    pages = ["<body><article>" + "".join(f'<div class="{names()}">{x}</div>' for x in b) + "</article></body>" for b in body]
    wrapper = html_text.wrapper_of(pages)
    assert sum(1 for _ in wrapper.walk()) < 200
    assert [html_text.extract(p, html_text.decide(wrapper)) for p in pages] == ["\n".join(b) for b in body]
    tags = ["div", "p", "blockquote", "ul", "table", "section", "h2", "h3", "pre", "address"]
    pages = ["<body><article>" + "".join(f"<{t}>{x}</{t}>" for x in b for t in [rng.choice(tags)]) * 8 + "</article></body>" for b in body[:40]]
    wrapper = html_text.wrapper_of(pages)
    assert sum(1 for _ in wrapper.walk()) < 200
    assert [html_text.extract(p, html_text.decide(wrapper)) for p in pages] == ["\n".join(b * 8) for b in body[:40]]
    assert time.perf_counter() - began < 20


def test_hosts_equal_wrappers_built_page_by_page(spark):
    """Brute force: hosts of random templates, known texts, any order and number of tasks."""
    rng = random.Random(7)
    rows, want = [], {}
    for h in range(6):
        named, notice, ads = h % 2, running(rng, 8), [running(rng, 5) for _ in range(2)]
        for i in range(12 + 40 * (h == 0)):
            blocks = [f"Title {h} {i}", *(running(rng, rng.randint(20, 60)) for _ in range(rng.randint(1, 5)))]
            inner = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
            body = f"<article><p>{notice}</p>{inner}</article>" if named else f"<div class=c><p>{notice}</p>{inner}</div>"
            page = f"<html><body class=p{i}><nav>Menu</nav><div class=ad>{ads[i % 2]}</div>{body}<footer>f</footer></body></html>"
            want[len(rows)] = "\n".join(blocks)
            rows.append((len(rows), f"http://h{h}.org/{i}", page))
    frame_ = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 7):
        got = {r.page_id: r.text for r in html_text.main_text(frame_.repartition(parts)).collect()}
        assert got == want
    for h in range(6):
        own = [(i, p) for i, u, p in rows if f"h{h}.org" in u]
        assert texts_of([p for _, p in own]) == [want[i] for i, _ in own]
        assert texts_of([p for _, p in own], rng.sample(range(len(own)), len(own))) == [want[i] for i, _ in own]


def plain_nearest(rows, asks, k):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = collections.Counter()
    for q in {i for i, _ in good if asks(i)}:
        v = next(v for i, v in good if i == q)
        best = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w, strict=True))), i) for i, w in good if i != q and len(w) == len(v))[:k]
        for rank, (d, i) in enumerate(best, 1):
            out[q, rank, i, float(f"{d:.12g}")] += 1
    return out


def test_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 60)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 5)
    monkeypatch.setattr(neighbours, "TILE", 16)
    rng = random.Random(3)
    rows = [(i, [rng.randrange(-4000, 4000) / 1024 for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]
    rows += [(400, None), (410, []), (420, [0.0] * 8), (430, [1.0, None] + [0.0] * 6), (440, [float("nan")] * 8), (450, [float("inf")] * 8), (460, [1.0, 2.0]), (470, [1.0, 2.5]), (None, rows[0][1]), (480, [1e6] * 8)]
    df = spark.createDataFrame([(i, v, 0.1) for i, v in rows], "vec_id long, embedding array<float>, score double")
    got = neighbours.nearest(df, F.col("vec_id") % 10 == 0).collect()
    assert collections.Counter((r.query_id, r["rank"], r.vec_id, float(f"{r.score:.12g}")) for r in got) == plain_nearest(rows, lambda i: i % 10 == 0, 10)
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_neighbours_of_huge_and_tiny_vectors(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) * 10.0**e for _ in range(6)]) for i, e in enumerate([200] * 30 + [-200] * 30 + [0] * 30)] + [(200, [1.7e308] * 6), (210, [-1.7e308] * 6)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0).collect()
    vectors = dict(rows)
    for q in [i for i in vectors if i % 10 == 0]:
        own = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        best = sorted(math.dist(vectors[q], v) for i, v in rows if i != q)[:10]
        assert len({i for _, i, _ in own}) == 10 == len(own)
        assert all(a == d or abs(a - d) <= 1e-12 * d for (_, _, a), d in zip(own, best, strict=True))
        assert all(a == (d := math.dist(vectors[q], vectors[i])) or abs(a - d) <= 1e-12 * d for _, i, a in own)


def test_bounds_hold():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(50, 32)), rng.normal(size=(70, 32)) * 100
    low, high = neighbours.bounds(neighbours.quantise(a), neighbours.quantise(b))
    true = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    assert (low <= true).all() and (true <= high).all()
