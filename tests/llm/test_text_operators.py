"""Quality rules, the classifier, secret scans and mixing against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import mixing, quality_model, quality_rules, secret_scan, textkernel
from tests.llm.data import documents, frame, prose


def base_measures(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    count = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {j for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked)


def test_quality_rules_equal_plain_python(spark):
    rows = documents()
    got = quality_rules.judge(frame(spark, rows)).collect()
    want = collections.Counter((i, *base_measures(t)) for i, t in rows)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.posterior >= quality_rules.KEEP_AT)
    kept = {r.doc_id for r in got if r.kept}
    assert kept >= set(range(30)) and not kept & {i for i, t in rows if t and ("WIN!!" in t or "buy***" in t)}
    assert sorted(r.doc_id or -1 for r in quality_rules.keep_good(frame(spark, rows)).collect()) == sorted(r.doc_id or -1 for r in got if r.kept)


def test_quality_rules_on_nothing(spark):
    assert quality_rules.judge(frame(spark, [])).collect() == []
    assert quality_rules.keep_good(frame(spark, [])).collect() == []


def plain_em(counts, rules, kinds):
    """The same model, one document pattern, class and rule at a time."""
    n_classes = len(kinds) + 1
    own = [[c > 0 and j in kinds[c - 1] for j in range(rules)] for c in range(n_classes)]
    rel = [[[0.05, 0.6, 0.35] if own[c][j] else [0.038, 0.002, 0.96] for j in range(rules)] for c in range(n_classes)]
    share = [0.9] + [0.1 / len(kinds)] * len(kinds)
    for _ in range(500):
        post = {}
        for p in counts:
            each = list(share)
            for c in range(n_classes):
                for j, v in enumerate(quality_rules.votes_of(p, rules)):
                    each[c] *= rel[c][j][v + 1]
            post[p] = [x / sum(each) for x in each]
        for c in range(n_classes):
            total = sum(n * post[p][c] for p, n in counts.items())
            for j in range(rules):
                rel[c][j] = [(sum(n * post[p][c] for p, n in counts.items() if quality_rules.votes_of(p, rules)[j] + 1 == k) + 0.5) / (total + 1.5) for k in range(3)]
        for c in range(1, n_classes):
            for j in range(rules):
                if own[c][j] and rel[0][j][1] > rel[c][j][1]:
                    rel[c][j] = list(rel[0][j])
        n = sum(counts.values())
        share = [(sum(counts[p] * post[p][c] for p in counts) + 1) / (n + n_classes) for c in range(n_classes)]
    return {p: x[0] for p, x in post.items()}


def test_em_equals_plain_loops():
    rng = random.Random(2)
    counts = collections.Counter()
    for _ in range(3000):
        bad = rng.random() < 0.15
        kind = rng.randrange(2)
        votes = [(0 if rng.random() < 0.9 else -1) if bad and j // 3 == kind else (1 if rng.random() < 0.97 else rng.choice([-1, 0])) for j in range(7)]
        counts[int(quality_rules.pattern(np.array([votes]))[0])] += 1
    kinds = ((0, 1, 2), (3, 4, 5))
    got, want = quality_rules.posteriors(dict(counts), 7, kinds), plain_em(counts, 7, kinds)
    assert all(abs(got[p] - want[p]) < 1e-3 for p in counts)


def pattern_of(*bad):
    return int(quality_rules.pattern(np.array([[0 if j in bad else 1 for j in range(len(quality_rules.RULES))]]))[0])


def test_kinds_of_defect_are_learnt():
    """Whatever rules agree beyond chance make a kind, beside others or alone, at any size."""
    for size in (1, 1000):
        for others in (0, 500):
            counts = {pattern_of(): 9500 - others, pattern_of(7, 8, 9): 500, pattern_of(1, 2, 3): others // 2, pattern_of(4, 5, 6): others - others // 2}
            counts = {p: n * size for p, n in counts.items() if n}
            assert set(quality_rules.learn(counts)) == ({(7, 8, 9), (1, 2, 3), (4, 5, 6)} if others else {(7, 8, 9)})
            assert all((x > 0.99) if p == pattern_of() else (x < 0.01) for p, x in quality_rules.posteriors(counts).items())
    assert quality_rules.learn({}) == () and quality_rules.posteriors({}) == {}


def test_chance_and_single_rules_are_no_kind():
    """Rules that err independently, and one rule's habit, leave every document good."""
    rng = random.Random(8)
    counts = collections.Counter()
    for _ in range(20_000):
        counts[pattern_of(*(j for j in range(10) if rng.random() < (0.15 if j == 9 else 0.03)))] += 1
    for size in (1, 1000):
        own = {p: n * size for p, n in counts.items()}
        assert quality_rules.learn(own) == ()
        assert all(x > 0.99 for x in quality_rules.posteriors(own).values())


def test_one_defect_counts_once():
    """However many copies of a rule there are, a document of one odd vote by another rule stays good."""
    for copies in (3, 6):
        counts = collections.Counter()
        rng = random.Random(3)
        for i in range(5000):
            symbols = 0 if i % 10 == 0 else 1
            votes = [symbols] * copies + [0 if rng.random() < 0.02 else 1 for _ in range(2)]
            counts[int(quality_rules.pattern(np.array([votes]))[0])] += 1
        post = quality_rules.posteriors(dict(counts), copies + 2, (tuple(range(copies)),))
        for p, x in post.items():
            v = quality_rules.votes_of(p, copies + 2)
            assert (x < 0.01) if v[0] == 0 else (x > 0.99)


def test_classifier_learns_and_holds_out(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 80) if i % 3 else prose(rng, 80).replace(" ", "### ").upper()) for i in range(600)] + [(600, None), (601, ""), (602, "a " * 50000), (None, "x")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(3, None, 0), (10**9, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_model.classify(frame(spark, rows), labels).collect()
    assert len(got) == len(rows)
    right = 0
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        right += r.doc_id is not None and r.doc_id < 600 and r.held_out and r.predicted == int(r.doc_id % 3 > 0)
    assert right >= 0.98 * sum(r.held_out and r.doc_id < 600 for r in got)
    assert quality_model.classify(frame(spark, []), labels).collect() == []
    none = quality_model.classify(frame(spark, rows[:5]), labels.limit(0)).collect()
    assert all(r.score == 0.5 for r in none)


def plain_hash(word):
    """The text kernel's hash of a span, one byte at a time."""
    mask, total, power = (1 << 64) - 1, 0, 1
    for b in word.encode():
        total = (total + int(textkernel._BYTE[b]) * power) & mask
        power = power * int(textkernel._BASE) & mask
    return plain_mix((total + len(word.encode()) * int(textkernel._MUL[15])) & mask)


def plain_mix(x):
    for _ in range(2):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & (1 << 64) - 1
    return x ^ x >> 32


def plain_vector(text):
    """{bucket: value} of a text by a regular expression and dictionaries."""
    tokens = re.findall(r"[0-9A-Za-z_\u0080-\U0010ffff]+|[^0-9A-Za-z_\u0080-\U0010ffff\x20\x09-\x0D]+", text or "")
    h = [plain_hash(t) for t in tokens]
    bits = 64 - quality_model.BITS
    count = collections.Counter(x >> bits for x in h)
    for a, b in zip(h, h[1:], strict=False):
        count[plain_mix((a * int(textkernel._MUL[0]) + b * int(textkernel._MUL[1])) & (1 << 64) - 1) >> bits] += 1
        if a == b:
            count[1] += 1
    count[0] += 1
    value = {k: 1 + math.log(n) for k, n in count.items()}
    size = math.sqrt(sum(x * x for x in value.values()))
    return {k: float(np.float32(x / size)) for k, x in value.items()}


def plain_ftrl(rows):
    """{bucket: weight}: one coordinate at a time."""
    q, z, n = quality_model, collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= q.L1 else -(z[i] - math.copysign(q.L1, z[i])) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + q.L2)

    for _ in range(q.EPOCHS):
        for label, vector in rows:
            w = {i: weight(i) for i in vector}
            p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in vector.items())))
            for i, x in vector.items():
                g = (p - label) * x
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / q.ALPHA * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_classifier_equals_plain_python(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 30) + (" !!! ### go go go" if i % 2 else " naïve, café") * (i % 4)) for i in range(120)] + [(120, None), (121, "  "), (122, "x\ny"), (7, "another text of an id")]
    labels = [(i, i % 2) for i in range(100)] + [(3, 0), (120, 0)]
    docs = frame(spark, rows)
    got = {(r.doc_id, r.score) for r in quality_model.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    text = collections.defaultdict(list)
    for i, t in rows:
        text[i].append(t)
    known = [(i, y, t) for i, y in labels if zlib.crc32(str(i).encode()) % 5 for t in text[i]]
    at = {r.i: r.at for r in spark.createDataFrame([(i,) for i in text], "i long").select("i", F.xxhash64("i").alias("at")).collect()}
    vectors = [(at[i], y, plain_vector(t)) for i, y, t in known]
    vectors.sort(key=lambda v: (v[0], v[1], len(v[2]), sorted(v[2])))
    w = plain_ftrl([v[1:] for v in vectors])
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(1 / (1 + math.exp(-sum(w.get(k, 0.0) * x for k, x in plain_vector(t).items()))))
    assert len({round(s, 9) for _, s in got}) > 50
    assert all(min(abs(s - x) for x in want[i]) < 1e-6 for i, s in got) and len(got) >= len(want)


def test_classifier_sample_is_bounded(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, prose(rng, 20) + ("!!! " * 9 if i % 2 else "")) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label int, text string")
    weights = quality_model.fit(df, max_rows=40)
    assert 0 < (weights != 0).sum() <= 40 * 60
    assert (quality_model.fit(df, max_rows=40) == weights).all()
    few = quality_model.fit(df, max_values=200)
    assert 0 < (few != 0).sum() <= 200 and (quality_model.fit(df.repartition(7), max_values=200) == few).all()


def test_classifier_joins_many_labels(spark, monkeypatch):
    rng = random.Random(4)
    docs = frame(spark, [(i, prose(rng, 20)) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    want = collections.Counter(quality_model.classify(docs, labels).collect())
    monkeypatch.setattr(quality_model, "BROADCAST_LABELS", 0)
    assert collections.Counter(quality_model.classify(docs, labels).collect()) == want


def test_texts_of_ten_megabytes(spark):
    """Whole long texts: measures, scores and signatures without more memory than a few times their length."""
    from graphloom.llm import neardup

    words = [f"w{i % 1009}x{i % 733}" for i in range(1_200_000)]
    long = " ".join(words)
    assert len(long) > 10_000_000
    rows = [(0, long), (1, long + " end"), (2, "a " * 5_000_000), (3, "b" * 10_000_000), (4, "\n" * 10_000_000)]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert [got[i].n_words for i in range(5)] == [1_200_000, 1_200_001, 5_000_000, 1, 0]
    assert got[2].n_repeat_words == 5_000_000 and got[3].word_chars == 10_000_000
    labels = spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, quality int")
    assert len(quality_model.classify(docs, labels).collect()) == 5
    found = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    assert [found[i].component_id for i in range(5)] == [0, 0, 2, 3, 4] and [found[i].n_shingles for i in (2, 3, 4)] == [1, 1, 0]


PATTERNS = (re.compile(secret_scan.ASSIGN), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"), re.compile(secret_scan.TOKEN))


def plain_spans(text, table):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in PATTERNS[0].finditer(t) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, m.end()) for m in PATTERNS[1].finditer(t) if len(m.group()) >= 18]
    out += [(m.start(), 2, m.end()) for m in PATTERNS[2].finditer(t) if len(m.group()) >= 16]
    index = lambda c: secret_scan.ALPHABET.find(c) + 1
    for m in PATTERNS[3].finditer(t):
        g = m.group()
        ratio = sum(table[index(a) * secret_scan.CLASSES + index(b)] for a, b in zip(g, g[1:], strict=False))
        if ratio > secret_scan.MARGIN + secret_scan.SHORT * max(0, secret_scan.LONG - len(g)) and not any(a < m.end() and m.start() < b for a, _, b in out if _ < 3):
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_secret_scan_equals_plain_python(spark):
    table = secret_scan.train(secret_scan.labelled_samples(spark))
    odd = ["secret=token: abcdefghijklmnop", "SECRET = 'abc' token=\"ABCDEFGHIJKL\"", "é😀 api-key api_key:abcdefghijkl=.", "AKIA" * 6, "deadbeef" * 2 + "x" + "0" * 15, "apikey=" + "a" * 50000, "getUserNameByIndex_2024_default_value", "\u0000token=" + "z9" * 8]
    rows = documents() + [(1000 + i, t) for i, t in enumerate(odd)]
    docs = frame(spark, rows)
    got = secret_scan.report(docs, table).collect()
    text = lambda s: ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in s)
    want = collections.Counter((i, text(plain_spans(t, table))) for i, t in rows)
    assert collections.Counter((r.doc_id, r.spans) for r in got) == want
    for r in got:
        own = [x for x in r.spans.split(",") if x and not x.startswith("random")]
        assert r.base_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in own) for k in secret_scan.KINDS[:3])
    assert any("random" in r.spans for r in got)

    def redacted(t):
        out, at = "", 0
        for a, _, b in plain_spans(t, table):
            if b <= at:
                continue
            out, at = (out if a < at else out + t[at:a] + "[secret]"), b
        return None if t is None else out + t[at:]

    clean = secret_scan.redact(docs, table)
    assert clean.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in clean.collect()) == collections.Counter((i, redacted(t)) for i, t in rows)
    assert secret_scan.report(frame(spark, []), table).collect() == []


def test_secret_scan_of_many_and_long_matches(spark):
    """100,000 spans in one text, and tokens of a million characters, in seconds; many overlaps at chunk ends."""
    import time

    table = secret_scan.train(secret_scan.labelled_samples(spark))
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    token = lambda n: "".join(rng.choice(letters) for _ in range(n))
    runs = " ".join("0123456789abcdef" for _ in range(100_000))
    mixed = "".join(rng.choice([" é ", " token=", " ", "\n", "=", "\U0001f600"]) + rng.choice(["0123456789abcdef" * rng.randint(1, 3), token(rng.randint(10, 40)), "AKIA" + "A1B2C3D4E5F6G7", "plain words"]) for _ in range(1500))
    rows = [(1, runs), (2, "o" * 1_000_000), (3, token(1_000_000)), (4, mixed), (5, "x" * 4095 + " " + "0123456789abcdef" * 2), (6, "0123456789abcdef" * 600), (7, None)]
    docs = spark.createDataFrame([(i, t, "s", "x") for i, t in rows], "doc_id long, text string, _Spans string, secrets string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in secret_scan.report(docs, table).collect()}
    clean = secret_scan.redact(docs, table)
    text = {r.doc_id: r.text for r in clean.collect()}
    assert time.perf_counter() - began < 90 and clean.columns == docs.columns
    assert got[1].n_hex == 100_000 and got[1].spans.endswith("hex:1699983:1699999")
    assert got[2].spans == "" and got[3].spans == "random:0:1000000"
    assert got[4].spans == ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(mixed, table))
    assert text[1] == " ".join(["[secret]"] * 100_000) and text[2] == rows[1][1] and text[3] == "[secret]" and text[7] is None
    assert text[5] == "x" * 4095 + " [secret]" and text[6] == "[secret]"
    out, at = "", 0
    for a, _, b in plain_spans(mixed, table):
        if b > at:
            out, at = (out if a < at else out + mixed[at:a] + "[secret]"), b
    assert text[4] == out + mixed[at:]


def test_markov_models_tell_random_from_names(spark):
    samples = secret_scan.labelled_samples(spark)
    table = secret_scan.train(samples.filter("crc32(sample) % 2 = 0"))
    from pyspark.sql import functions as F

    held = samples.filter("crc32(sample) % 2 = 1 and length(sample) >= 20").select("random", (secret_scan.log_ratio(F.col("sample"), table) > secret_scan.MARGIN).alias("hit")).collect()
    assert sum(r.random == r.hit for r in held) >= 0.97 * len(held)


def test_random_tokens_need_no_digit_and_no_20_characters(spark):
    table = secret_scan.train(secret_scan.labelled_samples(spark))
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    odd = ["".join(rng.choice(a) for _ in range(n)) for a in (letters, letters + "0123456789") for n in (12, 14, 16, 19, 20, 40) for _ in range(40)]
    usual = "antidisestablishmentarianism Donaudampfschifffahrtsgesellschaft anticonstitutionnellement electroencefalografista HTTPServerErrorException state-of-the-art"
    usual = [*usual.split(), "-" * 60, "=" * 12, "o" * 40, "2024-01-15T12", "1234567890123", "/usr/local/lib/python3/site-packages"]
    docs = frame(spark, [(i, f"see {t} here") for i, t in enumerate(odd + usual)])
    got = {r.doc_id: r.spans for r in secret_scan.report(docs, table).collect()}
    hit = [bool(got[i]) for i in range(len(odd))]
    assert sum(hit) >= 0.95 * len(odd) and all(h for h, t in zip(hit, odd, strict=True) if len(t) >= 20)
    assert [t for i, t in enumerate(usual) if got[len(odd) + i]] == []


def key_of(i, text):
    return f"null|{hashlib.md5((text or '').encode()).hexdigest()}" if i is None else i


def draws(seed, i, rate):
    u = int(hashlib.md5(f"{seed}|count|{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
    k, total = 0, math.exp(-rate)
    while total <= u:
        k += 1
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
    return k


def test_mixing_equals_plain_draws(spark):
    rows = [(i, "x" * (10 + i % 7)) for i in range(400)] + [(0, "x" * 10), (None, "yy"), (500, None)]
    docs = frame(spark, rows)
    weights = {"s0": 3.0, "s1": 0.0}
    got = mixing.mix(docs, weights, epochs=2.0, seed="t").collect()
    data = docs.collect()
    sizes = collections.Counter()
    for r in data:
        sizes[r.source] += len(r.text or "")
    weight = {s: weights.get(s, 1.0) for s in sizes}
    rate = {s: 2.0 * sum(sizes.values()) * (weight[s] / sum(weight.values())) / sizes[s] for s in sizes}
    want = collections.Counter()
    for r in data:
        for c in range(draws("t", key_of(r.doc_id, r.text), rate[r.source]) if rate[r.source] else 0):
            want[r.doc_id, c + 1] += 1
    assert collections.Counter((r.doc_id, r.copy_no) for r in got) == want
    assert [r.order_key for r in got] == sorted(r.order_key for r in got)
    share = collections.Counter()
    for r in got:
        share[r.source] += len(r.text or "")
    assert share["s1"] == 0 and abs(share["s0"] / sum(share.values()) - 3 / 5) < 0.08
    assert mixing.mix(frame(spark, []), weights).collect() == []
    parts = mixing.mix(docs, weights, epochs=2.0, seed="t").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 2 * min(r["count"] for r in parts)


def test_mixing_is_the_same_however_rates_reach_the_rows(spark, monkeypatch):
    """Tables, rates alone and a shuffled join make the same copies."""
    rows = [(i, "text " * (1 + i % 7), f"s{i % 40}" if i % 41 else None) for i in range(900)] + [(5000, "rare", "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = []
    for bound in (mixing.BROADCAST_BYTES, 6000, 100):
        monkeypatch.setattr(mixing, "BROADCAST_BYTES", bound)
        got = mixing.mix(docs, {"rare": 60.0, "s3": 0.0}, epochs=3.0, seed="t")
        seen.append(collections.Counter((r.doc_id, r.copy_no, r.order_key) for r in got.collect()))
    assert seen[0] == seen[1] == seen[2] and sum(k[0] == 5000 for k in seen[0]) > 1000


def test_mixing_keeps_columns_of_any_name(spark):
    docs = frame(spark, [(i, "x" * 9) for i in range(50)])
    names = ["copy_no", "Order_Key", "_of", "_cdf", "_rate", "_copies", "_block", "_copy", "rate", "size", "name", "weight"]
    clash = docs.select("*", *(F.lit(-1).alias(n) for n in names))
    for weights in ({}, {"s0": 1e6}):
        got = mixing.mix(clash, weights, seed="t")
        assert got.columns == [*clash.columns, "copy_no_", "order_key_"]
        plain = mixing.mix(docs, weights, seed="t")
        assert collections.Counter(r[:len(docs.columns)] + r[-2:] for r in got.collect()) == collections.Counter(map(tuple, plain.collect()))
        assert all(r[len(docs.columns) + j] == -1 for r in got.limit(5).collect() for j in range(len(names)))


def test_a_small_source_is_repeated_as_often_as_it_takes(spark):
    rows = [(i, "x" * 5000, "big") for i in range(100)] + [(1000, "yy", "small"), (1001, "z", "small"), (1002, "abcd", None), (1003, "m" * 300, "mid")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = collections.Counter()
    for r in mixing.mix(docs, {"big": 9.0}, seed="t").groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("copy_no").alias("d"), F.max("copy_no").alias("m")).collect():
        assert r.n == r.d == r.m
        got[r.doc_id] = r.n
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(t)
    rate = {s: sum(size.values()) * ((9.0 if s == "big" else 1.0) / 12.0) / size[s] for s in size}
    assert rate["small"] > 10_000 and rate[None] > 10_000 and rate["mid"] < 1000
    assert got == +collections.Counter({i: draws("t", i, rate[s]) for i, _, s in rows})
