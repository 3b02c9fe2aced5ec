import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.llm import collocations, decontamination
from tests.llm.data import documents, frame, prose

LOWER = {i: i + 32 for i in range(65, 91)}


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def stands(w, i, window, containment):
    """Whether enough runs of up to three words of the window have their place."""
    size = min(3, len(window))
    k = len(window) - size + 1
    return sum(w[i + j : i + j + size] == list(window[j : j + size]) for j in range(k)) >= max(1, containment * k - 1e-9)


def judged(rows, items, window=10, containment=1.0):
    wins = {}
    for name, text in items:
        w = alnum_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + window]), set()).add(name)
    out = []
    for doc, text in rows:
        w, hit, held = alnum_words(text), set(), set()
        for x, names in wins.items():
            for i in range(len(w) - len(x) + 1):
                if (containment < 1 and set(x) & set(w[i : i + len(x)]) or w[i] == x[0]) and stands(w, i, x, containment):
                    hit |= set(range(i, i + len(x)))
                    held |= {n for n in names if n is not None}
        out.append((doc, len(w), len(hit), len(held), sha(",".join(sorted(held))), bool(hit)))
    return sorted(out, key=str)


def leaked():
    rng = random.Random(3)
    items = [(str(i), prose(rng, rng.randint(8, 40))) for i in range(12)]
    items += [("short", "zebra crossing"), ("one", "xylophone"), ("blank", " .,! "), ("null", None), ("short", "other text of it"), (None, prose(rng, 14)), ("same", items[2][1]), ("2b", items[2][1][:60])]
    rows = [(i, t) for i, t in documents() if len(t or "") < 20000][::3]
    for i, (_, text) in enumerate(items):
        own = alnum_words(text)
        rows.append((1000 + i, prose(rng, 30) + "\n" + "; ".join(own).upper() + " " + prose(rng, 20)))
        rows.append((1100 + i, " ".join(own[1:-1])))
        if len(own) > 12:
            own[rng.randrange(3, 9)] = "other"
            rows.append((1200 + i, prose(rng, 30) + " " + " ".join(own)))
    rows += [(1300, "zebra"), (1301, "Zebra-CROSSING xylophone Xylophone"), (1302, "naïve" * 4)]
    return rows, items


@pytest.mark.parametrize(("window", "containment", "block"), [(10, 1.0, 1000), (10, 1.0, 40), (4, 1.0, 1000), (10, 0.6, 1000), (10, 0.6, 60)])
def test_decontamination_equals_brute_force(spark, window, containment, block):
    rows, items = leaked()
    docs = frame(spark, rows).repartition(3)
    table = spark.createDataFrame(items, "item_id string, text string")
    got = decontamination.contaminated(docs, table, window, containment, block=block)
    assert sorted(map(tuple, got.collect()), key=str) == judged(rows, items, window, containment)


def test_decontamination_of_empty_tables(spark):
    rows, items = leaked()
    none = spark.createDataFrame([], "item_id string, text string")
    assert all(not r.contaminated and r.items_sha256 == sha("") for r in decontamination.contaminated(frame(spark, rows), none).collect())
    assert decontamination.contaminated(frame(spark, []), spark.createDataFrame(items, "item_id string, text string")).collect() == []


def test_decontamination_of_a_window_that_fills_a_text(spark):
    text = "a b c " * 60_000
    got = decontamination.contaminated(frame(spark, [(1, text)]), spark.createDataFrame([("x", "a b c a b c a b c a b"), ("y", "b"), ("z", "c c")], "item_id string, text string")).collect()
    assert [(r.n_words, r.n_hit, r.n_items) for r in got] == [(180_000, 179_999, 2)]  # no window ends with the last c


def mined(rows, least, longest, top, subsume):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    many = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    out = collections.defaultdict(list)
    for (lang, *w), a in many.items():
        inside = lambda x, w=w: any(list(x[i : i + len(w)]) == w for i in range(1, len(x) - len(w) + 1))
        if any(len(x) > len(w) + 1 and x[0] == lang and 100 * b >= subsume * a and inside(x) for x, b in many.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, own in out.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top]))


@pytest.mark.parametrize(("least", "longest", "top", "subsume"), [(3, 5, 40, 100), (6, 3, 2000, 80), (300, 5, 2000, 100)])
def test_collocations_equal_brute_force(spark, least, longest, top, subsume):
    odd = ["New  York\tcity a b. New York, new york city", "c\x0bd\x0cé ü\xa0x é ü\xa0x é ü\xa0x", "x y z w v " * 40, "", None, "lone", ". , ;"]
    rows = [("de" if i % 3 else None, t) for i, (_, t) in enumerate(documents()) if len(t or "") < 20000] + [("en", t) for t in odd * 3] + [("und", "x y z")]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = collocations.collocations(docs, least, longest, top, subsume)
    assert sorted(map(tuple, got.collect())) == mined(rows, least, longest, top, subsume)


def test_a_small_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "RUN", 1 << 6)  # one run, whatever is asked for
    monkeypatch.setattr(collocations, "MOST_CELLS", 1 << 6)
    rows = [("en", t) for _, t in documents() if len(t or "") < 20000]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(docs, 5).collect())) == mined(rows, 5, 5, 2000, 100)
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_collocations_score_exactly_beyond_64_bits(spark):
    rows = [("en", "rare pair, " * 3 + "common " * 200_000)]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), 3, 2).collect()
    assert [(r.phrase, r.a, r.score) for r in got] == [("rare pair", 3, 1000 * 200_006 // 3), ("common common", 199_999, 1000 * 199_999 * 200_006 // 200_000**2)]


def test_queries_of_one_id_are_answered_each(spark):
    from graphloom.llm.neighbours import nearest

    rows = [(100, [0.0, 1.0]), (100, [9.0, 1.0]), (100, [9.0, 1.0]), (1, [0.0, 2.0]), (2, [9.0, 3.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 100, 1)
    assert sorted(map(tuple, got.collect())) == [(100, 1, 1, 1.0), (100, 1, 2, 2.0)]


def test_shards_of_rows_with_a_metadata_column(spark, tmp_path):
    from graphloom.llm.shards import ShardStore

    store = ShardStore(spark, f"file://{tmp_path}/s")
    store.append(spark.range(20).select("id", F.col("id").cast("string").alias("_metadata")))
    assert store.read().count() == 20


def test_open_elements_take_linear_time():
    import time

    from graphloom.llm.html_text import extract

    for part in ("<script", "<title", "<svg ", "<!-- ", "<script>", "</script", "<textarea x"):
        began = time.process_time()
        extract(part * (400_000 // len(part)), None)
        assert time.process_time() - began < 5, part
    assert extract("<article><p>one</p><script <p>two</script  ><p>three</p><!-- <p>four</p></article>", None) == "one\nthree"
