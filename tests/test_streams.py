"""Streams: incremental answers from kept runs, live tails."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions.terms import XSD
from graphloom.plans.agp import parse_agp
from graphloom.sources.fragments import FragmentStream
from graphloom.streaming import runs
from graphloom.streaming.incremental import IncrementalPattern
from graphloom.streaming.runs import Runs

P = {"t": "urn:x#"}
TRIPLE = "tp string, s struct<kind:int,lex:string,dt:string,lang:string>, p string, o struct<kind:int,lex:string,dt:string,lang:string>"


def iri(x):
    return (T.IRI, f"urn:{x}", None, None)


def text(x):
    return (T.LITERAL, x, XSD + "string", None)


def orders(n, seed=4):
    rng = random.Random(seed)
    rows = [("tp", iri(f"c{i}"), "urn:x#name", text(f"n{i}")) for i in range(n // 3)]
    rows += [("tp", iri(f"o{i}"), "urn:x#by", iri(f"c{rng.randrange(n // 3)}")) for i in range(n)]
    rows += [("tp", iri(f"o{i}"), "urn:x#state", text(rng.choice("ab"))) for i in range(n)]
    rng.shuffle(rows)
    return rows


def expected(rows):
    name = {s: o[1] for _, s, p, o in rows if p.endswith("name")}
    by = {s: o for _, s, p, o in rows if p.endswith("by")}
    return sorted((name[by[s]], o[1], s[1]) for _, s, p, o in rows if p.endswith("state") and s in by and by[s] in name)


def test_incremental_reads_in_proportion_to_the_batch(spark, tmp_path):
    rows = orders(900)
    pattern = parse_agp("{ ?x t:by ?c ; t:state ?s . ?c t:name ?n }", P)
    live = IncrementalPattern(spark, pattern, f"file://{tmp_path}/i", bucket_rows=64)
    cut, small = len(rows) - 8 * 4, list(range(1, 9))
    live.feed(spark.createDataFrame(rows[:cut], TRIPLE), 0)
    kept = sum(sum(r.sizes.values()) for r in live.runs.current())
    for i in small:
        live.feed(spark.createDataFrame(rows[cut + 4 * i - 4 : cut + 4 * i], TRIPLE), i)
    assert max(live.looked[i] for i in small) < kept / 3
    assert sorted(map(tuple, live.answers().select("n", "s", "x").collect())) == expected(rows)
    # Again, by another object over the same folder: nothing changes.
    again = IncrementalPattern(spark, pattern, f"file://{tmp_path}/i", bucket_rows=64)
    again.feed(spark.createDataFrame(rows[:40], TRIPLE), 5)
    again.feed(spark.createDataFrame(rows[:40], TRIPLE), 9)
    assert again.answers().count() == len(expected(rows)) and again.runs.last() == 9


def test_a_failed_batch_runs_again(spark, tmp_path, monkeypatch):
    rows = orders(60)
    live = IncrementalPattern(spark, parse_agp("{ ?x t:by ?c ; t:state ?s . ?c t:name ?n }", P), f"file://{tmp_path}/i")
    live.feed(spark.createDataFrame(rows[:90], TRIPLE), 0)

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError, match="lost"):
        m.setattr(Runs, "commit", lost)
        live.feed(spark.createDataFrame(rows[90:], TRIPLE), 1)
    assert len(live.answers().collect()) == len(expected(rows[:90]))
    live.feed(spark.createDataFrame(rows[90:], TRIPLE), 1)
    assert sorted(map(tuple, live.answers().select("n", "s", "x").collect())) == expected(rows)


def test_runs_are_merged_by_size(spark, tmp_path, monkeypatch):
    kept = Runs(spark, f"file://{tmp_path}/r", "v long", bucket_rows=8, fan=3)
    for i in range(13):
        df = spark.range(i * 10, i * 10 + 10).select(F.xxhash64("id").alias("k"), F.col("id").alias("v"))
        kept.commit(i, [*kept.current(), kept.write(df, 10)])
    found = kept.current()
    assert len(found) <= 5 and sum(r.rows for r in found) == 130 and max(r.mask for r in found) >= 7
    assert sorted(r.v for r in kept.read(found).collect()) == list(range(130))
    keys = spark.range(3).select(F.xxhash64(F.col("id") * 50).alias("k"))
    before = kept.bytes_read
    assert sorted(r.v for r in kept.read(found, keys).collect()) == [0, 50, 100]
    few = kept.bytes_read - before
    monkeypatch.setattr(runs, "MOST_KEYS", 2)
    assert {0, 50, 100} <= {r.v for r in kept.read(found, keys).collect()}
    assert few < kept.bytes_read - before - few


def told(stream, path, **options):
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start().awaitTermination()


def test_tail_tells_what_arrives_during_the_replay_once(spark, tmp_path):
    kept = FragmentStream(spark, f"file://{tmp_path}/s")
    quads = lambda *rows: spark.createDataFrame([("tp", iri(x), "urn:x#p", text("v"), t) for x, t in rows], TRIPLE + ", ts long").coalesce(1)
    kept.append(quads(("a", 10), ("b", 20), ("a", 30)))
    read = lambda: sorted((r.s.lex[4:], r.ts) for r in spark.read.schema(kept.SCHEMA).parquet(f"{tmp_path}/out").collect())
    assert sorted((r.s.lex[4:], r.ts) for r in kept.get(25).collect()) == [("a", 10), ("b", 20)]
    kept.append(quads(("b", 40), ("c", 50), ("c", 50)))
    told(kept.tail(25, files=1), tmp_path)
    assert read() == [("c", 50)]
    kept.append(quads(("a", 60), ("d", 70)))  # after a restart of the query
    told(kept.tail(25, files=1), tmp_path)
    assert read() == [("c", 50), ("d", 70)]


def test_tail_forgets_after_its_time(spark, tmp_path):
    kept = FragmentStream(spark, f"file://{tmp_path}/s")
    arrivals = [("a", 10), ("a", 90), ("b", 120), ("a", 111), ("c", 500), ("a", 505), ("b", 700), ("z", 1500), ("z", 1600), ("z", 1700)]
    for x, t in arrivals:
        kept.append(spark.createDataFrame([("tp", iri(x), "urn:x#p", text("v"), t)], TRIPLE + ", ts long"))
    told(kept.tail(ttl=100, files=1), tmp_path)
    assert sorted((r.s.lex[4:], r.ts) for r in spark.read.schema(kept.SCHEMA).parquet(f"{tmp_path}/out").collect()) == [("a", 10), ("a", 111), ("a", 505), ("b", 120), ("b", 700), ("c", 500), ("z", 1500), ("z", 1700)]
    state = spark.read.format("statestore").load(f"{tmp_path}/c")
    assert state.count() == 1  # z alone may still be told again


def test_put_looks_up_only_what_it_asks_for(spark, tmp_path):
    kept = FragmentStream(spark, f"file://{tmp_path}/s")
    kept._index.bucket_rows = 50
    rows = lambda a, b: spark.createDataFrame([("tp", iri(f"o{i}"), "urn:x#p", text(str(i))) for i in range(a, b)], TRIPLE)
    assert kept.put(rows(0, 2000), 1) == 2000
    whole = sum(sum(r.sizes.values()) for r in kept._index.current())
    kept._index.bytes_read = 0
    assert kept.put(rows(1998, 2002), 2) == 2 and kept.put(rows(1990, 1994), 3) == 0
    assert 0 < kept._index.bytes_read < whole / 2 and kept.get().count() == 2002
