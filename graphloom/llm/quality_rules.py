"""Quality rules as weak supervision.

Each rule votes good, bad or abstains on measures of the whole text.  The votes
are evidence of unknown reliability: expectation-maximisation over the counts
of vote patterns estimates how each rule votes on good documents and on those of
each kind of defect, and how many there are of each; a document is kept if its
posterior probability of being good reaches a threshold.  Rules that measure one
defect in several ways agree because of it, so they are independent only given its
kind: that is why bad documents are not one class but one a kind, and a defect
counts once however many rules see it.  The kinds are learnt: the rules that vote
bad together most beyond what the classes so far explain propose the next one,
which stays if the likelihood gains enough (see learn).  One rule alone is no kind;
its odd votes only lend weight.  The patterns of R rules number
3^R at most, whatever the corpus, so that their counts, made with partial aggregation
over all documents, fit on the driver.

Defined results: null counts as an empty text; a text without words has zero in
every measure and fails the base rules; repeated rows get equal answers; over an
empty table every answer is empty.  Equality of lines and of word windows is
equality of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from graphloom.llm import textkernel as K
from graphloom.llm.scratch import Scratch, unused

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_stops", "n_shouts", "n_capital_runs", "n_symbol_words")
BASE = MEASURES[:5]
RULES = ("length", "symbols", "symbol_words", "symbol_share", "capitals", "capital_runs", "shouts", "dup_lines", "repeats", "stops")
#: What a kind of defect must add to the log-likelihood per document, at any size of the corpus; small ones ask for more (BIC).
LEAST_GAIN = 1e-3
KEEP_AT = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_IS = {name: np.zeros(256, np.int64) for name in ("symbol", "upper", "letter", "stop", "shout", "char")}
_IS["symbol"][list(b"#*$%&|<>")] = 1
_IS["upper"][65:91] = 1
_IS["letter"][65:91] = _IS["letter"][97:123] = 1
_IS["stop"][list(b".?!")] = 1
_IS["shout"][list(b"!")] = 1
_IS["char"][:] = ~K._SPACE
_IS["char"][0x80:0xC0] = 0


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _later_equals(value: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """For each text, how many of its values equal an earlier one."""
    order = np.lexsort((value, text))
    v, t = value[order], text[order]
    same = (v[1:] == v[:-1]) & (t[1:] == t[:-1])
    return np.bincount(t[1:][same], minlength=n)


def measure_block(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The MEASURES of each text, shape (texts, measures)."""
    n = len(offsets) - 1
    hashes, begin, end, first = K.words(data, offsets, lower=False)
    count = np.diff(first)
    start, stop, lines = K.lines(data, offsets)
    inside = np.concatenate(([0], np.cumsum(~K._SPACE[data])))
    full = inside[stop] > inside[start]
    text = np.repeat(np.arange(n), np.diff(lines))[full]
    dup = _later_equals(K.span_hashes(data, start[full], stop[full]), text, n)

    at, window = K.windows(hashes, first, 3)
    owner = np.searchsorted(first, at, "right") - 1
    order = np.lexsort((window, owner))
    v, t = window[order], owner[order]
    same = np.zeros(len(v) + 1, bool)
    same[1:-1] = (v[1:] == v[:-1]) & (t[1:] == t[:-1])
    twice = at[order[same[:-1] | same[1:]]] if len(v) else at
    marked = np.zeros(len(hashes), np.int64)
    for j in range(3):
        marked[twice + j] = 1
    columns = [count, _per_text(_IS["char"][data], offsets), _per_text(_IS["symbol"][data], offsets), dup, _per_text(marked, first), np.bincount(text, minlength=n)]
    columns += [_per_text(_IS[k][data], offsets) for k in ("upper", "letter", "stop", "shout")]
    runs = _IS["upper"][data]
    runs[1:] &= runs[:-1].copy()
    runs[offsets[:-1][offsets[:-1] < len(data)]] = 0
    symbols = np.concatenate(([0], np.cumsum(_IS["symbol"][data])))
    columns += [_per_text(runs, offsets), _per_text((symbols[end] > symbols[begin]).astype(np.int64), first)]
    return np.stack(columns, axis=1)


def votes(m: np.ndarray) -> np.ndarray:
    """Votes of the RULES on measures: 1 good, 0 bad, -1 abstain."""
    g = dict(zip(MEASURES, m.T.astype(np.float64), strict=True))
    words, lines, letters = (np.maximum(g[k], 1) for k in ("n_words", "n_lines", "n_letters"))
    chars = np.maximum(g["word_chars"], 1)
    by = (
        (g["n_words"] >= 50, g["n_words"] < 20),
        (g["n_symbols"] / words <= 0.05, g["n_symbols"] / words > 0.25),
        (g["n_symbol_words"] / words <= 0.03, g["n_symbol_words"] / words > 0.15),
        (g["n_symbols"] / chars <= 0.01, g["n_symbols"] / chars > 0.05),
        (g["n_upper"] / letters <= 0.2, g["n_upper"] / letters > 0.4),
        (g["n_capital_runs"] / letters <= 0.1, g["n_capital_runs"] / letters > 0.25),
        (g["n_shouts"] / words <= 0.1, g["n_shouts"] / words > 0.4),
        (g["n_dup_lines"] / lines <= 0.2, g["n_dup_lines"] / lines > 0.5),
        (g["n_repeat_words"] / words <= 0.2, g["n_repeat_words"] / words > 0.4),
        (g["n_stops"] / words >= 0.02, g["n_stops"] / words < 0.005),
    )
    out = np.full((len(m), len(RULES)), -1, np.int64)
    for j, (good, bad) in enumerate(by):
        out[good, j] = 1
        out[bad, j] = 0
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    """Votes as one number in base 3."""
    return (v + 1) @ (3 ** np.arange(v.shape[1]))


def votes_of(pattern_id: int, rules: int) -> list[int]:
    return [pattern_id // 3**j % 3 - 1 for j in range(rules)]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.byte_view(batch.column(1))
        for i, j, part, offs in K.blocks(data, offsets):
            m = measure_block(part, offs)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(np.ascontiguousarray(c)) for c in m.T), pa.array(pattern(votes(m)))], names=["doc_id", *MEASURES, "pattern"])
        K.tidy()


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the MEASURES and the pattern of votes."""
    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", pattern long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_measured, schema)


def fit(counts: dict[int, int], rules: int, kinds: tuple[tuple[int, ...], ...], rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """(reliability, shares) by expectation-maximisation over the classes good, then each kind.

    ``reliability[c, j, k]`` is the probability that rule j abstains (k = 0), votes
    bad (1) or good (2) on a document of class c.  It starts from rules that seldom
    fail a document but catch most of their own kind of defect, and is smoothed by
    a few counts; a rule is never let to vote bad more often on good documents than
    on those of its kind, which pins the meaning of the classes.
    """
    own = np.zeros((len(kinds) + 1, rules), bool)
    for c, places in enumerate(kinds, 1):
        own[c, list(places)] = True
    rel = np.where(own[:, :, None], np.array([0.05, 0.6, 0.35]), np.array([0.038, 0.002, 0.96]))
    shares = np.array([0.9] + [0.1 / max(1, len(kinds))] * len(kinds))
    shares /= shares.sum()
    if not counts:
        return rel, shares
    v = np.array([votes_of(p, rules) for p in counts])
    n = np.array(list(counts.values()), np.float64)
    for _ in range(rounds):
        w = n[:, None] * classes(v, rel, shares)
        total = w.sum(axis=0)
        new = np.stack([(w.T @ (v + 1 == k) + 0.5) / (total[:, None] + 1.5) for k in range(3)], axis=2)
        for c in range(1, len(new)):
            swapped = own[c] & (new[0, :, 1] > new[c, :, 1])
            new[c, swapped] = new[0, swapped]
        mine = (total + 1) / (n.sum() + len(total))
        moved = np.abs(new - rel).max() + np.abs(mine - shares).max()
        rel, shares = new, mine
        if moved < 1e-10:
            break
    return rel, shares


def _joint(v: np.ndarray, rel: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Log-probability of votes and class: shape (patterns, classes)."""
    return np.log(shares)[None, :] + sum(np.log(rel[:, j, :])[:, v[:, j] + 1].T for j in range(v.shape[1]))


def classes(v: np.ndarray, rel: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Probability of each class, given votes: shape (patterns, classes)."""
    score = _joint(v, rel, shares)
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def learn(counts: dict[int, int], rules: int = len(RULES)) -> tuple[tuple[int, ...], ...]:
    """The kinds of defect, as places of the rules that propose them.

    Step by step: of the sets of two rules or more that vote bad together, the one
    whose count exceeds most what the classes so far lead to expect becomes a kind
    and all is fitted anew.  It stays if the log-likelihood grows by LEAST_GAIN a
    document and by BIC's price of a class, and if each kind still has two rules
    that fail at least half of its documents; else it is set aside.
    """
    kinds: tuple[tuple[int, ...], ...] = ()
    if not counts:
        return kinds
    v = np.array([votes_of(p, rules) for p in counts])
    n = np.array(list(counts.values()), np.float64)
    found: dict[tuple[int, ...], float] = {}
    for row, k in zip(v, n, strict=True):
        failing = tuple(np.flatnonzero(row == 0).tolist())
        found[failing] = found.get(failing, 0.0) + k
    left = sorted(s for s in found if len(s) > 1)
    price = max(LEAST_GAIN * n.sum(), (2 * rules + 1) * np.log(n.sum()) / 2)
    likelihood = lambda rel, shares: float(n @ np.logaddexp.reduce(_joint(v, rel, shares), axis=1))
    rel, shares = fit(counts, rules, kinds)
    best = likelihood(rel, shares)
    while left:
        fails = np.array([[j in s for j in range(rules)] for s in left])
        seen = np.array([found[s] for s in left])
        expected = n.sum() * sum(share * np.where(fails, r[:, 1], 1 - r[:, 1]).prod(axis=1) for share, r in zip(shares, rel, strict=True))
        excess = seen * np.log(seen / expected)
        at = int(excess.argmax())
        if excess[at] < price:
            break
        trial = (*kinds, left.pop(at))
        new = fit(counts, rules, trial)
        gained = likelihood(*new)
        if gained - best >= price and ((new[0][1:, :, 1] >= 0.5).sum(axis=1) > 1).all():
            kinds, (rel, shares), best = trial, new, gained
    return kinds


def pattern_counts(patterns: DataFrame) -> dict[int, int]:
    """How many documents have each pattern: 3^R rows at most."""
    return {r[0]: r[1] for r in patterns.groupBy("pattern").count().collect()}


def posteriors(counts: dict[int, int], rules: int = len(RULES), kinds: tuple[tuple[int, ...], ...] | None = None) -> dict[int, float]:
    """The posterior probability of good for every pattern that occurs; kinds are learnt unless given."""
    ids = sorted(counts)
    if not ids:
        return {}
    ordered = {p: counts[p] for p in ids}
    rel, shares = fit(ordered, rules, learn(ordered, rules) if kinds is None else kinds)
    return dict(zip(ids, classes(np.array([votes_of(p, rules) for p in ids]), rel, shares)[:, 0].tolist(), strict=True))


def _base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the BASE measures, base_failed, posterior, kept) for every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "rules")
    known = scratch.save(measures(docs, id_col, text_col), "measures")
    found = posteriors(pattern_counts(known))
    table = spark.createDataFrame(sorted(found.items()), "pattern long, posterior double")
    out = known.join(F.broadcast(table), "pattern").withColumn("base_failed", _base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return out.select("doc_id", *BASE, "base_failed", "posterior", (~F.col("base_failed") & (F.col("posterior") >= KEEP_AT)).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns, without a shuffle.

    Texts are measured once; the rows are saved with their pattern of votes, and the
    table of posteriors, one entry a pattern, then says which stay.
    """
    pattern_col, failed_col = (unused(docs.columns, n) for n in ("_pattern", "_failed"))
    schema = StructType([*docs.schema.fields, StructField(pattern_col, LongType()), StructField(failed_col, BooleanType())])
    voted = Scratch(docs.sparkSession, "rules").save(docs.mapInArrow(_voter(text_col, pattern_col, failed_col), schema), "voted")
    found = posteriors(pattern_counts(voted.select(F.col(pattern_col).alias("pattern"))))
    good = [p for p, q in found.items() if q >= KEEP_AT]
    return voted.filter(~F.col(failed_col) & F.col(pattern_col).isin(good)).select(*docs.columns)


def _voter(text_col: str, pattern_col: str, failed_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.byte_view(batch.column(batch.schema.get_field_index(text_col)))
            patterns, failed = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            for i, j, part, offs in K.blocks(data, offsets):
                m = measure_block(part, offs)
                patterns[i:j], failed[i:j] = pattern(votes(m)), (m[:, 0] < MIN_WORDS) | (100 * m[:, 4] > MAX_REPEAT_PERCENT * m[:, 0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(patterns), pa.array(failed)], names=[*batch.schema.names, pattern_col, failed_col])
            K.tidy()

    return run
