"""Secret scan: fixed patterns, and Markov models of random and ordinary strings.

Three patterns give base spans: a keyword with an assigned value, an access key
id, a run of hexadecimal digits.  Every other token of 12 characters or more is
judged by two first-order character models, one of random strings and one of
ordinary identifiers, words, numbers and rulers, trained from labelled samples; a
token whose log-likelihood ratio is above a margin, which is higher for tokens
under LONG characters, adds a span of kind "random" unless it overlaps a base span.

Everything is DataFrame expressions over one row, so a scan never shuffles and a
row's cost is that of a few passes over its text.  Positions follow from the
lengths between and of the matches (``split`` and ``regexp_extract_all`` with the
same pattern), counted in code points.  Running sums, maxima and minima over a row's
matches are made by doubling, a logarithm of passes over them, so that a text of
very many matches costs little more a match than others.  The trained table has one
number for each pair of the 68 character classes, whatever the samples.

Defined results: a null text counts as empty and has no spans; kinds may overlap
one another, spans of one kind never do; repeated rows get equal answers; texts and
tokens of any length are scanned whole; an empty table gives an empty table; other
columns are untouched and may have any names (``scan`` replaces one called ``out``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.scratch import unused

KINDS = ("assign", "access", "hex", "random")
#: Fixed values of the base patterns and their least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
MAY_ASSIGN = r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}"""
#: A run of one class is matched whole or not at all, so its least length stands in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_=-]{12,}"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CLASSES = len(ALPHABET) + 1
SMOOTHING = 0.5
#: Natural logarithm of how much likelier random must be: one ordinary token in about 3,000 passes by chance.
MARGIN = 8.0
#: Added for each character under LONG: short ordinary tokens are many, and short random ones have less to show.
SHORT, LONG = 0.5, 20
SAMPLES = 4000
#: Code points of the pieces of a text that is redacted.
CHUNK = 4096

_WORDS = "get set user name file path index value count list item node data load save read write open close start stop time date type size max min page view model table column row key map cache buffer string number config option default error message handler event request response server client session context module package version test main init update delete create insert select order group total average last first next previous".split()

_PROSE = (
    "international understanding responsibility development environmental particularly relationship significant independent communication characteristics throughout"
    " knowledge neighbourhood straightforward thoughtfulness whatsoever nevertheless strengthening questionable temperature acknowledgement extraordinary philosophical"
    " Geschwindigkeit Verantwortung Gesellschaft Entwicklung Wissenschaft selbstverständlich Zusammenarbeit Schwierigkeiten Aufmerksamkeit Bundesrepublik grundsätzlich"
    " Möglichkeiten Lebensversicherung Rechtsanwalt Krankenhaus Pflichtverletzung unterschiedlich Herausforderung Wirtschaftlichkeit Einheitlichkeit Umweltschutz entsprechend"
    " gouvernement développement particulièrement établissement connaissance malheureusement aujourd'hui environnement immédiatement responsabilité quelquefois nouveaux"
    " travailleurs appartement heureusement administration renseignements bouleversement naturellement intellectuelle actuellement chevaux questionnaire lorsqu'elles"
    " desarrollo conocimiento particularmente responsabilidad establecimiento universidad investigaciones acontecimientos trabajadores especialmente inmediatamente mejoramiento"
    " desafortunadamente enriquecimiento aproximadamente independiente construcciones verdaderamente hispanoamericano ayuntamiento guerrillero izquierdo bachillerato"
).split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(sample, random) rows: random strings of four alphabets; identifiers of one to four words, prose of four languages, numbers and rulers.

    Both are drawn from hashes of the row number, so that every run and every
    machine has the same ones.
    """
    rows = spark.range(n)
    pick = lambda i, m: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(m)).cast("int")
    raw = F.concat(F.unhex(F.sha2(F.concat(F.lit("a"), F.col("id").cast("string")), 256)), F.unhex(F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 256)))
    full = F.regexp_replace(F.base64(raw), r"\s", "")
    plain = F.regexp_replace(full, "[+/=]", "")
    made = F.substring(F.when(pick(0, 4) == 0, full).when(pick(0, 4) == 1, plain).when(pick(0, 4) == 2, F.translate(full, "+/=", "-_")).otherwise(F.hex(raw)), 1, 40)
    random = rows.select(made.alias("sample"), F.lit(True).alias("random"))
    words = F.array(*(F.lit(w) for w in _WORDS))
    word = [F.element_at(words, pick(i, len(_WORDS)) + 1) for i in range(1, 5)]
    title = [F.initcap(w) for w in word]
    size = pick(7, 3) + 2
    join = lambda sep, parts: F.array_join(F.slice(F.array(*parts), 1, size), sep)
    style = pick(8, 5)
    name = F.when(style == 0, join("_", word)).when(style == 1, join("", [word[0], *title[1:]])).when(style == 2, join("", title)).when(style == 3, F.upper(join("_", word))).otherwise(join("-", word))
    name = F.when(pick(9, 3) == 0, F.concat(name, pick(10, 100).cast("string"))).when(pick(9, 3) == 1, F.concat(join("/", word), F.lit("/"), name)).otherwise(name)
    names = rows.select(name.alias("sample"), F.lit(False).alias("random"))
    prose = F.array(*(F.lit(w) for w in _PROSE))
    long = [F.element_at(prose, pick(i, len(_PROSE)) + 1) for i in (21, 22)]
    style = pick(23, 6)
    plain = F.when(style < 2, long[0]).when(style == 2, F.initcap(long[0])).when(style == 3, F.concat(long[0], F.lower(long[1]))).when(style == 4, F.concat_ws("-", *long)).otherwise(F.upper(long[0]))
    digits = F.lpad(F.pmod(F.xxhash64("id", F.lit(24)), F.lit(10**15)).cast("string"), 15, "0")
    date = F.concat_ws("-", F.concat(F.lit("20"), F.substring(digits, 1, 2)), F.substring(digits, 3, 2), F.substring(digits, 5, 2))
    other = F.when(pick(26, 3) == 0, digits).when(pick(26, 3) == 1, date).otherwise(F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 3), F.substring(digits, 8, 6)))
    more = rows.select(F.when(pick(27, 8) > 0, plain).otherwise(other).alias("sample"), F.lit(False).alias("random"))
    signs = [a + b for a in "+/_=-" for b in "+/_=-" if a != b]
    runs = " ".join([c * m for c in ALPHABET for m in range(28, 36)] + [x * m for x in signs for m in range(10, 14)])
    rulers = spark.range(1).select(F.explode(F.split(F.lit(runs), " ")).alias("sample"), F.lit(False).alias("random"))
    return random.unionByName(names).unionByName(more).unionByName(rulers)


def _class(text: Column, at: Column) -> Column:
    """0 for a character outside the alphabet, else its place from 1."""
    return F.call_function("locate", F.call_function("substring", text, at, F.lit(1)), F.lit(ALPHABET))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios random : ordinary of each pair of character classes.

    Null samples and samples of under two characters teach nothing; with no
    samples of a label that model is uniform.
    """
    s = samples.filter("sample is not null and random is not null and length(sample) > 1").select("sample", "random")
    s = s.withColumn("at", F.explode(F.expr("sequence(1, length(sample) - 1)")))
    code = _class(F.col("sample"), F.col("at")) * CLASSES + _class(F.col("sample"), F.col("at") + 1)
    found = s.groupBy("random", code.alias("code")).count().collect()  # 2 * CLASSES^2 rows at most
    table: list[list[float]] = [[SMOOTHING] * CLASSES**2 for _ in range(2)]
    for r in found:
        table[r["random"]][r["code"]] += r["count"]
    logs = []
    for t in table:
        total = [sum(t[i * CLASSES : (i + 1) * CLASSES]) for i in range(CLASSES)]
        logs.append([log(x / total[i // CLASSES]) for i, x in enumerate(t)])
    return [round(b - a, 9) for a, b in zip(*logs, strict=True)]


def log_ratio(token: Column, table: Sequence[float]) -> Column:
    """Sum of the table over the pairs of neighbouring characters; a token's characters are coded once."""
    place = [ALPHABET.find(chr(c)) + 1 for c in range(128)]
    ratios = F.expr("array(" + ",".join(f"{table[a * CLASSES + b]!r}D" for a in place for b in place) + ")")
    codes = F.transform(F.split(token, ""), lambda c: F.least(F.ascii(c), F.lit(127)))

    def total(c: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0), lambda s, i: s + F.get(ratios, F.get(c, i - 1) * 128 + F.get(c, i)))

    return F.when(F.length(token) < 2, 0.0).otherwise(_with(codes, total))


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), 0)


def _scanned(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Each value joined with all before it, by doubling; ``join`` gets null where nothing is before."""

    def double(acc: Column, k: Column) -> Column:
        return F.transform(acc, lambda x, i: join(x, F.get(acc, i - F.call_function("shiftleft", F.lit(1), k))))

    def all_of(v: Column) -> Column:
        rounds = F.ceil(F.log2(F.size(v).cast("double"))).cast("int")
        return F.when(F.size(v) < 2, v).otherwise(F.aggregate(F.sequence(F.lit(0), rounds - 1), v, double))

    return _with(values, all_of)


def _zipped(*arrays: tuple[str, Column]) -> Column:
    """One array of structs of equally long arrays."""
    return F.arrays_zip(*(a.alias(n) for n, a in arrays))


def _spans(text: Column, pattern: str, kind: int, may: Column, keep: Callable[[Column], Column] | None = None, group: int = 0) -> Column:
    """Array of (start, kind, end) of a pattern's matches; ``keep`` says of a match's group whether it counts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps"))

    def placed(x: Column) -> Column:
        steps = F.zip_with(F.slice(x["gaps"], 1, F.size(x["found"])), x["found"], lambda g, m: F.length(g) + F.length(m))
        ends = _scanned(steps, lambda a, b: a + F.coalesce(b, F.lit(0)))
        spans = F.zip_with(ends, x["found"], lambda e, m: F.struct((e - F.length(m)).alias("start"), F.lit(kind).alias("kind"), e.alias("end")))
        if keep is None:
            return spans
        said = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else x["found"]
        return F.filter(F.zip_with(spans, said, lambda s, v: F.when(keep(v), s)), lambda s: s.isNotNull())

    return F.when(may, _with(parts, placed)).otherwise(F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)"))


def scan(docs: DataFrame, table: Sequence[float], text_col: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with the column ``out``: the array of (start, kind, end), by start, then kind; ``kind`` is a place in KINDS."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign = _spans(text, ASSIGN, 0, text.rlike(MAY_ASSIGN), lambda v: F.length(v) >= ASSIGN_VALUE, 2)
    access = _spans(text, ACCESS, 1, F.contains(text, F.lit("AKIA")))
    hexes = _spans(text, HEX, 2, text.rlike("[0-9a-f]{16}"))
    likely = lambda t: log_ratio(t, table) > MARGIN + SHORT * F.greatest(LONG - F.length(t), F.lit(0))
    random = _spans(text, TOKEN, 3, text.rlike(TOKEN), likely)
    found = docs.withColumn(out, F.array_sort(F.concat(assign, access, hexes, random)))
    # Random spans that a base span overlaps go: one that starts no later, or one that starts before their end.
    spans = F.col(out)
    left = _scanned(F.transform(spans, lambda s: F.when(s["kind"] < 3, s["end"])), F.greatest)
    right = F.reverse(_scanned(F.transform(F.reverse(spans), lambda s: F.when(s["kind"] < 3, s["start"])), F.least))
    apart = lambda x: (x["span"]["kind"] < 3) | (F.coalesce(x["left"], F.lit(0)) <= x["span"]["start"]) & (F.coalesce(x["right"], x["span"]["end"]) >= x["span"]["end"])
    clean = F.transform(F.filter(_zipped(("span", spans), ("left", left), ("right", right)), apart), lambda x: x["span"])
    mixed = F.exists(spans, lambda s: s["kind"] == 3) & F.exists(spans, lambda s: s["kind"] < 3)
    return found.withColumn(out, F.when(mixed, clean).otherwise(spans))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, table: Sequence[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row."""
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), table).select("doc_id", "secrets")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, table: Sequence[float], text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by a mark; overlapping spans become one.  A null text stays null.

    The text is cut into chunks of CHUNK code points, so that a piece between two
    spans is found without counting from the text's start.
    """
    names = [*docs.columns]
    spans, cuts, chunks = (unused(names, n) for n in ("_spans", "_cuts", "_chunks"))
    found, text = scan(docs, table, text_col, spans), F.col(text_col)
    # A span that starts where all before have ended opens a cut; a cut ends where its last span does.
    reach = _scanned(F.transform(spans, lambda s: s["end"]), F.greatest)
    before = _with(reach, lambda r: F.concat(F.array(F.lit(0)), F.slice(r, 1, F.size(r) - 1)))
    edges = F.filter(_zipped(("span", F.col(spans)), ("before", before)), lambda x: x["span"]["start"] >= x["before"])
    last = F.array_max(F.transform(spans, lambda s: s["end"]))

    def cut(e: Column) -> Column:
        starts = F.transform(e, lambda x: x["span"]["start"])
        ends = F.concat(F.slice(F.transform(e, lambda x: x["before"]), 2, F.size(e)), F.array(last))
        return F.zip_with(F.concat(F.array(F.lit(0)), ends), F.concat(starts, F.array(F.length(text))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    cutting = _with(edges, cut)
    some = F.size(spans) > 0
    found = found.withColumn(cuts, F.when(some, cutting)).withColumn(chunks, F.when(some, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))))
    chunk = lambda i: F.coalesce(F.get(chunks, i), F.lit(""))
    of = lambda x: F.floor(x / CHUNK).cast("int")

    def piece(c: Column) -> Column:
        a, b = c["a"], c["b"]
        within = F.substring(chunk(of(a)), a % CHUNK + 1, b - a)
        across = F.concat(F.substring(chunk(of(a)), a % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, of(a) + 2, F.greatest(of(b) - of(a) - 1, F.lit(0))), ""), F.substring(chunk(of(b)), F.lit(1), b % CHUNK))
        return F.when(of(a) == of(b), within).otherwise(across)

    clean = F.array_join(F.transform(cuts, piece), mark)
    return found.withColumn(text_col, F.when(some, clean).otherwise(text)).select(*names)
