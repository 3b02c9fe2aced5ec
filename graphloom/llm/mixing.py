"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of all characters over its
actual share.  A document's count is drawn by inverting the Poisson distribution
of that mean at a number in [0, 1) hashed from a seed and its id; the document is
exploded by its count and the copies are put into a global order by a second
hash.  The draw of a document depends on nothing but seed, id and rate, so that
a recomputed task makes the same copies.

Sizes by source are summed with partial aggregation, so a source that holds a
third of all rows costs no more than others; documents meet their source's rate
by a broadcast whose bytes are summed beforehand: of a table of probabilities for each
source while all of them are small, else of the rates alone, with the number then
inverted for each document, and a shuffled join where even those are too many.  They
are shuffled only once more, to the partition that the leading bits of the order's hash name, so that partitions are even
whatever the sources are and stand in the global order, without sampling.

Defined results: a null text has size 0; a null source is a source of its own; a
source without characters has rate ``epochs``; sources without a weight get
``default_weight``; a weight of 0 drops the source.  Repeated rows have the same
id and therefore equal counts; rows of a null id are told apart by a hash of their
text.  An empty table gives an empty table.  Other columns are kept, whatever their
names: a new column whose name is taken, in either case, gets underscores at its end.
Texts of any length are measured and kept whole.  A rate may be of any size: above
``TABLE_RATE`` the same number is inverted for each document over the counts about
the rate, without a table, and its copies are made in blocks.  The number of a
copy is a 32-bit integer; a document of more copies than that is an error.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.scratch import Scratch, unused

#: What may be sent to every task.
BROADCAST_BYTES = 16 << 20
#: Up to this rate a source has a table of probabilities, as long as the rate.
TABLE_RATE = 1000
#: Copies of a document that are made at once, where rates are above that.
BLOCK = 1 << 16


def hashed(*parts: Column | str) -> Column:
    """The first 52 bits of the MD5 of the parts, joined by a bar, as a whole number."""
    text = F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def _last(rate: Column) -> Column:
    """Above this count nothing can be drawn."""
    return F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")


def _step(rate: Column, s: Column, k: Column) -> tuple[Column, Column]:
    """log(k!) and P(count <= k) from those of k - 1."""
    log_k = s["log_k"] + F.log(F.greatest(k, F.lit(1)).cast("double"))
    return log_k, s["total"] + F.when(rate > 0, F.exp(k * F.log(rate) - rate - log_k)).otherwise(F.when(k == 0, 1.0).otherwise(0.0))


def poisson_cdf(rate: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... until nothing above can be drawn."""
    start = F.struct(F.lit(0.0).alias("log_k"), F.lit(0.0).alias("total"), F.expr("cast(array() as array<double>)").alias("out"))

    def step(s: Column, k: Column) -> Column:
        log_k, total = _step(rate, s, k)
        return F.struct(log_k.alias("log_k"), total.alias("total"), F.concat(s["out"], F.array(total)).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), _last(rate)), start, step, lambda s: s["out"])


def small_count(rate: Column, draw: Column) -> Column:
    """How many of poisson_cdf(rate) are at most ``draw``, without the table."""
    start = F.struct(F.lit(0.0).alias("log_k"), F.lit(0.0).alias("total"), F.lit(0).alias("n"))

    def step(s: Column, k: Column) -> Column:
        log_k, total = _step(rate, s, k)
        return F.struct(log_k.alias("log_k"), total.alias("total"), (s["n"] + F.when(total <= draw, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.sequence(F.lit(0), _last(rate)), start, step, lambda s: s["n"])


def poisson_count(rate: Column, draw: Column) -> Column:
    """How many k have P(count <= k) <= draw, for a rate above TABLE_RATE.

    Twelve deviations below the rate all probabilities together are below e^-60,
    far below the smallest draw, so the sum starts there: at Stirling's series,
    then each probability from the one before.
    """
    spread = F.lit(12) * F.sqrt(rate) + 30
    low, high = F.floor(rate - spread), F.ceil(rate + spread)
    n = low.cast("double")
    series = 1 / (12 * n) - 1 / (360 * n * n * n) + 1 / (1260 * n * n * n * n * n)
    first = F.exp(n - rate - n * F.log1p((n - rate) / rate) - series - 0.5 * F.log(2 * pi * n))
    start = F.struct(first.alias("p"), first.alias("total"), low.alias("n"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), (s["total"] + p).alias("total"), (s["n"] + F.when(s["total"] <= draw, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.sequence(low + 1, high), start, step, lambda s: s["n"])


def rates(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, epochs: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, size, rate) of every source, over all documents; sizes are summed once and saved."""
    spark = docs.sparkSession
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("size"))
    sizes = Scratch(spark, "mix").save(sizes, "sizes")
    asked = spark.createDataFrame(sorted((k, float(v)) for k, v in weights.items()), "name string, weight double")
    found = sizes.join(F.broadcast(asked), F.col("source") == F.col("name"), "left").select("source", "size", F.coalesce("weight", F.lit(default_weight)).alias("weight"))
    total = found.agg(F.sum("weight").alias("w"), F.sum("size").alias("s")).first()  # one row
    rate = F.lit(epochs) * F.lit(float(total["s"] or 0)) * (F.col("weight") / F.lit(float(total["w"] or 1))) / F.col("size")
    return found.select("source", "size", F.when(F.col("weight") <= 0, 0.0).when(F.col("size") == 0, F.lit(epochs)).otherwise(rate).alias("rate"))


def mix(
    docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, epochs: float = 1.0, seed: str = "mix",
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", copy_col: str = "copy_no", order_col: str = "order_key",
) -> DataFrame:
    """``docs`` repeated to the target weights, in global order of ``order_col``.

    Two columns are added: the number of the copy from 1, and the order's hash.
    """
    spark = docs.sparkSession
    table = rates(docs, weights, default_weight, epochs, source_col, text_col)
    named = F.coalesce(F.octet_length("source"), F.lit(0)).cast("long") + 64
    entries = F.when(F.col("rate") <= TABLE_RATE, _last(F.col("rate")).cast("long") + 1).otherwise(0)
    known = table.agg(F.sum(named).alias("named"), F.sum(8 * entries).alias("tables"), F.max("rate").alias("most")).first()  # one row
    few, high = (known["named"] or 0) <= BROADCAST_BYTES, (known["most"] or 0) > TABLE_RATE
    tables = (known["named"] or 0) + (known["tables"] or 0) <= BROADCAST_BYTES
    names = [*docs.columns]

    def new(name: str) -> str:
        names.append(unused(names, name))
        return names[-1]

    copy_no, order_key, of, rate, table_of, count, block, copy = map(new, (copy_col, order_col, "_of", "_rate", "_cdf", "_copies", "_block", "_copy"))
    cdf = poisson_cdf(F.col("rate"))
    table = table.select(F.col("source").alias(of), F.col("rate").alias(rate), *([(F.when(F.col("rate") <= TABLE_RATE, cdf) if high else cdf).alias(table_of)] if tables else []))
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null|"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    draw = hashed(seed, "count", key) / F.lit(float(1 << 52))
    joined = docs.join(F.broadcast(table) if few else table, F.col(source_col).eqNullSafe(F.col(of)))
    copies = F.size(F.filter(table_of, lambda c: c <= draw)) if tables else small_count(F.col(rate), draw)
    own = [F.col(c) for c in docs.columns]
    if high:
        copies = F.when(F.col(rate) <= TABLE_RATE, copies.cast("long")).otherwise(poisson_count(F.col(rate), draw))
        drawn = joined.select(*own, copies.alias(count)).filter(F.col(count) > 0)
        blocks = drawn.select("*", F.explode(F.expr(f"sequence(0L, ({count} - 1) div {BLOCK})")).alias(block))
        out = blocks.select(*own, F.explode(F.expr(f"sequence({block} * {BLOCK} + 1, least(({block} + 1) * {BLOCK}, {count}))")).alias(copy))
        number = F.when(F.col(copy) < 1 << 31, F.col(copy).cast("int")).otherwise(F.raise_error(F.lit("a document has more copies than a 32-bit integer can number")))
        out = out.select(*own, number.alias(copy_no))
    else:
        out = joined.select(*own, F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies))).alias(copy_no))
    out = out.withColumn(order_key, hashed(seed, "order", key, F.col(copy_no).cast("string")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.col(order_key) / F.lit(float(1 << 52)) * parts).cast("int")
    return out.repartitionById(parts, place).sortWithinPartitions(order_key, copy_no)
