"""Mix sources to target weights with hash-threshold histograms, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import materialize

WORD = r"[^\x20\x09-\x0D]+"
LEVEL_BITS, LEVELS = 12, 3


def sampling_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """36 bits of an md5 over the id (over the text where the id is null)."""
    told = F.coalesce(F.col(doc_id).cast("string"), F.md5(F.col(text).cast("binary")), F.lit(""))
    return F.conv(F.substring(F.md5(told.cast("binary")), 1, 9), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Add ``target``: weights repeat over the sources by code point, null last; capped excess is reshared.

    The reshared shares equal min(level * weight, most * size) for one level, found from running sums
    in the order of the sizes a unit of weight can use up. ``sources`` has one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    s = s.withColumns({
        "capped": F.sum("most").over(fill) - F.col("most"),
        "open_weight": F.sum("weight").over(everything) - F.sum("weight").over(fill) + F.col("weight"),
        "budget": F.sum("source_size").over(everything) * F.lit(float(share)),
    })
    s = s.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open_weight"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    # the first source in that order that the level does not fill up decides the level
    s = s.withColumn("level", F.first(fits, ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.withColumn("target", F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("most")), F.col("most"))).select("skey", "source", "source_size", "target")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How many times each document is taken so that every source comes near its target.

    Each document is taken floor(target / source size) times, and once more where its hash key lies
    under its source's threshold. Thresholds come from histograms of words by source and key prefix:
    the bucket in which a source's budget ends is refined by the next 12 bits, three levels deep, so
    nothing is sorted and equal keys (repeated rows) are taken together. Reruns give the same rows.

    Nulls: a null text has size 0, a null source is a source of its own, a null id is keyed by its text.
    An empty table gives an empty result; a source without words has target 0. Columns besides the three
    named are ignored. Returns doc_id, source, size, source_size, target, copies, taken.
    """
    slim = _sizes(docs, doc_id, text, source)
    taken = _copies(slim, weights, share, most)
    return taken.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as ``mix_sources`` takes each, with their columns.

    Each row is taken by its own key and source, so that null and repeated ids, and columns of any name,
    change nothing. An empty table gives an empty one.
    """
    plan = _plan(_sizes(docs, doc_id, text, source), weights, share, most)
    own = docs.select(F.struct(*docs.columns).alias("row"), *_keys(doc_id, text, source))
    placed = own.join(plan, "skey").select("row", _times(most).alias("copies")).where("copies > 0")
    return placed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def _keys(doc_id: str, text: str, source: str) -> list[Column]:
    return [F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")).alias("skey"), sampling_key(doc_id, text).alias("k")]


def _sizes(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), *_keys(doc_id, text, source))
    return materialize(slim, "mix-sizes")


def _plan(slim: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """One row a source: target, whole copies of every document, and the threshold under which keys get one more."""
    sums = slim.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    plan = materialize(targets(sums, weights, share, most).withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")).withColumn("rest", F.col("target") - F.col("base") * F.col("source_size")), "mix-targets")
    cut = plan.select("skey", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for level in range(1, LEVELS + 1):
        shift = LEVEL_BITS * (LEVELS - level)
        inside = slim.join(cut, "skey").where(F.shiftright("k", shift + LEVEL_BITS) == F.col("prefix"))
        cells = inside.groupBy("skey", F.shiftright("k", shift).alias("cell")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("below").alias("before"))
        run = Window.partitionBy("skey").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cells = cells.withColumn("upto", F.col("before") + F.sum("words").over(run))
        # the first cell whose end passes the budget; a source that ends before it has none left
        cells = cells.where(F.col("upto") > F.col("rest"))
        found = F.min_by(F.struct("cell", "words", "upto", "rest"), F.col("cell")).alias("c")
        cut = cells.groupBy("skey").agg(found).select("skey", F.col("c.rest").alias("rest"), F.col("c.cell").alias("prefix"), (F.col("c.upto") - F.col("c.words")).alias("below"), F.col("c.upto").alias("upto"))
        cut = materialize(cut, f"mix-cut{level}").drop(*["upto"] * (level < LEVELS))
    # the last cell is taken where that comes nearer to the target
    cut = cut.select("skey", (F.col("prefix") + F.when(F.col("upto") - F.col("rest") < F.col("rest") - F.col("below"), 1).otherwise(0)).alias("threshold"))
    return materialize(plan.join(cut, "skey", "left").select("skey", "source_size", "target", "base", F.when(F.col("rest") > 0, F.col("threshold")).otherwise(F.lit(0)).alias("threshold")), "mix-plan")


def _times(most: float) -> Column:
    copies = F.col("base") + F.when(F.col("threshold").isNull() | (F.col("k") < F.col("threshold")), 1).otherwise(0)
    return F.least(copies, F.lit(int(most))).cast("long")


def _copies(slim: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    return slim.join(_plan(slim, weights, share, most), "skey").withColumn("copies", _times(most))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(text), '')), 1, 9))::BIGINT AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM s),
f AS (SELECT *, sum(most) OVER o - most AS capped, sum(weight) OVER () - sum(weight) OVER o + weight AS open_weight, sum(source_size) OVER () * 1.5::DOUBLE AS budget
      FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT first((budget - capped) / open_weight ORDER BY most / weight, source NULLS LAST) AS level FROM f WHERE (budget - capped) / open_weight * weight <= most),
t AS (SELECT source, source_size, least(level * weight, most)::DOUBLE AS target FROM f LEFT JOIN l ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base FROM t),
q AS (SELECT *, target - base * source_size AS rest FROM p),
c AS (SELECT d.source, k, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY k) AS upto FROM d GROUP BY d.source, k),
h AS (SELECT q.source, min_by(c.k + CASE WHEN c.upto - rest < rest - (c.upto - c.words) THEN 1 ELSE 0 END, c.k) AS threshold
      FROM q JOIN c ON q.source IS NOT DISTINCT FROM c.source WHERE c.upto > rest GROUP BY q.source),
z AS (SELECT d.doc_id, d.size, q.source_size, q.target,
        least(2, base + CASE WHEN rest <= 0 THEN 0 WHEN h.threshold IS NULL OR d.k < h.threshold THEN 1 ELSE 0 END)::BIGINT AS copies
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN h ON h.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, (copies * size)::BIGINT AS taken FROM z
"""
