"""Mixing sources to target weights by Pareto order sampling (Rosén 1997).

A source with ``size`` words and a target of r times that takes floor(r) certain copies of every
document and a sample with inclusion probability p = r - floor(r). Each document draws a uniform u
from a keyed digest of its row and ranks by (u / (1 - u)) / (p / (1 - p)); the sample is the head of
that order. Its fixed size is counted in words, the unit of the targets: the cut falls where the
running words come nearest to what the target still lacks, so a source misses its target by at most
half of the one document at its cut.

The cut is found without sorting a source in one task: ranks are mapped to integers, their words
are summed per (source, cell) with partial aggregation, the cell that holds the cut is opened again,
and only the documents of the last cell (a millionth of the ranks) are ordered.

Rows: null text has size 0; null sources form one source that comes last; rows equal in id, text and
source draw alike, so they are taken alike; an empty table gives an empty result; the input's other
columns are ignored. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import SPACED_WORD, stage, text_or_empty, unstage

CAP = 3  # a target stops at this multiple of its source
BROADCAST_SOURCES = 100_000  # of some 60 bytes each
CELL_BITS = 10  # of each of the two levels of cells
RANK_BITS = 50


def _ranked_sources(per: DataFrame) -> DataFrame:
    """``per`` with the rank of each source by code point, null last, from 0: counted in ranges of sources, so that no task holds all."""
    sorted_parts = per.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = stage(sorted_parts.withColumn("id", F.monotonically_increasing_id()), "mix-sources")
    part, at = F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"))  # a row per shuffle partition
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", F.col("before") + at).drop("part", "before", "id")


def source_targets(sized: DataFrame) -> DataFrame:
    """Per source: source_size, target, certain (whole copies) and lack (words the sample adds).

    Water-filling: each round caps the sources that the level would bring over ``CAP`` times their size and shares
    what is left among the others, until none is above; a round is one sum over the sources.
    """
    per = stage(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-source-sizes")
    per = stage(_ranked_sources(per).withColumn("weight", F.col("rank") % 3 + 1).withColumn("cap", CAP * F.col("source_size")), "mix-source-weights")
    level = 0.0
    while True:
        free = F.col("cap") / F.col("weight") > F.lit(level)
        words, capped, weights = per.agg(F.sum("source_size"), F.sum(F.when(~free, F.col("cap"))), F.sum(F.when(free, F.col("weight")))).first()
        new = (words - (capped or 0)) / weights if weights else level
        if new <= level:
            break
        level = new
    per = per.withColumn("target", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")))
    per = per.withColumn("certain", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
    return per.select("source", "source_size", "target", "certain", (F.col("target") - F.col("certain") * F.col("source_size")).alias("lack"))


def uniform(key: Column, seed: str) -> Column:
    """u in (0, 1) from the first 52 bits of a keyed digest."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def pareto_rank(u: Column, p: Column) -> Column:
    """Order of the sampling odds as an integer: q / (1 + q) for q = (u / (1 - u)) / (p / (1 - p))."""
    a, b = u * (F.lit(1.0) - p), (F.lit(1.0) - u) * p
    return F.floor(a / (a + b) * F.lit(float(1 << RANK_BITS))).cast("bigint")


def mix_sources(docs: DataFrame, seed: str = "mix-0:", id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, ``carry``, source, size, source_size, target, copies, taken (= copies * size)."""
    ranked, ends = _ranked_and_ends(docs, seed, id_col, carry)
    out = ranked.alias("d").join(ends.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")), "left")
    copies = F.col("d.certain") + F.coalesce(F.col("rank") <= F.col("last"), F.lit(False)).cast("bigint")
    return out.select("doc_id", *carry, F.col("d.source").alias("source"), "size", "d.source_size", "d.target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeat_rows(docs: DataFrame, seed: str = "mix-0:", id_col: str = "doc_id") -> DataFrame:
    """``docs`` as the mix takes them: a row taken k times is k rows, one taken 0 times is none.

    How often a row is taken follows from its own draw and its source's cut, so texts are joined with one row per
    source: broadcast up to ``BROADCAST_SOURCES`` of them.
    """
    _, ends = _ranked_and_ends(docs, seed, id_col, ())
    plan = ends.select(F.col("source").alias("_source"), "certain", "lack", "source_size", "last")
    plan = F.broadcast(plan) if ends.count() <= BROADCAST_SOURCES else plan
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("source").cast("string").alias("_of"), uniform(_key(id_col), seed).alias("_u"))
    rows = rows.join(plan, F.col("_of").eqNullSafe(F.col("_source")))
    p = _probability()
    sampled = F.coalesce(F.when(p > 0, pareto_rank(F.col("_u"), p)) <= F.col("last"), F.lit(False)).cast("bigint")
    rows = rows.withColumn("_copies", (F.col("certain") + sampled).cast("int")).where("_copies > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def _key(id_col: str) -> Column:
    return F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text_or_empty()), F.coalesce("source", F.lit("")))


def _probability() -> Column:
    return F.when(F.col("source_size") > 0, F.col("lack") / F.col("source_size")).otherwise(0.0)


def _ranked_and_ends(docs: DataFrame, seed: str, id_col: str, carry: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Documents with their ranks, and per source its target, certain copies and the last rank of its sample."""
    sized = stage(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"), *carry, F.col("source").cast("string").alias("source"),
            F.regexp_count(text_or_empty(), F.lit(SPACED_WORD)).cast("bigint").alias("size"), uniform(_key(id_col), seed).alias("u"),
        ), "mix-sizes",
    )
    targets = stage(source_targets(sized), "mix-targets")
    same = F.col("d.source").eqNullSafe(F.col("t.source"))
    p = _probability()
    ranked = (
        sized.alias("d").join(targets.alias("t"), same)
        .select("doc_id", *carry, "d.source", "size", "source_size", "target", "certain", "lack", F.when(p > 0, pareto_rank(F.col("u"), p)).alias("rank"))
    )
    ranked = stage(ranked, "mix-ranks")
    unstage(sized)

    low, cut = RANK_BITS - CELL_BITS, F.shiftright
    first = ranked.where("rank IS NOT NULL").groupBy("source", "lack", cut("rank", low).alias("cell")).agg(F.sum("size").alias("words"))
    opened = _crossing(first, F.lit(0).cast("bigint"), ["source", "lack"])
    inner = ranked.where("rank IS NOT NULL").select("source", "size", "rank", cut("rank", low).alias("cell"))
    inner = stage(_match(inner, opened, ["cell"]), "mix-inner")
    second = inner.groupBy("source", "lack", "cell", "before", cut("rank", low - CELL_BITS).alias("fine")).agg(F.sum("size").alias("words"))
    last = _crossing(second.withColumnRenamed("before", "base").drop("cell").withColumnRenamed("fine", "cell"), F.col("base"), ["source", "lack", "base"])
    rows = _match(inner.select("source", "size", "rank", cut("rank", low - CELL_BITS).alias("cell")), last, ["cell"])
    steps = rows.groupBy("source", "lack", "before", "rank").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("source").orderBy("rank")
    steps = steps.withColumn("start", F.col("before") + F.sum("size").over(order) - F.col("size"))
    # A rank belongs to the sample when that brings the words nearer to the target.
    inside = F.col("start") + F.col("size") / 2 <= F.col("lack")
    ends = steps.groupBy("source").agg(F.max(F.when(inside, F.col("rank"))).alias("last"), F.min("rank").alias("least"))
    ends = ends.select("source", F.coalesce(F.col("last"), F.col("least") - 1).alias("last"))
    ends = targets.alias("t").join(ends.alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")), "left").select("t.*", "e.last")
    return ranked, stage(ends, "mix-ends")


def _crossing(cells: DataFrame, base: Column, keys: list[str]) -> DataFrame:
    """The cell of each source in which the running words pass what is lacking, with the words before it."""
    order = Window.partitionBy("source").orderBy("cell")
    run = cells.withColumn("before", base + F.sum("words").over(order) - F.col("words"))
    hit = run.where("before <= lack").groupBy("source", "lack").agg(F.max_by("cell", "cell").alias("cell"), F.max_by("before", "cell").alias("before"))
    return hit


def _match(rows: DataFrame, cells: DataFrame, on: list[str]) -> DataFrame:
    cond = F.col("r.source").eqNullSafe(F.col("c.source"))
    for k in on:
        cond &= F.col(f"r.{k}") == F.col(f"c.{k}")
    return rows.alias("r").join(cells.alias("c"), cond).select("r.*", "c.lack", "c.before")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('mix-0:' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) || '|' || coalesce(source, '')), 1, 13))::BIGINT::DOUBLE + 0.5)
      / 4503599627370496.0 AS u
  FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM p),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS lvl
      FROM w WINDOW b AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap::DOUBLE, max(lvl) OVER () * weight) AS target FROM l),
c AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS certain FROM t),
k AS (SELECT *, target - certain * source_size AS lack FROM c),
r AS (SELECT d.*, source_size, target, certain, lack, CASE WHEN source_size > 0 THEN lack / source_size ELSE 0.0 END AS p
      FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source),
q AS (SELECT *, CASE WHEN p > 0 THEN floor(u * (1.0::DOUBLE - p) / (u * (1.0::DOUBLE - p) + (1.0::DOUBLE - u) * p) * 1125899906842624.0)::BIGINT END AS rank FROM r),
s AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank) AS upto, sum(size) OVER (PARTITION BY source, rank) AS own FROM q)
SELECT doc_id, source, size, source_size, target, certain + CASE WHEN rank IS NOT NULL AND upto - own + own / 2 <= lack THEN 1 ELSE 0 END AS copies,
  (certain + CASE WHEN rank IS NOT NULL AND upto - own + own / 2 <= lack THEN 1 ELSE 0 END) * size AS taken
FROM s
"""
