"""Sharding by extendible hashing.

The directory starts with one bucket (no bits). Only a bucket over the byte limit splits, on the next
bit of its documents' hashes, until every shard fits. A shard is the prefix of bits that leads to it.

Splits need no rounds of their own: bytes are summed per prefix of ``LEVEL_BITS`` bits (partial sums
before the shuffle), all shorter prefixes are summed from those cells, and a cell's shard is its
shortest prefix that fits. Cells that are still too large are opened with the next ``NEXT_BITS`` bits,
so a level costs one pass over the hashes and the directory deepens only where it must.

The levels give the shards; these are broadcast to the documents, one join for each depth that shards have,
up to ``BROADCAST_SHARDS`` of them. Beyond, hashes find their shards without the texts, which are then shuffled
once, to their hash.

Rows: the hash covers id and text, so copies of a text part as well; null text has 0 bytes and null ids
are allowed; one document over the limit is a shard of its own and marked ``oversized``, as are rows
repeated with the same id and text that together pass the limit (60 equal bits cannot be split); an
empty table gives no row; other input columns, whatever their names, pass through untouched, except that
columns named like this operator's outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import stage, text_or_empty, unstage, unused

BYTE_LIMIT = 16 << 20  # of UTF-8 text in a shard
LEVEL_BITS, NEXT_BITS = 12, 8
HASH_BITS = 60
BROADCAST_SHARDS = 500_000  # of 32 bytes each
OUTPUTS = ("bytes", "shard_id", "shard_depth", "shard_bytes", "shard_docs", "oversized")


def hash_bits(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """60 bits as a long, from md5 of id and text."""
    key = F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text_or_empty(text_col)))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def cell_of(hashed: str, top: int) -> Column:
    return F.shiftright(hashed, HASH_BITS - top)


def directory(keys: DataFrame, byte_limit: int) -> DataFrame:
    """(depth, prefix, shard_bytes, shard_docs): the shards of ``keys`` (hash, bytes)."""
    levels, base, todo = [], 0, keys.select("hash", "bytes")
    while True:
        top = min(HASH_BITS, base + (NEXT_BITS if base else LEVEL_BITS))
        cells = stage(todo.groupBy(cell_of("hash", top).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs")), "shard-cells")
        paths = cells.select("cell", "bytes", "docs", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth")).withColumn(
            "prefix", F.expr(f"shiftright(cell, {top} - depth)")
        )
        sums = paths.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
        fits = (F.col("shard_bytes") <= byte_limit) | (F.col("shard_docs") == 1)
        if top >= HASH_BITS:
            fits |= F.col("depth") == top
        best = F.min(F.when(fits, F.struct("depth", "prefix", "shard_bytes", "shard_docs"))).alias("leaf")
        level = stage(paths.select("cell", "depth", "prefix").join(sums, ["depth", "prefix"]).groupBy("cell").agg(best), "shard-level")
        unstage(cells)
        levels.append(level)
        over = level.where("leaf IS NULL").select("cell")
        if top >= HASH_BITS or over.isEmpty():
            break
        todo = todo.withColumn("cell", cell_of("hash", top)).join(over, "cell", "left_semi").drop("cell")
        base = top
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    shards = stage(found.where("leaf IS NOT NULL").select("leaf.*").distinct(), "shards")
    unstage(*levels)
    return shards


def _placed(rows: DataFrame, shards: DataFrame, depths: list[int], hashed: str, leaf: str, small: bool) -> DataFrame:
    """``rows`` with the shard of their hash as the struct ``leaf``: one join for each depth, on the prefix of so many bits."""
    names = []
    for depth in depths:
        at, found = unused(rows.columns, f"_at{depth}"), unused(rows.columns, f"_shard{depth}")
        part = shards.where(F.col("depth") == depth).select(F.col("prefix").alias(at), F.struct("depth", "prefix", "shard_bytes", "shard_docs").alias(found))
        rows = rows.withColumn(at, cell_of(hashed, depth)).join(F.broadcast(part) if small else part, at, "left").drop(at)
        names.append(found)
    return rows.withColumn(leaf, F.coalesce(*names)).drop(*names)


def shard_name(prefix: Column, depth: Column) -> Column:
    """The bits of the prefix; the one shard of an unsplit directory is called 'all'."""
    return F.when(depth == 0, F.lit("all")).otherwise(F.lpad(F.conv(prefix.cast("string"), 10, 2), depth, F.lit("0")))


def assign_shards(docs: DataFrame, byte_limit: int = BYTE_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with bytes (of the row), shard_id, shard_depth, shard_bytes, shard_docs and oversized."""
    kept = [c for c in docs.columns if c.lower() not in OUTPUTS]
    hashed, size, leaf = (unused(docs.columns, x) for x in ("_hash", "_size", "_leaf"))
    out = docs.withColumns({hashed: hash_bits(id_col, text_col), size: F.octet_length(text_or_empty(text_col)).cast("bigint")})
    keys = stage(out.select(F.col(hashed).alias("hash"), F.col(size).alias("bytes")), "shard-keys")
    shards = directory(keys, byte_limit)
    depths = sorted(r[0] for r in shards.select("depth").distinct().collect()) or [0]  # 61 at most
    if shards.count() <= BROADCAST_SHARDS:
        out = _placed(out, shards, depths, hashed, leaf, small=True)
    else:
        found = stage(_placed(keys.select("hash").distinct(), shards, depths, "hash", "leaf", small=False), "shard-of-hash")
        out = out.join(found.select(F.col("hash").alias(hashed), F.col("leaf").alias(leaf)), hashed, "left")
    unstage(keys)
    at = lambda name: F.col(f"{leaf}.{name}")
    return out.select(
        *(f"`{c}`" for c in kept), F.col(size).alias("bytes"), shard_name(at("prefix"), at("depth")).alias("shard_id"), at("depth").alias("shard_depth"),
        at("shard_bytes").alias("shard_bytes"), at("shard_docs").alias("shard_docs"), (at("shard_bytes") > byte_limit).alias("oversized"),
    )


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder per shard. Rows of a shard meet in one task, which its byte limit bounds."""
    assigned.repartition("shard_id").write.partitionBy("shard_id").mode("overwrite").parquet(path)


ORACLE = f"""
WITH d AS (SELECT *, md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS bytes FROM documents),
b AS (SELECT doc_id, bytes, printf('%060b', ('0x' || substr(h, 1, 15))::BIGINT) AS bits FROM d),
n AS (SELECT b.*, g.depth::INTEGER AS depth, left(bits, g.depth::INTEGER) AS prefix FROM b, range(0, 31) g(depth)),
s AS (SELECT depth, prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM n GROUP BY ALL),
f AS (SELECT n.doc_id, n.bytes, s.*, row_number() OVER (PARTITION BY n.doc_id, n.bits ORDER BY n.depth) AS rn
      FROM n JOIN s USING (depth, prefix) WHERE shard_bytes <= {BYTE_LIMIT} OR shard_docs = 1)
SELECT doc_id, bytes, CASE WHEN depth = 0 THEN 'all' ELSE prefix END AS shard_id, depth AS shard_depth, shard_bytes, shard_docs,
  shard_bytes > {BYTE_LIMIT} AS oversized FROM f WHERE rn = 1
"""
