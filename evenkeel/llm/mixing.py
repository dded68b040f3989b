"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Sources in code-point order, null last, weigh 5, 2, 1, repeating.  Their targets share
the total of all sizes by weight; a target stops at ``MAX_EPOCHS`` times its source's
size and the excess is shared again by weight.  That fixed point has a closed form:
with sources sorted by cap / weight, the common level is the remaining total over the
remaining weight at the first source whose cap / weight reaches it.

Schedule.  Point i is the fractional part of i times the golden ratio, in 32-bit
integers (Weyl sequence), mapped through the cumulative targets to a source.  The
points of a source are ranked; rank k asks for block k of the source's stream.  A
source has ceil(target / BLOCK_TOKENS) slots: the few points beyond are dropped, the
few missing ones (the discrepancy, logarithmic in the number of points) come last.

Blocks.  A source's documents, shuffled by a hash of their id, are laid end to end and
repeated; block k holds the words [k * BLOCK_TOKENS, (k + 1) * BLOCK_TOKENS), the last
one up to the rounded target.  Slots and blocks meet in an equi-join on (source, block).
The mix comes in the order of its slots: its partitions are equal runs of slots, sorted,
so a reader that goes through them in order meets the sources at their target weights
all along; the digest names the first slot of each document.

Offsets and ranks are prefix sums in levels, over hash buckets or chunks of points and
then inside each, so that a source with a third of all rows is many window groups.  The
numbers of buckets follow the number of rows, and points meet the sources' intervals in
an equi-join on cells of the unit interval.  Sizes and ids are written once to the shared
folder; words are counted once.

Defined results: a null text has size 0 and is never taken; null is a source like any
other and comes last; rows with the same id are separate documents; rows without an id
are shuffled by their text; an empty table gives an empty table; other columns are
ignored and kept, whatever their names.  Ties in the shuffle are broken by id and size,
so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import dealt, stored

BLOCK_TOKENS = 1024
MAX_EPOCHS = 3
WEIGHTS = (5, 2, 1)
#: Rows of a hash bucket, about; points in a chunk of the schedule, and chunks in a group.
BUCKET_ROWS = 1 << 14
CHUNK = 4096
GROUP = 512
#: Cells of the unit interval that sources' intervals are looked up by, as a power of two.
CELLS_LOG2 = 12
#: Slots in a partition of the mix, at most.
RUN = 1 << 14
#: The golden ratio's fractional part in 32 bits.
GOLDEN = 2654435769


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null counts as empty."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(flat == "", F.lit(0)).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")


def keys(docs: DataFrame) -> list[Column]:
    """(h, tag): the place in the shuffle, by the id or, without one, by the text; and a hash of the text."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return [F.md5(F.coalesce(docs["doc_id"].cast("string"), text)).alias("h"), F.xxhash64(text).alias("tag")]


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h, tag, bucket, rn): what the schedule needs of each document."""
    digits = min(8, max(2, (docs.count() // BUCKET_ROWS).bit_length() // 4 + 1))
    base = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), word_count(docs["text"].cast("string")).alias("size"), *keys(docs)
    ).withColumn("bucket", F.substring("h", 1, digits))
    order = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "tag")
    return base.withColumn("rn", F.row_number().over(order))


def targets(base: DataFrame) -> DataFrame:
    """(source, source_size, weight, target, quota_words, low, high): one row for each source.

    ``low`` and ``high`` are the source's interval of 32-bit points.
    """
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here on: these windows see aggregated rows only.
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy(F.lit(1))
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    s = sizes.withColumn("k", F.row_number().over(by_name)).withColumn("weight", F.element_at(weights, (F.pmod(F.col("k") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * MAX_EPOCHS)
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "k").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum("cap").over(by_cap), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0))
    s = s.withColumn("level", left / weight_left)
    s = s.withColumn("level", F.max(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))).over(everything))
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    s = s.withColumn("quota_words", F.floor(F.col("target") + 0.5))
    share = F.sum("quota_words").over(by_name.rowsBetween(Window.unboundedPreceding, 0)) / F.greatest(F.sum("quota_words").over(everything), F.lit(1))
    s = s.withColumn("high", F.floor(share * float(1 << 32)))
    s = s.withColumn("low", F.coalesce(F.lag("high").over(by_name), F.lit(0)))
    return s.select("source", "k", "source_size", "weight", "target", "quota_words", "low", "high")


def point(i: Column) -> Column:
    """i times the golden ratio, its fraction in 32 bits; no product exceeds 2**49."""
    i = F.pmod(i, F.lit(1 << 32))
    high, low = F.shiftright(i, 16), i.bitwiseAND(F.lit((1 << 16) - 1))
    return F.pmod(F.pmod(high * GOLDEN, F.lit(1 << 32)) * (1 << 16) + low * GOLDEN, F.lit(1 << 32))


def _before(counts: DataFrame, key: str, group: Column) -> DataFrame:
    """(k, key, before): what a source's earlier chunks hold, summed over groups of chunks and then inside each."""
    inside = Window.partitionBy("k", "group").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    groups = Window.partitionBy("k").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("group", group)
    outer = counts.groupBy("k", "group").agg(F.sum("n").alias("all")).withColumn("outer", F.coalesce(F.sum("all").over(groups), F.lit(0)))
    counts = counts.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return counts.join(outer, ["k", "group"]).select("k", key, (F.col("outer") + F.col("inner")).alias("before"))


def slots(goals: DataFrame) -> int:
    """The number of points, which is that of blocks of all sources together."""
    return int(goals.agg(F.coalesce(F.sum(F.ceil(F.col("quota_words") / BLOCK_TOKENS)), F.lit(0))).first()[0])


def schedule(base: DataFrame, goals: DataFrame) -> DataFrame:
    """(slot, k, block): the schedule; slot orders it, ``k`` numbers the source."""
    spark = base.sparkSession
    goals = goals.withColumn("quota", F.ceil(F.col("quota_words") / BLOCK_TOKENS))
    points = slots(goals)
    shift = 32 - CELLS_LOG2
    drawn = spark.range(points).select("id", point(F.col("id")).alias("u"), F.floor(F.col("id") / CHUNK).alias("chunk"))
    drawn = drawn.withColumn("cell", F.shiftright("u", shift))
    # A source is listed in the cells that its interval meets: all sources together are as many rows as there are cells and sources.
    ranges = goals.where("high > low").select("k", "quota", "low", "high")
    ranges = ranges.withColumn("cell", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))))
    drawn = drawn.join(ranges, "cell").where("u >= low AND u < high").select("id", "chunk", "k", "quota")
    counts = drawn.groupBy("k", "chunk").agg(F.count("*").alias("n"))
    before = _before(counts, "chunk", F.floor(F.col("chunk") / GROUP))
    rank = F.row_number().over(Window.partitionBy("k", "chunk").orderBy("id")) - 1
    ranked = drawn.withColumn("r", rank).join(before, ["k", "chunk"]).select(F.col("id").alias("slot"), "k", (F.col("before") + F.col("r")).alias("block"), "quota").where("block < quota").drop("quota")
    have = counts.groupBy("k").agg(F.sum("n").alias("n"))
    short = goals.join(have, "k", "left").select("k", "quota", F.coalesce("n", F.lit(0)).alias("n")).where("quota > n")
    late = short.select("k", F.explode(F.sequence(F.col("n"), F.col("quota") - 1)).alias("block"))
    return ranked.unionByName(late.select((F.lit(points) + F.col("block")).alias("slot"), "k", "block"))


def placed(base: DataFrame, goals: DataFrame) -> DataFrame:
    """The documents with ``start``, their offset in the source's shuffled stream."""
    own = base.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    totals = own.groupBy("k", "bucket").agg(F.sum("size").alias("n"))
    before = _before(totals, "bucket", F.substring("bucket", 1, 2))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("k", "bucket").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.withColumn("inside", inside).join(before, ["k", "bucket"])
    return own.withColumn("start", F.col("before") + F.col("inside"))


def pieces(base: DataFrame, goals: DataFrame) -> DataFrame:
    """(doc_id, source, bucket, rn, slot, epoch, from_word, to_word): what each slot takes of each document."""
    docs = placed(base, goals).where("size > 0 AND quota_words > 0")
    docs = docs.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota_words") - 1) / F.col("source_size")))))
    docs = docs.withColumn("a", F.col("epoch") * F.col("source_size") + F.col("start")).where("a < quota_words")
    docs = docs.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / BLOCK_TOKENS), F.floor((F.col("a") + F.col("size") - 1) / BLOCK_TOKENS))))
    low = F.greatest(F.col("block") * BLOCK_TOKENS, F.col("a"))
    high = F.least((F.col("block") + 1) * BLOCK_TOKENS, F.col("a") + F.col("size"), F.col("quota_words"))
    docs = docs.withColumn("from_word", low - F.col("a")).withColumn("to_word", high - F.col("a")).where("to_word > from_word")
    return docs.join(dealt(schedule(base, goals)), ["k", "block"]).select("doc_id", "source", "bucket", "rn", "slot", "epoch", "from_word", "to_word")


def mix_digest(docs: DataFrame) -> DataFrame:
    """One row per document: its size, its source's size and target, the words the mix takes of it, and its first slot.

    ``first_slot`` is null for a document that the mix does not take.
    """
    base = stored(sized(docs))
    goals = stored(targets(base))
    taken = pieces(base, goals).groupBy("source", "bucket", "rn").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.min("slot").alias("first_slot"))
    taken = taken.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.col("rn").alias("r"), "taken", "first_slot")
    goal = goals.select(F.col("source").alias("gs"), "source_size", "target")
    out = base.join(dealt(taken), base["source"].eqNullSafe(taken["s"]) & (base["bucket"] == taken["b"]) & (base["rn"] == taken["r"]), "left")
    out = out.join(goal, out["source"].eqNullSafe(goal["gs"]))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def mix(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them, in the order of its slots.

    One row for each document and epoch, cut to the words taken, in the place of its
    first slot: partitions are equal runs of slots in rising order, sorted inside.  The
    columns are those of ``docs`` (``n_chars`` recomputed if there); a document the mix
    takes twice comes twice, one it does not take is gone.
    """
    spark = docs.sparkSession
    base = stored(sized(docs))
    goals = stored(targets(base))
    spans = pieces(base, goals).groupBy("source", "bucket", "rn", "epoch").agg(F.min("from_word").alias("from"), F.max("to_word").alias("to"), F.min("slot").alias("slot"))
    spans = spans.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.col("rn").alias("r"), "epoch", "from", "to", "slot")
    spans = base.join(dealt(spans), base["source"].eqNullSafe(F.col("s")) & (base["bucket"] == F.col("b")) & (base["rn"] == F.col("r")))
    one = Window.partitionBy("source", "h", "tag", "epoch").orderBy("rn")
    # Written, so that the join with the texts is a plan of its own and the schedule's stages end before it.
    spans = stored(spans.select("source", "h", "tag", "size", F.row_number().over(one).alias("t"), "epoch", "from", "to", "slot"))
    own = docs.select(docs["source"].cast("string").alias("own_source"), *[k.alias("own_" + n) for k, n in zip(keys(docs), ("h", "tag"))], F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    # Equal rows are told apart by a number; texts are moved for it only if there are any.
    twins = base.groupBy("source", "h", "tag").count().where("count > 1").limit(1).count() > 0
    number = F.row_number().over(Window.partitionBy("own_source", "own_h", "own_tag").orderBy("own_h")) if twins else F.lit(1)
    own = own.withColumn("own_t", number)
    out = own.join(dealt(spans), F.col("own_source").eqNullSafe(F.col("source")) & (F.col("own_h") == F.col("h")) & (F.col("own_tag") == F.col("tag")) & (F.col("own_t") == F.col("t")))
    flat = F.trim(F.regexp_replace("row.text", r"[\x20\x09-\x0D]+", " "))
    words = F.slice(F.split(flat, " "), (F.col("from") + 1).cast("int"), (F.col("to") - F.col("from")).cast("int"))
    text = F.when(F.col("to") - F.col("from") == F.col("size"), F.col("row.text")).otherwise(F.array_join(words, " "))
    total = slots(goals)
    parts = max(2 * spark.sparkContext.defaultParallelism, total // RUN)
    # Late slots, a few beyond the last point, go with the last run.
    run = F.least(F.floor(F.col("slot") * parts / max(1, total)), F.lit(parts - 1)).cast("int").alias("run")
    out = out.select(run, "slot", "h", "epoch", "row", text.alias("cut")).repartitionById(parts, "run").sortWithinPartitions("slot", "h", "epoch")
    new = {"text": F.col("cut"), "n_chars": F.length("cut")}
    return out.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s),
c AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM w),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS DOUBLE)
          / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS level
  FROM c WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE), max(CASE WHEN CAST(cap AS DOUBLE) / weight >= level THEN level END) OVER () * weight) AS target
  FROM l),
q AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words, (CAST(floor(target + 0.5) AS BIGINT) + 1023) // 1024 AS quota, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM t),
i AS (
  SELECT *, CAST(floor(CAST(sum(words) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(greatest(sum(words) OVER (), 1) AS DOUBLE) * 4294967296.0) AS BIGINT) AS high FROM q),
j AS (SELECT *, coalesce(lag(high) OVER (ORDER BY k), 0) AS low FROM i),
points AS (SELECT CAST(coalesce(sum(quota), 0) AS BIGINT) AS n FROM j),
u AS (SELECT id, CAST(id * 2654435769 % 4294967296 AS BIGINT) AS u FROM (SELECT unnest(range(n)) AS id FROM points)),
d AS (SELECT u.id AS slot, j.k, j.quota, row_number() OVER (PARTITION BY j.k ORDER BY u.id) - 1 AS block FROM u JOIN j ON u.u >= j.low AND u.u < j.high),
late AS (
  SELECT k, unnest(range(n, quota)) AS block FROM (SELECT j.k, j.quota, count(d.k) AS n FROM j LEFT JOIN d ON d.k = j.k GROUP BY j.k, j.quota) AS have),
slots AS (
  SELECT slot, k, block FROM d WHERE block < quota
  UNION ALL SELECT n + block, k, block FROM late, points),
p AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM base),
x AS (
  SELECT p.doc_id, p.size, q.source_size, q.target, q.k, q.words, p.start, row_number() OVER () AS row_no
  FROM p JOIN q ON p.source IS NOT DISTINCT FROM q.source),
y AS (SELECT row_no, k, size, words, unnest(range((words - 1) // source_size + 1)) * source_size + start AS a FROM x WHERE size > 0 AND words > 0),
z AS (SELECT row_no, k, unnest(range(a // 1024, (least(a + size, words) - 1) // 1024 + 1)) AS block FROM y WHERE a < words),
f AS (SELECT z.row_no, min(slots.slot) AS first_slot FROM z JOIN slots ON slots.k = z.k AND slots.block = z.block GROUP BY z.row_no)
SELECT x.doc_id, x.size, x.source_size, x.target,
       CAST(CASE WHEN x.size = 0 THEN 0 ELSE x.size * (x.words // x.source_size) + greatest(0, least(x.size, x.words % x.source_size - x.start)) END AS BIGINT) AS taken,
       CAST(f.first_slot AS BIGINT) AS first_slot
FROM x LEFT JOIN f ON f.row_no = x.row_no
"""
