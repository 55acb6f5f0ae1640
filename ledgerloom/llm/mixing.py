"""Mixing sources to target weights by a splitting tree over exact block quotas.

Sizes are word counts.  Each source's target is its weighted share of all words,
at most MOST_COPIES times its own size; what a capped source leaves is shared by
weight among the others, round by round until no more are capped (each round one
aggregation over the sources).

A document's place is fixed by md5(seed, doc_id): it puts the document into one of
its source's blocks, of BLOCK_WORDS words on average whatever the input, and orders it
there.  A source is drawn as so many whole copies of all its blocks plus, for the rest of its
target, its first blocks in that permuted order; of the block in which the rest runs out,
documents are drawn by falling size while they fit, of one size by key.  So one row a
source decides every document by itself: copies, whole blocks, and for each size in
that one block the last key drawn (a few hundred sizes, as they sum up to no more than the block).

A source's quota is its number of drawn blocks, repeats counted.  The tree starts with all
quotas in one node and halves the nodes level by level: how many of each source's blocks go
left is a multivariate hypergeometric draw, source by source from what is left of the
node, by inversion with a random number from md5 of seed, node and source.  So both
halves' sizes and all quotas stay exact.  With more sources than FAN, the draw goes first to
groups of sources and from there to their members, so that no array is longer than FAN.  The
leaves are the output shards, of SHARD_UNITS blocks or a few less.  Each node's draws
are consecutive in the source's order of blocks, so shards get disjoint permuted blocks, which are
shuffled locally by md5 within the shard.

Everything is DataFrame functions.  The tables it works on have a row for each source, for
each node and source, or for each drawn block.  Documents of one doc_id, source and size are
drawn alike.

Null texts have size 0; a null source is a source, the last one; null doc_ids share
one key.  A source without words has target 0 and its documents are not drawn.  An empty
table gives an empty table.  Other columns are handed through by mix(); internal
columns begin with "__".
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, stored, table
from ledgerloom.sources.shared import numbered

WEIGHTS, MOST_COPIES = (1, 2, 3), 3
BLOCK_WORDS, SEED = 65_536, "mix"
#: Most units a shard, most sources in one draw of the tree, blocks whose words are first summed.
SHARD_UNITS, FAN, RUN = 64, 256, 1024
#: Rows of 100 bytes or less that may be broadcast.
SMALL = 500_000
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """A document's permuted key: 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))


def block_of(key: Column, blocks: Column) -> Column:
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), blocks)


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """sources (source, source_size) with place, weight and target: weighted shares of all words, none above most times its size."""
    ranked = numbered(sources, F.col("source").asc_nulls_last())
    weighted = cut(ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("__cap", most * F.col("source_size")))
    words, weight = weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level, capped = float(words) / max(1, weight), -1
    while True:  # a capped source leaves the others more, so the level rises and sources stay capped
        full = F.col("__cap") <= F.lit(level) * F.col("weight")
        n, taken, of_weight = weighted.where(full).agg(F.count(F.lit(1)), F.coalesce(F.sum("__cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n == capped or of_weight == weight:
            break
        level, capped = float(words - taken) / (weight - of_weight), n
    return weighted.withColumn("target", F.when(full, F.col("__cap").cast("double")).otherwise(F.lit(level) * F.col("weight"))).drop("__cap")


def plan(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES, block_words: int = BLOCK_WORDS, seed: str = SEED) -> DataFrame:
    """A row for each source: place, source_size, target, blocks, copies of all, whole blocks, and the edge block's last keys by size.

    docs has doc_id, source and size.
    """
    keyed = docs.select("source", "size", key_of("doc_id", seed).alias("key"))
    sources = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    sources = sources.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long"))
    # a target at the cap is whole copies only; rounding must not turn it into one copy fewer and a rest
    sources = sources.withColumn("copies", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size") + 1e-12))).otherwise(0).cast("long"))
    sources = cut(sources.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("copies") * F.col("source_size"))))
    same = lambda s: F.col("source").eqNullSafe(F.col(s))
    side = _small(sources.select(F.col("source").alias("s"), "blocks"), sources.count())
    placed = keyed.join(side, same("s")).select("source", "size", "key", block_of(F.col("key"), F.col("blocks")).alias("block"))
    sized = cut(placed.groupBy("source", "block").agg(F.sum("size").alias("words")))
    # the first blocks whose running total stays within the rest are whole; the next one is the edge.  Runs of blocks come first, then the blocks of one run
    rests = sources.select(F.col("source").alias("s"), "rest")
    runs = sized.groupBy("source", F.floor(F.col("block") / RUN).alias("run")).agg(F.sum("words").alias("words"))
    upto = lambda by, order: F.sum("words").over(Window.partitionBy(*by).orderBy(order))
    over = runs.withColumn("upto", upto(["source"], "run")).join(rests, same("s")).where(F.col("upto") > F.col("rest"))
    edge_runs = over.groupBy("s", "rest").agg(F.min(F.struct("run", (F.col("upto") - F.col("words")).alias("before"))).alias("e")).select("s", "rest", F.col("e.run").alias("run"), F.col("e.before").alias("before"))
    inside = sized.join(edge_runs, same("s") & (F.floor(F.col("block") / RUN) == F.col("run")))
    over = inside.withColumn("upto", F.col("before") + upto(["s"], "block")).where(F.col("upto") > F.col("rest"))
    edges = cut(over.groupBy("s", "rest").agg(F.min(F.struct("block", (F.col("upto") - F.col("words")).alias("before"))).alias("e")).select("s", F.col("e.block").alias("edge"), (F.col("rest") - F.col("e.before")).alias("open")))
    # documents of the edge block by falling size while they fit, of one size by key.  A block has BLOCK_WORDS words on average, so these arrays are bounded
    at_edge = placed.where("size > 0").join(_small(edges, sources.count()), same("s") & (F.col("block") == F.col("edge")))
    by_key = at_edge.groupBy("s", "edge", "open", "size", "key").agg(F.count(F.lit(1)).alias("n"))
    by_size = by_key.groupBy("s", "edge", "open", "size").agg(F.sort_array(F.collect_list(F.struct("key", "n"))).alias("keys"))
    whole_block = by_size.groupBy("s", "edge", "open").agg(F.sort_array(F.collect_list(F.struct("size", "keys")), asc=False).alias("sizes"))
    taken = F.expr(
        "aggregate(sizes, named_struct('open', cast(open as double), 'last', cast(array() as array<struct<size:bigint,key:string>>)), (acc, x) -> element_at(transform(array("
        # of the size's keys the first ones for which there is room: how many documents, and the last key
        "aggregate(x.keys, named_struct('n', 0L, 'key', cast(null as string), 'more', true), (a, y) -> if(a.more and (a.n + y.n) * x.size <= acc.open, named_struct('n', a.n + y.n, 'key', y.key, 'more', true), named_struct('n', a.n, 'key', a.key, 'more', false)))),"
        " t -> named_struct('open', acc.open - t.n * x.size, 'last', if(t.n > 0, array_append(acc.last, named_struct('size', x.size, 'key', t.key)), acc.last))), 1), acc -> map_from_entries(acc.last))"
    )
    cuts = whole_block.select("s", "edge", taken.alias("last"))
    # without an edge the rest covers all blocks
    out = sources.join(cuts, same("s"), "left")
    none = F.create_map().cast("map<bigint,string>")
    return cut(out.select("source", "place", "source_size", "weight", "target", "blocks", "copies", F.coalesce("edge", "blocks").alias("whole"), F.coalesce("last", none).alias("last")))


def quotas(sources: DataFrame) -> DataFrame:
    """sources with q, the number of drawn blocks, repeats counted."""
    edge = (F.col("whole") < F.col("blocks")) & (F.size("last") > 0)
    return sources.withColumn("q", F.col("copies") * F.col("blocks") + F.when(F.col("source_size") > 0, F.col("whole")).otherwise(0) + edge.cast("int"))


_LOG_FACTORIALS = [math.lgamma(n + 1) for n in range(32)]


def _log_factorial(n: str) -> str:
    """SQL for the logarithm of n!, by Stirling's series from 32 on (error below 1e-11)."""
    small = f"element_at(array({', '.join(f'{x!r}D' for x in _LOG_FACTORIALS)}), cast({n} as int) + 1)"
    return f"if({n} < 32, {small}, {n} * ln({n}) - {n} + 0.5D * ln(6.283185307179586D * {n}) + 1 / (12D * {n}) - 1 / (360D * pow(cast({n} as double), 3)))"


def _hypergeometric() -> str:
    """SQL lambda body: of d draws without repeats from w units, g of which are good, the number of good ones for the uniform number u.

    Inversion outwards from the mode; x is a struct (g, w, d, u, m) with m the mode.
    """
    parts = "x.g, x.m, x.g - x.m, x.w - x.g, x.d - x.m, x.w - x.g - x.d + x.m, x.w, x.d, x.w - x.d"
    signs = "1D, -1D, -1D, 1D, -1D, -1D, -1D, 1D, 1D"
    log_p = f"aggregate(zip_with(array({parts}), array({signs}), (n, s) -> s * {_log_factorial('n')}), 0D, (a, y) -> a + y)"
    steps = "cast(12 * sqrt(x.d * (cast(x.g as double) / x.w) * (1 - cast(x.g as double) / x.w)) + 30 as int)"
    up = "a.ph * (x.g - a.hi) * (x.d - a.hi) / ((a.hi + 1D) * (x.w - x.g - x.d + a.hi + 1D))"
    down = "if(a.lo > 0, a.pl * a.lo * (x.w - x.g - x.d + a.lo) / ((x.g - a.lo + 1D) * (x.d - a.lo + 1D)), 0D)"
    first = f"element_at(transform(array(exp({log_p})), p -> named_struct('u', x.u - p, 'hi', x.m, 'ph', p, 'lo', x.m, 'pl', p, 'out', x.m)), 1)"
    # a step each way; what is found stays
    step = (
        f"if(a.u < 0, a, element_at(transform(array(named_struct('h', {up}, 'l', {down})), t -> named_struct('u', if(a.u - t.h < 0, a.u - t.h, a.u - t.h - t.l), 'hi', a.hi + 1, 'ph', t.h, 'lo', a.lo - 1, 'pl', t.l,"
        " 'out', if(a.u - t.h < 0, a.hi + 1, if(a.u - t.h - t.l < 0, a.lo - 1, a.out)))), 1))"
    )
    return f"if(x.g = 0 or x.d = 0, 0L, if(x.g = x.w, x.d, if(x.d = x.w, x.g, aggregate(sequence(1, {steps}), {first}, (a, i) -> {step}, a -> a.out))))"


def drawn(nodes: DataFrame, seed: str = SEED) -> DataFrame:
    """nodes (node, d, members: array of (item, q)) with left, an array of (item, q, l): how many of each item's q are among the d drawn."""
    uniform = f"cast(conv(substring(md5(cast(concat_ws(':', '{seed}', cast(node as string), cast(x.item as string)) as binary)), 1, 13), 16, 10) as double) / 4503599627370496D"
    draw = f"element_at(transform(array(named_struct('g', x.q, 'w', acc.w, 'd', acc.d, 'u', {uniform}, 'm', cast(floor((acc.d + 1D) * (x.q + 1D) / (acc.w + 2D)) as bigint))), x -> {_hypergeometric()}), 1)"
    fold = (
        "aggregate(members, named_struct('w', aggregate(members, 0L, (a, x) -> a + x.q), 'd', d, 'out', cast(array() as array<struct<item:bigint,q:bigint,l:bigint>>)),"
        f" (acc, x) -> element_at(transform(array({draw}), l -> named_struct('w', acc.w - x.q, 'd', acc.d - l, 'out', array_append(acc.out, named_struct('item', x.item, 'q', x.q, 'l', l)))), 1), acc -> acc.out)"
    )
    return nodes.withColumn("left", F.expr(fold))


def halved(rows: DataFrame, sources: int, seed: str = SEED) -> DataFrame:
    """Rows (node, item, q, start) of the tree's next level: each node halved, the larger half left; rows without draws are left out."""
    depth = 1
    while FAN**depth < sources:
        depth += 1
    of = lambda k: F.floor(F.col("item") / FAN**k).cast("long")
    # groups of groups first: the number drawn from a group is what its members' draw shares out
    d = rows.groupBy("node", F.lit(0).cast("long").alias("up")).agg(F.ceil(F.sum("q") / 2).cast("long").alias("d"))
    for k in reversed(range(depth)):
        sums = rows.groupBy("node", of(k).alias("item")).agg(F.sum("q").alias("q")).withColumn("up", F.floor(F.col("item") / FAN).cast("long") if k < depth - 1 else F.lit(0).cast("long"))
        members = sums.groupBy("node", "up").agg(F.sort_array(F.collect_list(F.struct("item", "q"))).alias("members"))
        taken = drawn(members.join(d, ["node", "up"]), f"{seed}:{k}").select("node", F.explode("left").alias("x")).select("node", "x.item", "x.l")
        d = taken.select("node", F.col("item").alias("up"), F.col("l").alias("d"))
    both = rows.join(taken, ["node", "item"])
    child = lambda bit, q, start: F.struct((F.col("node") * 2 + bit).alias("node"), F.col("item"), q.alias("q"), start.alias("start"))
    halves = F.array(child(0, F.col("l"), F.col("start")), child(1, F.col("q") - F.col("l"), F.col("start") + F.col("l")))
    return both.select(F.explode(halves).alias("x")).select("x.*").where("q > 0")


def units(sources: DataFrame, splits: int, seed: str = SEED) -> DataFrame:
    """(source, block, copy, shard) for each block draw, from halving all quotas splits times."""
    known = cut(quotas(sources).where("q > 0"))
    rows, n = known.select(F.lit(0).cast("long").alias("node"), (F.col("place") - 1).cast("long").alias("item"), "q", F.lit(0).cast("long").alias("start")), sources.count()
    for level in range(splits):
        rows = cut(halved(rows, n, f"{seed}:{level}"))
    leaves = rows.select(F.col("node").cast("int").alias("shard"), F.col("item").alias("__item"), F.explode(F.sequence(F.col("start"), F.col("start") + F.col("q") - 1)).alias("__j"))
    side = _small(known.select((F.col("place") - 1).cast("long").alias("__item"), "source", "blocks"), n)
    return leaves.join(side, "__item").select("source", F.pmod("__j", F.col("blocks")).alias("block"), (F.floor(F.col("__j") / F.col("blocks")) + 1).cast("long").alias("copy"), "shard")


def drawn_copies(block: Column, key: Column, size: Column) -> Column:
    """Times a document is drawn, by its block, key and size and its source's row of the plan."""
    extra = (block < F.col("__whole")) | ((block == F.col("__whole")) & F.coalesce(key <= F.element_at("__last", size), F.lit(False)))
    return (F.col("__copies") + F.when(extra & (F.col("__source_size") > 0), 1).otherwise(0)).cast("long")


def _small(side: DataFrame, rows: int) -> DataFrame:
    """side to be broadcast if it has so few rows; otherwise Spark joins by shuffling."""
    return F.broadcast(side) if rows <= SMALL else side


def _with_plan(docs: DataFrame, sources: DataFrame, doc_id: str, text: str, source: str, seed: str) -> DataFrame:
    # counted in sources and their edge blocks' sizes
    side = _small(sources, sources.agg(F.coalesce(F.sum(F.size("last") + 1), F.lit(0))).first()[0])
    side = side.withColumnsRenamed({c: f"__{c}" for c in sources.columns})
    keyed = docs.withColumn("__key", key_of(doc_id, seed)).join(side, F.col(source).eqNullSafe(F.col("__source")))
    return keyed.withColumn("__block", block_of(F.col("__key"), F.col("__blocks"))).withColumn("__n", drawn_copies(F.col("__block"), F.col("__key"), F.when(F.col("__block") == F.col("__whole"), size_of(text))))


def _sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(text).alias("size")))


def _mixed(docs: DataFrame, sources: DataFrame, doc_id: str, text: str, source: str, splits: int | None, seed: str) -> DataFrame:
    """mix() by the plan of its sources."""
    rows = _with_plan(docs, sources, doc_id, text, source, seed).where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    many = quotas(sources).agg(F.coalesce(F.sum("q"), F.lit(0))).first()[0]
    if splits is None:
        splits = max(0, math.ceil(math.log2(max(1, many) / SHARD_UNITS)))
    side = units(sources, splits, seed).select(F.col("source").alias("__s"), F.col("block").alias("__b"), F.col("copy").alias("__c"), F.col("shard").alias("__shard"))
    rows = rows.join(_small(side, many), F.col(source).eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b")) & (F.col("__copy") == F.col("__c")))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("__shard"), F.col("__key"), F.col("__copy")).cast("binary"))
    return rows.repartition("__shard").sortWithinPartitions("__shard", order).select(*[F.col(c) for c in docs.columns if c != "shard"], F.col("__shard").alias("shard"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, most: int = MOST_COPIES, block_words: int = BLOCK_WORDS, splits: int | None = None, seed: str = SEED) -> DataFrame:
    """The mixed documents, each as often as it is drawn, with its column shard; shuffled within each shard."""
    sources = plan(_sized(docs, doc_id, text, source), weights, most, block_words, seed)
    return _mixed(docs, sources, doc_id, text, source, splits, seed)


def amounts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, most: int = MOST_COPIES, block_words: int = BLOCK_WORDS, splits: int | None = None, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) of each document.

    The mix is made with its texts and stored, and taken is counted in its rows.  Rows with equal doc_id, source
    and size are drawn alike, so each has an equal part of what the mix holds of them.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"))
    sized = _sized(named, "doc_id", "text", "source")
    sources = plan(sized, weights, most, block_words, seed)
    mixed = stored(_mixed(named, sources, "doc_id", "text", "source", splits, seed))
    there = sized.withColumns({"__rows": F.lit(1).cast("long"), "__words": F.lit(0).cast("long")})
    drawn = mixed.select("doc_id", "source", size_of().alias("size")).withColumns({"__rows": F.lit(0).cast("long"), "__words": F.col("size")})
    each = there.unionByName(drawn).groupBy("doc_id", "source", "size").agg(F.sum("__rows").alias("__rows"), F.sum("__words").alias("__words"))
    side = _small(sources.select(F.col("source").alias("__source"), "source_size", "target"), sources.count())
    each = each.join(side, F.col("source").eqNullSafe(F.col("__source"))).withColumn("taken", F.expr("__words div __rows"))
    return each.withColumn("__row", F.explode(F.sequence(F.lit(1), F.col("__rows")))).select("doc_id", "size", "source_size", "target", "taken")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amounts(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lv FROM s1
       WINDOW o AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, 3 * source_size <= lv * w AS capped FROM s2),
s4 AS (SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE
         ELSE w * (SELECT max(lv) FROM s3 WHERE NOT capped) END AS target,
         greatest(1, ceil(source_size::DOUBLE / {BLOCK_WORDS}))::BIGINT AS nb FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size + 1e-12)) ELSE 0 END::BIGINT AS copies FROM s4),
s6 AS (SELECT *, greatest(0.0, target - copies * source_size) AS rest FROM s5),
p AS (SELECT d.*, s6.* EXCLUDE (source), ('0x' || substr(k, 1, 8))::BIGINT % nb AS b FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
q AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY b RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM p),
e AS (SELECT source, rest, min(b) AS edge, min(upto) AS upto FROM q WHERE upto > rest GROUP BY ALL),
u AS (SELECT q.source, k, sum(size)::BIGINT AS z, any_value(e.rest - e.upto) + sum(sum(size)) OVER (PARTITION BY q.source) AS room,
             row_number() OVER (PARTITION BY q.source ORDER BY sum(size) DESC, k) AS i
      FROM q JOIN e ON q.source IS NOT DISTINCT FROM e.source AND q.b = e.edge WHERE size > 0 GROUP BY q.source, k),
g AS (SELECT source, 0::BIGINT AS i, NULL::VARCHAR AS k, any_value(room)::DOUBLE AS room, false AS got FROM u GROUP BY source
      UNION ALL
      SELECT u.source, u.i, u.k, g.room - CASE WHEN u.z <= g.room THEN u.z ELSE 0 END, u.z <= g.room
      FROM g JOIN u ON u.source IS NOT DISTINCT FROM g.source AND u.i = g.i + 1)
SELECT doc_id, size, source_size, target, (size * (copies + CASE WHEN q.upto <= q.rest OR coalesce(g.got, false) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM q LEFT JOIN g ON q.source IS NOT DISTINCT FROM g.source AND q.k = g.k
"""
