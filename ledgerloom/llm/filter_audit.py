"""Filter interaction audit: what each filter removes, in every order of the filters.

Each document gets the mask of the filters that it fails.  Documents are counted by part
and mask, with the good and the toxic ones among them, which is all that a part's audit
needs: at most 2^k rows a part for k filters, pre-aggregated before the shuffle, so that
neither a hot part nor a hot text meets in one task.

A part's counts are built into a decision diagram: a level a filter, a branch for passing
and one for failing, equal branches shared, and each node weighted with the counts below
it.  Orders follow each other by one swap of neighbours, and the diagram is reordered by
that swap of two adjacent levels, which touches no other level's filters.  On the path on
which everything passes, a node's failing branch is what its filter removes at that step
and its passing branch what is kept; at the first step that is all that fails the filter,
at the last one what fails it only.

Handling: null texts count as empty; null parts are the empty part; a null doc_id fails
no comparison with other documents (E) and isn't the smaller one in any.  Rows that are
repeated with their doc_id are documents of their own, none of which is smaller than the
other.  Several labels of a doc_id count as one, which is good (toxic) if any of them is.
Documents without a label, or with a null one, are neither.  An empty table gives an empty
table.  Other columns of either table are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import HOT, cut, lean, table

#: Least words, least share of distinct words and largest share of capitals (in hundredths), and the characters not wanted.
WORDS, DISTINCT, CAPITALS, SIGNS = 50, 65, 5, "#$%&*|"
BLANKS = r"[\x20\x09-\x0D]+"
Weights = tuple[int, ...]


def text_filters(text: Column) -> list[Column]:
    """Whether a text fails each of the filters A to D."""
    words = F.filter(F.split(text, BLANKS, -1), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return [F.size(words) < WORDS, 100 * F.size(F.array_distinct(words)) < DISTINCT * F.size(words), 100 * capitals > CAPITALS * F.length(text), text.rlike(f"[{SIGNS}]")]


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """doc_id, part and mask of each document: bit i is set if it fails filter i of ABCDE."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("text"))
    mask = sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(text_filters(F.col("text")))), F.lit(0))
    # digests instead of texts from here on, computed once for both sides of the join
    rows = cut(rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").select("digest", "first", "n")
    firsts, total = cut(firsts), rows.count()
    again = F.when(F.col("doc_id") > F.col("first"), F.lit(16)).otherwise(F.lit(0))
    # rows of a text that has over a HOT-th of all rows stay where they are; HOT such texts at most are broadcast
    hot = F.broadcast(firsts.where(F.col("n") * HOT > total))
    rest = rows.join(hot, "digest", "left_anti").join(firsts.where(F.col("n") * HOT <= total), "digest", "left")
    both = rows.join(hot, "digest").unionByName(rest)
    return both.select("doc_id", "part", (F.col("mask") + again).alias("mask"))


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: the documents of each mask, and those that are labelled so."""
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    numbered = failed.where("doc_id is not null").join(known, "doc_id", "left")  # rows without an id have no label, and no place in a join
    rows = numbered.select("part", "mask", "good", "toxic").union(failed.where("doc_id is null").select("part", "mask", F.lit(None).cast("int"), F.lit(None).cast("int")))
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic"))


class Diagram:
    """Counts of failure masks as a decision diagram whose levels can be swapped.

    A node is (level's filter, passing branch, failing branch), a leaf the mask's weights; weight holds each node's sums.
    """

    def __init__(self, filters: str, counts: dict[int, Weights]) -> None:
        self.order = list(range(len(filters)))
        self.filters = filters
        self.nodes: list[tuple[int, int, int] | None] = []
        self.weight: list[Weights] = []
        self.known: dict[tuple, int] = {}
        width = len(next(iter(counts.values()), (0,)))

        def build(level: int, mask: int) -> int:
            if level == len(filters):
                return self.leaf(counts.get(mask, (0,) * width))
            return self.node(level, build(level + 1, mask), build(level + 1, mask | 1 << level))

        self.root = build(0, 0)

    def leaf(self, weights: Weights) -> int:
        return self._add(("leaf", weights), None, weights)

    def node(self, which: int, passing: int, failing: int) -> int:
        """The node with these branches; an equal one is shared."""
        key = (which, passing, failing)
        return self._add(key, key, tuple(a + b for a, b in zip(self.weight[passing], self.weight[failing], strict=True)))

    def _add(self, key: tuple, node: tuple[int, int, int] | None, weights: Weights) -> int:
        if key not in self.known:
            self.known[key] = len(self.nodes)
            self.nodes.append(node)
            self.weight.append(weights)
        return self.known[key]

    def swap(self, level: int) -> None:
        """Exchanges a level with the next one; what lies below is as it was, what lies above points to the new nodes."""
        done: dict[int, int] = {}
        upper, lower = self.order[level], self.order[level + 1]

        def moved(at: int, depth: int) -> int:
            if at not in done:
                which, passing, failing = self.nodes[at]
                if depth < level:
                    done[at] = self.node(which, moved(passing, depth + 1), moved(failing, depth + 1))
                else:
                    (_, pp, pf), (_, fp, ff) = self.nodes[passing], self.nodes[failing]
                    done[at] = self.node(lower, self.node(upper, pp, fp), self.node(upper, pf, ff))
            return done[at]

        self.root = moved(self.root, 0)
        self.order[level], self.order[level + 1] = lower, upper

    def steps(self) -> Iterator[tuple[str, Weights, Weights]]:
        """Along the path on which all filters pass: the filter, the weights it keeps and those it removes."""
        at = self.root
        while self.nodes[at] is not None:
            which, passing, failing = self.nodes[at]
            yield self.filters[which], self.weight[passing], self.weight[failing]
            at = passing


def swaps(n: int) -> Iterator[int]:
    """Levels whose swaps with the next one lead through all orders of n filters.

    The last filter walks from one end to the other; between two walks the others make one swap of theirs.
    """
    if n < 2:
        return
    at_end = True  # whether the walking filter is behind the others
    for inner in [*swaps(n - 1), None]:
        yield from range(n - 2, -1, -1) if at_end else range(n - 1)
        at_end = not at_end
        if inner is not None:
            yield inner + (0 if at_end else 1)


def audit(filters: str, counts: dict[int, Weights]) -> list[tuple]:
    """filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for all orders of the filters."""
    diagram = Diagram(filters, counts)
    rows, alone, only, shared = [], {}, {}, dict.fromkeys(filters, 0)
    for swap in [None, *swaps(len(filters))]:
        if swap is not None:
            diagram.swap(swap)
        order = "".join(filters[i] for i in diagram.order)
        for step, (which, kept, removed) in enumerate(diagram.steps(), 1):
            shared[which] += removed[0]
            if step == 1:
                alone[which] = removed[0]
            if step == len(filters):
                only[which] = removed[0]
            rows.append((order, step, kept[0], *removed))
    return [(order, step, kept, n, alone[order[step - 1]] - n, only[order[step - 1]], good, toxic, shared[order[step - 1]]) for order, step, kept, n, good, toxic in rows]


FILTERS = "ABCDE"
COLUMNS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
_KINDS = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]


def interactions(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """COLUMNS for each part, order and step."""
    counts = mask_counts(failures(docs, doc_id, text, part), labels)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # a row a mask: 32 at most

    def run(batches):
        for batch in batches:
            for name, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = audit(FILTERS, {x["mask"]: (x["n"], x["good"], x["toxic"]) for x in some})
                values = [[name] * len(rows), *zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, _KINDS, strict=True)], names=[c.split()[0] for c in COLUMNS.split(", ")])

    return parts.mapInArrow(lean(run), COLUMNS)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > first THEN 'E' ELSE '' END AS mask,
        count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS f, filter_order[1:step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, f,
        coalesce(sum(n) FILTER (WHERE translate(mask, before || f, '') = mask), 0) AS kept,
        coalesce(sum(n) FILTER (WHERE contains(mask, f) AND translate(mask, before, '') = mask), 0) AS removed,
        coalesce(sum(n) FILTER (WHERE contains(mask, f) AND translate(mask, before, '') <> mask), 0) AS redundant,
        coalesce(sum(n) FILTER (WHERE mask = f), 0) AS unique_fails,
        coalesce(sum(good) FILTER (WHERE contains(mask, f) AND translate(mask, before, '') = mask), 0) AS good_lost,
        coalesce(sum(toxic) FILTER (WHERE contains(mask, f) AND translate(mask, before, '') = mask), 0) AS toxic_lost
      FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""
