"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source's target is its weight's share of all words, but MOST times its own
words at most; what a capped source leaves is shared out again by weight.
Target over words is the number of copies f each of its documents should get:
floor(f) certain whole copies, and one more for a sample.  Inclusion grows with
size, as words are what is mixed: a document's inclusion odds are those of its
source, p / (1 - p) for the fraction p of f, times its size over the source's
mean size.  The sample takes documents by rising order of random odds over
inclusion odds, u / (1 - u) divided by these, until the words that are wanting
are nearest.

No source is brought together in a task: its documents are dealt into
sqrt(documents) ranges of the ranking, whose sums are added up first; only
within a range are documents ranked one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import checkpointed, repeated

#: Copies of a document at most, and the weights of sources in code point order, repeating.
MOST, WEIGHTS = 3, (1, 2, 3)
#: Sources whose totals are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def draw(doc_id: str, seed: str) -> F.Column:
    """A number in (0, 1) that only the id and the seed settle: 52 bits of an MD5 digest, in the middle of their step."""
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":" + seed)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame) -> DataFrame:
    """Per source of `sizes` (none, src, n, source_size): weight, target, copies, need and the number of ranges.

    One ordered pass over sources, not documents: rising by MOST x size over
    weight, the capped ones come first.
    """
    order = Window.orderBy("none", "src")
    weighed = sizes.withColumn("w", F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")).cast("long"))
    rising = Window.orderBy((F.lit(MOST) * F.col("source_size")).cast("double") / F.col("w"), "none", "src")
    upto, down = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = weighed.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(F.lit(MOST) * F.col("source_size")).over(upto), F.lit(0))).alias("left"),
        F.sum("w").over(down).alias("open"),
    ).withColumn("capped", (F.lit(MOST) * F.col("source_size")).cast("double") / F.col("w") <= F.col("left").cast("double") / F.col("open"))
    level = filled.withColumn("rn", F.row_number().over(rising))
    first = F.min(F.when(~F.col("capped"), F.struct("rn", "left", "open"))).over(everything)
    out = level.withColumn("first", first).withColumn(
        "target", F.when(F.col("capped"), (F.lit(MOST) * F.col("source_size")).cast("double")).otherwise((F.col("w") * F.col("first.left")).cast("double") / F.col("first.open"))
    )
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        out.withColumn("copies", F.floor(f).cast("long"))
        .withColumn("p", f - F.floor(f))
        .withColumn("need", F.col("target") - (F.col("copies") * F.col("source_size")).cast("double"))
        .withColumn("ranges", F.ceil(F.sqrt(F.col("n"))))
        .select("none", "src", "n", "source_size", "target", "copies", "p", "need", "ranges")
    )


def mix(df: DataFrame, doc_id: str, text: str, source: str, *, seed: str = "mix") -> DataFrame:
    """Per row of `df`: doc_id, tie (the text's MD5 digest), source (as `src`, with `none` for null), size, source_size, target, copies, taken.

    size counts words; a null or empty text has 0 and takes nothing.  A null
    source is a source of its own, last in order.  Rows with equal ids are
    ordered by size and text; repeated rows are interchangeable.  taken is
    copies times size, of MOST copies at most.  No row: no row.
    """
    t = F.col(text)
    sized = checkpointed(
        df.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).isNull().alias("none"),
            F.coalesce(F.col(source).cast("string"), F.lit("")).alias("src"),
            F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.coalesce(t, F.lit(""))).alias("tie"),
        ).withColumn("u", draw("doc_id", seed))
    )
    sizes = checkpointed(sized.groupBy("none", "src").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size")))
    goals = targets(sizes)
    if sizes.count() <= BROADCAST_ROWS:
        goals = F.broadcast(goals)
    odds = F.col("u") / (F.lit(1.0) - F.col("u"))
    p = F.greatest(F.lit(1e-12), F.col("p"))
    share = (F.greatest(F.lit(1), F.col("size")) * F.col("n")).cast("double") / F.greatest(F.lit(1), F.col("source_size")).cast("double")
    ranked = sized.join(goals, ["none", "src"]).withColumn("rank", odds / (p / (F.lit(1.0) - p) * share))
    level = odds / share  # rises with the rank within a source
    ranged = ranked.withColumn("range", F.floor(level / (F.lit(1.0) + level) * F.col("ranges")))
    keys = ["none", "src", "range"]
    sums = ranged.groupBy(*keys).agg(F.sum("size").alias("sum"))
    before = sums.select(*keys, F.coalesce(F.sum("sum").over(Window.partitionBy("none", "src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy(*keys).orderBy("rank", "u", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(before, keys)
    more = ((2 * (F.col("before") + F.col("within")) + F.col("size")).cast("double") <= 2 * F.col("need")).cast("long")
    copies = F.when(F.col("size") > 0, F.col("copies") + more).otherwise(F.lit(0))
    return placed.withColumn("copies", copies.cast("long")).select("doc_id", "tie", "none", "src", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(df: DataFrame, doc_id: str, text: str, source: str, *, seed: str = "mix") -> DataFrame:
    """The rows of `df`, each as often as the mix takes it.  Documents without a word go, as no mix needs them."""
    return repeated(df, doc_id, text, mix(df, doc_id, text, source, seed=seed).select("doc_id", "tie", "copies"))


#: The same mix in another engine's SQL, ranking each source as a whole.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS tie,
         (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5e0) / 4503599627370496e0 AS u
  FROM documents),
s AS (SELECT source, count(*) AS n, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
rising AS (SELECT *, row_number() OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source NULLS LAST) AS rn FROM weighed),
filled AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
         CAST(sum(w) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open
  FROM rising),
marked AS (SELECT *, CAST(3 * source_size AS DOUBLE) / w <= CAST(rest AS DOUBLE) / open AS capped FROM filled),
level AS (SELECT min_by(rest, rn) AS rest, min_by(open, rn) AS open FROM marked WHERE NOT capped),
goals AS (
  SELECT m.source, m.n, m.source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(w * level.rest AS DOUBLE) / level.open END AS target
  FROM marked m LEFT JOIN level ON true),
split AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies,
         CASE WHEN source_size > 0 THEN target / source_size - floor(target / source_size) ELSE 0 END AS p
  FROM goals),
placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, CAST(g.copies AS BIGINT) AS copies, g.target - CAST(CAST(g.copies AS BIGINT) * g.source_size AS DOUBLE) AS need,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u / (1e0 - d.u) / (greatest(1e-12, g.p) / (1e0 - greatest(1e-12, g.p)) * (CAST(greatest(1, d.size) * g.n AS DOUBLE) / CAST(greatest(1, g.source_size) AS DOUBLE))), d.u, d.doc_id, d.size, d.tie
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN split g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size > 0 THEN (copies + CASE WHEN CAST(2 * before + size AS DOUBLE) <= 2 * need THEN 1 ELSE 0 END) * size ELSE 0 END AS BIGINT) AS taken
FROM placed
"""
