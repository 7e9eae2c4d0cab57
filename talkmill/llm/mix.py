"""Mixing sources to target weights by proportionate-fair scheduling.

Each source gets a quota of tokens: its target share of the whole, or what it has times its cap on repeats if
that is less. Its documents, in a fixed pseudo-random order and copy after copy, are laid out on a token line that is cut into
blocks. Block k of a source of weight w is released at slot floor(k/w) and due by slot ceil((k+1)/w); earliest
deadline first among the released blocks gives every prefix of the mix the target shares to less than one block.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkmill.llm.tokenize import count_tokens
from talkmill.session import cut, spread, table

#: Blocks a whole mix is scheduled in; the schedule has this many rows and one more a source, whatever the data.
BLOCKS = 4096
#: Sources that targets may be given for.
MOST_SOURCES = 100_000
#: Rows of one source that are put in order by one task.
ORDER_ROWS = 50_000


def source_key(c: Column) -> Column:
    """The source meant by a spelling: case, padding and hyphens or spaces for underscores don't count. Null stays null."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"[-\s]+", "_")


def sized(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, source, n_tokens) with the source as meant."""
    return count_tokens(documents, ["doc_id", "source"], text_col).withColumn("source", source_key(F.col("source")))


def plan(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each source of ``targets``: what it has, what it may give and whether it can reach its target.

    ``docs`` has source and n_tokens; every row counts in the whole, also those without a source or with one that
    isn't wanted. Null shares count as 0 and null caps as 1; of a source named twice the larger share and cap hold.
    No documents: all quotas are 0 and no source falls short.
    """
    # Partial sums by task, then a row a spelling, then a row a target and one for all the rest.
    want = targets.filter(F.col("source").isNotNull()).groupBy(source_key(F.col("source")).alias("source")).agg(
        F.max("source").alias("spelled"), F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")
    )
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    t = have.join(want, "source", "full").groupBy(F.when(F.col("spelled").isNotNull(), F.col("source")).alias("source")).agg(
        F.max("spelled").alias("spelled"), F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs")
    )
    t = t.withColumn("whole", F.sum("tokens").over(Window.partitionBy(F.lit(0)))).filter("source is not null")
    most = F.col("tokens") * F.col("max_repeats")
    wish = F.col("target_share") * F.col("whole")
    return t.select("spelled", "source", "target_share", "max_repeats", "n_docs", "tokens", "whole", F.least(most, F.floor(wish)).alias("quota"), (most < wish).alias("short"))


def planned(docs: DataFrame, targets: DataFrame) -> list:
    """The rows of :func:`plan`, which are scheduled in one place; more than MOST_SOURCES are an error."""
    rows = plan(docs, targets).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"there are targets for more than {MOST_SOURCES} sources")
    return rows


def pfair(quotas: dict[str, int], blocks: int = BLOCKS, supply: dict[str, int] | None = None) -> tuple[int, list[tuple[str, int, int]], list[str]]:
    """(tokens a block, rows (source, k, slot), sources that miss a deadline) of the earliest-deadline-first schedule.

    Ties go by source name. ``supply`` has the tokens that each source can give, its quota if it isn't named: a
    source without the tokens of its block, of which the last may be a part, misses the deadline of it and of all after
    it, and its slots go to the others.
    """
    supply = supply or {}
    missed = sorted(s for s, q in quotas.items() if q > 0 and supply.get(s, q) <= 0)
    quotas = {s: q for s, q in quotas.items() if q > 0 and s not in missed}
    whole = sum(quotas.values())
    if not whole:
        return 1, [], missed
    size = max(1, math.ceil(whole / blocks))
    total = {s: math.ceil(q / size) for s, q in quotas.items()}
    weight = {s: Fraction(n, sum(total.values())) for s, n in total.items()}
    due = lambda s, k: math.ceil((k + 1) / weight[s])
    release = lambda s, k: math.floor(k / weight[s])
    waiting = [(0, s, 0) for s in sorted(total)]
    ready: list[tuple[int, str, int]] = []
    rows: list[tuple[str, int, int]] = []
    slot = 0
    while waiting or ready:
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            if min((k + 1) * size, quotas[s]) > supply.get(s, quotas[s]):
                missed.append(s)
                continue
            heapq.heappush(ready, (due(s, k), s, k))
        if ready:
            _, s, k = heapq.heappop(ready)
            rows.append((s, k, slot))
            if k + 1 < total[s]:
                heapq.heappush(waiting, (max(release(s, k + 1), slot + 1), s, k + 1))
        slot += 1
    return size, rows, sorted(missed)


def unreachable(planned: list, blocks: int = BLOCKS) -> list[str]:
    """The sources of a plan, as spelled there, that the schedule by target weights finds short of tokens for one of their blocks.

    Counted in parts of a token, as a target needn't be a whole number of them.
    """
    parts = {r["source"]: Fraction(str(r["target_share"])) * r["whole"] for r in planned}
    unit = math.lcm(1, *(f.denominator for f in parts.values()))
    _, _, missed = pfair({s: int(f * unit) for s, f in parts.items()}, blocks, {r["source"]: r["tokens"] * r["max_repeats"] * unit for r in planned})
    return [r["spelled"] for r in planned if r["source"] in missed]


def _laid_out(docs: DataFrame, n_docs: int) -> DataFrame:
    """``docs`` with ``start``, the tokens before each document within its source.

    The order is by hash bucket, then doc_id; buckets hold about ORDER_ROWS rows, so a source with a third of all
    rows is put in order by many tasks.
    """
    buckets = max(1, math.ceil(n_docs / ORDER_ROWS)) * 4
    d = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    sums = d.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    before = sums.select("source", "bucket", (F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket")) - F.col("in_bucket")).alias("before"))
    own = Window.partitionBy("source", "bucket").orderBy("doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    return d.join(before, ["source", "bucket"]).withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).drop("before", "bucket")


def mix(documents: DataFrame, targets: DataFrame, blocks: int = BLOCKS, text_col: str = "text") -> DataFrame:
    """The mixed corpus: one row for each use of a document, (doc_id, source, copy_no, slot, at, n_tokens).

    Reading by (slot, at) gives the interleaved order. A use is taken if it ends within the source's quota, so a
    source stays below its quota by less than one document. Null, empty texts have no tokens and are left out, as
    are sources without a target. Repeated rows are documents of their own. Empty tables give an empty mix.
    """
    spark = documents.sparkSession
    docs = cut(sized(documents, text_col))
    p = planned(docs, targets)
    size, schedule, _ = pfair({r["source"]: r["quota"] for r in p}, blocks)
    quotas = spark.createDataFrame([(r["source"], r["quota"], r["tokens"]) for r in p], "source string, quota long, tokens long")
    slots = spark.createDataFrame(schedule, "source string, block long, slot long")
    d = _laid_out(docs.join(F.broadcast(quotas.filter("quota > 0").select("source")), "source", "left_semi").filter("n_tokens > 0"), max([0, *(r["n_docs"] for r in p)]))
    uses = (
        d.join(F.broadcast(quotas), "source")
        .withColumn("last", F.expr("quota - start - n_tokens"))
        .filter("last >= 0")
        .withColumn("copy_no", F.explode(F.expr("sequence(0L, last div tokens)")))
        .withColumn("at", F.expr("copy_no * tokens + start"))
    )
    return uses.withColumn("block", F.expr(f"at div {size}")).join(F.broadcast(slots), ["source", "block"]).select("doc_id", "source", "copy_no", "slot", "at", "n_tokens")


def shares(documents: DataFrame, targets: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """What :func:`mix` reaches: (source, target_share, mixed_tokens, actual_share, most_uses, short), a row a target."""
    used = mix(documents, targets, blocks).groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), (F.max("copy_no") + 1).alias("most_uses"))
    t = targets.filter(F.col("source").isNotNull()).groupBy(source_key(F.col("source")).alias("source")).agg(F.max("source").alias("spelled"), F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"))
    t = t.join(used, "source", "left").fillna(0, ["mixed_tokens", "most_uses"])
    t = t.withColumn("whole", F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0))))  # a row a target
    return t.select(F.col("spelled").alias("source"), "target_share", "mixed_tokens", F.when(F.col("whole") > 0, F.col("mixed_tokens") / F.col("whole")).otherwise(0.0).alias("actual_share"), "most_uses")


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")), table(spark, sf_dir, "mix_targets")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources whose blocks run out when all are scheduled by their target weights over the tokens of all documents."""
    documents, targets = _tables(spark, sf_dir)
    return spark.createDataFrame([(s,) for s in unreachable(planned(sized(documents), targets))], "source string")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(*_tables(spark, sf_dir))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(*_tables(spark, sf_dir))
