"""Codebooks and subtopics: ordered, deduplicated vocabularies with definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkmill.functions.text import is_blank, slug, strip
from talkmill.session import cut

# The label of what fits no other, and labels that stand for it already.
OTHER = "Other / Not Listed"
OTHER_NAMES = ("other / not listed", "other", "not listed", "none", "n/a")

# The topic and the subtopics that hold where none are given; the slugs are a contract with the files, the
# definitions say in a few words what each of these subjects is.
DEFAULT_TOPIC = "Donald Trump"
DEFAULT_SUBTOPICS = {
    "mental_health": "Mental fitness: memory, decline, state of mind.",
    "physical_health": "Bodily health: illness, injury, fitness, stamina.",
    "christianity": "Christian belief, believers and communities, and appeals to them.",
    "corruption": "Abuse of office for gain: bribes, favours, conflicts of interest.",
    "iran_war": "Armed conflict that involves Iran.",
    "epstein": "Jeffrey Epstein, his deeds, victims and circle; a first name alone isn't enough.",
    "debt": "The national debt, deficits, borrowing and the debt ceiling.",
    "vaccines": "Vaccines, vaccination and rules about them.",
    "affordability": "What everyday life costs: prices, wages, housing.",
    "transgender": "Transgender people, their rights and their care.",
    "immigration_violence": "Violence by immigrants or in the enforcement of immigration law.",
    "border_chaos": "Disorder and crowding at the border.",
}


def default_subtopics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, s, d) for i, (s, d) in enumerate(DEFAULT_SUBTOPICS.items())], "pos long, slug string, definition string")


def with_position(df: DataFrame, name: str = "pos") -> DataFrame:
    """``df`` with the 0-based position of each row in the input, without bringing the rows together.

    The rows are written to the shared folder once, so that their places within partitions stay as they are. What to
    add to them is a row a partition, which is summed up by one task and sent to all.
    """
    numbered = cut(df).withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", 33).cast("int")
    sizes = numbered.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_start"))
    placed = numbered.withColumn("_p", part).join(F.broadcast(starts), "_p")
    return placed.select(*df.columns, (F.col("_start") + F.col("_m").bitwiseAND((1 << 33) - 1)).cast("long").alias(name))


def label_key(c: Column) -> Column:
    return F.lower(strip(c))


def first_spellings(labels: DataFrame) -> DataFrame:
    """(pos, label, key, definition): labels that differ in case only are one, with the first spelling and position and the first definition that isn't blank."""
    df = labels.filter(~is_blank(F.col("label"))).withColumn("key", label_key(F.col("label")))
    return df.groupBy("key").agg(
        F.min("pos").alias("pos"), F.min_by(strip(F.col("label")), "pos").alias("label"), F.min_by(F.when(~is_blank(F.col("definition")), strip(F.col("definition"))), F.when(~is_blank(F.col("definition")), F.col("pos"))).alias("definition")
    )


def with_other(labels: DataFrame) -> DataFrame:
    """``labels`` (pos, label, key, definition) with OTHER added last unless a label stands for it already."""
    known = labels.agg(F.coalesce(F.bool_or(F.col("key").isin(*OTHER_NAMES)), F.lit(False)).alias("known"), (F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias("pos"))
    added = known.filter("not known").select("pos", F.lit(OTHER).alias("label"), F.lower(F.lit(OTHER)).alias("key"), F.lit(None).cast("string").alias("definition"))
    return labels.select("pos", "label", "key", "definition").unionByName(added)


def override(labels: DataFrame, definitions: DataFrame) -> DataFrame:
    """``labels`` with the definitions of another table (key, definition) where it has the key, even blank ones."""
    other = definitions.select("key", F.col("definition").alias("_d"), F.lit(True).alias("_has"))
    return labels.join(other, "key", "left").withColumn("definition", F.when(F.col("_has"), F.col("_d")).otherwise(F.col("definition"))).drop("_d", "_has")


def fallback_label(labels: list[str]) -> str:
    """The label that stands for none of the others."""
    keys = {x.strip().lower(): x for x in labels}
    return next((keys[k] for k in OTHER_NAMES if k in keys), OTHER)


def slugged(subtopics: DataFrame) -> DataFrame:
    """(pos, slug, definition): subtopics whose slugs are alike are one, with the first position and the last definition; empty slugs are dropped."""
    return subtopics.withColumn("slug", slug(F.col("label"))).filter("slug <> ''").groupBy("slug").agg(F.min("pos").alias("pos"), F.max_by(F.coalesce(F.col("definition"), F.lit("")), "pos").alias("definition"))


def check_slugs(slugs: list[str], taken: list[str]) -> None:
    bad = [s for s in slugs if s in taken or s in ("index", "")]
    if bad:
        raise ValueError(f"subtopics that clash with other columns: {', '.join(bad)}")
