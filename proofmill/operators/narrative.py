"""What can be told of a decision from its evidence: five slots, each with what it cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = ("role", "inputs", "options", "chosen", "human")


def chain_index(ev: DataFrame) -> DataFrame:
    """(subject, agent, position, principal): who an agent acted for, by place in the chain, each once."""
    return ev.where("agent is not null").select("subject", "agent", F.posexplode("acted_for").alias("position", "principal")).distinct()


def sampled(decisions: DataFrame, k: int) -> DataFrame:
    """The k decisions with the least (sha256 of their id, id): a top-k report, the same on every run."""
    return decisions.orderBy(F.sha2("id", 256), "id").limit(k)


def slots(decisions: DataFrame, reviews: DataFrame, humans: DataFrame) -> DataFrame:
    """One row per decision and slot: (subject, id, slot, told, cites).

    ``decisions(subject, id, agent, ai_role, used, options, chosen)``, ``reviews(subject, id, review)``,
    ``humans(subject, id, principal)``: human principals at the end of the decision's chain.  What the
    evidence does not tell cites the decision itself.
    """
    keys = ["subject", "id"]
    seen = reviews.groupBy(*keys).agg(F.array_sort(F.collect_set("review")).alias("seen"))
    ends = humans.groupBy(*keys).agg(F.min("principal").alias("ends"))
    rows = decisions.join(seen, keys, "left").join(ends, keys, "left")
    option = lambda o: F.concat_ws("/", F.col("id"), F.lit("option"), o)
    own = F.array(F.col("id"))

    def slot(name: str, ok: Column, cites: Column) -> Column:
        told = F.coalesce(ok, F.lit(False))
        return F.struct(F.lit(name).alias("slot"), told.alias("told"), F.when(told, cites).otherwise(own).alias("cites"))

    human = F.when(F.col("ends").isNotNull(), F.array("ends")).otherwise(F.col("seen"))
    every = F.array(
        slot("role", F.nullif("ai_role", F.lit("")).isNotNull(), F.array(F.coalesce("agent", "id"))),
        slot("inputs", F.size("used") > 0, F.array_sort("used")),
        slot("options", F.size("options") > 0, F.transform("options", option)),
        slot("chosen", F.array_contains("options", F.col("chosen")), F.array(option(F.col("chosen")))),
        slot("human", human.isNotNull(), human),
    )
    return rows.select("subject", "id", F.explode(every).alias("s")).select("subject", "id", "s.*")


def content_reference(content: Column) -> Column:
    """How content is named without being kept: its digest."""
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))
