"""Entity resolution: records with external identifiers become catalog works.

A record joins the work of its first known identifier, in its own order; unseen
identifiers are registered with it, known ones never move. The outcome depends
on arrival and is not transitive, so it is an ordered fold. Components of the
(identifier, record) graph bound what a fold must see together: they are found
by alternating hooking and pointer jumping over *distinct* identifier
neighbourhoods, in rounds that are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.folding import fold_groups
from tidemark.session import stage_table


def components(groups: DataFrame) -> DataFrame:
    """(node, component) for ``groups`` (nodes array): nodes of one array belong together.

    Edges lead from each node to the least node of its array. Each round every
    node takes the least label among its neighbours and then its label's label.
    Partial minima are taken before each shuffle, so hubs do no harm.
    """
    edges = groups.select(F.array_min("nodes").alias("a"), F.explode("nodes").alias("b")).where("a <> b").distinct()
    edges = stage_table(edges, "edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nodes = groups.select(F.explode("nodes").alias("node")).distinct()
    labels = stage_table(nodes.withColumn("label", F.col("node")), "labels")
    while True:  # labels only ever become smaller, and pointer jumping halves the way to the least one
        near = both.join(labels, both["b"] == labels["node"]).groupBy(both["a"].alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node", "left").select("node", "label", F.least("label", "near").alias("new"))
        jump = hooked.select(F.col("node").alias("new"), F.col("new").alias("far"))
        after = hooked.join(jump, "new", "left").select("node", "label", F.least("new", "far").alias("next"))
        after = stage_table(after, "labels")
        labels = after.select("node", F.col("next").alias("label"))
        if after.where("label <> next").limit(1).count() == 0:
            return labels.select("node", F.col("label").alias("component"))


MINTED = "seq bigint, minted_key string"


def joining():
    """The fold of one component: (seq, own key, alias names in the record's order) to (seq, key of the work it joins)."""
    owner: dict[str, str] = {}

    def step(seq: int, own: str, aliases: list[str]) -> list[tuple[int, str]]:
        key = next((owner[a] for a in aliases if a in owner), own)
        for a in aliases:
            owner.setdefault(a, key)
        return [(seq, key)]

    return step


def mint(rows: DataFrame) -> DataFrame:
    """(seq, minted_key) of each row (seq, work_type, work_key, aliases) that names a work.

    Repeats are folded away first: of rows with the same key and identifiers in
    the same order only the first arrival can change anything, so the fold gets
    those, and later ones take the result by a join. A work that a third of all
    records are about is therefore as small as its identifiers are few.
    """
    names = F.transform("aliases", lambda a: F.to_json(F.array(F.col("work_type"), a["key"], a["id"])))
    # filtered only once written: a filter above would be pushed down with the whole derivation of the key inside
    named = stage_table(rows.select("seq", "work_key", names.alias("aliases")), "named").where(F.col("work_key").isNotNull())
    distinct = stage_table(named.groupBy("work_key", "aliases").agg(F.min("seq").alias("seq")), "mint")
    parts = components(distinct.where("size(aliases) > 0").select(F.col("aliases").alias("nodes")).distinct())
    keyed = distinct.withColumn("node", F.coalesce(F.get("aliases", F.lit(0)), F.concat(F.lit("!"), "work_key")))
    placed = keyed.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    minted = fold_groups(placed, "component", ["seq"], ["seq", "work_key", "aliases"], joining, MINTED)
    result = distinct.join(minted, "seq").select("work_key", "aliases", "minted_key")
    return named.join(result, ["work_key", "aliases"]).select("seq", "minted_key")


def catalog(rows: DataFrame, minted: DataFrame) -> DataFrame:
    """(work_key, title, poster, records, first_seq) of each work: first title and poster that are not empty."""
    joined = rows.join(minted, "seq")
    filled = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("seq")))
    return joined.groupBy(F.col("minted_key").alias("work_key")).agg(
        filled("work_title").alias("title"), filled("poster").alias("poster"), F.count(F.lit(1)).alias("records"), F.min("seq").alias("first_seq")
    )
