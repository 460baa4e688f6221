"""Forum tables: visibility, search, threads, ownership, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.scratch import settled

PUBLIC_TYPES = (0, 2)
PRIVATE_TYPE = 1
RESEARCHER = "Researcher"


def visible(topics: DataFrame, researcher: bool, type_col: str = "type") -> DataFrame:
    """Everything for researchers, else topics of the public types."""
    return topics if researcher else topics.filter(F.col(type_col).isin(*PUBLIC_TYPES))


def mentions(column: Column, text: str) -> Column:
    return F.contains(F.lower(column), F.lit(text.lower()))


def search(topics: DataFrame, seen: DataFrame, text: str, title_col: str = "title", content_col: str = "content", keep: list[str] | None = None) -> DataFrame:
    """(title hits union content hits) intersect seen, as sets of the columns to keep.

    Both hits come from one table, so the union is a disjunction and needs no shuffle of
    its own; the intersection deals out only the columns that are kept.
    """
    keep = keep or topics.columns
    hits = topics.filter(mentions(F.col(title_col), text) | mentions(F.col(content_col), text))
    return hits.select(*keep).intersect(seen.select(*keep))


def permitted(type_col: Column, researcher: Column, name: Column) -> Column:
    """Private topics are for researchers; questions and answers only stand in discussions."""
    return ~((type_col == 1) & ~researcher) & ~((type_col != 2) & name.isin("Question", "Answer"))


def owned(rows: DataFrame, user_id: int, owner_col: str = "owner_id") -> DataFrame:
    return rows.filter(F.col(owner_col) == user_id)


def with_owner(rows: DataFrame, users: DataFrame, owner_col: str = "owner_id") -> DataFrame:
    """Adds owner: a struct of the user's columns, null where the owner is gone."""
    info = users.select(F.col("owner_id").alias("_owner"), F.struct(*users.columns).alias("owner"))
    return rows.join(info, rows[owner_col] == info["_owner"], "left").drop("_owner")


def replies_of(rows: DataFrame, topic_id: int, topic_col: str = "topic_id") -> DataFrame:
    return rows.filter(F.col(topic_col) == topic_id)


def threads(comments: DataFrame, id_col: str = "id", parent_col: str = "ansto_id") -> DataFrame:
    """Adds root and depth to each comment by pointer doubling: rounds grow with the logarithm of the depth.

    A comment whose parent is missing is a root. No depth exceeds the number of comments;
    those that still have further to go then are on a cycle, or hang on one, and have null
    for both.
    """
    nodes = comments.select(F.col(id_col).alias("node"), F.col(parent_col).alias("up"))
    ids = nodes.select(F.col("node").alias("known"))
    links = nodes.join(ids, F.col("up") == F.col("known"), "left").select("node", F.col("known").alias("up"))
    links = links.select("node", F.coalesce("up", "node").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    links = settled(links.withColumn("moved", F.col("depth") > 0))
    for _ in range(links.count().bit_length() + 1):
        if links.filter("moved").isEmpty():
            break
        above = links.select(F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        links = settled(
            links.join(above, F.col("up") == F.col("_node")).select(
                "node", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("_depth") > 0).alias("moved")
            )
        )
    done = ~F.col("moved") | (F.col("depth") == 0)
    links = links.withColumns({"up": F.when(done, F.col("up")), "depth": F.when(done, F.col("depth").cast("int"))})
    found = links.select(F.col("node").alias("_node"), F.col("up").alias("root"), "depth")
    return comments.join(found, comments[id_col] == found["_node"]).drop("_node")


def cascade(parents: DataFrame, children: DataFrame, parent_id: str, child_ref: str) -> DataFrame:
    """Children that are left when parents are the rows that stay; children without a parent stay."""
    kept = parents.select(F.col(parent_id).alias("_kept")).distinct()
    orphans = children.filter(F.col(child_ref).isNull())
    return children.join(kept, F.col(child_ref) == F.col("_kept"), "left_semi").unionByName(orphans)


def votes(rows: DataFrame, answer_col: str = "answer_id") -> DataFrame:
    """Votes counted, not incremented."""
    return rows.groupBy(answer_col).agg(F.count("*").alias("ansagree"))


def _acting(rows: DataFrame, users: DataFrame, user_col: str) -> DataFrame:
    """Adds whether the acting user, one of users (owner_id, job_title), is a researcher; null for unknown ones."""
    who = users.select(F.col("owner_id").alias("_user"), F.coalesce(F.col("job_title") == RESEARCHER, F.lit(False)).alias("_researcher"))
    return rows.join(who, rows[user_col] == who["_user"], "left").drop("_user")


def _parted(rows: DataFrame, allowed: Column, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows that are allowed and those refused; what can't be told is refused."""
    told = rows.withColumn("_allowed", F.coalesce(allowed, F.lit(False)))
    return told.filter("_allowed").select(columns), told.filter("not _allowed").select(columns)


def may_see(type_col: Column, researcher: Column) -> Column:
    """Topics with a type: private ones are for researchers."""
    return type_col.isNotNull() & ((type_col != PRIVATE_TYPE) | researcher)


def created_topics(topics: DataFrame, new: DataFrame, users: DataFrame, owner_col: str = "owner_id", type_col: str = "type") -> tuple[DataFrame, DataFrame]:
    """topics with the new ones, and the new ones refused: private ones of non-researchers, and those of unknown users or without a type."""
    known = F.col("_researcher").isNotNull()
    kept, refused = _parted(_acting(new, users, owner_col), known & may_see(F.col(type_col), F.col("_researcher")), new.columns)
    return topics.unionByName(kept), refused


def created_replies(
    replies: DataFrame, new: DataFrame, topics: DataFrame, users: DataFrame, topic_col: str = "topic_id", owner_col: str = "owner_id", id_col: str = "id", type_col: str = "type"
) -> tuple[DataFrame, DataFrame]:
    """Comments or attachments with the new ones, and the new ones refused: in topics that their user may not see, or that don't exist."""
    types = topics.select(F.col(id_col).alias("_topic"), F.col(type_col).alias("_type"))
    joined = _acting(new, users, owner_col)
    joined = joined.join(types, joined[topic_col] == types["_topic"], "left")
    kept, refused = _parted(joined, F.col("_researcher").isNotNull() & may_see(F.col("_type"), F.col("_researcher")), new.columns)
    return replies.unionByName(kept), refused


def updated_topics(topics: DataFrame, changes: DataFrame, users: DataFrame, id_col: str = "id", by: str = "user_id", type_col: str = "type") -> tuple[DataFrame, DataFrame]:
    """topics with changes (id, user_id, columns to set), one a topic, and the changes refused: of topics that their user may not see, or that don't exist.

    Null columns leave the topic's value.
    """
    types = topics.select(F.col(id_col).alias("_topic"), F.col(type_col).alias("_type"))
    joined = _acting(changes, users, by)
    joined = joined.join(types, joined[id_col] == types["_topic"], "left")
    kept, refused = _parted(joined, F.col("_researcher").isNotNull() & may_see(F.col("_type"), F.col("_researcher")), changes.columns)
    names = [c for c in changes.columns if c not in (id_col, by)]
    sets = kept.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_new_{c}") for c in names])
    out = topics.join(sets, topics[id_col] == sets["_id"], "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in names})
    return out.select(topics.columns), refused


def destroyed(rows: DataFrame, requests: DataFrame, id_col: str = "id", owner_col: str = "owner_id", by: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """rows without those that requests (id, user_id) of their own owner name, and the requests refused: of others, or for rows that don't exist."""
    asked = requests.select(F.col(id_col).alias("_id"), F.col(by).alias("_by"))
    owners = rows.select(F.col(id_col).alias("_id"), F.col(owner_col).alias("_by"))
    left = rows.join(asked, (rows[id_col] == asked["_id"]) & (rows[owner_col] == asked["_by"]), "left_anti")
    return left, requests.join(owners, (requests[id_col] == owners["_id"]) & (requests[by] == owners["_by"]), "left_anti")
