"""Assignment of topic partitions to the members of a consumer group: range, round-robin, sticky.

Inputs are members (member) and topics (topic, num_partitions); the result is long: (member, topic, partition). Members
with nothing have no rows; empty inputs give none. Ranks over all partitions are put together from ranks within a topic
and the topics' sizes, so no task sorts all partitions.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.order import ranked
from tidelog.runtime import cut, small


def universe(topics: DataFrame) -> DataFrame:
    """(topic, partition): every partition id from 0 of every topic that has any."""
    some = topics.where(F.col("num_partitions") > 0)
    return some.select("topic", F.explode(F.sequence(F.lit(0), F.col("num_partitions") - 1)).alias("partition"))


def _ranked_members(members: DataFrame) -> DataFrame:
    """(member, i, m): place among the sorted members and their number. A group's members are few."""
    once = members.where(F.col("member").isNotNull()).distinct()
    return once.withColumn("i", F.row_number().over(Window.orderBy("member")) - 1).crossJoin(F.broadcast(once.agg(F.count("*").alias("m"))))


def assign_range(members: DataFrame, topics: DataFrame) -> DataFrame:
    """Each topic is cut into one run per sorted member; the first ones get one more where it doesn't divide evenly."""
    ranks = _ranked_members(members)
    m = ranks.agg(F.max("m").alias("m"))  # one row
    served = topics.where(F.col("num_partitions") > 0).crossJoin(F.broadcast(m)).where("m > 0")
    pairs = served.select("topic", "num_partitions", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("m"), F.col("num_partitions").cast("long")) - 1)).alias("i"))
    pairs = pairs.join(ranks.select("member", F.col("i").cast("long").alias("i")), "i")
    base, extra = F.floor(F.col("num_partitions") / F.col("m")), F.col("num_partitions") % F.col("m")
    start = F.col("i") * base + F.least("i", extra)
    length = base + F.when(F.col("i") < extra, 1).otherwise(0)
    runs = pairs.select("member", "topic", start.alias("start"), length.alias("length")).where("length > 0")
    ids = F.sequence(F.col("start").cast("int"), (F.col("start") + F.col("length") - 1).cast("int"))
    return runs.select("member", "topic", F.explode(ids).alias("partition"))


def assign_round_robin(members: DataFrame, topics: DataFrame) -> DataFrame:
    """All partitions by topic and id are dealt to the sorted members in turn."""
    dealt = ranked(universe(topics), "topic", ["partition"], "at")
    turns = small(cut(_ranked_members(members)))
    return dealt.join(turns, F.pmod(F.col("at"), F.col("m")) == F.col("i")).select("member", "topic", "partition")


def _take_turns(claims: pd.DataFrame) -> pd.DataFrame:
    """What members keep of contested partitions: one after the other takes what is left, up to its share."""
    claims = claims.sort_values(["member", "topic_pos", "topic", "partition"])
    taken: set = set()
    load: dict = {}
    kept = []
    for m, t, p, share in zip(claims["member"], claims["topic"], claims["partition"], claims["share"], strict=True):
        keep = (t, p) not in taken and load.get(m, 0) < share
        if keep:
            taken.add((t, p))
            load[m] = load.get(m, 0) + 1
        kept.append(keep)
    return claims.loc[kept, ["member", "topic", "partition"]]


def assign_sticky(members: DataFrame, topics: DataFrame, previous: DataFrame) -> DataFrame:
    """Members keep what they had, up to an even share; the rest goes to whoever has least.

    ``previous`` is (member, topic, partition, topic_pos), topic_pos giving the order of a member's topics. First each
    member, in order of name, keeps its previous partitions that still exist and no member before it has taken, in that
    order, up to the total divided by the members, rounded up. Members that claim something nobody else does depend on no
    other and are cut off by rank; the others, by nature few, take their turns in one task. Then the remaining partitions by topic and id go to the
    member with the fewest, of equal ones the first in name: the n-th of them takes the n-th slot by (level, member).
    """
    ranks = _ranked_members(members)
    whole = universe(topics)
    shares = F.broadcast(whole.agg(F.count("*").alias("p")).crossJoin(ranks.agg(F.count("*").alias("m"))).select(F.ceil(F.col("p") / F.greatest("m", F.lit(1))).alias("share")))
    valid = previous.join(ranks.select("member"), "member").join(whole, ["topic", "partition"])
    claims = valid.groupBy("member", "topic", "partition").agg(F.min("topic_pos").alias("topic_pos"))
    claims = claims.withColumn("_rivals", F.count("*").over(Window.partitionBy("topic", "partition")) - 1)
    claims = claims.withColumn("_rivals", F.max("_rivals").over(Window.partitionBy("member"))).crossJoin(shares)
    place = Window.partitionBy("member").orderBy("topic_pos", "topic", "partition")
    alone = claims.where("_rivals = 0").withColumn("_k", F.row_number().over(place)).where(F.col("_k") <= F.col("share")).select("member", "topic", "partition")
    kinds = ", ".join(f"{c} {claims.schema[c].dataType.simpleString()}" for c in ("member", "topic", "partition"))
    contested = claims.where("_rivals > 0").select("member", "topic", "partition", "topic_pos", "share", F.lit(0).alias("_all"))
    kept = cut(alone.unionByName(contested.groupBy("_all").applyInPandas(_take_turns, kinds)))

    loads = ranks.join(kept.groupBy("member").agg(F.count("*").alias("load")), "member", "left").select("member", F.coalesce("load", F.lit(0)).alias("load"))
    # No partition ever goes to a member that has an even share already, so slots end there.
    slots = loads.crossJoin(shares).where(F.col("load") < F.col("share")).select("member", F.explode(F.sequence("load", F.col("share") - 1)).alias("level"))
    slots = ranked(slots, "level", ["member"], "slot")
    rest = ranked(whole.join(kept, ["topic", "partition"], "left_anti"), "topic", ["partition"], "at")
    return kept.unionByName(rest.join(slots, F.col("at") == F.col("slot")).select("member", "topic", "partition"))


Assignor = Callable[..., DataFrame]


def assignor(name: str | None) -> Assignor:
    """The strategy of a name in any case; range if it is none of them."""
    return {"roundrobin": assign_round_robin, "sticky": assign_sticky}.get((name or "").lower(), assign_range)


def encoded(assignment: DataFrame) -> DataFrame:
    """(text): the whole assignment as ``m:t=0,1;t2=3`` with members set apart by two bars. One row, for the wire."""
    listed = assignment.groupBy("member", "topic").agg(F.sort_array(F.collect_list("partition")).alias("ps"))
    per_topic = listed.select("member", F.struct("topic", F.concat_ws(",", F.transform("ps", lambda p: p.cast("string"))).alias("ids")).alias("t"))
    per_member = per_topic.groupBy("member").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    joined = per_member.select(F.struct("member", F.array_join(F.transform("ts", lambda t: F.concat(t["topic"], F.lit("="), t["ids"])), ";").alias("x")).alias("s"))
    return joined.agg(F.sort_array(F.collect_list("s")).alias("all")).select(
        F.array_join(F.transform("all", lambda s: F.concat(s["member"], F.lit(":"), s["x"])), "||").alias("text")
    )


def per_member(members: DataFrame, assignment: DataFrame) -> DataFrame:
    """(member, text): what each member is told of an assignment, ``t=0,1;t2=3``; an empty text if it has nothing."""
    listed = assignment.groupBy("member", "topic").agg(F.sort_array(F.collect_list("partition")).alias("ps"))
    own = listed.select("member", F.struct("topic", F.concat_ws(",", F.transform("ps", lambda p: p.cast("string"))).alias("ids")).alias("t"))
    own = own.groupBy("member").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.concat(t["topic"], F.lit("="), t["ids"])), ";").alias("text"))
    return members.select("member").distinct().join(own, "member", "left").select("member", F.coalesce("text", F.lit("")).alias("text"))


def decoded(text: Column) -> Column:
    """Array of (member, topic, partition) of such a text."""
    member = lambda m: F.split(m, ":", 2)

    def topics_of(m: Column) -> Column:
        return F.flatten(
            F.transform(
                F.split(member(m)[1], ";"),
                lambda t: F.transform(
                    F.split(F.split(t, "=")[1], ","),
                    lambda p: F.struct(member(m)[0].alias("member"), F.split(t, "=")[0].alias("topic"), p.cast("int").alias("partition")),
                ),
            )
        )

    return F.flatten(F.transform(F.filter(F.split(text, r"\|\|"), lambda m: m != ""), topics_of))
