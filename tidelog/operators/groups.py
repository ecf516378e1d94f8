"""Consumer groups: rounds of joins, generations, the protocol all members share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def join_round(joins: DataFrame) -> DataFrame:
    """One round per group of join events (group_id, member, protocols, arrival): who leads and which protocol is taken.

    (group_id, leader, n_members, generation, protocol, status). A member that joins again replaces its protocols in place.
    The first joiner leads. The protocol is the first in the leader's order that all members have; without one the
    status is INCOMPATIBLE_PROTOCOL and the generation -1. A blank member id counts as a new member of its own.
    """
    named = joins.withColumn("member", F.when(F.trim(F.coalesce("member", F.lit(""))) == "", F.concat(F.lit("member-"), F.col("arrival"))).otherwise(F.col("member")))
    members = named.groupBy("group_id", "member").agg(F.min("arrival").alias("first"), F.max_by("protocols", "arrival").alias("protocols"))
    leaders = members.groupBy("group_id").agg(
        F.min_by("member", "first").alias("leader"), F.min_by("protocols", "first").alias("preferred"), F.count("*").alias("n_members")
    )
    shared = (
        members.select("group_id", "member", F.explode(F.array_distinct("protocols")).alias("protocol"))
        .groupBy("group_id", "protocol")
        .agg(F.count("*").alias("n"))
        .join(leaders, "group_id")
        .where(F.col("n") == F.col("n_members"))
        .groupBy("group_id")
        .agg(F.min(F.struct(F.array_position("preferred", F.col("protocol")).alias("at"), "protocol"))["protocol"].alias("protocol"))
    )
    return leaders.join(shared, "group_id", "left").select(
        "group_id",
        "leader",
        "n_members",
        F.when(F.col("protocol").isNotNull(), 1).otherwise(-1).alias("generation"),
        "protocol",
        F.when(F.col("protocol").isNotNull(), "SUCCESS").otherwise("INCOMPATIBLE_PROTOCOL").alias("status"),
    )


def join_rounds(joins: DataFrame, closes: DataFrame) -> DataFrame:
    """The same for successive rounds: (group_id, leader, n_members, generation, protocol, status), one row per round.

    ``closes`` (group_id, arrival) are the moments at which a group's round ends; the next join after one starts a new round with
    nobody in it. Joins without protocols are refused and start none. Generations count the rounds that were started, from 1;
    a round that ends without a shared protocol has generation -1, but counts.
    """
    valid = joins.where(F.size(F.coalesce("protocols", F.array().cast("array<string>"))) > 0)
    events = valid.select("group_id", "member", "protocols", "arrival", F.lit(0).alias("_close")).unionByName(
        closes.select("group_id", "arrival", F.lit(1).alias("_close")), allowMissingColumns=True
    )
    # A close counts for what comes after it.
    before = Window.partitionBy("group_id").orderBy("arrival", "_close").rowsBetween(Window.unboundedPreceding, 0)
    rounds = events.withColumn("_round", F.sum("_close").over(before)).where("_close = 0").drop("_close")
    each = join_round(rounds.withColumn("group_id", F.struct(F.col("group_id").alias("g"), F.col("_round").alias("r"))).drop("_round"))
    started = F.row_number().over(Window.partitionBy("group_id.g").orderBy("group_id.r"))
    numbered = each.withColumn("generation", F.when(F.col("status") == "SUCCESS", started).otherwise(-1))
    return numbered.select(F.col("group_id.g").alias("group_id"), "leader", "n_members", "generation", "protocol", "status", F.col("group_id.r").alias("round"))


def leave(members: DataFrame, leaving: DataFrame) -> DataFrame:
    """The members that stay; assignments are then made anew."""
    return members.join(leaving.select("member"), "member", "left_anti")
