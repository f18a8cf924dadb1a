"""The supplied tables as the canonical activity model: repositories, people, changes, reviews."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import table

#: What makes two versions of a commit comparable: the latest by these wins. Later columns can't change what is read of it.
VERSION = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
#: Agents that sign commits; a commit's are a set of bits.
AGENTS = tuple(f"agent_{i}" for i in range(5))


def agents_in(bits: Column) -> Column:
    """Keys of the agents in a set of bits, in order."""
    return F.filter(F.array(*[F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, F.lit(name)) for i, name in enumerate(AGENTS)]), lambda x: x.isNotNull())


def first_agent(bits: Column) -> Column:
    """The smallest key in a set of bits, else NULL."""
    return F.coalesce(*[F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, F.lit(name)) for i, name in enumerate(AGENTS)])


@dataclass(frozen=True)
class Activity:
    """Lazy DataFrames of the canonical entities over one data directory."""

    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def repos(self) -> DataFrame:
        """repo_id, owner, name, full_name, is_shallow."""
        joined = self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return joined.select(
            F.col("n_nationkey").cast("long").alias("repo_id"),
            F.col("r_name").alias("owner"),
            F.col("n_name").alias("name"),
            F.concat_ws("/", "r_name", "n_name").alias("full_name"),
            (F.col("n_nationkey") % 12 == 11).cast("int").alias("is_shallow"),
        )

    @cached_property
    def owned(self) -> DataFrame:
        """Orders with repository and author, joined with people once; every tenth order has no known author."""
        people = self.raw("customer").select("c_custkey", "c_nationkey", "c_name", (F.col("c_mktsegment") == "MACHINERY").cast("int").alias("bot"), (F.col("c_acctbal") < -700).cast("int").alias("shut"))
        joined = self.raw("orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
        known = F.col("o_orderkey") % 10 != 0
        kind = F.create_map(*map(F.lit, ("1-URGENT", "bugfix", "2-HIGH", "feature", "3-MEDIUM", "chore", "5-LOW", "revert")))
        return joined.select(
            F.col("o_orderkey").alias("pr_id"),
            F.col("c_nationkey").cast("long").alias("repo_id"),
            F.when(known, F.col("o_custkey")).alias("identity_id"),
            F.when(known, F.col("c_name")).alias("login"),
            F.when(known, F.col("bot")).alias("is_bot"),
            F.when(known, F.col("shut")).alias("is_excluded"),
            "o_orderstatus",
            F.col("o_orderdate").alias("created_at"),
            kind[F.col("o_orderpriority")].alias("class"),
        )

    @property
    def signed(self) -> Column:
        """The bit of the agent whose trailer a line is, else NULL."""
        return F.when(F.col("l_returnflag") == "R", F.expr("shiftleft(1, cast(l_suppkey % 5 as int))"))

    @cached_property
    def pull_requests(self) -> DataFrame:
        """Reviews with class (NULL if unspecified), first change, agents and, if merged, the time of merging; changes are read once."""
        spans = self.raw("lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_commit_at"), F.max("l_shipdate").alias("last_at"), F.bit_or(self.signed).alias("agents"))
        state = F.when(F.col("o_orderstatus") == "F", "MERGED").when(F.col("o_orderstatus") == "O", "OPEN").otherwise("CLOSED")
        joined = self.owned.join(spans, F.col("pr_id") == F.col("l_orderkey"), "left")
        person = ("identity_id", "login", "is_bot", "is_excluded")
        return joined.select("pr_id", "repo_id", *person, state.alias("state"), "created_at", "first_commit_at", F.when(F.col("o_orderstatus") == "F", F.col("last_at")).alias("merged_at"), "class", (F.col("class") == "revert").cast("int").alias("is_revert"), "agents")

    @cached_property
    def commits(self) -> DataFrame:
        """Latest version of each (order, line) and the agents of all its versions, from one aggregate combined map-side.

        The time is a measure of its own, so that queries that read nothing else of the version aggregate by hash.
        """
        latest = self.raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_shipdate").alias("authored_at"), F.max(F.struct(*VERSION))["l_quantity"].alias("quantity"), F.bit_or(self.signed).alias("agents"))
        owner = self.owned.select("pr_id", "repo_id", "identity_id", "login", "is_bot", "is_excluded")
        joined = latest.join(owner, F.col("l_orderkey") == F.col("pr_id"))
        return joined.select(
            "repo_id",
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sha"),
            "pr_id",
            "identity_id",
            "login",
            "is_bot",
            "is_excluded",
            "authored_at",
            (F.col("l_linenumber") == 7).cast("int").alias("is_merge"),
            F.col("quantity").cast("double").alias("insertions"),
            "agents",
        )
