"""Domain tables of the temporal knowledge graph as views of the star schema.

Every property is lazy; Spark prunes columns and pushes filters into the scans.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The date that "today" stands for; every as-of plan takes it as an argument.
AS_OF = "1998-06-01"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str, as_of: str = AS_OF):
        self.spark, self.dir, self.as_of = spark, sf_dir, as_of

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def day(self):
        return F.lit(self.as_of).cast("date")

    @cached_property
    def people(self) -> DataFrame:
        """id, firstname, lastname, size"""
        words = F.split("p_name", " ")
        return self.raw("part").select(F.col("p_partkey").alias("id"), words[0].alias("firstname"), F.get(words, F.lit(1)).alias("lastname"), F.col("p_size").cast("long").alias("size"))

    @cached_property
    def publications(self) -> DataFrame:
        """id, title, year, date, cited_by, venue"""
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"), F.concat_ws(" ", F.lit("Order"), F.col("o_orderpriority"), F.col("o_orderkey").cast("string")).alias("title"),
            F.year("o_orderdate").cast("long").alias("year"), F.to_date("o_orderdate").alias("date"),
            F.floor(F.col("o_totalprice") / 1000).alias("cited_by"), F.col("o_custkey").alias("venue"))

    @cached_property
    def authors(self) -> DataFrame:
        """publication_id, person_id, position, is_corresponding"""
        own = self.raw("lineitem").groupBy(F.col("l_orderkey").alias("publication_id"), F.col("l_partkey").alias("person_id")).agg(F.min("l_linenumber").alias("line"))
        at = F.row_number().over(W.partitionBy("publication_id").orderBy("line", "person_id")).cast("long")
        return own.select("publication_id", "person_id", at.alias("position")).withColumn("is_corresponding", F.col("position") == 1)

    @cached_property
    def organizations(self) -> DataFrame:
        """id, name, short_name, kind, is_context_only"""
        none = F.lit(None).cast("string")
        regions = self.raw("region").select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.col("r_name").alias("name"), none.alias("short_name"), F.lit("university").alias("kind"), F.lit(False).alias("is_context_only"))
        nations = self.raw("nation").select((F.col("n_nationkey") + 2000).cast("long"), "n_name", F.substring("n_name", 1, 3), F.lit("department"), F.lit(None).cast("boolean"))
        labs = self.raw("supplier").select((F.col("s_suppkey") + 10000).cast("long"), "s_name", none, F.lit("lab"), F.col("s_suppkey") % 11 == 0)
        return regions.union(nations).union(labs)

    @cached_property
    def org_links(self) -> DataFrame:
        """child, parent, valid_from, valid_to"""
        start = F.lit("1995-01-01").cast("date")
        nations = self.raw("nation").select((F.col("n_nationkey") + 2000).cast("long").alias("child"), (F.col("n_regionkey") + 1000).cast("long").alias("parent"), start.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
        labs = self.raw("supplier").select((F.col("s_suppkey") + 10000).cast("long"), (F.col("s_nationkey") + 2000).cast("long"), start, F.when(F.col("s_suppkey") % 7 == 0, F.lit("2000-01-01").cast("date")))
        return nations.union(labs)

    @cached_property
    def affiliations(self) -> DataFrame:
        """id, person_id, org_id, valid_from, valid_to, is_primary, position_rank"""
        p, s = F.col("l_partkey"), F.col("l_suppkey")
        own = self.raw("lineitem").groupBy(p.alias("person_id"), s.alias("supp")).agg(F.to_date(F.min("l_shipdate")).alias("valid_from"), F.to_date(F.max("l_shipdate")).alias("last"))
        first = F.row_number().over(W.partitionBy("person_id").orderBy(F.desc("valid_from"), "supp")) == 1
        rank = F.element_at(F.array(*[F.lit(r) for r in RANKS]), (F.col("person_id") % len(RANKS) + 1).cast("int"))
        return own.select((F.col("person_id") * 100000 + F.col("supp")).alias("id"), "person_id", (F.col("supp") + 10000).alias("org_id"), "valid_from",
                          F.when((F.col("person_id") + F.col("supp")) % 3 == 0, F.col("last")).alias("valid_to"), first.alias("is_primary"), rank.alias("position_rank"))

    @cached_property
    def relations(self) -> DataFrame:
        """from_id, to_id, valid_from, valid_to: advised_by"""
        p = F.col("p_partkey")
        to = F.expr("p_partkey div 10")
        return self.raw("part").where((p % 4 == 0) & (to != p) & (to >= 1)).select(
            p.alias("from_id"), to.alias("to_id"), F.when(p % 8 == 0, F.lit("1996-01-01").cast("date")).alias("valid_from"), F.when(p % 8 == 0, F.lit("1999-01-01").cast("date")).alias("valid_to"))

    @cached_property
    def person_topics(self) -> DataFrame:
        """person_id, topic, field, score: positive components of the embeddings"""
        return self.raw("embeddings").select(F.col("vec_id").alias("person_id"), F.posexplode("embedding").alias("topic", "score")).where("score > 0").select(
            "person_id", F.col("topic").cast("long").alias("topic"), (F.col("topic") % 8).cast("long").alias("field"), F.col("score").cast("double").alias("score"))

    @cached_property
    def snapshots(self) -> DataFrame:
        """id, url, hash, fetched_at, expires_at"""
        at = F.date_add(F.lit("1997-06-01").cast("date"), F.col("page_id").cast("int"))
        return self.raw("pages").select(F.col("page_id").alias("id"), "url", F.sha2("html", 256).alias("hash"), at.alias("fetched_at"), F.date_add(at, 365).alias("expires_at"))

    @cached_property
    def titles(self) -> DataFrame:
        """id, title: the first line of every document"""
        return self.raw("documents").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"))


RANKS = ("full_professor", "associate_professor", "assistant_professor", "postdoc", "phd_student", "lecturer", "unknown")
