"""From documents to shards of training text, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlumen.llm import decontaminate, mixing, quality, rare, sharding
from runlumen.llm.common import fresh, table
from runlumen.session import stage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (probability of label 1 at least 0.5)."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "quality_score")
    return quality.score(docs, model, score).filter(F.col(score) >= 0.5).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group alike in 5-word shingles (80 % or more).

    Rows are compared by their own texts, under numbers made from id and text, so of a doc_id that
    stands at several texts only those go that are in a group. Of rows with one doc_id and one text one
    stays. Rows without a doc_id are in no group and stay.
    """
    # a row's own columns travel as one, so none of them can meet a name used here
    number = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    content = F.xxhash64(*[F.col(c) for c, t in docs.dtypes if "map<" not in t])
    known = docs.filter(F.col("doc_id").isNotNull())
    placed = rare.join(known.select(number.alias("doc_id"), "text"), n=5, percent=80).select(
        F.col("doc_id").alias("number"), F.col("component_id").alias("component")).distinct()
    counted = known.select("doc_id", number.alias("number")).groupBy("doc_id", "number").count()
    members = counted.join(placed, "number")
    first = members.groupBy("component").agg(
        F.min(F.struct("doc_id", "number")).alias("first"), F.count("*").alias("members")).filter("members > 1")
    own = F.struct(F.col("doc_id"), F.col("number"))
    later = members.join(first, "component").filter(own != F.col("first")).select("doc_id", "number")
    told = later.select("doc_id", "number", F.lit(True).alias("goes")).unionByName(
        counted.filter("count > 1").select("doc_id", "number", F.lit(False).alias("goes")))
    told = told.groupBy(F.col("doc_id").alias("told_id"), F.col("number").alias("told")).agg(F.bool_or("goes").alias("goes"))
    marked = known.select(F.struct(*docs.columns).alias("own"), F.col("doc_id").alias("id"), number.alias("number"),
                          content.alias("content")).join(
        told, (F.col("id") == F.col("told_id")) & (F.col("number") == F.col("told")), "left")
    single = marked.filter("goes is null").select("own.*")
    # of rows of one id and text the least by their columns
    one = marked.filter("not goes").groupBy("id", "number").agg(F.min_by("own", "content").alias("own"))
    return single.union(one.select("own.*")).union(docs.filter(F.col("doc_id").isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = fresh(docs, "benchmark_items")
    found = decontaminate.contaminating(docs, table(spark, sf_dir, "benchmark"), out=items)
    return found.filter(F.size(items) == 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, one row for each pass of the mix over them."""
    schedule = mixing.ramps(mixing.cyclic_weights(docs))
    return mixing.training_order(mixing.mix(docs, schedule), fresh(docs, "position")).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with their shard of 40 and their slot in it."""
    return sharding.assign(docs, 40)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix),
    ("sharding", shard),
]

#: The classifier is learnt and the joins search by overlap: not for SQL; tests compare with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
