"""Pairs of revisions (key.., old, new) from tables; and test cases from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def spread(pairs: DataFrame, *keys: str) -> DataFrame:
    """Deals pairs to tasks for a kernel.

    A pair costs its texts' difference, not its bytes; by bytes a few large tasks would be made
    of many small pairs. Three tasks a core even out what one pair can cost.
    """
    spark = pairs.sparkSession
    n = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return pairs.repartition(n, *keys)


def revision_pairs(revisions: DataFrame, group: list, order: list, text: str, keys: list[str]) -> DataFrame:
    """Each row with the text before it in its group, in a total order; first ones have no pair."""
    old = F.lag(text).over(W.partitionBy(*group).orderBy(*order))
    return spread(revisions.select(*keys, old.alias("old"), F.col(text).alias("new")).filter("old is not null"), *keys)


#: Parts by order that a group is found in; a group of all rows still makes so many tasks.
PARTS = 32


def neighbour_keys(rows: DataFrame, group: str, order: str) -> DataFrame:
    """(o, before): each row's order value and that of the row before it in its group; values are unique numbers.

    Each group is cut at the same quantiles of the order, so one that holds a large part of all rows
    is spread over tasks; the row that a part lacks is the last one of the part before. Only
    the two columns travel. Groups that are null have no pairs.
    """
    rows = rows.select(F.col(group).alias("g"), F.col(order).alias("o")).filter("g is not null")
    cuts = rows.agg(F.percentile_approx("o", [k / PARTS for k in range(1, PARTS)], 1000)).first()[0] or []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("o"))) if cuts else F.lit(0)
    placed = rows.withColumn("part", part)
    inside = placed.withColumn("p", F.lag("o").over(W.partitionBy("g", "part").orderBy("o")))
    last = placed.groupBy("g", "part").agg(F.max("o").alias("last"))
    edge = last.select("g", "part", F.lag("last").over(W.partitionBy("g").orderBy("part")).alias("edge"))  # at most PARTS rows a group
    return inside.join(edge, ["g", "part"]).select("o", F.coalesce("p", "edge").alias("before")).filter("before is not null")


def neighbour_pairs(rows: DataFrame, group, order: str, text: str) -> DataFrame:
    """(order, old, new): each row with the text before it in its group, whose size has no bound.

    Neighbours are found by keys alone; then each text is fetched by its key, so no text is
    sorted and none has to fit in a task with others of its group.
    """
    spark = rows.sparkSession
    n = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = neighbour_keys(rows.select(F.sha2(group.cast("binary"), 256).alias("group"), F.col(order)), "group", order)
    new = rows.select(F.col(order).alias("o"), F.col(text).alias("new")).join(keys, "o").repartition(n, "before")
    old = rows.select(F.col(order).alias("before"), F.col(text).alias("old")).repartition(n, "before")
    return new.join(old, "before").filter("old is not null").select(F.col("o").alias(order), "old", "new")


def conversation_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation with the one before it."""
    return revision_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet"), ["conv_id"], ["turn"], "text", ["conv_id", "turn"])


def document_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the same first line, each with the one before it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return neighbour_pairs(docs, F.substring_index("text", "\n", 1), "doc_id", "text")


def rotated_documents(spark: SparkSession, sf_dir: str, mark: str = "") -> DataFrame:
    """Documents of four lines or more with their last third of lines moved to the front, each moved line ending in ``mark``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.split("text", "\n").alias("l")).filter("size(l) > 3")
    n = F.size("l")
    k = F.floor(n / 3).cast("int")
    front = F.transform(F.slice("l", n - k + 1, k), lambda x: F.concat(x, F.lit(mark)))
    whole = lambda a: F.concat(F.array_join(a, "\n"), F.lit("\n"))
    return spread(docs.select("doc_id", whole(F.col("l")).alias("old"), whole(F.concat(front, F.slice("l", F.lit(1), n - k))).alias("new")), "doc_id")


def page_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a host, each with the one before it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return neighbour_pairs(pages, F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), "page_id", "html")


def fixture_cases(spark: SparkSession, path: str) -> DataFrame:
    """Test cases of a JSON file: name, old, new, and options and expected results as JSON text."""
    return spark.read.schema("name string, old string, new string, options string, expected string").json(path, multiLine=True)


#: The same pairs in SQL.
PAIRS_SQL = {
    "rotated": "(SELECT doc_id, array_to_string(l, chr(10)) || chr(10) AS old, array_to_string(list_transform(l[len(l) - len(l) // 3 + 1:], lambda x: x || '{mark}') || l[:len(l) - len(l) // 3], chr(10)) || chr(10) AS new FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) WHERE len(l) > 3)",
    "conversations": "(SELECT * FROM (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old, text AS new FROM conversations) WHERE old IS NOT NULL)",
    "documents": "(SELECT * FROM (SELECT doc_id, lag(text) OVER (PARTITION BY string_split(text, chr(10))[1] ORDER BY doc_id) AS old, text AS new FROM documents) WHERE old IS NOT NULL)",
    "pages": "(SELECT * FROM (SELECT page_id, lag(html) OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/]+)', 1) ORDER BY page_id) AS old, html AS new FROM pages) WHERE old IS NOT NULL)",
}
