"""Removal of duplicates in search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scores, text
from ..tables import checkpointed, dropped


def first_of(frame: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order, by a partial aggregate and not by a sort of whole groups."""
    rank = F.min_by(F.struct("*"), F.struct(*order))
    return frame.groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys))).agg(rank.alias("_first")).select("_first.*")


def search_dedup(papers: DataFrame, group: str = "matched_query", order: str = "seq", most: int = 200) -> DataFrame:
    """(group, order) of the rows kept by the greedy rule with two keys, in arrival order within each group.

    A row is dropped if its DOI or else its title key was registered by a kept row; only kept rows register; a row with
    neither key is lost. Rows are the edges of a graph of keys, and the greedy rule is its matching in the order of arrival:
    in each round a row that comes first for both of its keys is kept, and all rows with one of its keys go. Rounds are
    aggregates and joins, so neither a group nor a key with a third of all rows meets in one task, and the rows left over
    shrink from round to round; of rows with equal keys only the first can be kept, so the others go before.
    Raises an error if rows are undecided after ``most`` rounds.
    """
    keyed = papers.select(
        F.col(group).alias("g"), F.col(order).alias("o"), F.coalesce(F.lower("doi"), F.lit("")).alias("k1"), F.coalesce(text.title_key(F.col("title")), F.lit("")).alias("k2"),
        F.coalesce(F.nullif("id", F.lit("")), F.nullif("doi", F.lit("")), "title").alias("uid"),
    ).where("k1 <> '' or k2 <> ''")
    digest = lambda k: F.when(F.col(k) != "", F.unhex(F.md5(F.concat_ws("\u0000", F.coalesce("g", F.lit("\u0001")), k))))
    rows = keyed.groupBy("g", "k1", "k2").agg(F.min(F.struct("o", "uid")).alias("x")).select(
        "x.*", "g", digest("k1").alias("h1"), digest("k2").alias("h2"),
    )
    rows, kept = checkpointed(rows), None
    for _ in range(most):
        first = lambda h: rows.where(f"{h} is not null").groupBy(h).agg(F.min("o").alias(f"o_{h}"))  # noqa: E731, B023
        marked = rows.join(first("h1"), "h1", "left").join(first("h2"), "h2", "left")
        marked = checkpointed(marked.withColumn("keep", (F.col("o") <= F.coalesce("o_h1", "o")) & (F.col("o") <= F.coalesce("o_h2", "o"))).select("g", "o", "uid", "h1", "h2", "keep"))
        taken = marked.where("keep").select("g", "o", "uid", "h1", "h2")
        kept = taken if kept is None else kept.unionByName(taken)
        rest = marked.where("not keep").drop("keep")
        for h in ("h1", "h2"):
            rest = rest.join(taken.where(f"{h} is not null").select(h), h, "left_anti")
        rest = checkpointed(rest)
        dropped(rows)
        rows = rest
        if rows.isEmpty():
            break
    else:
        raise RuntimeError(f"rows are undecided after {most} rounds")
    return first_of(kept.select("g", "o", "uid"), ["g", "uid"], "o").select(F.col("g").alias(group), F.col("o").alias(order))


def batch_key() -> Column:
    """The one key of a record: its bare DOI, else its title and year, else its id; null if it has none."""
    title = text.dedup_text(F.col("title"))
    doi = text.bare_doi(F.col("doi"))
    year = F.when(text.no_number(F.col("year")), "").otherwise(F.col("year").cast("string"))
    by_title = F.when(F.length(title) > 12, F.concat(F.lit("title:"), F.substring(title, 1, 90), F.lit(":"), year))
    return F.coalesce(F.when(~text.missing(doi), F.concat(F.lit("doi:"), doi)), by_title, F.when(~text.missing(F.col("id")), F.concat(F.lit("id:"), F.col("id"))))


def batch_dedup(papers: DataFrame, order: str = "seq", *carried: str) -> DataFrame:
    """(key, winner, quality, first, queries, carried): one row for each key: the best row, ties to the first, and all matched queries in order.

    Rows without a key are dropped. Two aggregates with partial steps; ``carried`` columns of the winner travel in its struct, and the queries of a key are made
    distinct before they are collected.
    """
    rows = papers.select(batch_key().alias("key"), F.col(order).alias("o"), scores.quality().alias("q"), F.col("matched_query").alias("query"), *carried).where("key is not null")
    best = rows.groupBy("key").agg(F.max(F.struct("q", (-F.col("o")).alias("o"), *carried)).alias("x"), F.min("o").alias("first"))
    asked = rows.where("query is not null").groupBy("key", "query").agg(F.min("o").alias("o")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("o", "query"))).alias("z"))
    joined = F.coalesce(F.array_join(F.transform("z", lambda s: s["query"]), "|"), F.lit(""))
    return best.join(asked, "key", "left").select("key", (-F.col("x.o")).alias("winner"), F.col("x.q").alias("quality"), "first", joined.alias("queries"), *(f"x.{c}" for c in carried))


def smart_dedup(papers: DataFrame, order: str = "seq") -> DataFrame:
    """(order): first row of each raw DOI, or of the first 60 characters of the folded title; rows with neither are dropped."""
    key = F.coalesce(F.nullif("doi", F.lit("")), F.nullif(F.substring(text.folded(F.col("title")), 1, 60), F.lit("")))
    return papers.select(key.alias("key"), F.col(order).alias("o")).where("key is not null").groupBy("key").agg(F.min("o").alias(order)).select(order)


def id_dedup(papers: DataFrame, order: str = "seq") -> DataFrame:
    """(id, order): the first row of each id; rows without an id count as one id."""
    return papers.select(F.coalesce("id", F.lit("")).alias("id"), F.col(order).alias("o")).groupBy("id").agg(F.min("o").alias(order))


def limited(frame: DataFrame, per: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each group; Spark keeps only so many for each group before it shuffles."""
    return frame.withColumn("_n", F.row_number().over(W.partitionBy(per).orderBy(order))).where(f"_n <= {most}").drop("_n")


def add_by_id(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """All rows of ``left``, then those of ``right`` whose key it lacks."""
    return left.unionByName(right.join(left.select(key).distinct(), key, "left_anti"))

