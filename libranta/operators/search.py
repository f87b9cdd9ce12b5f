"""Search: filters, source groups, relaxation, limits, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import dedup

# Groups of sources; a member may be another group.
GROUPS = {
    "latam": "alicia renati lareferencia conacyt unam anid oasisbr bdtd snrd minciencias rraae costarica uruguay elsalvador scielo redalyc", "iberoamerica": "latam espana",
    "global": "semantic openalex pubmed crossref doaj zenodo openaire core", "premium": "scopus serpapi", "peru": "alicia renati laref_peru", "brasil": "oasisbr bdtd laref_brasil",
    "ecuador": "rraae laref_ecuador", "mexico": "conacyt unam laref_mexico", "argentina": "snrd laref_argentina", "colombia": "minciencias laref_colombia", "chile": "anid laref_chile",
    "centroamerica": "costarica elsalvador", "tesis": "alicia renati bdtd rraae lareferencia snrd minciencias espana costarica uruguay elsalvador", "ai_ml": "arxiv huggingface paperswithcode openreview dblp",
}
GROUPS["free"] = "semantic openalex pubmed arxiv crossref doaj zenodo openaire core scielo redalyc alicia renati lareferencia conacyt unam anid oasisbr bdtd snrd minciencias rraae espana costarica uruguay elsalvador dblp paperswithcode huggingface openreview"
GROUPS["all"] = GROUPS["free"] + " scopus serpapi"
# Other names of sources.
ALIASES = {
    "semanticscholar": "semantic", "semantic_scholar": "semantic", "semantic-scholar": "semantic", "open_alex": "openalex", "open-alex": "openalex", "la_referencia": "lareferencia", "la-referencia": "lareferencia",
    "papers_with_code": "paperswithcode", "papers-with-code": "paperswithcode", "hugging_face": "huggingface", "hugging-face": "huggingface", "open_review": "openreview", "open-review": "openreview",
    "bdtdbr": "bdtd", "bdtd-br": "bdtd", "rraae_ecuador": "rraae", "rraae-ecuador": "rraae", "recolecta": "espana", "españa": "espana", "spain": "espana", "kimuk": "costarica", "costa_rica": "costarica",
    "costa-rica": "costarica", "timbo": "uruguay", "timbó": "uruguay", "redicces": "elsalvador", "el_salvador": "elsalvador", "el-salvador": "elsalvador",
    "laref-peru": "laref_peru", "laref-brasil": "laref_brasil", "laref-ecuador": "laref_ecuador", "laref-mexico": "laref_mexico", "laref-argentina": "laref_argentina", "laref-colombia": "laref_colombia", "laref-chile": "laref_chile",
}


def expanded(names: list[str]) -> list[str]:
    """Source ids that names, aliases and groups stand for, each once, in order; unknown names pass."""
    out: list[str] = []
    seen: set[str] = set()
    todo = list(names)
    while todo:
        name = todo.pop(0).strip().lower()
        name = ALIASES.get(name, name)
        if name in seen:
            continue
        seen.add(name)
        if name in GROUPS:
            todo = GROUPS[name].split() + todo
        else:
            out.append(name)
    return out


def edges(spark: SparkSession) -> DataFrame:
    """(grp, member): the groups as an edge table."""
    return spark.createDataFrame([(g, m) for g, members in GROUPS.items() for m in members.split()], "grp string, member string")


def group_members(spark: SparkSession, depth: int = 2) -> DataFrame:
    """(grp, member): all groups expanded to sources, by joins to a fixed depth."""
    table = edges(spark)
    inner = table.select(F.col("grp").alias("via"), F.col("member").alias("leaf"))
    for _ in range(depth):
        table = table.join(inner, table["member"] == inner["via"], "left").select("grp", F.coalesce("leaf", "member").alias("member")).distinct()
    return table


def in_years(year: Column, start: int | None, end: int | None) -> Column:
    """Years in range; unknown years are kept, absent bounds do not count."""
    test = F.lit(True)
    for bound, ok in ((start, year >= F.lit(start)), (end, year <= F.lit(end))):
        test = test & ok if bound is not None else test
    return text.no_number(year) | test


def any_term(query: str, *columns: str, nothing: bool = True) -> Column:
    """Whether any term of three letters or more is contained in the columns; ``nothing`` is the answer to a query without terms."""
    terms = [w for w in query.lower().split() if len(w) >= 3]
    hay = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in columns)))
    test = F.lit(nothing and not terms)
    for term in terms:
        test = test | hay.contains(term)
    return test


def batch_search(papers: DataFrame, query: str, start: int | None = None, end: int | None = None, most: int = 120) -> DataFrame:
    """(seq, id, title, year, quality, queries): filter, keep the best of each work, filter by year, take the first ``most`` by arrival."""
    best = dedup.batch_dedup(papers.where(any_term(query, "title", "abstract")), "seq", "id", "title", "year").where(in_years(F.col("year"), start, end))
    return best.orderBy("first").limit(most).select(F.col("winner").alias("seq"), "id", "title", "year", "quality", "queries")


def budget(most: Column | int, queries: Column | int) -> Column:
    """How many rows each of several queries may ask for: its share of at most 120, and ten more, between 20 and 60."""
    most, queries = (x if isinstance(x, Column) else F.lit(x) for x in (most, queries))
    return F.least(F.lit(60), F.greatest(F.lit(20), F.ceil(F.least(most, F.lit(120)) / queries) + 10)).cast("int")


def merged_stats(stats: DataFrame) -> DataFrame:
    """(source, found, time, errors): the statistics of several queries put together; errors are not carried over."""
    return stats.groupBy("source").agg(F.sum("found").alias("found"), F.sum("time").alias("time"), F.lit(0).alias("errors"))


def seeded_sample(frame: DataFrame, key: str, most: int = 30, seed: int = 42) -> DataFrame:
    """``most`` rows that a seed picks, the same ones at each call: those of the smallest hashes of key and seed."""
    return frame.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(most)


def formats(name: Column) -> Column:
    """The kind of document that a file's extension names."""
    # Extensions and kinds.
    kinds = {".pdf": "pdf", ".docx": "docx", ".doc": "docx", ".pptx": "pptx", ".ppt": "pptx", ".xlsx": "xlsx", ".xls": "xlsx", ".png": "image", ".jpg": "image", ".jpeg": "image", ".html": "html"}
    extension = F.regexp_extract(F.lower(name), r"(\.[^./\\]+)$", 1)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)), extension), F.lit("unknown"))


def backoff_seconds(attempt: Column, base: int = 2, factor: int = 2) -> Column:
    """How long to wait before an attempt is made again: ``factor`` times ``base`` to the power of the attempt."""
    return (F.pow(F.lit(base), attempt) * factor).cast("int")


def ladder(papers: DataFrame, queries: DataFrame, levels: int = 3) -> DataFrame:
    """(query_id, level, n): for each query the first level of relaxation with hits: all its words, its first three, its first two.

    Words are matched through an inverted index by equi-joins, so no query is held against every row.
    """
    words = queries.select("query_id", F.array_distinct(F.filter(F.split(text.folded(F.col("query")), r"[^a-z0-9]+"), lambda w: F.length(w) > 2)).alias("w"))
    steps = F.array(*(F.struct(F.lit(k).alias("level"), (F.col("w") if n is None else F.slice("w", 1, n)).alias("need")) for k, n in ((0, None), (1, 3), (2, 2))[:levels]))
    asked = words.select("query_id", F.explode(steps).alias("s")).select("query_id", "s.level", F.explode("s.need").alias("word"), F.size("s.need").alias("m"))
    index = papers.select("seq", F.explode(F.array_distinct(F.split(text.folded(F.col("title")), r"[^a-z0-9]+"))).alias("word"))
    hits = asked.join(index, "word").groupBy("query_id", "level", "m", "seq").agg(F.count("*").alias("k")).where("k = m")
    counts = hits.groupBy("query_id", "level").agg(F.count("*").alias("n"))
    return counts.groupBy("query_id").agg(F.min(F.struct("level", "n")).alias("x")).select("query_id", "x.level", "x.n")


def source_stats(papers: DataFrame) -> DataFrame:
    return papers.groupBy("source").agg(F.count("*").alias("found"), F.count_if(~text.missing(F.col("doi"))).alias("with_doi"), F.count_distinct("id").alias("ids"))


def query_report(papers: DataFrame) -> DataFrame:
    kept = dedup.search_dedup(papers).groupBy("matched_query").agg(F.count("*").alias("returned"))
    return papers.groupBy("matched_query").agg(F.count("*").alias("before_dedup")).join(kept, "matched_query", "left").select("matched_query", "before_dedup", F.coalesce("returned", F.lit(0)).alias("returned"))


def health(events: DataFrame, by: str = "event_type") -> DataFrame:
    """(category, total, working, percent): with a total row."""
    rows = events.select(F.col(by).alias("category"), (F.col("value") >= 5).cast("int").alias("ok"))
    total = rows.rollup("category").agg(F.count("*").alias("total"), F.sum("ok").alias("working"))
    return total.select(F.coalesce("category", F.lit("all")).alias("category"), "total", "working", F.floor(100 * F.col("working") / F.col("total")).alias("percent"))


def latest(events: DataFrame, key: str) -> DataFrame:
    """(key, event_type, at): the last status of each key."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.groupBy(key).agg(F.max(F.struct(at.alias("at"), "event_id", "event_type")).alias("x")).select(key, "x.event_type", "x.at")


