"""Filling in missing metadata by gated joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scores, text
from .pages import host, link_kind


def first_by(frame: DataFrame, key: Column | str, order: str, *columns: str) -> DataFrame:
    """(key, columns): one row for each key, the first in order. Rows without a key are left out."""
    rows = frame.select((F.col(key) if isinstance(key, str) else key).alias("key"), order, *(c for c in columns if c != order)).where("key is not null and key <> ''")
    return rows.groupBy("key").agg(F.min_by(F.struct(*columns), order).alias("x")).select("key", "x.*")


def _take(rows: DataFrame, field: str, test: Column, value: Column) -> DataFrame:
    """``field`` replaced where ``test`` holds, which the list of recovered fields notes."""
    test = F.coalesce(test, F.lit(False))
    return rows.withColumns({field: F.when(test, value).otherwise(F.col(field)), "_got": F.when(test, F.array_append("_got", F.lit(field))).otherwise(F.col("_got"))})


def _short(field: str, least: int) -> Column:
    return F.col(field).isNull() | (F.length(field) < least)


def _no_place() -> Column:
    return text.missing(F.col("university")) | (F.col("university") == scores.NO_UNIVERSITY)


def _no_author() -> Column:
    return F.coalesce(F.try_element_at("authors", F.lit(1)) == scores.NO_AUTHOR, F.lit(False))


def enriched(papers: DataFrame, works: DataFrame, by_doi: DataFrame, open_access: DataFrame, pages: DataFrame, below: int = 70) -> DataFrame:
    """(seq, score, title, authors, year, doi, abstract, pdf_url, university, fields, new_score): poor records completed in four gated stages; only they are joined.

    1. ``works`` by title (seq, doi, year, abstract, university, authors), where abstract, DOI or year is missing or short; 2. ``by_doi`` (key, abstract, year), where the
    abstract is short; 3. ``open_access`` by DOI (key, authors, abstract, pdf_url), where the author is a placeholder or there is no file; 4. ``pages`` by link (key, abstract,
    university, authors, pdf_url), where the abstract is still short and the link is a repository's. What is there and no sentinel stays. A key that is not in a table changes nothing.
    """
    cols = ["seq", "title", "authors", "year", "doi", "abstract", "pdf_url", "university", "handle_url", "url"]
    rows = papers.withColumn("score", scores.completeness()).where(F.col("score") < below).select(*cols, "score", F.array().cast("array<string>").alias("_got"))
    named = lambda frame, prefix, key: frame.select(F.col(key).alias(f"{prefix}_key"), *(F.col(c).alias(f"{prefix}_{c}") for c in frame.columns if c != key))
    has = lambda c: ~text.missing(F.col(c))
    # 1. by title
    rows = rows.join(named(works, "w", "seq"), F.col("seq") == F.col("w_key"), "left")
    gate = F.col("w_key").isNotNull() & (_short("abstract", 100) | text.missing(F.col("doi")) | text.no_number(F.col("year")))
    rows = rows.withColumn("_gate", F.coalesce(gate, F.lit(False)))
    rows = _take(rows, "doi", F.col("_gate") & text.missing(F.col("doi")) & has("w_doi"), text.bare_link(F.col("w_doi")))
    rows = _take(rows, "year", F.col("_gate") & text.no_number(F.col("year")) & ~text.no_number(F.col("w_year")), F.col("w_year"))
    rows = _take(rows, "abstract", F.col("_gate") & _short("abstract", 100) & (F.length("w_abstract") > F.coalesce(F.length("abstract"), F.lit(0))), F.col("w_abstract"))
    rows = _take(rows, "university", F.col("_gate") & _no_place() & has("w_university"), F.col("w_university"))
    rows = _take(rows, "authors", F.col("_gate") & _no_author() & (F.size("w_authors") > 0), F.col("w_authors")).select(*cols, "score", "_got")
    # 2. and 3. by DOI
    rows = rows.withColumn("_doi", text.bare_doi(F.col("doi"))).join(named(by_doi, "c", "key"), F.col("_doi") == F.col("c_key"), "left")
    rows = rows.withColumn("_gate", F.col("c_key").isNotNull() & _short("abstract", 100))
    rows = _take(rows, "abstract", F.col("_gate") & has("c_abstract"), F.trim(F.regexp_replace("c_abstract", "<[^>]+>", "")))
    rows = _take(rows, "year", F.col("_gate") & text.no_number(F.col("year")) & ~text.no_number(F.col("c_year")), F.col("c_year"))
    rows = rows.select(*cols, "score", "_got", "_doi").join(named(open_access, "o", "key"), F.col("_doi") == F.col("o_key"), "left")
    rows = rows.withColumn("_gate", F.col("o_key").isNotNull() & (_no_author() | text.missing(F.col("pdf_url"))))
    rows = _take(rows, "authors", F.col("_gate") & _no_author() & (F.size("o_authors") > 0), F.col("o_authors"))
    rows = _take(rows, "abstract", F.col("_gate") & has("o_abstract") & _short("abstract", 50), F.col("o_abstract"))
    rows = _take(rows, "pdf_url", F.col("_gate") & text.missing(F.col("pdf_url")) & has("o_pdf_url"), F.col("o_pdf_url")).select(*cols, "score", "_got")
    # 4. by the repository's page
    link = F.coalesce(F.nullif("handle_url", F.lit("")), F.nullif("pdf_url", F.lit("")))
    known = link.contains("handle") | link.contains(".edu.") | link.contains(".gob.")
    rows = rows.withColumn("_link", F.when(_short("abstract", 80) & known, link)).join(named(pages, "p", "key"), F.col("_link") == F.col("p_key"), "left").withColumn("_gate", F.col("p_key").isNotNull())
    rows = _take(rows, "abstract", F.col("_gate") & (F.length("p_abstract") > F.coalesce(F.length("abstract"), F.lit(0))), F.col("p_abstract"))
    rows = _take(rows, "university", F.col("_gate") & has("p_university") & _no_place(), F.col("p_university"))
    rows = _take(rows, "authors", F.col("_gate") & (F.size("p_authors") > 0) & _no_author(), F.col("p_authors"))
    rows = _take(rows, "pdf_url", F.col("_gate") & has("p_pdf_url") & text.missing(F.col("pdf_url")), F.col("p_pdf_url"))
    return rows.select("seq", "score", "title", "authors", "year", "doi", "abstract", "pdf_url", "university", F.array_join(F.array_distinct("_got"), "|").alias("fields"), scores.completeness().alias("new_score"))


def updated(papers: DataFrame, changed: DataFrame, key: str = "seq") -> DataFrame:
    """All papers, with the columns of ``changed`` in place of their own where it has a row of the key; of several such rows one of the largest values is taken."""
    columns = [c for c in changed.columns if c != key and c in papers.columns]
    last = changed.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*(c for c in columns if c != "metadata"))).alias("_new"))
    rows = papers.join(last, key, "left")
    return rows.select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in papers.columns))


def detailed(papers: DataFrame, details: DataFrame, key: str = "seq", most: int | None = 30, order: str = "seq", group: str | None = None) -> DataFrame:
    """(key, title, authors, year, doi, abstract, pdf_url, university, enrichment_url): the first ``most`` records (of each ``group``) in need completed from their details.

    A longer abstract wins; a sentinel gives way; the file's direct link always wins and the old one is kept beside it. Other records stay as they are.
    """
    need = F.coalesce(scores.needs_enhancement(), F.lit(False))
    rows = papers.withColumn("_need", need)
    if most is not None:
        turn = F.row_number().over(W.partitionBy(*([group] if group else []), "_need").orderBy(order))
        rows = rows.withColumn("_need", F.col("_need") & (turn <= most)) if group else rows.join(rows.where("_need").orderBy(order).limit(most).select(F.col(key).alias("_first")), F.col(key) == F.col("_first"), "left").withColumn("_need", F.col("_first").isNotNull())
    new = details.select(F.col(key).alias("_k"), *(F.col(c).alias(f"d_{c}") for c in ("title", "authors", "year", "doi", "abstract", "pdf_url", "university")))
    rows = rows.join(new, (F.col(key) == F.col("_k")) & F.col("_need"), "left")
    take = lambda test, c: F.when(F.coalesce(test, F.lit(False)), F.col(f"d_{c}")).otherwise(F.col(c)).alias(c)
    has = lambda c: ~text.missing(F.col(c))
    file = has("d_pdf_url")
    return rows.select(
        key, take(has("d_title") & (text.missing(F.col("title")) | (F.col("title") == "Sin título")), "title"), take((F.size("d_authors") > 0) & _no_author(), "authors"), take(text.no_number(F.col("year")) & ~text.no_number(F.col("d_year")), "year"),
        take(has("d_doi") & text.missing(F.col("doi")), "doi"), take(F.length("d_abstract") > F.coalesce(F.length("abstract"), F.lit(0)), "abstract"), take(file, "pdf_url"),
        take(has("d_university") & (text.missing(F.col("university")) | F.col("university").isin(scores.NO_UNIVERSITY, "Universidad", "Universidad Nacional")), "university"), F.when(file & has("pdf_url"), F.col("pdf_url")).alias("enrichment_url"),
    )


def recovered(asked: DataFrame, by_doi: DataFrame, crossref: DataFrame, open_access: DataFrame) -> DataFrame:
    """(seq, title, authors, year, abstract, pdf_url, fields, score): records asked for by DOI, recovered from three tables (key, ...) in order.

    The first table's values win whatever was there; the others fill what is still missing or short.
    """
    rows = asked.select("seq", "title", F.array().cast("array<string>").alias("authors"), F.lit(None).cast("int").alias("year"), F.lit("").alias("abstract"), F.lit(None).cast("string").alias("pdf_url"), F.lit(None).cast("string").alias("university"), text.bare_doi(F.col("doi")).alias("doi"), F.array().cast("array<string>").alias("_got"))
    keep = rows.columns
    has = lambda c: ~text.missing(F.col(c))
    put = lambda frame, prefix: frame.select(F.col("key").alias(f"{prefix}_key"), *(F.col(c).alias(f"{prefix}_{c}") for c in frame.columns if c != "key"))
    rows = rows.join(put(by_doi, "a"), F.col("doi") == F.col("a_key"), "left")
    for field, test in (("title", has("a_title")), ("abstract", has("a_abstract")), ("year", ~text.no_number(F.col("a_year"))), ("authors", F.size("a_authors") > 0), ("university", has("a_university")), ("pdf_url", has("a_pdf_url"))):
        rows = _take(rows, field, test, F.col(f"a_{field}"))
    rows = rows.select(*keep).join(put(crossref, "c"), F.col("doi") == F.col("c_key"), "left").withColumn("_gate", _short("abstract", 100))
    rows = _take(rows, "abstract", F.col("_gate") & (F.length("c_abstract") > F.length("abstract")), F.col("c_abstract"))
    rows = _take(rows, "year", F.col("_gate") & text.no_number(F.col("year")) & ~text.no_number(F.col("c_year")), F.col("c_year"))
    rows = rows.select(*keep).join(put(open_access, "o"), F.col("doi") == F.col("o_key"), "left")
    rows = _take(rows, "authors", (F.size("authors") == 0) & (F.size("o_authors") > 0), F.col("o_authors"))
    rows = _take(rows, "abstract", has("o_abstract") & _short("abstract", 50), F.col("o_abstract"))
    rows = _take(rows, "pdf_url", has("o_pdf_url") & F.col("pdf_url").isNull(), F.col("o_pdf_url"))
    return rows.select("seq", "title", F.array_join("authors", "|").alias("authors"), "year", "abstract", "pdf_url", F.array_join(F.array_distinct("_got"), "|").alias("fields"), scores.completeness(sentinels=False).alias("score"))


def simple_enriched(papers: DataFrame, found: DataFrame, least: int = 200, short: int = 150) -> DataFrame:
    """(seq, abstract, year, citation_count): papers whose abstract has ``least`` characters or fewer, filled by title from ``found`` (seq, abstract, year, citation_count)."""
    f = found.select(F.col("seq").alias("_k"), *(F.col(c).alias(f"f_{c}") for c in ("abstract", "year", "citation_count")))
    rows = papers.join(f, (F.col("seq") == F.col("_k")) & ~(F.coalesce(F.length("abstract"), F.lit(0)) > least), "left")
    better = (F.coalesce(F.length("abstract"), F.lit(0)) < short) & (F.length("f_abstract") > F.coalesce(F.length("abstract"), F.lit(0)))
    return rows.select("seq", F.when(better, F.col("f_abstract")).otherwise(F.col("abstract")).alias("abstract"), F.when(text.no_number(F.col("year")), F.coalesce("f_year", "year")).otherwise(F.col("year")).alias("year"), F.coalesce(F.nullif("citation_count", F.lit(0)), "f_citation_count").alias("citation_count"))


MOST_PATTERNS = 10_000  # rows of a table whose patterns every link is held against; it is sent to all tasks


def first_contained(frame: DataFrame, column: str, patterns: DataFrame, pattern: str = "pattern", order: str = "ord") -> DataFrame:
    """``frame`` with ``match``, the row of ``patterns`` that comes first of those whose ``pattern`` the column contains; null if none does.

    The patterns are a small fixed table; more than MOST_PATTERNS are refused.
    """
    n = patterns.count()
    if n > MOST_PATTERNS:
        raise ValueError(f"{n} patterns are too many to hold every row against")
    rest = [c for c in patterns.columns if c != order]
    packed = patterns.where(F.col(pattern).isNotNull() & (F.col(pattern) != "")).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, *rest))), lambda p: F.struct(*(p[c].alias(c) for c in rest))).alias("_all"))
    rows = frame.crossJoin(F.broadcast(packed))
    return rows.select(*frame.columns, F.try_element_at(F.filter("_all", lambda p: F.col(column).contains(p[pattern])), F.lit(1)).alias("match"))


def handle_rewritten(frame: DataFrame, column: str, repositories: DataFrame) -> DataFrame:
    """``frame`` with (resolved, repository): handle links that hold a known prefix lead to the repository itself; others stay. ``repositories`` is (pattern, ord, base, name)."""
    rows = first_contained(frame, column, repositories)
    known = F.col(column).contains("hdl.handle.net") & F.col("match").isNotNull()
    suffix = F.expr(f"substring({column}, locate(match.pattern, {column}))")
    handled = F.col(column).contains("hdl.handle.net") | F.col(column).contains("/handle/")
    return rows.select(*frame.columns, F.when(known, F.concat(F.col("match.base"), F.lit("/"), suffix)).otherwise(F.col(column)).alias("resolved"), F.when(handled, F.col("match.name")).alias("repository"))


def resolved_universities(papers: DataFrame, by_prefix: DataFrame, by_acronym: DataFrame) -> DataFrame:
    """(seq, university): names that are missing or sentinels filled by the handle prefix in id or link, else by what stands before the first underscore of the id.

    ``by_prefix`` and ``by_acronym`` are (key, name) with one row a key.
    """
    own = F.regexp_extract("id", r"(20\.500\.\d+|\d{4,})", 1)
    prefix = F.when(own != "", own).otherwise(F.regexp_extract(F.coalesce("handle_url", F.lit("")), r"handle/(20\.500\.\d+|\d+)", 1))
    rows = papers.select("seq", "university", prefix.alias("_p"), F.substring_index("id", "_", 1).alias("_a"))
    rows = rows.join(by_prefix.select(F.col("key").alias("_p"), F.col("name").alias("_n1")), "_p", "left").join(by_acronym.select(F.col("key").alias("_a"), F.col("name").alias("_n2")), "_a", "left")
    none = text.missing(F.col("university")) | F.col("university").isin("Universidad Peruana", "Universidad")
    return rows.select("seq", F.when(none, F.coalesce("_n1", "_n2", "university")).otherwise(F.col("university")).alias("university"))


def dois_by_name(files: DataFrame, records: DataFrame, most: int = 5) -> DataFrame:
    """(seq, doi): for files named by author and year, the DOI of the first of the year's first ``most`` records whose author's name contains the author, else of the first of all.

    ``files`` is (seq, author, year), ``records`` (ord, year, authors, doi). Only ``most`` records a year take part, as the source returns them.
    """
    top = records.withColumn("_n", F.row_number().over(W.partitionBy("year").orderBy("ord"))).where(F.col("_n") <= most)
    rows = files.join(top.select(F.col("year").alias("_y"), "ord", "authors", "doi"), F.col("year").cast("int") == F.col("_y"))
    like = F.exists("authors", lambda a: F.lower(a).contains(F.lower(F.col("author"))))
    best = rows.groupBy("seq").agg(F.min_by("doi", F.struct(F.when(F.coalesce(like, F.lit(False)) & F.col("doi").isNotNull(), 0).otherwise(1).alias("other"), "ord")).alias("doi"))
    return best


def with_fallback(rows: DataFrame, primary: DataFrame, secondary: DataFrame, queries: DataFrame, label: str, names: tuple[str, str]) -> DataFrame:
    """(query_id, seq, source, is_fallback): a query's own rows; if it has none those of the first stand-in, else of the second, labelled by both sources.

    All frames are (query_id, seq). Each level is reached only by queries that the levels before left empty.
    """
    levels = [rows.withColumns({"source": F.lit(label), "level": F.lit(0)})]
    levels += [frame.withColumns({"source": F.lit(f"{label} (via {name})"), "level": F.lit(k)}) for k, (frame, name) in enumerate(zip((primary, secondary), names, strict=True), 1)]
    every = levels[0].unionByName(levels[1]).unionByName(levels[2]).join(queries.select("query_id"), "query_id", "left_semi")
    first = every.groupBy("query_id").agg(F.min("level").alias("first"))
    return every.join(first, "query_id").where("level = first").select("query_id", "seq", "source", (F.col("level") > 0).alias("is_fallback"))


def merged_fallback(left: DataFrame, right: DataFrame, least: int = 5, key: str = "id") -> DataFrame:
    """``left``, and where a query (query_id) has fewer than ``least`` rows also the rows of ``right`` whose key it lacks."""
    few = left.groupBy("query_id").agg(F.count("*").alias("n"))
    need = right.join(few, "query_id", "left").where(F.coalesce("n", F.lit(0)) < least).drop("n")
    return left.unionByName(need.join(left.select("query_id", key).distinct(), ["query_id", key], "left_anti"))


def recovered_fields(papers: DataFrame) -> DataFrame:
    return papers.select(F.explode("enriched_fields").alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def title_matches(papers: DataFrame, records: DataFrame, head: int = 20, short: int = 12) -> DataFrame:
    """(seq, rec_id): the first record whose lower-cased title contains the first ``head`` characters of a paper's title.

    All sections of that length of the records' different titles are keys of an equi-join, so nothing is compared with everything. Titles
    under ``short`` characters are few different placeholders: a small table that every title is held against, refused beyond MOST_PATTERNS.
    """
    want = papers.select("seq", F.lower(F.substring("title", 1, head)).alias("part")).where("length(part) >= 1")
    low = records.where("title is not null").groupBy(F.lower("title").alias("t")).agg(F.min("rec_id").alias("rec_id"))
    sizes = want.where(F.length("part") >= short).select(F.length("part").alias("size")).distinct()
    pieces = low.crossJoin(F.broadcast(sizes)).where("length(t) >= size").select("rec_id", F.explode(F.array_distinct(F.expr("transform(sequence(1, length(t) - size + 1), i -> substring(t, i, size))"))).alias("part"))
    pieces = pieces.groupBy("part").agg(F.min("rec_id").alias("rec_id"))
    parts = want.where(F.length("part") < short).select("part").distinct()
    n = parts.count()
    if n > MOST_PATTERNS:
        raise ValueError(f"{n} short titles are too many to hold every title against")
    packed = parts.agg(F.collect_list("part").alias("_all"))
    brief = low.crossJoin(F.broadcast(packed)).select("rec_id", F.explode(F.filter("_all", lambda p: F.contains(F.col("t"), p))).alias("part")).groupBy("part").agg(F.min("rec_id").alias("rec_id"))
    return want.join(pieces.unionByName(brief), "part").select("seq", "rec_id")


def classified(papers: DataFrame, records: DataFrame) -> DataFrame:
    """(seq, host, repository): each paper's host and the known repository that it is, by an equi-join on the host."""
    known = records.select(F.lower("repository").alias("repository")).distinct()
    rows = papers.where("url is not null").select("seq", host(F.col("url")).alias("host"))
    return rows.join(known, rows["host"] == known["repository"], "left").select("seq", "host", F.coalesce("repository", F.when(F.col("host").rlike("^(dspace|repositorio)"), F.lit("unknown repository"))).alias("repository"))


def prefix_conflicts(records: DataFrame) -> DataFrame:
    """(prefix, repositories): handle prefixes that more than one repository uses."""
    rows = records.select(F.substring_index("handle", "/", 1).alias("prefix"), "repository").where("prefix <> ''").distinct()
    return rows.groupBy("prefix").agg(F.count("*").alias("repositories")).where("repositories > 1")


def full_text_locations(papers: DataFrame, unpaywall: DataFrame, semantic: DataFrame, core: DataFrame) -> DataFrame:
    """(seq, location, step, steps): where the full text of a record with a DOI lies: the first source that knows it, else the DOI's landing page.

    The tables are (key, pdf_url) by bare DOI. ``steps`` lists what was asked, in order. Records without a DOI have their own link, if any.
    """
    rows = papers.select("seq", "pdf_url", text.bare_doi(F.col("doi")).alias("_doi"))
    for name, frame in (("u", unpaywall), ("s", semantic), ("c", core)):
        rows = rows.join(frame.select(F.col("key").alias(f"{name}_key"), F.nullif(F.col("pdf_url"), F.lit("")).alias(f"{name}_url")), F.col("_doi") == F.col(f"{name}_key"), "left")
    has = ~text.missing(F.col("_doi"))
    own = F.when(F.col("pdf_url").rlike("(?i)^https?://"), F.col("pdf_url"))
    chain = [("unpaywall", F.col("u_url")), ("semantic", F.col("s_url")), ("core", F.col("c_url")), ("doi", F.concat(F.lit("https://doi.org/"), F.col("_doi")))]
    location = F.when(has, F.coalesce(*(c for _, c in chain))).otherwise(own)
    step = F.when(has, F.coalesce(*(F.when(c.isNotNull(), F.lit(n)) for n, c in chain))).when(own.isNotNull(), "own").otherwise("none")
    names = F.array(*(F.lit(n) for n, _ in chain))
    return rows.select("seq", location.alias("location"), step.alias("step"), F.when(has, F.array_join(F.slice(names, F.lit(1), F.array_position(names, step).cast("int")), ">")).otherwise(F.lit("")).alias("steps"))


def file_stages(records: DataFrame) -> DataFrame:
    """(seq, stage, url): the licensed stages by which a record's bytes may be had, and the first that has a link: open-access copies, the index, PubMed Central, the DOI, the repository.

    Only the order is decided here; nothing is fetched, and mirrors without a licence are no stage.
    """
    pmc = text.pmc_id(F.concat_ws(" ", "url", "pdf_url", "handle_url"))
    doi = text.bare_doi(F.col("doi"))
    chain = [("direct", F.when(F.lower("pdf_url").rlike(r"\.pdf(?:[?#]|$)"), F.col("pdf_url"))), ("pmc", text.pmc_url(pmc)), ("doi", F.when(~text.missing(doi), F.concat(F.lit("https://doi.org/"), doi))), ("repository", F.when(F.col("handle_url").contains("/handle/"), F.col("handle_url"))), ("page", F.when(F.col("url").rlike("(?i)^https?://"), F.col("url")))]
    return records.select("seq", F.coalesce(*(F.when(c.isNotNull(), F.lit(n)) for n, c in chain), F.lit("none")).alias("stage"), F.coalesce(*(c for _, c in chain)).alias("url"))


def route_of(links: DataFrame, column: str) -> DataFrame:
    """(kind, n): how links of each kind would be resolved."""
    return links.where(F.col(column).isNotNull()).groupBy(F.coalesce(link_kind(F.col(column)), F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"))


def resolution_error(source: Column, kind: Column, tried: Column) -> Column:
    """What to tell when nothing was found: the source, what was tried and advice by its kind, a line each."""
    advice = F.when(kind == "local", "The path cannot be reached from here; give a link or a DOI.").when(kind == "doi", "The publisher may not offer an open copy; try the repository of the authors.").otherwise("Check the link, or give the DOI of the work.")
    return F.concat_ws("\n", F.concat(F.lit("No full text found for: "), source), F.when(F.size(tried) > 0, F.concat(F.lit("Tried: "), F.array_join(tried, ", "))), advice)


def converted(documents: DataFrame, key: str) -> DataFrame:
    """(key, content, engine): the first of what the cloud, the local converter and the plain reader gave; without any it is an error."""
    value = lambda c: F.nullif(F.col(c), F.lit(""))
    engine = F.when(value("cloud").isNotNull(), "cloud").when(value("local").isNotNull(), "local").when(value("plain").isNotNull(), "text").otherwise("error")
    return documents.select(key, F.coalesce(value("cloud"), value("local"), value("plain")).alias("content"), engine.alias("engine"))
