"""Queries of enrichment, pages, documents and small operators over derived inputs, each with its SQL in ``works_sql``.

The tables have no raw HTML, no second sources and no files, so inputs are written from what there is: synthetic derivations,
the same in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import docs, enrich, pages, search
from ..sources import parsers
from ..streaming import state
from ..tables import table as t
from ..tables import utc

Query = Callable[[SparkSession, str], DataFrame]


def _like(pattern: str):
    return lambda x: x.rlike(pattern)


def by_doi(s: SparkSession, d: str, columns: str, test: str) -> DataFrame:
    """(key, columns): for each bare DOI the first paper for which ``test`` holds."""
    rows = t(s, d, "papers").where(test)
    return enrich.first_by(rows, text.bare_doi(F.col("doi")), "seq", *columns.split(","))


def shells(s: SparkSession, d: str) -> DataFrame:
    """(page_id, html): pages of which some are shells of applications and some checks for robots."""
    head = "case page_id % 5 when 0 then '<ds-app></ds-app>' when 1 then '<p>Just a moment...</p>' when 2 then '<div id=\"root\"></div>' else '<p>text</p>' end"
    return t(s, d, "scraped_pages").select("page_id", F.expr(f"'<html><title>' || regexp_replace(coalesce(title, ''), '[<>]', '') || '</title>' || {head} || '</html>'").alias("html"))


TABLE = (
    "'<table><tr><th>title_full</th><td>' || regexp_replace(coalesce(title, ''), '[<>]', '') || '</td></tr><tr><th> description </th><td>' || regexp_replace(coalesce(abstract, ''), '[<>]', '') || '</td></tr><tr><th>dc.creator.none.fl_str_mv</th><td>'"
    " || coalesce(array_join(transform(authors, a -> regexp_replace(a, '[<>]', '')), '<br/>'), '') || '</td></tr><tr><th>dc.identifier.none.fl_str_mv</th><td>http://x<br>10.' || (1000 + page_id) || '/p</td></tr><tr><th>instname_str</th><td>' || regexp_replace(coalesce(university, ''), '[<>]', '')"
    " || '</td></tr><tr><th>publishDate</th><td>' || coalesce(cast(pub_year as string), '') || '</td></tr></table>' || case when pdf_url rlike '^https?://[^ <&]+$' then '<a href=\"https://h.example/thumbnail.pdf\">t</a><a href=\"' || pdf_url || '\">f</a>' else '' end"
)


def details(s: SparkSession, d: str) -> DataFrame:
    return pages.details(t(s, d, "scraped_pages").select("page_id", F.expr(TABLE).alias("html")), "page_id", "html")


BODY = (
    "'<html><title>Index</title>' || case page_id % 4 when 0 then '<meta name=\"citation_abstract\" content=\"' || A || '\">' when 1 then '<div class=\"simple-item-view-description\">Resumen: ' || A || '</div>' when 2 then '<meta content=\"Bienvenidos al repositorio institucional de la universidad de todos nosotros\" name=\"description\">"
    "<td class=\"metadataFieldLabel\">Resumen</td> <td>' || A || '</td>' else '<h1>Forbidden</h1>' || A end || repeat(' ', 500) || '</html>'"
).replace("A ", "regexp_replace(coalesce(abstract, ''), '[<>\"'']', '') ")


def links_page(s: SparkSession, d: str) -> DataFrame:
    """(page_id, url, html): pages with links to files of several kinds, or none."""
    html = "case page_id % 3 when 0 then '<a href=\"/bitstream/' || page_id || '/a.pdf\">a</a><a href=\"/bitstream/' || page_id || '/a.pdf\">b</a><a href=\"files/c.pdf?x=1\">c</a>' when 1 then '<a href=\"https://o.example/api/core/bitstreams/' || page_id || '/content\">a</a>' else '<a href=\"/about\">a</a>' end"
    return t(s, d, "scraped_pages").where("url like 'https://%'").select("page_id", "url", F.expr(html).alias("html"))


def queries() -> dict[str, Query]:
    works = lambda s, d: enrich.title_matches(t(s, d, "papers"), t(s, d, "repo_records")).join(t(s, d, "repo_records").select("rec_id", "doi", "year", F.lit(None).cast("string").alias("abstract"), "university", "authors"), "rec_id").drop("rec_id")
    found = lambda s, d: by_doi(s, d, "abstract,year", "length(abstract) > 0")
    access = lambda s, d: by_doi(s, d, "authors,abstract,pdf_url", "pdf_url like '%.pdf'")
    scraped = lambda s, d: enrich.first_by(t(s, d, "papers").where("length(abstract) > 200 and handle_url is not null"), F.col("handle_url"), "seq", "abstract", "university", "authors", "pdf_url")
    full = lambda s, d: enrich.enriched(t(s, d, "papers"), works(s, d), found(s, d), access(s, d), scraped(s, d))
    repositories = lambda s, d: t(s, d, "repo_records").where("handle like '%/%'").groupBy(F.substring_index("handle", "/", 1).alias("pattern")).agg(F.min("rec_id").alias("ord"), F.min(F.concat(F.lit("https://"), F.col("repository"))).alias("base"), F.min("repository").alias("name"))
    papers_by_query = lambda s, d, test: t(s, d, "papers").where(test).select((F.length("matched_query") % 97).cast("int").alias("query_id"), "seq")
    doc = lambda s, d: t(s, d, "documents")
    return {
        "q_analysis_sections": lambda s, d: docs.analysed_sections(doc(s, d), "doc_id", "text").withColumn("statistics", F.array_join(F.transform("statistics", lambda x: F.concat(x["family"], F.lit(":"), x["n"].cast("string"))), "|")),
        "q_analysis": lambda s, d: docs.analysis(doc(s, d), "doc_id", "text"),
        "q_extract_section": lambda s, d: docs.extracted_section(doc(s, d), "doc_id", "text", "Metodología").select("doc_id", "found", "name", "category", "content", "content_length", "available"),
        "q_enrich": lambda s, d: full(s, d).withColumn("authors", F.array_join("authors", "|")),
        "q_recovered_enrich": lambda s, d: full(s, d).where("fields <> ''").select(F.explode(F.split("fields", r"\|")).alias("field")).groupBy("field").agg(F.count("*").alias("n")),
        "q_updated": lambda s, d: enrich.updated(t(s, d, "papers").select("seq", "year", "doi", "university"), full(s, d).where("fields <> ''").select("seq", "year", "doi", "university")),
        "q_details_table": details,
        "q_details_enrich": lambda s, d: enrich.detailed(t(s, d, "papers"), details(s, d).select((F.col("page_id") - 1).alias("seq"), "title", F.split("authors", r"\|").alias("authors"), "year", "doi", "abstract", "pdf_url", "university"), most=None).withColumn("authors", F.array_join("authors", "|")),
        "q_recover": lambda s, d: enrich.recovered(t(s, d, "papers").where("doi <> ''"), by_doi(s, d, "title,authors,year,abstract,university,pdf_url", "source = 'indexa'"), found(s, d), access(s, d)),
        "q_simple_enrich": lambda s, d: enrich.simple_enriched(t(s, d, "papers"), enrich.title_matches(t(s, d, "papers"), t(s, d, "repo_records")).join(t(s, d, "repo_records").select("rec_id", "year", F.col("title").alias("abstract"), F.length("title").cast("long").alias("citation_count")), "rec_id")),
        "q_handle_rewrite": lambda s, d: enrich.handle_rewritten(t(s, d, "repo_records").where("handle is not null").select("rec_id", F.concat(F.when(F.col("rec_id") % 3 == 0, "https://other.example/handle/").otherwise("http://hdl.handle.net/"), F.col("handle")).alias("link")), "link", repositories(s, d)),
        "q_university_lookup": lambda s, d: enrich.resolved_universities(
            t(s, d, "papers"), enrich.first_by(t(s, d, "papers").where("id like '20.500.%' and university <> ''"), F.regexp_extract("id", r"(20\.500\.\d+)", 1), "seq", "university").withColumnRenamed("university", "name"),
            enrich.first_by(t(s, d, "papers").where("id like '%\\_%' and university <> ''"), F.substring_index("id", "_", 1), "seq", "university").withColumnRenamed("university", "name"),
        ),
        "q_doi_by_name": lambda s, d: enrich.dois_by_name(
            t(s, d, "papers").select("seq", text.author_year(F.concat(F.lit("/a/b/"), F.regexp_replace(F.substring_index(text.folded(F.try_element_at("authors", F.lit(1))), " ", -1), "[^a-z]", ""), F.lit("_"), F.col("year").cast("string"), F.lit(".pdf"))).alias("x")).where("x is not null").select("seq", "x.author", "x.year"),
            t(s, d, "repo_records").where("doi <> ''").select(F.col("rec_id").alias("ord"), "year", F.transform("authors", text.folded).alias("authors"), "doi"), 50,
        ),
        "q_full_text": lambda s, d: enrich.full_text_locations(t(s, d, "papers"), by_doi(s, d, "pdf_url", "pdf_url like '%fulltext%'"), by_doi(s, d, "pdf_url", "pdf_url like '%.pdf'"), by_doi(s, d, "pdf_url", "pdf_url <> ''")),
        "q_file_stages": lambda s, d: enrich.file_stages(t(s, d, "papers").withColumn("url", F.when(F.col("seq") % 7 == 0, F.concat(F.lit("https://x.example/PMC"), F.col("seq"))).otherwise(F.col("url")))),
        "q_route_kinds": lambda s, d: enrich.route_of(t(s, d, "papers").select(F.explode(F.array(F.col("pdf_url"), F.col("url"), F.col("handle_url"), F.col("doi"), F.concat(F.lit("/tmp/"), F.col("id")))).alias("link")), "link"),
        "q_resolution_error": lambda s, d: t(s, d, "papers").where("doi <> ''").select("seq", enrich.resolution_error(F.col("doi"), pages.link_kind(text.bare_doi(F.col("doi"))), F.split("source", "a")).alias("message")),
        "q_convert_chain": lambda s, d: enrich.converted(t(s, d, "pdf_texts").join(t(s, d, "markdown_results").groupBy("file_id").agg(F.min("markdown").alias("local")), "file_id", "left").select("file_id", F.lit("").alias("cloud"), "local", F.col("text").alias("plain")), "file_id"),
        "q_fallback": lambda s, d: enrich.with_fallback(papers_by_query(s, d, "source = 'alixia'"), papers_by_query(s, d, "source = 'renata'"), papers_by_query(s, d, "source = 'indexa'"), s.range(97).select(F.col("id").cast("int").alias("query_id")), "Main", ("openalex", "scielo")),
        "q_merged_fallback": lambda s, d: enrich.merged_fallback(papers_by_query(s, d, "source = 'renata'").withColumn("id", F.col("seq") % 50).drop("seq"), papers_by_query(s, d, "source = 'alixia'").withColumn("id", F.col("seq") % 50).drop("seq")),
        "q_via": lambda s, d: parsers.via(t(s, d, "papers").select("seq"), "Redalyc", "OpenAlex"),
        "q_page_abstract": lambda s, d: t(s, d, "scraped_pages").select("page_id", pages.page_abstract(F.expr(BODY)).alias("abstract")),
        "q_record_page": lambda s, d: pages.record_page(t(s, d, "scraped_pages").select("page_id", F.expr("'<title>' || regexp_replace(coalesce(title, ''), '[<>|]', '') || '</title><h3>Descripción del Artículo</h3> <p>' || replace(regexp_replace(coalesce(abstract, ''), '[<>]', ''), '&#', '#') || '</p></div><a href=\"https://hdl.handle.net/1/' || page_id || '\">h</a><a href=\"/bitstream/' || page_id || '/x.pdf\">f</a>'").alias("html")), "page_id", "html").select("page_id", "abstract", "handle", "pdf_url"),
        "q_bitstreams": lambda s, d: links_page(s, d).select("page_id", F.array_join(pages.bitstreams(F.col("html"), F.col("url")), " ").alias("links")),
        "q_best_file": lambda s, d: t(s, d, "papers").where("pdf_url <> ''").groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "pdf_url", "citation_count"))), lambda x: F.struct(F.concat(F.substring_index(x["pdf_url"], "/", -1), F.lit(".pdf")).alias("name"), (F.coalesce(x["citation_count"], F.lit(0)) * 20000).alias("octets"), x["pdf_url"].alias("url"))).alias("files")).select("source", pages.best_bitstream(F.array(F.struct(F.lit("LICENSE").alias("name"), F.col("files")), F.struct(F.lit("ORIGINAL").alias("name"), F.col("files"))), scores.file_score).alias("best")),
        "q_shell_pages": lambda s, d: shells(s, d).where(pages.is_shell(F.col("html"))).select("page_id"),
        "q_preferred_link": lambda s, d: t(s, d, "papers").select("seq", pages.preferred_link(F.filter(F.array("url", F.concat("pdf_url", F.lit(".jpg")), "handle_url", "pdf_url"), lambda x: x.isNotNull())).alias("link")),
        "q_pdf_bytes": lambda s, d: t(s, d, "pdf_texts").where("text is not null").select("file_id", pages.is_pdf(F.encode(F.concat(F.when(F.col("file_id") % 2 == 0, "%PDF-").otherwise("<html"), F.col("text")), "UTF-8"), 1500).alias("pdf")),
        "q_dspace7": lambda s, d: parsers.dspace7(t(s, d, "repo_records").select(F.to_json(F.struct(F.col("rec_id").cast("string").alias("uuid"), F.map_from_arrays(F.array(F.lit("dc.title"), F.lit("dc.contributor.author"), F.lit("dc.creator"), F.lit("dc.date.issued")), F.array(F.array(F.struct(F.col("title").alias("value"))), F.transform("authors", lambda a: F.struct(a.alias("value"))), F.array(F.struct(F.lit("Z").alias("value"))), F.array(F.struct(F.col("date_issued").alias("value"))))).alias("metadata"))).alias("raw")), "raw", "Here").select("id", "title", F.array_join("authors", "|").alias("authors"), "year", "university"),
        "q_query_variations": lambda s, d: t(s, d, "papers").select("matched_query").distinct().where("matched_query is not null").select("matched_query", F.posexplode(text.query_variations(F.col("matched_query"))).alias("pos", "variation")),
        "q_portuguese": lambda s, d: t(s, d, "papers").select("seq", text.portuguese(F.concat_ws(" ", "matched_query", F.lit("análisis de la calidad"))).alias("query")),
        "q_plain_query": lambda s, d: t(s, d, "papers").select("seq", text.plain_query(F.col("title")).alias("query")),
        "q_cache_key": lambda s, d: t(s, d, "papers").select("seq", text.cache_key("search", "year", "source").alias("cache_key")),
        "q_query_budget": lambda s, d: s.range(1, 201).select(F.col("id").alias("asked"), search.budget(F.col("id"), (F.col("id") % 6 + 1)).alias("budget")),
        "q_merged_stats": lambda s, d: search.merged_stats(t(s, d, "papers").groupBy("matched_query", "source").agg(F.count("*").alias("found"), F.sum(F.length("title")).alias("time"))),
        "q_seeded_sample": lambda s, d: search.seeded_sample(doc(s, d).select("doc_id"), "doc_id"),
        "q_low_first": lambda s, d: t(s, d, "papers").select("seq", scores.completeness().alias("score")).where("score < 70").orderBy("score", "seq").limit(50),
        "q_block_counts": lambda s, d: t(s, d, "markdown_results").where("markdown is not null").select("md_id", F.split("markdown", "\n").alias("l")).select("md_id", *(F.nullif(F.size(F.filter("l", _like(p))), F.lit(0)).alias(n) for n, p in (("headings", r"^#+\s"), ("rows", r"^\s*\|"), ("texts", r"^\p{L}")))),
        "q_cache_age": lambda s, d: state.cache_report(utc(t(s, d, "events")), "ts"),
        "q_serial_queue": lambda s, d: state.serial_queue(utc(t(s, d, "events")), "ts", "event_id"),
        "q_backoff": lambda s, d: s.range(6).select(F.col("id").alias("attempt"), search.backoff_seconds(F.col("id")).alias("seconds"), search.backoff_seconds(F.col("id"), 3, 3).alias("slow")),
        "q_ndjson": lambda s, d: state.framed(doc(s, d).where("text is not null").select("doc_id", F.posexplode(F.array(F.substring("text", 1, 50), F.expr("substring(text, 51)"), F.lit("\nlast"))).alias("n", "chunk")), "doc_id", "n", "chunk"),
        "q_formats": lambda s, d: t(s, d, "papers").where("pdf_url is not null").groupBy(search.formats(F.col("pdf_url")).alias("kind")).agg(F.count("*").alias("n")),
    }
