"""The queries of the library's own operators, over whole tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import dedup, docs, enrich, pages, search
from ..streaming import state
from ..tables import table, utc
from . import payloads, works

Query = Callable[[SparkSession, str], DataFrame]
WORDS, START, END = "gestión agua estrés", 2010, 2020
ASKED = ["gestión del agua de riego", "machine learning for social capital", "energía solar fotovoltaica y capital social", "childhood anaemia zzzz", "turismo rural comunitario"]
EXPANDED = ["iberoamerica", "España", "semantic_scholar", "peru", "mystery"]
SPECS = ["1-5", "1,3,7", "last3", "first5", "last", "0", "8-20", "x", "3,1,3"]
HEAD = (
    "'<html><head><title>' || coalesce(title, '') || ' | Repositorio</title><meta name=\"citation_title\" content=\"' || replace(replace(coalesce(title, ''), '\"', ''), '&#', '#') || '\">' || coalesce(array_join(transform(authors, a -> '<meta content=\"' || replace(replace(a, '\"', ''), '&#', '#') || '\" name=\"DC.creator\">'), ''), '')"
    " || '<meta content=\"' || coalesce(cast(pub_year as string), '') || '-03-01\" name=\"citation_date\"><meta name=\"citation_pdf_url\" content=\"' || coalesce(pdf_url, '') || '\"><meta property=\"dc.publisher\" content=\"' || replace(replace(coalesce(university, ''), '\"', ''), '&#', '#') || '\"><meta name=\"description\" content=\"' || replace(replace(coalesce(abstract, ''), '\"', ''), '&#', '#') || '\"></head></html>'"
)


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written from the scraped table: a synthetic derivation, since no raw HTML is among the tables."""
    return table(spark, sf_dir, "scraped_pages").select("page_id", F.expr(HEAD).alias("html"))


def _papers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "papers")


def inverted_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Every text as an inverted index and back; one exchange by document serves both aggregates."""
    words = F.split(F.trim(F.regexp_replace(F.translate("text", "\n\t\r", "   "), " +", " ")), " ")
    rows = table(s, d, "documents").where("text is not null").select("doc_id", F.posexplode(words).alias("p", "w")).where("w <> ''").repartition("doc_id")
    index = rows.groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return index.select("doc_id", text.inverted_text(F.col("index")).alias("round_trip"))


def queries() -> dict[str, Query]:
    t = table
    ev = lambda s, d: utc(t(s, d, "events"))
    return {
        "q_batch_search": lambda s, d: search.batch_search(_papers(s, d), WORDS, START, END),
        "q_any_term_search": lambda s, d: _papers(s, d).where(search.any_term(WORDS, "title", "abstract")).select("seq", "title"),
        "q_year_filter": lambda s, d: _papers(s, d).where(search.in_years(F.col("year"), START, END)).select("seq", "year"),
        "q_has_abstract": lambda s, d: _papers(s, d).where(F.length("abstract") > 0).groupBy("source").agg(F.count("*").alias("n")),
        "q_accent_search": lambda s, d: _papers(s, d).where(text.folded(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("university", "title", "abstract")))).contains("gestion del agua")).select("seq"),
        "q_needs_enhancement": lambda s, d: _papers(s, d).where(scores.needs_enhancement()).select("seq"),
        "q_completeness": lambda s, d: _papers(s, d).select("seq", scores.completeness().alias("score")),
        "q_quality": lambda s, d: _papers(s, d).select("seq", scores.quality().alias("score")),
        "q_low_scores": lambda s, d: _papers(s, d).select("seq", "source", scores.completeness().alias("score")).where("score < 70").groupBy("source", "score").agg(F.count("*").alias("n")),
        "q_search_dedup": lambda s, d: dedup.search_dedup(_papers(s, d)),
        "q_batch_dedup": lambda s, d: dedup.batch_dedup(_papers(s, d)),
        "q_smart_dedup": lambda s, d: dedup.smart_dedup(_papers(s, d)),
        "q_id_dedup": lambda s, d: dedup.id_dedup(_papers(s, d)),
        "q_union_by_id": lambda s, d: dedup.add_by_id(_papers(s, d).where("source = 'alixia'").select("id", "seq"), _papers(s, d).where("source = 'renata'").select("id", "seq")),
        "q_first_per_source": lambda s, d: dedup.limited(_papers(s, d).select("source", "seq"), "source", "seq", 30),
        "q_source_stats": lambda s, d: search.source_stats(_papers(s, d)),
        "q_query_report": lambda s, d: search.query_report(_papers(s, d)),
        "q_recovered_fields": lambda s, d: enrich.recovered_fields(_papers(s, d)),
        "q_type_counts": lambda s, d: s.createDataFrame([(x,) for x in ("thesis", "article", "report", "unknown")], "doc_type string").join(t(s, d, "documents").groupBy("doc_type").agg(F.count("*").alias("c")), "doc_type", "left").select("doc_type", F.coalesce("c", F.lit(0)).alias("n")),
        "q_exact_duplicates": lambda s, d: t(s, d, "documents").where("text <> ''").groupBy(F.md5("text").alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("n > 1"),
        "q_name_duplicates": lambda s, d: _papers(s, d).where("pdf_url is not null and pdf_url <> ''").groupBy(F.lower(F.regexp_replace(F.substring_index("pdf_url", "/", -1), r"^\d+_", "")).alias("name")).agg(F.count("*").alias("n")).where("n > 1"),
        "q_health_rollup": lambda s, d: search.health(ev(s, d)),
        "q_latest_status": lambda s, d: search.latest(ev(s, d), "user_id"),
        "q_rate_limit": lambda s, d: state.rate_limited(ev(s, d), "user_id", "ts", "event_id", 3_600_000_000),
        "q_circuit_breaker": lambda s, d: state.breaker(ev(s, d), "user_id", "ts", "event_id", "event_type = 'error'", 3, 86_400_000_000),
        "q_ttl_cache": lambda s, d: state.cached(ev(s, d), "user_id", "ts", "event_id", 86_400_000_000),
        "q_token_saving": lambda s, d: t(s, d, "markdown_results").join(t(s, d, "pdf_texts").select("file_id", "text"), "file_id").select("md_id", text.word_count(F.col("text")).alias("text_words"), text.word_count(F.col("markdown")).alias("md_words")).where("text_words > 0").withColumn("saved", F.floor(100 - 100 * F.col("md_words") / F.col("text_words"))),
        "q_normalize_title": lambda s, d: _papers(s, d).select("seq", text.title_key(F.col("title")).alias("title_key")),
        "q_dedup_key": lambda s, d: _papers(s, d).select("seq", dedup.batch_key().alias("dedup_key")),
        "q_boolean_query": lambda s, d: _papers(s, d).select("seq", text.boolean_query(F.col("matched_query")).alias("boolean_query")),
        "q_simplify": lambda s, d: _papers(s, d).select("seq", text.simple_query(F.col("title")).alias("short_query")),
        "q_sanitize": lambda s, d: _papers(s, d).select("seq", text.sanitised(F.concat(F.lit("Claro, la consulta: \\textbf{"), "matched_query", F.lit("} `x` (y)"))).alias("clean_query")),
        "q_record_id": lambda s, d: _papers(s, d).where("url is not null and title is not null").select("seq", text.record_id(text.folded(F.col("url")), F.regexp_replace(text.folded(F.col("title")), r"[^\x00-\x7f]", "")).alias("record_id")),
        "q_doi_extraction": lambda s, d: _papers(s, d).select("seq", text.found_doi(F.col("doi")).alias("found_doi")),
        "q_first_year": lambda s, d: t(s, d, "repo_records").select("rec_id", text.first_year(F.col("date_issued")).alias("first_year")),
        "q_clean_abstract": lambda s, d: _papers(s, d).select("seq", text.stripped_abstract(F.col("abstract")).alias("clean")),
        "q_unescape": lambda s, d: _papers(s, d).where("title is not null").select("seq", text.unescaped(F.concat(F.lit("&amp;lt;b&gt; &#233;&#xe9; "), "title", F.lit("&nbsp;&quot;x&quot;"))).alias("plain")),
        "q_word_count": lambda s, d: t(s, d, "documents").where("text is not null").select("doc_id", text.word_count(F.col("text")).alias("n_words")),
        "q_inverted_index": inverted_round_trip,
        "q_page_ranges": lambda s, d: s.createDataFrame([(x,) for x in SPECS], "spec string").select("spec", F.array_join(text.page_list(F.col("spec"), F.lit(10)), ",").alias("pages")),
        "q_smart_truncate": lambda s, d: t(s, d, "markdown_results").where("markdown is not null").select("md_id", text.cut_smartly(F.col("markdown"), 1000).alias("kept")),
        "q_tags": lambda s, d: _papers(s, d).select("seq", F.concat_ws(" | ", "source", "type", F.col("year").cast("string")).alias("tags")),
        "q_source_expand": lambda s, d: search.group_members(s),
        "q_source_alias": lambda s, d: s.createDataFrame([(i + 1, x) for i, x in enumerate(search.expanded(EXPANDED))], "pos int, source string"),
        "q_relaxation_ladder": lambda s, d: search.ladder(_papers(s, d), s.createDataFrame(list(enumerate(ASKED)), "query_id int, query string")),
        "q_title_theta_join": lambda s, d: enrich.title_matches(_papers(s, d), t(s, d, "repo_records")),
        "q_repo_classify": lambda s, d: enrich.classified(_papers(s, d), t(s, d, "repo_records")),
        "q_prefix_conflicts": lambda s, d: enrich.prefix_conflicts(t(s, d, "repo_records")),
        "q_host": lambda s, d: _papers(s, d).where("url is not null").groupBy(pages.host(F.col("url")).alias("host")).agg(F.count("*").alias("n")),
        "q_file_score": lambda s, d: _papers(s, d).where("pdf_url is not null and university is not null").select("university", "seq", scores.file_score(F.col("pdf_url"), F.coalesce("citation_count", F.lit(0)) * 20000).alias("score")).groupBy("university").agg(F.max(F.struct("score", (-F.col("seq")).alias("o"))).alias("x")).select("university", (-F.col("x.o")).alias("seq"), F.col("x.score").alias("score")),
        "q_meta_extract": lambda s, d: pages.metadata(html_pages(s, d), "page_id", "html").select("page_id", "title", "authors", "year", "pdf_url", "university", "abstract"),
        "q_challenge_pages": lambda s, d: works.shells(s, d).where(pages.is_challenge(F.col("html"))).select("page_id"),
        "q_tables": lambda s, d: t(s, d, "markdown_results").where("markdown is not null").select("md_id", F.size(pages.tables(F.col("markdown"))).alias("n_tables")),
        "q_formulas": lambda s, d: t(s, d, "markdown_results").where("markdown is not null").select("md_id", F.array_join(pages.formulas(F.concat(F.lit("$$a+b$$ x \\(c\\) $$ a+b $$ "), "markdown")), "|").alias("found")),
        "q_language_id": lambda s, d: t(s, d, "documents").where("text is not null").select("doc_id", docs.language(F.col("text")).alias("detected")),
        "q_doc_type": lambda s, d: t(s, d, "documents").where("text is not null").select("doc_id", docs.document_type(F.col("text")).alias("kind")),
        "q_sections": lambda s, d: docs.sections(t(s, d, "documents"), "doc_id", "text"),
        "q_section_totals": lambda s, d: docs.sections(t(s, d, "documents"), "doc_id", "text").groupBy("category").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("characters"), F.count_distinct("doc_id").alias("documents")),
        "q_statistics": lambda s, d: docs.statistics(t(s, d, "documents"), "doc_id", "text").withColumn("matches", F.array_join("matches", "|")),
        "q_citations": lambda s, d: docs.citations(t(s, d, "documents"), "doc_id", "text"),
        "q_summary_budget": lambda s, d: docs.summary(t(s, d, "documents"), "doc_id", "text", 4000),
        "q_preview": lambda s, d: t(s, d, "pdf_texts").where("text is not null").select("file_id", F.substring("text", 1, 500).alias("preview"), F.length("text").alias("n_chars")),
        **works.queries(),
        "q_payload_parsers": payloads.parsed,
    }


def oracle_sql() -> dict[str, str]:
    from .oracles import oracle_sql as sql

    return sql()
