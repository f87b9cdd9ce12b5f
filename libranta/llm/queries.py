"""The pN_ queries: each runs its operator with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..tables import table
from . import cuts, garbles, languages, leaks, looks, matches, scans, spellings, subwords, survivors

SURVIVAL = ("seq", "id", "source", "title", "authors", "year", "doi", "abstract", "university", "pdf_url", "fetched_at")
Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    t = table
    return {
        "p1_found": lambda s, d: matches.linked(t(s, d, "papers", "seq", "title", "authors", "year", "doi"), t(s, d, "repo_records", "rec_id", "title", "authors", "year", "doi")).select("seq", "rec_id"),
        "p1_links": lambda s, d: matches.linked(t(s, d, "papers", "seq", "title", "authors", "year", "doi"), t(s, d, "repo_records", "rec_id", "title", "authors", "year", "doi")),
        "p2_found": lambda s, d: cuts.cut_values(t(s, d, "papers", "seq", "source", "abstract", "snippet")),
        "p2_report": lambda s, d: cuts.cut_report(t(s, d, "papers", "seq", "source", "abstract", "snippet")),
        "p3_found": lambda s, d: garbles.garbled_values(t(s, d, "scraped_pages", "page_id", "title", "abstract", "authors")),
        "p3_restored": lambda s, d: garbles.mended(t(s, d, "scraped_pages", "page_id", "title", "abstract", "authors")).where("garbled"),
        "p4_found": lambda s, d: survivors.survivors(t(s, d, "papers", *SURVIVAL)),
        "p4_merged": lambda s, d: survivors.merged(t(s, d, "papers", *SURVIVAL)),
        "p5_found": lambda s, d: spellings.linked(t(s, d, "papers", "authors", "university")),
        "p6_found": lambda s, d: scans.noises(t(s, d, "pdf_texts", "file_id", "text"), t(s, d, "markdown_results", "md_id", "markdown")),
        "p6_repaired": lambda s, d: scans.repaired(t(s, d, "pdf_texts", "file_id", "text"), t(s, d, "markdown_results", "md_id", "markdown")),
        "p7_found": lambda s, d: languages.found(t(s, d, "papers", "seq", "title", "abstract", "metadata")),
        "p7_labels": lambda s, d: languages.relabelled(t(s, d, "papers", "seq", "title", "abstract", "metadata")).select("seq", "label", "main", "title_lang", "title_conf", "langs", "affected"),
        "p8_ids": lambda s, d: subwords.encoded(t(s, d, "documents", "doc_id", "text")),
        "p8_round_trip": lambda s, d: subwords.decoded(subwords.encoded(t(s, d, "documents", "doc_id", "text"))),
        "p9_found": lambda s, d: leaks.leaked(t(s, d, "documents", "doc_id", "text"), t(s, d, "eval_items", "item_id", "text")).select("item_id", "doc_id"),
        "p9_passages": lambda s, d: leaks.passages(t(s, d, "documents", "doc_id", "text"), t(s, d, "eval_items", "item_id", "text")),
        "p9_clean": lambda s, d: leaks.without_leaks(t(s, d, "documents"), t(s, d, "eval_items", "item_id", "text")).select("doc_id", "source", "n_chars"),
        "p10_found": lambda s, d: looks.look_alikes(t(s, d, "documents", "doc_id", "text")),
        "p10_texts": lambda s, d: looks.normalised(t(s, d, "documents", "doc_id", "text")),
    }


def oracle_sql() -> dict[str, str]:
    return {"p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
