"""Payloads of bibliographic sources to one record shape, by declared schemas.

Each parser takes a column of raw text and gives ``FIELDS``. Garbage around a payload is cut off first; what cannot
be read gives nulls or no rows, never an error. Elements that are objects in one payload and lists in another are read as text
first and then by either schema.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.scores import NO_AUTHOR

FIELDS = ("id", "title", "authors", "year", "doi", "abstract", "pdf_url", "university", "type", "citation_count", "url", "snippet")
NO_TITLE = "Sin título"


def outer_json(raw: Column) -> Column:
    """From the first opening to the last closing bracket."""
    return F.nullif(F.regexp_extract(raw, r"(?s)([{\[].*[}\]])", 1), F.lit(""))


def _rows(frame: DataFrame, raw: str, schema: str, path: str) -> DataFrame:
    parsed = frame.select(F.from_json(outer_json(F.col(raw)), schema).alias("p"))
    return parsed.select(F.posexplode_outer(F.col(f"p.{path}") if path else F.col("p")).alias("pos", "x")).where("x is not null")


def _record(rows: DataFrame, **columns: Column) -> DataFrame:
    """The record shape; authors default to a placeholder, empty strings of what may be missing to null."""
    kinds = {"year": "int", "authors": "array<string>", "citation_count": "long"}
    out = {c: columns.get(c, F.lit(None)).cast(kinds.get(c, "string")) for c in FIELDS}
    for c in ("doi", "pdf_url", "university", "url", "snippet"):
        out[c] = F.nullif(out[c], F.lit(""))
    return rows.select(*(out[c].alias(c) for c in FIELDS))


def _or(column: Column, default: str | Column) -> Column:
    """JavaScript's or: null and the empty string give way."""
    return F.coalesce(F.nullif(column, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def _names(names: Column, default: str = NO_AUTHOR) -> Column:
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(default)))


def _year(column: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(column, F.lit("")), r"(\d{4})", 1), F.lit("")).cast("int")


def _first(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def _is(key: str):
    return lambda pair: pair["key"] == key


def _one_or_many(raw: Column, schema: str) -> Column:
    """An array of ``schema`` from text that holds one object or a list of them."""
    return F.when(F.trim(raw).startswith("["), F.from_json(raw, f"array<{schema}>")).when(F.trim(raw).startswith("{"), F.array(F.from_json(raw, schema)))


def _id(prefix: str, own: Column, url: Column | None = None, title: Column | None = None) -> Column:
    """The source's id behind its prefix, or one made of link and title."""
    made = text.record_id(url if url is not None else F.lit(""), title if title is not None else F.lit(""))
    return F.concat(F.lit(prefix), F.coalesce(F.nullif(own, F.lit("")), made))


def _crossref(frame: DataFrame, raw: str, prefix: str, publisher: str, abstract: bool) -> DataFrame:
    schema = (
        "message struct<items: array<struct<DOI: string, title: array<string>, author: array<struct<given: string, family: string>>, published: struct<`date-parts`: array<array<int>>>,"
        " abstract: string, link: array<struct<URL: string>>, type: string, publisher: string, `is-referenced-by-count`: long>>>"
    )
    x = F.col("x")
    title = _or(_first(x["title"]), NO_TITLE)
    names = F.transform(x["author"], lambda a: F.trim(F.concat(F.coalesce(a["given"], F.lit("")), F.lit(" "), F.coalesce(a["family"], F.lit("")))))
    link = F.when(x["DOI"].isNotNull(), F.concat(F.lit("https://doi.org/"), x["DOI"]))
    return _record(
        _rows(frame, raw, schema, "message.items"), id=_id(prefix, F.regexp_replace(x["DOI"], "[^a-zA-Z0-9]", "_"), None, F.coalesce(_first(x["title"]), F.lit(""))), title=title, authors=F.coalesce(names, F.array(F.lit(NO_AUTHOR))),
        year=F.nullif(_first(_first(x["published"]["date-parts"])), F.lit(0)), doi=x["DOI"], abstract=text.stripped_abstract(F.coalesce(x["abstract"], F.lit("")), None) if abstract else F.lit(""),
        pdf_url=F.coalesce(_first(x["link"])["URL"], link) if abstract else link, university=_or(x["publisher"], publisher), type=_or(x["type"], "work" if abstract else "article"), citation_count=F.nullif(x["is-referenced-by-count"], F.lit(0)),
    )


def crossref(frame: DataFrame, raw: str = "raw") -> DataFrame:
    return _crossref(frame, raw, "crossref_", "Crossref Registry", True)


def scielo(frame: DataFrame, raw: str = "raw") -> DataFrame:
    """The same notation, for one publisher's DOI prefix; abstracts are not taken."""
    return _crossref(frame, raw, "scielo_", "SciELO", False)


def openalex(frame: DataFrame, raw: str = "raw") -> DataFrame:
    schema = (
        "results array<struct<id: string, title: string, doi: string, publication_year: int, authorships: array<struct<author: struct<display_name: string>, institutions: array<struct<display_name: string>>>>,"
        " abstract_inverted_index: map<string, array<int>>, primary_location: struct<landing_page_url: string>, type: string, cited_by_count: long>>"
    )
    x = F.col("x")
    return _record(
        _rows(frame, raw, schema, "results"), id=x["id"], title=_or(x["title"], NO_TITLE), authors=F.transform(x["authorships"], lambda a: a["author"]["display_name"]), year=F.nullif(x["publication_year"], F.lit(0)),
        doi=F.regexp_replace(x["doi"], r"^https://doi\.org/", ""), abstract=F.when(F.size(x["abstract_inverted_index"]) > 0, text.inverted_text(x["abstract_inverted_index"])), pdf_url=_or(x["doi"], x["primary_location"]["landing_page_url"]),
        university=_first(_first(x["authorships"])["institutions"])["display_name"], type=x["type"], citation_count=F.nullif(x["cited_by_count"], F.lit(0)),
    )


def via(records: DataFrame, source: str, other: str) -> DataFrame:
    """Records that another source stands in for, labelled by both."""
    return records.withColumn("source", F.lit(f"{source} (via {other})"))


def semantic(frame: DataFrame, raw: str = "raw") -> DataFrame:
    schema = "data array<struct<paperId: string, title: string, authors: array<struct<name: string>>, year: int, abstract: string, externalIds: struct<DOI: string>, openAccessPdf: struct<url: string>, url: string, venue: string, citationCount: long>>"
    x = F.col("x")
    return _record(
        _rows(frame, raw, schema, "data"), id=x["paperId"], title=_or(x["title"], NO_TITLE), authors=F.transform(x["authors"], lambda a: a["name"]), year=x["year"], doi=x["externalIds"]["DOI"], abstract=x["abstract"],
        pdf_url=_or(x["openAccessPdf"]["url"], x["url"]), university=x["venue"], citation_count=F.nullif(x["citationCount"], F.lit(0)),
    )


def scopus(frame: DataFrame, raw: str = "raw") -> DataFrame:
    """A count of zero stays zero here."""
    schema = "`search-results` struct<entry: array<struct<`dc:identifier`: string, `dc:title`: string, `dc:creator`: string, `prism:coverDate`: string, `dc:description`: string, `prism:doi`: string, affilname: string, `citedby-count`: string>>>"
    x = F.col("x")
    return _record(
        _rows(frame, raw, schema, "`search-results`.entry"), id=F.coalesce(F.concat(F.lit("scopus:"), x["dc:identifier"]), text.record_id(F.lit(""), F.coalesce(x["dc:title"], F.lit("")))), title=_or(x["dc:title"], NO_TITLE),
        authors=F.array(_or(x["dc:creator"], "Scopus Author")), year=_year(x["prism:coverDate"]), doi=x["prism:doi"], abstract=F.coalesce(x["dc:description"], F.lit("")), pdf_url=F.concat(F.lit("https://doi.org/"), F.nullif(x["prism:doi"], F.lit(""))),
        university=x["affilname"], type=F.lit("Article"), citation_count=x["citedby-count"].try_cast("long"),
    )


def zenodo(frame: DataFrame, raw: str = "raw") -> DataFrame:
    schema = (
        "hits struct<hits: array<struct<id: string, metadata: struct<title: string, creators: array<struct<name: string, affiliation: string>>, publication_date: string, description: string, doi: string, resource_type: struct<type: string>>,"
        " links: struct<self_html: string>, files: array<struct<links: struct<self: string>>>>>>"
    )
    x, m = F.col("x"), F.col("x.metadata")
    return _record(
        _rows(frame, raw, schema, "hits.hits"), id=F.concat(F.lit("zenodo_"), x["id"]), title=_or(m["title"], NO_TITLE), authors=F.coalesce(F.transform(m["creators"], lambda a: a["name"]), F.array(F.lit(NO_AUTHOR))),
        year=F.substring(m["publication_date"], 1, 4).try_cast("int"), doi=m["doi"], abstract=F.nullif(m["description"], F.lit("")), pdf_url=_or(x["links"]["self_html"], _first(x["files"])["links"]["self"]),
        university=_or(_first(m["creators"])["affiliation"], "CERN Open Repository"), type=_or(m["resource_type"]["type"], "publication"),
    )


def openaire(frame: DataFrame, raw: str = "raw") -> DataFrame:
    """Text nodes of XML in JSON: title, creator and pid may be one object or a list."""
    result = "struct<title: string, creator: string, pid: string, dateofacceptance: struct<`$`: string>, description: struct<`$`: string>, webresource: struct<url: string>, resulttype: struct<`@classname`: string>, collectedfrom: struct<`@name`: string>>"
    schema = f"response struct<results: struct<result: array<struct<header: struct<`dri:objIdentifier`: struct<`$`: string>>, metadata: struct<`oaf:entity`: struct<`oaf:result`: {result}>>>>>>"
    m = F.col("x.metadata")["oaf:entity"]["oaf:result"]
    node = "struct<`$`: string, `@classid`: string>"
    plain = F.when(~F.trim(m["title"]).rlike(r"^[\[{]"), m["title"])
    title = F.coalesce(_first(_one_or_many(m["title"], node))["$"], plain, F.lit(NO_TITLE))
    names = F.transform(_one_or_many(m["creator"], node), lambda c: F.coalesce(c["$"], F.lit("Unknown")))
    pids = F.filter(_one_or_many(m["pid"], node), lambda p: p["@classid"] == "doi")
    own = F.regexp_replace(F.col("x.header")["dri:objIdentifier"]["$"], "[^a-zA-Z0-9]", "_")
    return _record(
        _rows(frame, raw, schema, "response.results.result"), id=_id("openaire_", own, None, title), title=title, authors=_names(names), year=F.substring(m["dateofacceptance"]["$"], 1, 4).try_cast("int"), doi=_first(pids)["$"],
        abstract=text.stripped_abstract(F.coalesce(m["description"]["$"], F.lit("")), None), pdf_url=m["webresource"]["url"], university=_or(m["collectedfrom"]["@name"], "OpenAIRE"), type=_or(m["resulttype"]["@classname"], "publication"),
    )


def doaj(frame: DataFrame, raw: str = "raw") -> DataFrame:
    schema = "results array<struct<id: string, bibjson: struct<title: string, author: array<struct<name: string>>, year: string, abstract: string, identifier: array<struct<type: string, id: string>>, link: array<struct<type: string, content_type: string, url: string>>, journal: struct<publisher: string>>>>"
    b = F.col("x.bibjson")
    doi = _first(F.filter(b["identifier"], lambda i: i["type"] == "doi"))["id"]
    link = _first(F.filter(b["link"], lambda k: (k["content_type"] == "text/html") | (k["type"] == "fulltext")))["url"]
    return _record(
        _rows(frame, raw, schema, "results"), id=_id("doaj_", F.col("x.id"), None, F.coalesce(b["title"], F.lit(""))), title=_or(b["title"], NO_TITLE), authors=F.coalesce(F.transform(b["author"], lambda a: a["name"]), F.array(F.lit(NO_AUTHOR))),
        year=b["year"].try_cast("int"), doi=doi, abstract=F.nullif(text.stripped_abstract(b["abstract"], None), F.lit("")), pdf_url=link, university=_or(b["journal"]["publisher"], "Open Access Journal"), type=F.lit("article"),
    )


def core(frame: DataFrame, raw: str = "raw") -> DataFrame:
    """Authors are objects with a name or plain strings."""
    schema = "results array<struct<id: string, title: string, authors: array<string>, yearPublished: int, abstract: string, downloadUrl: string, sourceFulltextUrls: array<string>, publisher: string, dataProvider: struct<name: string>, doi: string>>"
    x = F.col("x")
    names = F.transform(x["authors"], lambda a: F.when(F.trim(a).startswith("{"), F.get_json_object(a, "$.name")).otherwise(a))
    return _record(
        _rows(frame, raw, schema, "results"), id=_id("core_", x["id"], None, F.coalesce(x["title"], F.lit(""))), title=_or(x["title"], NO_TITLE), authors=F.coalesce(names, F.array(F.lit(NO_AUTHOR))), year=F.nullif(x["yearPublished"], F.lit(0)), doi=x["doi"],
        abstract=F.nullif(text.stripped_abstract(x["abstract"], None), F.lit("")), pdf_url=_or(x["downloadUrl"], _first(x["sourceFulltextUrls"])), university=_or(x["publisher"], _or(x["dataProvider"]["name"], "CORE Aggregator")), type=F.lit("work"),
    )


def redalyc(frame: DataFrame, raw: str = "raw") -> DataFrame:
    """Authors are one text with semicolons. A page of HTML instead of a payload gives no rows."""
    schema = "documentos array<struct<id: string, titulo: string, autores: string, anio: string, resumen: string, urlPdf: string, url: string, revista: string, institucion: string, doi: string>>"
    x = F.col("x")
    return _record(
        _rows(frame.where(~F.trim(raw).startswith("<")), raw, schema, "documentos"), id=_id("redalyc_", x["id"], None, F.coalesce(x["titulo"], F.lit(""))), title=_or(x["titulo"], NO_TITLE), authors=F.coalesce(F.transform(F.split(F.nullif(x["autores"], F.lit("")), ";"), lambda a: F.trim(a)), F.array(F.lit(NO_AUTHOR))),
        year=x["anio"].try_cast("int"), doi=x["doi"], abstract=F.nullif(text.stripped_abstract(x["resumen"], None), F.lit("")), pdf_url=_or(x["urlPdf"], x["url"]), university=_or(x["revista"], _or(x["institucion"], "Redalyc")), type=F.lit("article"),
    )


def serpapi(frame: DataFrame, raw: str = "raw") -> DataFrame:
    schema = "organic_results array<struct<title: string, link: string, snippet: string, publication_info: struct<summary: string, authors: array<struct<name: string>>>, resources: array<struct<link: string>>, inline_links: struct<cited_by: struct<total: long>>>>"
    x = F.col("x")
    info = x["publication_info"]
    return _record(
        _rows(frame, raw, schema, "organic_results"), id=F.concat(F.lit("serpapi_"), text.record_id(F.coalesce(x["link"], F.lit("")), F.coalesce(x["title"], F.lit("")))), title=_or(x["title"], NO_TITLE),
        authors=F.coalesce(F.transform(info["authors"], lambda a: a["name"]), F.array(F.lit("Google Scholar"))), year=_year(info["summary"]), abstract=F.nullif(x["snippet"], F.lit("")), pdf_url=_or(_first(x["resources"])["link"], x["link"]),
        university=F.get(F.split(info["summary"], " - "), F.lit(1)), type=F.lit("Paper"), citation_count=F.nullif(x["inline_links"]["cited_by"]["total"], F.lit(0)),
    )


def dblp(frame: DataFrame, raw: str = "raw") -> DataFrame:
    """A single author may come as an object instead of a list."""
    schema = "result struct<hits: struct<hit: array<struct<info: struct<title: string, authors: struct<author: string>, year: string, venue: string, doi: string, ee: string, url: string, type: string, key: string>>>>>"
    x = F.col("x.info")
    names = F.transform(_one_or_many(x["authors"]["author"], "struct<text: string>"), lambda a: a["text"])
    return _record(_rows(frame, raw, schema, "result.hits.hit"), id=x["key"], title=F.regexp_replace(_or(x["title"], "Untitled"), r"\.$", ""), authors=F.coalesce(names, F.array().cast("array<string>")), year=x["year"].try_cast("int"), doi=x["doi"], url=_or(x["ee"], x["url"]), type=x["type"], snippet=x["venue"])


def paperswithcode(frame: DataFrame, raw: str = "raw") -> DataFrame:
    """The snippet joins what is there of conference and arXiv number."""
    schema = "results array<struct<id: string, title: string, abstract: string, url_abs: string, url_pdf: string, arxiv_id: string, authors: array<string>, published: string, conference: string>>"
    x = F.col("x")
    part = lambda label, c: F.concat(F.lit(label), F.nullif(c, F.lit("")))
    return _record(
        _rows(frame, raw, schema, "results"), id=F.concat(F.lit("pwc_"), _or(x["id"], F.col("pos").cast("string"))), title=_or(x["title"], "Untitled"), authors=F.coalesce(x["authors"], F.array().cast("array<string>")), year=_year(x["published"]),
        abstract=F.coalesce(x["abstract"], F.lit("")), pdf_url=x["url_pdf"], url=_or(x["url_abs"], F.concat(F.lit("https://paperswithcode.com/paper/"), F.nullif(x["id"], F.lit("")))), snippet=F.concat_ws(" | ", part("Conference: ", x["conference"]), part("arXiv: ", x["arxiv_id"])),
    )


def daily_papers(frame: DataFrame, raw: str = "raw") -> DataFrame:
    """A list of items; most of each record stands in its ``paper``."""
    schema = "array<struct<title: string, publishedAt: string, paper: struct<id: string, title: string, authors: array<struct<name: string, user: string>>, summary: string, publishedAt: string, upvotes: int>>>"
    x, paper = F.col("x"), F.col("x.paper")
    names = F.filter(F.transform(paper["authors"], lambda a: F.coalesce(F.nullif(a["name"], F.lit("")), a["user"])), lambda n: n.isNotNull() & (n != ""))
    own = F.nullif(paper["id"], F.lit(""))
    return _record(
        _rows(frame, raw, schema, "").where("x.title is not null or x.paper is not null"), id=F.concat(F.lit("hf_"), F.coalesce(own, F.col("pos").cast("string"))), title=_or(paper["title"], _or(x["title"], "Untitled")), authors=F.coalesce(names, F.array().cast("array<string>")),
        year=_year(F.coalesce(paper["publishedAt"], x["publishedAt"])), abstract=F.coalesce(paper["summary"], F.lit("")), pdf_url=F.concat(F.lit("https://arxiv.org/pdf/"), own),
    )


def openreview(frame: DataFrame, raw: str = "raw") -> DataFrame:
    """Values stand in wrappers; the year comes from the publication, creation or true creation time, else from the venue's digits."""
    value = "struct<value: string>"
    schema = f"notes array<struct<id: string, forum: string, content: struct<title: {value}, abstract: {value}, authors: struct<value: array<string>>, keywords: struct<value: array<string>>, venue: {value}, venueid: {value}, pdf: {value}>, cdate: long, tcdate: long, pdate: long>>"
    x, c = F.col("x"), F.col("x.content")
    stamp = F.coalesce(*(F.nullif(x[k], F.lit(0)) for k in ("pdate", "cdate", "tcdate")))
    venue = _or(c["venue"]["value"], F.coalesce(c["venueid"]["value"], F.lit("")))
    pdf = c["pdf"]["value"]
    words = F.array_join(F.slice(c["keywords"]["value"], 1, 5), ", ")
    return _record(
        _rows(frame, raw, schema, "notes"), id=F.concat(F.lit("openreview_"), _or(x["id"], F.col("pos").cast("string"))), title=_or(c["title"]["value"], "Untitled"), authors=F.coalesce(c["authors"]["value"], F.array().cast("array<string>")),
        year=F.coalesce(F.year(F.timestamp_millis(stamp)), _year(venue)), abstract=F.coalesce(c["abstract"]["value"], F.lit("")), pdf_url=F.when(pdf.startswith("http"), pdf).otherwise(F.concat(F.lit("https://api2.openreview.net"), pdf)),
        url=F.concat(F.lit("https://openreview.net/forum?id="), x["forum"]), snippet=F.concat_ws(" | ", F.concat(F.lit("Venue: "), F.nullif(venue, F.lit(""))), F.concat(F.lit("Keywords: "), F.nullif(words, F.lit("")))),
    )


def dspace(frame: DataFrame, raw: str = "raw") -> DataFrame:
    """Metadata as an array of keys and values; only the first author is kept."""
    schema = "items array<struct<uuid: string, name: string, link: string, metadata: array<struct<key: string, value: string>>>>"
    x = F.col("x")
    first = lambda *keys: F.coalesce(*(_first(F.filter(x["metadata"], _is(k)))["value"] for k in keys))
    return _record(
        _rows(frame, raw, schema, "items"), id=x["uuid"], title=_or(first("dc.title"), _or(x["name"], NO_TITLE)), authors=F.array(_or(first("dc.contributor.author", "dc.creator"), NO_AUTHOR)), year=_year(first("dc.date.issued")),
        doi=first("dc.identifier.doi"), abstract=F.coalesce(first("dc.description.abstract"), F.lit("")), pdf_url=_or(first("dc.identifier.uri"), x["link"]), university=first("dc.publisher"), type=_or(first("dc.type"), "Tesis"),
    )


def dspace7(frame: DataFrame, raw: str = "raw", university: str | None = None) -> DataFrame:
    """One item whose metadata maps a key to a list of values; contributors come before creators."""
    item = F.from_json(outer_json(F.col(raw)), "uuid string, name string, metadata map<string, array<struct<value: string>>>")
    rows = frame.select(item.alias("x")).where("x is not null and (x.uuid is not null or x.name is not null or x.metadata is not null)")
    x = F.col("x")
    values = lambda key: F.coalesce(F.transform(F.try_element_at(x["metadata"], F.lit(key)), lambda m: m["value"]), F.array().cast("array<string>"))
    return _record(
        rows, id=x["uuid"], title=_or(x["name"], _first(values("dc.title"))), authors=F.concat(values("dc.contributor.author"), values("dc.creator")), year=_year(F.coalesce(_first(values("dc.date.issued")), _first(values("citation_date")))),
        abstract=_or(_first(values("dc.description.abstract")), _first(values("dc.description"))), university=F.coalesce(_first(values("dc.publisher")), F.lit(university).cast("string")),
    )


def solr(frame: DataFrame, raw: str = "raw", university: str | None = None) -> DataFrame:
    schema = "response struct<docs: array<struct<id: string, title: string, author: string, date: string, description: string, url: string, institution: string>>>"
    x = F.col("x")
    return _record(
        _rows(frame, raw, schema, "response.docs"), id=_id("", x["id"], None, F.coalesce(x["title"], F.lit(""))), title=_or(x["title"], NO_TITLE), authors=F.array(_or(x["author"], NO_AUTHOR)), year=F.substring(x["date"], 1, 4).try_cast("int"),
        abstract=F.coalesce(x["description"], F.lit("")), pdf_url=x["url"], university=F.lit(university).cast("string") if university else x["institution"], type=F.lit("Tesis"),
    )


def vufind(frame: DataFrame, raw: str = "raw", university: str = "Latinoamérica", country: str | None = None) -> DataFrame:
    """Authors are the keys of a map, a list of strings or a list of objects; links are strings or objects. ``country`` keeps that country's records."""
    schema = "records array<struct<id: string, title: string, authors: string, publicationDates: array<string>, summary: array<string>, urls: array<string>, formats: array<string>, institutions: array<string>, country: string, doi: string>>"
    x = F.col("x")
    primary = F.map_keys(F.from_json(F.get_json_object(x["authors"], "$.primary"), "map<string, string>"))
    listed = F.from_json(x["authors"], "array<string>")
    listed = F.filter(F.transform(listed, lambda a: F.when(F.trim(a).startswith("{"), F.get_json_object(a, "$.name")).otherwise(a)), lambda a: a.isNotNull() & (a != ""))
    names = F.coalesce(primary, F.when(F.trim(x["authors"]).startswith("["), listed))
    link = _first(x["urls"])
    link = F.when(F.trim(link).startswith("{"), F.get_json_object(link, "$.url")).otherwise(link)
    rows = _rows(frame, raw, schema, "records")
    if country:
        rows = rows.where(F.upper("x.country") == country.upper())
    return _record(
        rows, id=_id("", x["id"], F.coalesce(link, F.lit("")), F.coalesce(x["title"], F.lit(""))), title=_or(x["title"], "Sin titulo"), authors=_names(names), year=_year(_first(x["publicationDates"])), doi=x["doi"], abstract=F.coalesce(_first(x["summary"]), F.lit("")),
        pdf_url=link, university=F.coalesce(_first(x["institutions"]), x["country"], F.lit(university)), type=F.coalesce(_first(x["formats"]), F.lit("Tesis")),
    )


def pubmed(frame: DataFrame, raw: str = "raw", ids: str | None = None) -> DataFrame:
    """Summaries by id. With ``ids``, a column of the id list's payload, they come in its order and unlisted ones are left out.

    The DOI is the article id of that type, else what the location says.
    """
    schema = "result map<string, struct<title: string, authors: array<struct<name: string>>, pubdate: string, elocationid: string, fulljournalname: string, articleids: array<struct<idtype: string, value: string>>>>"
    summaries = F.from_json(F.regexp_replace(outer_json(F.col(raw)), r'"uids"\s*:\s*\[[^\]]*\]\s*,?', ""), schema)["result"]
    if ids:
        listed = F.from_json(outer_json(F.col(ids)), "esearchresult struct<idlist: array<string>>")["esearchresult"]["idlist"]
        rows = frame.select(summaries.alias("s"), F.posexplode(listed).alias("pos", "id")).select("pos", "id", F.try_element_at("s", F.col("id")).alias("x")).where("x is not null")
    else:
        rows = frame.select(F.explode(summaries).alias("id", "x")).where("x is not null")
    x = F.col("x")
    of = lambda kind: _first(F.filter(x["articleids"], lambda a: a["idtype"] == kind))["value"]
    pmc = of("pmc")
    return _record(
        rows, id=F.concat(F.lit("pubmed_"), F.col("id")), title=_or(x["title"], NO_TITLE), authors=F.coalesce(F.transform(x["authors"], lambda a: a["name"]), F.array(F.lit("PubMed Author"))), year=_year(F.substring(x["pubdate"], 1, 4)),
        doi=F.coalesce(of("doi"), text.found_doi(F.coalesce(x["elocationid"], F.lit("")))), abstract=F.lit(""), pdf_url=F.when(pmc.isNotNull(), text.pmc_url(pmc)).otherwise(F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col("id"), F.lit("/"))), university=x["fulljournalname"],
    )


def arxiv(frame: DataFrame, raw: str = "raw") -> DataFrame:
    """Entries of an Atom feed; the authors' names are not read."""
    rows = frame.select(F.explode(F.regexp_extract_all(raw, F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))).alias("e"))
    tag = lambda name: text.arxiv_text(F.regexp_extract("e", rf"(?s)<{name}[^>]*>(.*?)</{name}>", 1))
    pdf = F.nullif(F.regexp_extract("e", r'<link[^>]*title="pdf"[^>]*href="([^"]*)"', 1), F.lit(""))
    return _record(rows, id=tag("id"), title=_or(tag("title"), NO_TITLE), authors=F.array(F.lit("arXiv Author")), year=_year(F.substring(tag("published"), 1, 4)), doi=F.nullif(tag("arxiv:doi"), F.lit("")), abstract=tag("summary"), pdf_url=F.coalesce(pdf, tag("id")), type=F.lit("preprint"))


PARSERS: dict[str, Callable[..., DataFrame]] = {
    "crossref": crossref, "scielo": scielo, "openalex": openalex, "semantic": semantic, "scopus": scopus, "zenodo": zenodo, "openaire": openaire, "doaj": doaj, "core": core, "redalyc": redalyc, "serpapi": serpapi,
    "dblp": dblp, "paperswithcode": paperswithcode, "huggingface": daily_papers, "openreview": openreview, "dspace": dspace, "solr": solr, "vufind": vufind, "pubmed": pubmed, "arxiv": arxiv,
}
