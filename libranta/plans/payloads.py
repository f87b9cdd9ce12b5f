"""Payloads of every notation written from papers and read back by their parsers: a synthetic derivation, compared field by field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import parsers
from ..tables import table

_DAY = "lpad(cast(year as string), 4, '0') || '-03-01'"
_NAMED = "transform(authors, a -> named_struct('name', a))"
#: Source: the payload of one paper as a Spark SQL expression over id, title, authors, year, doi, abstract.
PAYLOADS = {
    "crossref": "to_json(named_struct('message', named_struct('items', array(named_struct('DOI', doi, 'title', array(title), 'author', transform(authors, a -> named_struct('given', a)), 'published', named_struct('date-parts', array(array(year))), 'abstract', abstract)))))",
    "scielo": "to_json(named_struct('message', named_struct('items', array(named_struct('DOI', doi, 'title', array(title), 'author', transform(authors, a -> named_struct('family', a)), 'published', named_struct('date-parts', array(array(year))), 'abstract', abstract)))))",
    "openalex": "to_json(named_struct('results', array(named_struct('id', id, 'title', title, 'doi', 'https://doi.org/' || doi, 'publication_year', year, 'authorships', transform(authors, a -> named_struct('author', named_struct('display_name', a))), 'abstract_inverted_index', map('one', array(0, 2), 'two', array(1))))))",
    "semantic": "'noise ' || to_json(named_struct('data', array(named_struct('paperId', id, 'title', title, 'authors', " + _NAMED + ", 'year', year, 'abstract', abstract, 'externalIds', named_struct('DOI', doi))))) || ' tail'",
    "scopus": "to_json(named_struct('search-results', named_struct('entry', array(named_struct('dc:identifier', id, 'dc:title', title, 'dc:creator', get(authors, 0), 'prism:coverDate', " + _DAY + ", 'dc:description', abstract, 'prism:doi', doi)))))",
    "zenodo": "to_json(named_struct('hits', named_struct('hits', array(named_struct('id', id, 'metadata', named_struct('title', title, 'creators', " + _NAMED + ", 'publication_date', " + _DAY + ", 'description', abstract, 'doi', doi))))))",
    "openaire": "to_json(named_struct('response', named_struct('results', named_struct('result', array(named_struct('header', named_struct('dri:objIdentifier', named_struct('$', 'a:' || id)), 'metadata', named_struct('oaf:entity', named_struct('oaf:result', named_struct('title', named_struct('$', title), 'creator', transform(authors, a -> named_struct('$', a)), 'pid', array(named_struct('@classid', 'other', '$', 'x'), named_struct('@classid', 'doi', '$', doi)), 'dateofacceptance', named_struct('$', " + _DAY + "), 'description', named_struct('$', abstract))))))))))",
    "doaj": "to_json(named_struct('results', array(named_struct('id', id, 'bibjson', named_struct('title', title, 'author', " + _NAMED + ", 'year', cast(year as string), 'abstract', abstract, 'identifier', array(named_struct('type', 'issn', 'id', 'x'), named_struct('type', 'doi', 'id', doi)))))))",
    "core": "to_json(named_struct('results', array(named_struct('id', id, 'title', title, 'authors', " + _NAMED + ", 'yearPublished', year, 'abstract', abstract, 'doi', doi))))",
    "redalyc": "to_json(named_struct('documentos', array(named_struct('id', id, 'titulo', title, 'autores', array_join(authors, ' ; '), 'anio', cast(year as string), 'resumen', abstract, 'doi', doi))))",
    "serpapi": "to_json(named_struct('organic_results', array(named_struct('title', title, 'link', 'l' || id, 'snippet', abstract, 'publication_info', named_struct('summary', 'A - ' || lpad(cast(year as string), 4, '0'), 'authors', " + _NAMED + ")))))",
    "dblp": "to_json(named_struct('result', named_struct('hits', named_struct('hit', array(named_struct('info', named_struct('key', id, 'title', title, 'authors', named_struct('author', transform(authors, a -> named_struct('text', a))), 'year', cast(year as string), 'doi', doi)))))))",
    "paperswithcode": "to_json(named_struct('results', array(named_struct('id', id, 'title', title, 'abstract', abstract, 'authors', authors, 'published', " + _DAY + "))))",
    "huggingface": "to_json(array(named_struct('title', 'outer', 'paper', named_struct('id', id, 'title', title, 'authors', " + _NAMED + ", 'summary', abstract, 'publishedAt', " + _DAY + "))))",
    "openreview": "to_json(named_struct('notes', array(named_struct('id', id, 'content', named_struct('title', named_struct('value', title), 'abstract', named_struct('value', abstract), 'authors', named_struct('value', authors), 'venue', named_struct('value', 'V ' || lpad(cast(year as string), 4, '0')))))))",
    "dspace": "to_json(named_struct('items', array(named_struct('uuid', id, 'metadata', array(named_struct('key', 'dc.title', 'value', title), named_struct('key', 'dc.contributor.author', 'value', get(authors, 0)), named_struct('key', 'dc.contributor.author', 'value', 'second'), named_struct('key', 'dc.date.issued', 'value', " + _DAY + "), named_struct('key', 'dc.identifier.doi', 'value', doi), named_struct('key', 'dc.description.abstract', 'value', abstract))))))",
    "solr": "to_json(named_struct('response', named_struct('docs', array(named_struct('id', id, 'title', title, 'author', get(authors, 0), 'date', " + _DAY + ", 'description', abstract)))))",
    "vufind": "to_json(named_struct('records', array(named_struct('id', id, 'title', title, 'authors', authors, 'publicationDates', array(" + _DAY + "), 'summary', array(abstract), 'doi', doi))))",
    "pubmed": "to_json(named_struct('result', map_from_arrays(array(id), array(named_struct('title', title, 'authors', " + _NAMED + ", 'pubdate', lpad(cast(year as string), 4, '0') || ' Mar', 'elocationid', 'doi: ' || doi)))))",
    "arxiv": "'<feed><entry><id>' || id || '</id><title>' || coalesce(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '') || '</title><summary>' || coalesce(replace(replace(abstract, '&', '&amp;'), '<', '&lt;'), '') || '</summary><published>' || coalesce(" + _DAY + ", '') || '</published></entry></feed>'",
}


def parsed(s: SparkSession, d: str) -> DataFrame:
    """(source, n, and a sum of hashes for each field): what the parsers read out of the payloads of all papers."""
    clean = lambda c: F.regexp_replace(c, r"[\x00-\x1f   ]", " ")
    p = table(s, d, "papers").select(F.col("seq").cast("string").alias("id"), clean(F.col("title")).alias("title"), F.transform("authors", clean).alias("authors"), "year", F.trim(F.regexp_replace("doi", r"\s", "")).alias("doi"), clean(F.col("abstract")).alias("abstract"))
    out = None
    for name, expression in PAYLOADS.items():
        part = parsers.PARSERS[name](p.select(F.expr(expression).alias("raw"))).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    h = lambda c: F.sum(F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("\u0001"))), 1, 8), 16, 10).cast("long"))
    own = F.when(F.col("source").isin("crossref", "scielo", "serpapi"), F.lit("")).otherwise(F.col("id"))
    return out.groupBy("source").agg(
        F.count("*").alias("n"), h(own).alias("ids"), h(F.col("title")).alias("titles"), h(F.array_join("authors", "|")).alias("names"), h(F.col("year")).alias("years"), h(F.col("doi")).alias("dois"), h(F.col("abstract")).alias("abstracts"),
    )


def parsed_sql() -> str:
    """The same from the papers themselves, by what each notation keeps."""
    clean = lambda c: f"regexp_replace({c}, '[\\x00-\\x1f\\x{{00a0}}\\x{{2028}}\\x{{2029}}]', ' ', 'g')"
    base = f"select cast(seq as varchar) as id, {clean('title')} as title, list_transform(authors, lambda a: {clean('a')}) as authors, year, trim(regexp_replace(doi, '\\s', '', 'g')) as doi, {clean('abstract')} as abstract from papers"
    # source, prefix of the id, default title, authors, default author, years (zero or null), DOI, abstract
    kinds = [
        ("crossref", "", "Sin título", "given", "Autor Desconocido", "null", "raw", "clean"), ("scielo", "", "Sin título", "given", "Autor Desconocido", "null", "raw", "none"), ("openalex", "", "Sin título", "bare", "", "null", "raw", "fixed"),
        ("semantic", "", "Sin título", "bare", "", "zero", "raw", "raw"), ("scopus", "scopus:", "Sin título", "first", "Scopus Author", "zero", "raw", "blank"), ("zenodo", "zenodo_", "Sin título", "all", "Autor Desconocido", "zero", "raw", "null"),
        ("openaire", "openaire_a_", "Sin título", "held", "Autor Desconocido", "zero", "raw", "clean"), ("doaj", "doaj_", "Sin título", "all", "Autor Desconocido", "zero", "raw", "clean_null"), ("core", "core_", "Sin título", "all", "Autor Desconocido", "null", "raw", "clean_null"),
        ("redalyc", "redalyc_", "Sin título", "split", "Autor Desconocido", "zero", "raw", "clean_null"), ("serpapi", "", "Sin título", "all", "Google Scholar", "zero", "none", "null"), ("dblp", "", "Untitled", "bare", "", "zero", "raw", "no"),
        ("paperswithcode", "pwc_", "Untitled", "bare", "", "zero", "none", "blank"), ("huggingface", "hf_", "outer", "filled", "", "zero", "none", "blank"), ("openreview", "openreview_", "Untitled", "bare", "", "zero", "none", "blank"),
        ("dspace", "", "Sin título", "first", "Autor Desconocido", "zero", "raw", "blank"), ("solr", "", "Sin título", "first", "Autor Desconocido", "zero", "none", "blank"), ("vufind", "", "Sin titulo", "filled", "Autor Desconocido", "zero", "raw", "blank"),
        ("pubmed", "pubmed_", "Sin título", "all", "PubMed Author", "zero", "found", "none"), ("arxiv", "", "Sin título", "const", "arXiv Author", "zero", "none", "trim"),
    ]
    rows = ", ".join("(" + ", ".join("'" + x + "'" for x in k) + ")" for k in kinds)
    stripped = "trim(regexp_replace(replace(regexp_replace(coalesce(abstract, ''), '<[^>]*>', '', 'g'), '&nbsp;', ' '), '\\s+', ' ', 'g'))"
    title = "case when source = 'dblp' then regexp_replace(coalesce(nullif(title, ''), dt), '\\.$', '') when source = 'openaire' then coalesce(title, dt) when source = 'arxiv' then coalesce(nullif(trim(title), ''), dt) else coalesce(nullif(title, ''), dt) end"
    joined = "array_to_string(list_filter(authors, lambda a: a is not null), '|')"
    names = (
        f"case am when 'const' then da when 'first' then coalesce(nullif(authors[1], ''), da) when 'given' then coalesce(array_to_string(list_transform(authors, lambda a: trim(coalesce(a, ''))), '|'), da) when 'all' then coalesce({joined}, da) when 'bare' then coalesce({joined}, case when source in ('openalex', 'semantic') then null else '' end)"
        " when 'filled' then coalesce(nullif(array_to_string(list_filter(authors, lambda a: a is not null and a <> ''), '|'), ''), da) when 'held' then case when len(authors) > 0 then array_to_string(list_transform(authors, lambda a: coalesce(a, 'Unknown')), '|') else da end"
        " when 'split' then coalesce(array_to_string(list_transform(string_split(nullif(array_to_string(authors, ' ; '), ''), ';'), lambda a: trim(a)), '|'), da) end"
    )
    years = "case when ym = 'null' then nullif(year, 0) else year end"
    dois = "case dm when 'raw' then nullif(doi, '') when 'found' then nullif(regexp_replace(regexp_extract('doi: ' || doi, '(10\\.\\d{4,9}/[^\\s\"''<>]+)', 1), '[.)]+$', ''), '') end"
    abstracts = f"case bm when 'raw' then abstract when 'null' then nullif(abstract, '') when 'blank' then coalesce(abstract, '') when 'clean' then {stripped} when 'clean_null' then case when abstract is null then null else nullif({stripped}, '') end when 'none' then '' when 'fixed' then 'one two one' when 'trim' then trim(coalesce(abstract, '')) end"
    h = lambda x: f"cast(sum(cast('0x' || substr(md5(coalesce(cast({x} as varchar), chr(1))), 1, 8) as bigint)) as bigint)"
    own = "case when source in ('crossref', 'scielo', 'serpapi') then '' else prefix || id end"
    return (
        f"with k(source, prefix, dt, am, da, ym, dm, bm) as (values {rows}), p as ({base}), x as (select source, {own} as id, {title} as title, {names} as names, {years} as year, {dois} as doi, {abstracts} as abstract from p, k)"
        f" select source, count(*) as n, {h('id')} as ids, {h('title')} as titles, {h('names')} as names, {h('year')} as years, {h('doi')} as dois, {h('abstract')} as abstracts from x group by 1"
    )
