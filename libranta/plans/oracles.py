"""The same results in SQL, for the correctness gate."""

from __future__ import annotations

from ..operators.search import GROUPS
from . import payloads, works_sql


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def title_key(x: str) -> str:
    return f"substr({collapse(f"regexp_replace({fold(x)}, '[^a-z0-9\\s]', '', 'g')")}, 1, 60)"


DEDUP_TITLE = collapse(f"regexp_replace({fold('title')}, '[^a-z0-9\\s]', ' ', 'g')")


def bare(x: str) -> str:
    return f"trim(lower(regexp_replace({x}, '^https?://doi\\.org/', '', 'i')))"


def found_doi(x: str) -> str:
    return f"nullif(regexp_replace(regexp_extract({x}, '(10\\.\\d{{4,9}}/[^\\s\"''<>]+)', 1), '[.)]+$', ''), '')"


MISSING_YEAR = "(year is null or year = 0)"
SCORE = (
    "(case when length(title) > 10 then 15 else 0 end + case when length(abstract) > 100 then 25 else 0 end + case when year is not null and year <> 0 then 10 else 0 end"
    " + case when doi is not null and doi <> '' then 15 else 0 end + case when pdf_url is not null and pdf_url <> '' then 15 else 0 end"
    " + case when len(authors) > 0 and coalesce(authors[1], '') <> 'Autor Desconocido' then 10 else 0 end + case when university is not null and university <> '' and university <> 'Universidad Peruana' then 10 else 0 end)"
)
QUALITY = (
    "(case when doi is not null and doi <> '' then 20 else 0 end + case when (pdf_url is not null and pdf_url <> '') or (url is not null and url <> '') or (handle_url is not null and handle_url <> '') then 15 else 0 end"
    " + case when length(abstract) > 80 then 20 else 0 end + case when len(authors) > 0 then 10 else 0 end + case when year is not null and year <> 0 then 10 else 0 end"
    " + case when university is not null and university <> '' then 5 else 0 end + cast(least(10, coalesce(citation_count, 0)) as int))"
)
KEY = (
    f"coalesce(case when doi is not null and {bare('doi')} <> '' then 'doi:' || {bare('doi')} end, case when length({DEDUP_TITLE}) > 12 then 'title:' || substr({DEDUP_TITLE}, 1, 90) || ':' || case when {MISSING_YEAR} then '' else cast(year as varchar) end end,"
    " case when id is not null and id <> '' then 'id:' || id end)"
)
HAY = "lower(coalesce(title, '') || ' ' || coalesce(abstract, ''))"
ANY = f"(contains({HAY}, 'gestión') or contains({HAY}, 'agua') or contains({HAY}, 'estrés'))"
HTML = "('<html><head><title>' || coalesce(title, '') || ' | Repositorio</title><meta name=\"citation_title\" content=\"' || replace(coalesce(title, ''), '\"', '') || '\"><meta content=\"' || coalesce(cast(pub_year as varchar), '') || '-03-01\" name=\"citation_date\"></head></html>')"


def META(x: str) -> str:  # noqa: N802
    """A tag's content as it is read back: without double quotes, references resolved, blanks collapsed."""
    y = f"trim(replace(replace({x}, '\"', ''), '&#', '#'))"
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''")):
        y = f"replace({y}, '{a}', '{b}')"
    y = f"regexp_replace({y}, '\\.{{2,3}}\\s*descripci[oó]n completa\\s*$', '', 'i')"
    return f"nullif({collapse(y)}, '')"


_AUTHORS = "list_filter(list_transform(authors, lambda a: trim(replace(replace(a, '\"', ''), '&#', '#'))), lambda a: length(a) > 2 and not contains(a, '@'))"
DISTINCT_AUTHORS = "list_transform(list_filter(" + _AUTHORS + ", lambda a, i: list_position(" + _AUTHORS + ", a) = i), lambda a: " + META("a") + ")"


def batch(source: str) -> str:
    return (
        f"r as (select {KEY} as key, seq, {QUALITY} as quality, matched_query from {source}), k as (select * from r where key is not null),"
        " w as (select key, seq as winner, quality, min(seq) over (partition by key) as first, row_number() over (partition by key order by quality desc, seq) as rn from k),"
        " z as (select key, string_agg(matched_query, '|' order by o) as queries from (select key, matched_query, min(seq) as o from k where matched_query is not null group by 1, 2) group by 1)"
    )


def oracle_sql() -> dict[str, str]:
    groups = ", ".join(f"({q(g)}, {q(m)})" for g, members in GROUPS.items() for m in members.split())
    terms = "list_filter(regexp_split_to_array(regexp_replace(lower(matched_query), '[^A-Za-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 3 and not list_contains(['de','la','el','los','las','un','una','y','o','en','para','con','del','al','como','que','por','sobre','se','su','es','son','ser','si','the','and','of','to','in','on','with','for','at','by','from'], w))"
    distinct = f"list_filter({terms}, lambda w, i: list_position({terms}, w) = i)[1:5]"
    search_dedup = f"with recursive o as (select matched_query, seq, coalesce(lower(doi), '') as k1, coalesce({title_key('title')}, '') as k2, coalesce(nullif(id, ''), nullif(doi, ''), title) as uid, row_number() over (partition by matched_query order by seq) as rn from papers), s as (select matched_query, seq, uid, rn, (k1 <> '' or k2 <> '') as keep, case when k1 <> '' then [k1] else [] end as s1, case when k2 <> '' then [k2] else [] end as s2 from o where rn = 1 union all select o.matched_query, o.seq, o.uid, o.rn, x.keep, case when x.keep and k1 <> '' then list_append(s1, k1) else s1 end, case when x.keep and k2 <> '' then list_append(s2, k2) else s2 end from s join o on o.matched_query is not distinct from s.matched_query and o.rn = s.rn + 1, lateral (select (k1 <> '' or k2 <> '') and not (k1 <> '' and list_contains(s1, k1)) and not (k2 <> '' and list_contains(s2, k2)) as keep) x) select matched_query, min(seq) as seq from s where keep group by matched_query, uid"
    return {
        "q_batch_search": f"with {batch(f'(select * from papers where {ANY})')} select w.winner as seq, p.id, p.title, p.year, w.quality, coalesce(z.queries, '') as queries from w join papers p on p.seq = w.winner left join z on z.key = w.key where rn = 1 and (p.year is null or p.year = 0 or p.year between 2010 and 2020) order by w.first limit 120",
        "q_any_term_search": f"select seq, title from papers where {ANY}",
        "q_year_filter": "select seq, year from papers where year is null or year = 0 or year between 2010 and 2020",
        "q_has_abstract": "select source, count(*) as n from papers where length(abstract) > 0 group by 1",
        "q_accent_search": f"select seq from papers where contains({fold("coalesce(university, '') || ' ' || coalesce(title, '') || ' ' || coalesce(abstract, '')")}, 'gestion del agua')",
        "q_completeness": f"select seq, {SCORE} as score from papers",
        "q_quality": f"select seq, {QUALITY} as score from papers",
        "q_low_scores": f"select source, score, count(*) as n from (select source, {SCORE} as score from papers) where score < 70 group by 1, 2",
        "q_search_dedup": search_dedup,
        "q_batch_dedup": f"with {batch('papers')} select w.key, winner, quality, first, coalesce(queries, '') as queries from w left join z using (key) where rn = 1",
        "q_smart_dedup": f"select min(seq) as seq from (select coalesce(nullif(doi, ''), nullif(substr({fold('title')}, 1, 60), '')) as k, seq from papers) where k is not null group by k",
        "q_id_dedup": "select coalesce(id, '') as id, min(seq) as seq from papers group by 1",
        "q_union_by_id": "select id, seq from papers where source = 'alixia' union all select id, seq from papers where source = 'renata' and id not in (select id from papers where source = 'alixia' and id is not null)",
        "q_first_per_source": "select source, seq from papers qualify row_number() over (partition by source order by seq) <= 30",
        "q_source_stats": "select source, count(*) as found, count(*) filter (where doi is not null and doi <> '') as with_doi, count(distinct id) as ids from papers group by 1",
        "q_query_report": f"select p.matched_query, count(*) as before_dedup, coalesce(any_value(k.returned), 0) as returned from papers p left join (select matched_query, count(*) as returned from ({search_dedup}) group by 1) k using (matched_query) group by 1",
        "q_recovered_fields": "select field, count(*) as n from (select unnest(enriched_fields) as field from papers) group by 1",
        "q_type_counts": "select d.doc_type, count(x.doc_id) as n from (values ('thesis'), ('article'), ('report'), ('unknown')) d(doc_type) left join documents x using (doc_type) group by 1",
        "q_exact_duplicates": "select md5(text) as hash, count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id from documents where text <> '' group by 1 having count(*) > 1",
        "q_name_duplicates": "select lower(regexp_replace(regexp_extract(pdf_url, '([^/]*)$', 1), '^\\d+_', '')) as name, count(*) as n from papers where pdf_url <> '' group by 1 having count(*) > 1",
        "q_health_rollup": "select coalesce(event_type, 'all') as category, count(*) as total, count(*) filter (where value >= 5) as working, cast(floor(100 * count(*) filter (where value >= 5) / count(*)) as bigint) as percent from events group by rollup (event_type)",
        "q_latest_status": "select user_id, arg_max(event_type, (epoch_us(ts), event_id)) as event_type, max(epoch_us(ts)) as \"at\" from events group by 1",
        "q_rate_limit": "select user_id, event_id, max(epoch_us(ts) - n * 3600000000) over (partition by user_id order by ts, event_id) + n * 3600000000 as start from (select *, row_number() over (partition by user_id order by ts, event_id) as n from events)",
        "q_circuit_breaker": "with a as (select *, epoch_us(ts) as tm, event_type = 'error' as bad from events), b as (select *, last_value(case when bad then tm end ignore nulls) over (partition by user_id order by tm, event_id rows between unbounded preceding and 1 preceding) as lb from a), c as (select *, sum(case when not bad or coalesce(tm - lb > 86400000000, false) then 1 else 0 end) over (partition by user_id order by tm, event_id) as blk from b), d as (select *, cast(sum(case when bad then 1 else 0 end) over (partition by user_id, blk order by tm, event_id) as int) as failures from c) select user_id, event_id, failures, failures >= 3 as open from d",
        "q_ttl_cache": "with recursive o as (select user_id, event_id, epoch_us(ts) as tm, row_number() over (partition by user_id order by ts, event_id) as n from events), s as (select user_id, event_id, n, tm as written, false as hit from o where n = 1 union all select o.user_id, o.event_id, o.n, case when o.tm - s.written < 86400000000 then s.written else o.tm end, o.tm - s.written < 86400000000 from s join o on o.user_id = s.user_id and o.n = s.n + 1) select user_id, event_id, hit from s",
        "q_token_saving": "select md_id, cast(t as int) as text_words, cast(m as int) as md_words, cast(floor(100 - 100 * m / t) as bigint) as saved from (select md_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: length(w) > 1)) as t, len(list_filter(regexp_split_to_array(markdown, '\\s+'), lambda w: length(w) > 1)) as m from markdown_results join pdf_texts using (file_id)) where t > 0",
        "q_normalize_title": f"select seq, {title_key('title')} as title_key from papers",
        "q_dedup_key": f"select seq, {KEY} as dedup_key from papers",
        "q_boolean_query": f"select seq, case when len({terms}) = 0 then matched_query else array_to_string({distinct}, ' ') end as boolean_query from papers",
        "q_simplify": "select seq, array_to_string(list_filter(regexp_split_to_array(title, '\\s+'), lambda w: length(w) > 2)[1:6], ' ') as short_query from papers",
        "q_sanitize": "select seq, trim(strip_accents(regexp_replace(matched_query || '  x   y ', '\\s+', ' ', 'g'))) as clean_query from papers",
        "q_doi_extraction": f"select seq, {found_doi('doi')} as found_doi from papers",
        "q_first_year": "select rec_id, cast(nullif(regexp_extract(date_issued, '(\\d{4})', 1), '') as int) as first_year from repo_records",
        "q_clean_abstract": f"select seq, substr({collapse("replace(regexp_replace(abstract, '<[^>]*>', '', 'g'), '&nbsp;', ' ')")}, 1, 500) as clean from papers",
        "q_word_count": "select doc_id, cast(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: length(w) > 1)) as int) as n_words from documents where text is not null",
        "q_page_ranges": "select * from (values ('1-5', '0,1,2,3,4'), ('1,3,7', '0,2,6'), ('last3', '7,8,9'), ('first5', '0,1,2,3,4'), ('last', '7,8,9'), ('0', ''), ('8-20', '7,8,9'), ('x', ''), ('3,1,3', '0,2')) t(spec, pages)",
        "q_tags": "select seq, concat_ws(' | ', source, type, cast(year as varchar)) as tags from papers",
        "q_source_expand": f"with recursive e(grp, member) as (values {groups}), x as (select grp, member from e union select x.grp, e.member from x join e on e.grp = x.member) select distinct grp, member from x where member not in (select grp from e)",
        "q_source_alias": "select cast(row_number() over () as int) as pos, source from (select unnest(['alicia', 'renati', 'lareferencia', 'conacyt', 'unam', 'anid', 'oasisbr', 'bdtd', 'snrd', 'minciencias', 'rraae', 'costarica', 'uruguay', 'elsalvador', 'scielo', 'redalyc', 'espana', 'semantic', 'laref_peru', 'mystery']) as source)",
        "q_relaxation_ladder": "with a(query_id, w) as (values (0, ['gestion','del','agua','riego']), (1, ['machine','learning','for','social','capital']), (2, ['energia','solar','fotovoltaica','capital','social']), (3, ['childhood','anaemia','zzzz']), (4, ['turismo','rural','comunitario'])), s as (select query_id, 0 as level, w as need from a union all select query_id, 1, w[1:3] from a union all select query_id, 2, w[1:2] from a), p as (select seq, regexp_split_to_array(strip_accents(lower(title)), '[^a-z0-9]+') as words from papers), h as (select query_id, level, count(*) as n from s join p on list_has_all(p.words, s.need) group by 1, 2) select query_id, min(level) as level, arg_min(n, level) as n from h group by 1",
        "q_repo_classify": "with k as (select distinct lower(repository) as repository from repo_records), p as (select seq, coalesce(nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), ''), url) as host from papers where url is not null) select seq, host, coalesce(repository, case when regexp_matches(host, '^(dspace|repositorio)') then 'unknown repository' end) as repository from p left join k on host = repository",
        "q_prefix_conflicts": "select split_part(handle, '/', 1) as prefix, count(distinct repository) as repositories from repo_records where split_part(handle, '/', 1) <> '' group by 1 having count(distinct repository) > 1",
        "q_host": "select coalesce(nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), ''), url) as host, count(*) as n from papers where url is not null group by 1",
        "q_file_score": "with s as (select university, seq, case when regexp_matches(pdf_url, 'licen|autorizacion|declaracion|formulario|similitud|turnitin', 'i') then -100 else 0 end + case when regexp_matches(pdf_url, 'resumen|abstract|portada|indice|anexo|apendice', 'i') then -50 else 0 end + case when regexp_matches(pdf_url, 'tesis|trabajo_de_grado|proyecto|investigacion|completo|main', 'i') then 50 else 0 end + case when coalesce(citation_count, 0) * 20000 / 1048576.0 > 1 then 10 else 0 end + case when coalesce(citation_count, 0) * 20000 / 1048576.0 > 5 then 20 else 0 end as score from papers where pdf_url is not null and university is not null) select university, seq, score from s qualify row_number() over (partition by university order by score desc, seq) = 1",
        "q_preview": "select file_id, substr(text, 1, 500) as preview, cast(length(text) as int) as n_chars from pdf_texts where text is not null",
        "q_payload_parsers": payloads.parsed_sql(),
        "q_needs_enhancement": "select seq from papers where coalesce(authors[1] = 'Autor Desconocido', false) or abstract is null or length(abstract) < 80 or regexp_matches(trim(abstract), '(\\.\\.\\.|…|\\[\\.\\.\\.\\]|\\.\\.\\.\\s*descripci[oó]n\\s+completa)$', 'i') or pdf_url is null or pdf_url = '' or university is null or university in ('', 'Universidad Peruana')",
        "q_title_theta_join": "select seq, min(rec_id) as rec_id from (select seq, lower(substr(title, 1, 20)) as part from papers where length(title) >= 1) p join repo_records r on contains(lower(r.title), p.part) group by 1",
        "q_inverted_index": "select doc_id, trim(regexp_replace(regexp_replace(text, '[\\n\\t\\r]', ' ', 'g'), ' +', ' ', 'g')) as round_trip from documents where trim(regexp_replace(text, '[\\n\\t\\r]', ' ', 'g')) <> ''",
        "q_unescape": f"select seq, {collapse("'<b> éé ' || replace(replace(replace(replace(replace(replace(title, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', '''') || ' \"x\"'")} as plain from papers where title is not null",
        "q_meta_extract": f"select page_id, {META('title')} as title, coalesce(array_to_string(list_filter({DISTINCT_AUTHORS}, lambda a: a <> ''), '|'), '') as authors, pub_year as year, nullif(trim(pdf_url), '') as pdf_url, {META('university')} as university, case when length(trim(replace(abstract, '\"', ''))) > 50 then {META('abstract')} end as abstract from scraped_pages",
        **works_sql.oracle_sql(),
        "q_tables": "select md_id, cast(len(regexp_extract_all(markdown, '(<table.*?</table>)', 1, 'is')) + len(regexp_extract_all(markdown, '(?m)((?:^\\|[^\\n]*\\|[ ]*\\n?)+)', 1)) as int) as n_tables from markdown_results where markdown is not null",
    }
