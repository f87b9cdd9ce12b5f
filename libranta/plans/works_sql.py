"""The same results in SQL. Section names, patterns, statistical families and the like are written out here again, so that a wrong value in the library shows."""

from __future__ import annotations

EDGE = "[\\s\\x{00a0}\\x{feff}]+"
# Sections with their category and pattern, in order of priority.
SECTION_PATTERNS = [
    ("Resumen / Abstract", "front", r"resumen|abstract|sumario"),
    ("Palabras Clave / Keywords", "front", r"palabras\s+clave|keywords|key\s+words"),
    ("Introducción / Introduction", "intro", r"introducci[oó]n|introduction"),
    ("Planteamiento del Problema", "intro", r"planteamiento\s+del\s+problema|problem\s+statement|formulaci[oó]n\s+del\s+problema|definici[oó]n\s+del\s+problema"),
    ("Justificación", "intro", r"justificaci[oó]n|justification|importancia|relevancia|motivation"),
    ("Objetivos", "intro", r"objetivos?\s*(?:generales?|espec[ií]ficos?)?|objectives?|goals?|aims?"),
    ("Hipótesis", "intro", r"hip[oó]tesis|hypothesis|hypotheses"),
    ("Marco Teórico", "theory", r"marco\s+te[oó]rico|theoretical\s+framework|fundamento\s+te[oó]rico|bases\s+te[oó]ricas|theoretical\s+background|state\s+of\s+the\s+art"),
    ("Antecedentes", "theory", r"antecedentes|background|related\s+work|literature\s+review|revisi[oó]n\s+de\s+literatura|estado\s+del\s+arte|trabajos\s+previos|prior\s+work"),
    ("Bases Conceptuales", "theory", r"bases\s+conceptuales|marco\s+conceptual|conceptual\s+framework|definici[oó]n\s+de\s+t[eé]rminos|glosario"),
    ("Marco Legal", "theory", r"marco\s+legal|marco\s+normativo|legal\s+framework|regulatory\s+framework"),
    ("Metodología / Methods", "methods", r"metodolog[ií]a|methods?|methodology|materiales?\s+y\s+m[eé]todos?|materials?\s+and\s+methods?|procedimiento|approach|proposed\s+method|dise[ñn]o\s+metodol[oó]gico"),
    ("Población y Muestra", "methods", r"poblaci[oó]n\s+y\s+muestra|population\s+and\s+sample|sample\s+size|muestra|participants?|participantes|sujetos"),
    ("Instrumentos", "methods", r"instrumentos?\s+de\s+recolecci[oó]n|instruments?|herramientas|cuestionario|encuesta|survey|data\s+collection"),
    ("Diseño Experimental", "methods", r"dise[ñn]o\s+experimental|experimental\s+design|experimental\s+setup|setup|implementaci[oó]n|implementation"),
    ("Resultados / Results", "results", r"resultados|results|findings|hallazgos"),
    ("Análisis de Datos", "results", r"an[aá]lisis\s+de\s+(?:datos|resultados)|data\s+analysis|analysis\s+of\s+results|an[aá]lisis\s+estad[ií]stico|statistical\s+analysis"),
    ("Discusión / Discussion", "results", r"discusi[oó]n|discussion|interpretaci[oó]n"),
    ("Conclusiones / Conclusions", "conclusion", r"conclusi[oó]n|conclusions?|concluding\s+remarks"),
    ("Recomendaciones", "conclusion", r"recomendaciones|recommendations|sugerencias|suggestions|future\s+work|trabajo\s+futuro|trabajos?\s+futuros?"),
    ("Referencias / References", "back", r"referencias|references|bibliograf[ií]a|bibliography|works\s+cited"),
    ("Anexos / Appendix", "back", r"anexos?|appendix|appendices|ap[eé]ndices?|supplementary|material\s+complementario"),
]
# Statistical families, their patterns and whether case counts.
FAMILIES = [
    ("p-value", r"p\s*[<>=≤≥]\s*0?\.\d+", "i"), ("percentage", r"\d+[.,]\d*\s*%", "c"), ("mean_std", r"(?:media|mean|promedio|average|M)\s*[=:]\s*\d+[.,]?\d*", "i"), ("correlation", r"r\s*[=]\s*[+-]?0?\.\d+", "i"),
    ("chi_square", r"(?:chi|χ)[²2]\s*[=()]\s*\d+[.,]?\d*", "i"), ("confidence_interval", r"(?:IC|CI)\s*[=:(\[]\s*\d+", "i"), ("t_test", r"t\s*[=(]\s*\d+[.,]?\d*", "i"), ("f_test", r"F\s*[=(]\s*\d+[.,]?\d*", "i"), ("n_sample", r"(?:n|N)\s*[=]\s*\d+", "c"),
    ("alpha", r"(?:α|alfa|alpha)\s*[=]\s*0?\.\d+", "i"), ("r_squared", r"R[²2]\s*[=]\s*0?\.\d+", "i"), ("anova", r"ANOVA|an[aá]lisis\s+de\s+varianza", "i"),
    ("regression", r"regresi[oó]n\s+(?:lineal|log[ií]stica|m[uú]ltiple)|(?:linear|logistic|multiple)\s+regression", "i"), ("table_reference", r"(?:tabla|table|cuadro|figure|figura)\s+\d+", "i"),
]
ES, EN = "de|en|la|el|los|las|del|para|por|con|una|que|como", "the|and|of|in|to|for|with|that|this|from|are|was"
THESIS_SIGNS = [r"tesis|tesina|disertaci[oó]n|dissertation|thesis", r"para\s+optar\s+(?:el|al)\s+(?:t[ií]tulo|grado)", r"asesor|advisor|tutor|director\s+de\s+tesis", r"universidad|university|facultad|faculty|escuela\s+de", r"bachiller|licenciatura|maestr[ií]a|doctorado|master|phd"]
ARTICLE_SIGNS = [r"journal|revista|proceedings|conference", r"doi:\s*10\.\d+", r"\bsubmitted\s+to\b|\bpublished\s+in\b"]
ORDER = ["front", "conclusion", "results", "methods", "intro", "theory"]


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{EDGE}|{EDGE}$', '', 'g')"


def label(x: str) -> str:
    return "case " + " ".join(f"when regexp_matches({x}, {q(chr(92) + 'b(?:' + p + ')' + chr(92) + 'b')}, 'i') then {k + 1}" for k, (_, _, p) in enumerate(SECTION_PATTERNS)) + " end"


def segments(route: str = "analysis") -> str:
    """CTEs that end in ``sec`` (doc_id, pos, name, category, start, content)."""
    low, high = (1, 79) if route == "detect" else (3, 99)
    lists = ", ".join(f"[{', '.join(q(s[n]) for s in SECTION_PATTERNS)}] as {c}" for n, c in ((0, "names"), (1, "categories")))
    kept = "list_reduce(list_transform(hits, lambda h: [h]), lambda a, b: case when a[-1].k <> b[1].k or b[1].line - a[-1].line > 3 then list_concat(a, b) else a end)"
    plain = "hits" if route == "detect" else kept
    chosen = plain if route == "analysis" else f"case when len(marked) >= {2 if route == 'detect' else 3} then marked else {plain} end"
    return (
        "l0 as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents where text is not null),"
        f" l1 as (select doc_id, i, sum(length(line) + 1) over (partition by doc_id order by i) - length(line) - 1 as start, {trimmed('line')} as t from l0),"
        f" l2 as (select *, case when length(t) between {low} and {high} then {label('t')} end as k, case when regexp_matches(t, '^#{{1,4}}\\s+.+') then {label(trimmed("regexp_extract(t, '^#{1,4}" + chr(92) + "s+(.+)', 1)"))} end as km from l1),"
        " l3 as (select doc_id, coalesce(list({'line': i, 'start': cast(start as int), 'k': k} order by i) filter (where k is not null), []) as hits, coalesce(list({'line': i, 'start': cast(start as int), 'k': km} order by i) filter (where km is not null), []) as marked from l2 group by 1),"
        f" l4 as (select doc_id, {chosen} as heads from l3 where len(hits) > 0 or len(marked) > 0), l5 as (select doc_id, unnest(heads) as h, generate_subscripts(heads, 1) as pos, heads from l4),"
        f" sec as (select doc_id, cast(pos as int) as pos, names[h.k] as name, categories[h.k] as category, h.start as start, {trimmed("substr(text, h.start + 1, coalesce(heads[pos + 1].start, length(text)) - h.start)")} as content from l5 join documents using (doc_id), (select {lists}))"
    )


def family_counts(x: str, also: str = "") -> str:
    """Rows (doc_id, family, n, all) for each family in a text expression over ``src``."""
    return " union all ".join(f"select doc_id{also}, {k} as o, {q(n)} as family, regexp_extract_all({x}, {q(p)}, 0, '{f}') as found from src" for k, (n, p, f) in enumerate(FAMILIES))


SCORE = (
    "(case when length(TITLE) > 10 then 15 else 0 end + case when length(abstract) > 100 then 25 else 0 end + case when year is not null and year <> 0 then 10 else 0 end + case when doi is not null and doi <> '' then 15 else 0 end"
    " + case when pdf_url is not null and pdf_url <> '' then 15 else 0 end + case when len(authors) > 0 and coalesce(authors[1], '') <> 'Autor Desconocido' then 10 else 0 end + case when university is not null and university <> '' and university <> 'Universidad Peruana' then 10 else 0 end)"
).replace("TITLE", "title")


def bare(x: str) -> str:
    return f"trim(lower(regexp_replace({x}, '^https?://doi\\.org/', '', 'i')))"


def first_by_doi(columns: str, test: str) -> str:
    cols = columns.split(",")
    return f"(select {bare('doi')} as key, {', '.join(f'arg_min([{c}], seq)[1] as {c}' for c in cols)} from papers where {test} and {bare('doi')} <> '' group by 1)"


def enrichment() -> str:
    """CTEs that end in ``e4``: the four gated stages."""
    no_year, no_place, no_author = "(year is null or year = 0)", "(university is null or university = '' or university = 'Universidad Peruana')", "coalesce(authors[1] = 'Autor Desconocido', false)"
    short = lambda n: f"(abstract is null or length(abstract) < {n})"
    keep = "seq, title, handle_url, score"
    take = lambda f, test, value: (f"case when coalesce({test}, false) then {value} else {f} end as {f}", f"case when coalesce({test}, false) then ['{f}'] else [] end")

    def stage(name: str, source: str, fields: list[tuple[str, str, str]]) -> str:
        done = {f for f, _, _ in fields}
        parts = [take(*x) for x in fields]
        rest = [c for c in ("authors", "year", "doi", "abstract", "pdf_url", "university") if c not in done]
        return f"{name} as (select {keep}, {', '.join([*rest, *(p[0] for p in parts)])}, got || {' || '.join(p[1] for p in parts)} as got from {source})"

    works = "(select p.seq, arg_min(r.doi, r.rec_id) filter (where true) as x, min(r.rec_id) as rec_id from (select seq, lower(substr(title, 1, 20)) as part from papers where length(title) >= 1) p join repo_records r on contains(lower(r.title), p.part) group by 1)"
    g1 = f"w_rec is not null and ({short(100)} or doi is null or doi = '' or {no_year})"
    g2 = f"c.key is not null and {short(100)}"
    g3 = f"o.key is not null and ({no_author} or pdf_url is null or pdf_url = '')"
    # each later gate is read before its own stage changes anything, so it is computed in the stage's source
    s1 = f"(select e0.*, w.doi as w_doi, w.year as w_year, w.university as w_university, w.authors as w_authors, w.rec_id as w_rec from e0 left join (select x.seq, r.* from {works} x join repo_records r on r.rec_id = x.rec_id) w on w.seq = e0.seq)"
    out = [f"e0 as (select seq, title, handle_url, {SCORE} as score, authors, year, doi, abstract, pdf_url, university, cast([] as varchar[]) as got from papers where {SCORE} < 70)"]
    out.append(stage("e1", f"(select *, coalesce({g1}, false) as g from {s1})", [
        ("doi", "g and (doi is null or doi = '') and w_doi <> ''", "regexp_replace(w_doi, '^https?://(?:dx\\.)?doi\\.org/', '')"), ("year", f"g and {no_year} and w_year is not null and w_year <> 0", "w_year"),
        ("university", f"g and {no_place} and w_university is not null and w_university <> ''", "w_university"), ("authors", f"g and {no_author} and len(w_authors) > 0", "w_authors"),
    ]))
    out.append(stage("e2", f"(select e1.*, c.abstract as c_abstract, c.year as c_year, coalesce({g2.replace('abstract', 'e1.abstract')}, false) as g from e1 left join {first_by_doi('abstract,year', 'length(abstract) > 0')} c on c.key = {bare('e1.doi')})", [
        ("abstract", "g and c_abstract <> ''", "trim(regexp_replace(c_abstract, '<[^>]+>', '', 'g'))"), ("year", f"g and {no_year} and c_year is not null and c_year <> 0", "c_year"),
    ]))
    out.append(stage("e3", f"(select e2.*, o.authors as o_authors, o.abstract as o_abstract, o.pdf_url as o_pdf_url, coalesce(o.key is not null and (coalesce(e2.authors[1] = 'Autor Desconocido', false) or e2.pdf_url is null or e2.pdf_url = ''), false) as g from e2 left join {first_by_doi('authors,abstract,pdf_url', "pdf_url like '%.pdf'")} o on o.key = {bare('e1.doi').replace('e1.', 'e2.')})", [
        ("authors", f"g and {no_author} and len(o_authors) > 0", "o_authors"), ("abstract", f"g and o_abstract <> '' and {short(50)}", "o_abstract"), ("pdf_url", "g and (pdf_url is null or pdf_url = '') and o_pdf_url <> ''", "o_pdf_url"),
    ]))
    pages = "(select handle_url as key, arg_min([abstract], seq)[1] as abstract, arg_min([university], seq)[1] as university, arg_min([authors], seq)[1] as authors, arg_min([pdf_url], seq)[1] as pdf_url from papers where length(abstract) > 200 and handle_url is not null and handle_url <> '' group by 1)"
    link = "coalesce(nullif(handle_url, ''), nullif(pdf_url, ''))"
    s4 = f"(select l.*, p.key is not null as g, p.abstract as p_abstract, p.university as p_university, p.authors as p_authors, p.pdf_url as p_pdf_url from (select *, case when {short(80)} and (contains({link}, 'handle') or contains({link}, '.edu.') or contains({link}, '.gob.')) then {link} end as link from e3) l left join {pages} p on p.key = l.link)"
    out.append(stage("e4", s4, [
        ("abstract", "g and length(p_abstract) > coalesce(length(abstract), 0)", "p_abstract"), ("university", f"g and p_university <> '' and {no_place}", "p_university"), ("authors", f"g and len(p_authors) > 0 and {no_author}", "p_authors"),
        ("pdf_url", "g and p_pdf_url <> '' and (pdf_url is null or pdf_url = '')", "p_pdf_url"),
    ]))
    return ", ".join(out)


DISTINCT_GOT = "array_to_string(list_filter(got, lambda x, i: list_position(got, x) = i), '|')"
CLEAN = "regexp_replace({}, '[<>]', '', 'g')"


def _entities(x: str) -> str:
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def oracle_sql() -> dict[str, str]:
    seg, rank = segments("summary"), "case category " + " ".join(f"when '{c}' then {i + 1}" for i, c in enumerate(ORDER)) + " else 99 end"
    head = "substr(text, 1, 10000)"
    kind = (
        f"case when t >= 2 then 'thesis' when a >= 2 then 'article' when t > a then 'thesis' when a > t then 'article' else 'unknown' end"
    )
    signs = lambda ps: " + ".join(f"case when regexp_matches({head}, {q(p)}, 'i') then 1 else 0 end" for p in ps)
    types = f"select doc_id, text, {signs(THESIS_SIGNS)} as t, {signs(ARTICLE_SIGNS)} + case when regexp_matches({head}, '\\babstract\\b.*\\bintroduction\\b', 'is') then 1 else 0 end as a from documents where text is not null"
    count = lambda words: f"len(regexp_extract_all(lower(substr(text, 1, 5000)), {q(chr(92) + 'b(?:' + words + ')' + chr(92) + 'b')}))"
    language = f"case when 2 * {count(ES)} > 3 * {count(EN)} then 'es' when 2 * {count(EN)} > 3 * {count(ES)} then 'en' else 'mixed' end"
    uniq = lambda x: f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"
    found = "list_transform(found, lambda v: " + trimmed("v") + ")"
    refs = "regexp_extract(text, '\\b((?:references|bibliography|works\\s+cited)\\b.*)$', 1, 'is')"
    squeeze = lambda x: f"regexp_replace({trimmed(x)}, '\\s+', ' ', 'g')"
    year = "nullif(regexp_extract(entry, '\\b((?:19|20)\\d{2})\\b', 1), '')"
    link_kind = "case when not regexp_matches(x, '^https?://') and (contains(x, '/mnt/user-data/') or contains(x, '/mnt/user/') or contains(x, '/tmp/') or contains(x, '/uploads/') or contains(x, '/var/data/')) then 'local' when regexp_matches(lower(x), '\\.pdf(?:[?#]|$)') then 'pdf' when regexp_matches(x, '(?:^|[/.])pmc\\.ncbi|/pmc/|^PMC\\d+$', 'i') then 'pmc' when regexp_matches(x, '^10\\.\\d{4,9}/') or regexp_matches(x, 'doi\\.org/10\\.', 'i') then 'doi' when contains(x, '/handle/') then 'handle' when regexp_matches(x, '^https?://') then 'page' end"
    dim = "dim as (select split_part(handle, '/', 1) as pattern, min(rec_id) as ord, min('https://' || repository) as base, min(repository) as name from repo_records where handle like '%/%' group by 1)"
    byq = lambda test: f"select cast(length(matched_query) % 97 as int) as query_id, seq from papers where {test}"
    last = "regexp_replace(regexp_extract(strip_accents(lower(authors[1])), '([^ ]*)$', 1), '[^a-z]', '', 'g')"
    page_text = "regexp_replace(coalesce(abstract, ''), '[<>\"'']', '', 'g')"
    details = (
        f"det as (select page_id, nullif(trim(regexp_replace({CLEAN.format("coalesce(title, '')")}, '\\s+', ' ', 'g')), '') as title, array_to_string({uniq("list_filter(list_transform(coalesce(authors, []), lambda a: trim(" + CLEAN.format('a') + ")), lambda a: a <> '')")}, '|') as authors, pub_year as year, '10.' || (1000 + page_id) || '/p' as doi,"
        f" nullif(trim(regexp_replace({CLEAN.format("coalesce(university, '')")}, '\\s+', ' ', 'g')), '') as university, cast(null as varchar) as publisher, case when length(trim(regexp_replace({CLEAN.format("coalesce(abstract, '')")}, '\\s+', ' ', 'g'))) > 50 then trim(regexp_replace({CLEAN.format("coalesce(abstract, '')")}, '\\s+', ' ', 'g')) end as abstract,"
        " case when regexp_matches(pdf_url, '^https?://[^ <&]+$') and regexp_matches(lower(pdf_url), 'bitstream|download|\\.pdf') and not regexp_matches(lower(pdf_url), '\\.(jpg|jpeg|png|gif|svg|xml|docx|doc|ppt|pptx|xls|xlsx)$|thumbnail|preview') then pdf_url end as pdf_url from scraped_pages)"
    )
    need = "(coalesce(p.authors[1] = 'Autor Desconocido', false) or p.abstract is null or length(p.abstract) < 80 or regexp_matches(trim(p.abstract), '(\\.\\.\\.|…|\\[\\.\\.\\.\\]|\\.\\.\\.\\s*descripci[oó]n\\s+completa)$', 'i') or p.pdf_url is null or p.pdf_url = '' or p.university is null or p.university in ('', 'Universidad Peruana'))"
    has = lambda c: f"coalesce({c} <> '', false)"
    # Spanish words and their Portuguese forms, in the order in which they are put.
    pt = [
        ("investigación", "pesquisa"), ("investigacion", "pesquisa"), ("estudio", "estudo"), ("análisis", "análise"), ("analisis", "analise"), ("desarrollo", "desenvolvimento"), ("evaluación", "avaliação"), ("evaluacion", "avaliacao"),
        ("optimización", "otimização"), ("optimizacion", "otimizacao"), ("mejora", "melhoria"), ("proceso", "processo"), ("producción", "produção"), ("produccion", "producao"), ("calidad", "qualidade"), ("efecto", "efeito"),
        ("aplicación", "aplicação"), ("aplicacion", "aplicacao"), ("universidad", "universidade"), ("tesis", "tese"), ("maestría", "mestrado"), ("maestria", "mestrado"), ("doctorado", "doutorado"), ("suelo", "solo"), ("agua", "água"),
        ("rendimiento", "rendimento"), ("crecimiento", "crescimento"), ("diseño", "design"), ("construcción", "construção"), ("construccion", "construcao"), ("estructura", "estrutura"), ("salud", "saúde"), ("enfermedad", "doença"), ("tratamiento", "tratamento"),
    ]
    return {
        "q_sections": f"with {segments('detect')} select doc_id, pos, name, category, start, substr(content, 1, 3000) as content from sec",
        "q_section_totals": f"with {segments('detect')} select category, count(*) as n, cast(sum(length(substr(content, 1, 3000))) as bigint) as characters, count(distinct doc_id) as documents from sec group by 1",
        "q_statistics": f"with src as (select doc_id, text from documents where text is not null), f as ({family_counts('text')}) select doc_id, family, cast(len(found) as int) as n, array_to_string({uniq(found)}[1:20], '|') as matches from f where len(found) > 0",
        "q_analysis_sections": f"with {segments()}, src as (select doc_id, pos, substr(content, 1, 8000) as part from sec), f as ({family_counts('part', ', pos')}), g as (select doc_id, pos, string_agg(family || ':' || len(found), '|' order by o) as statistics from f where len(found) > 0 group by 1, 2) select sec.doc_id, sec.pos, name, category, substr(content, 1, 5000) as content, cast(length(content) as int) as content_length, coalesce(statistics, '') as statistics, statistics is not null or regexp_matches(substr(content, 1, 8000), '\\d+[.,]\\d+') as has_numbers from sec left join g using (doc_id, pos)",
        "q_analysis": f"with {segments()}, src as (select doc_id, pos, substr(content, 1, 8000) as part from sec), f as ({family_counts('part', ', pos')}), g as (select distinct doc_id, pos, 1 as has from f where len(found) > 0), s as (select doc_id, count(*) as n, sum(coalesce(has, 0)) as w, list(category order by pos) as cats from sec left join g using (doc_id, pos) group by 1), k as ({types})"
        f" select k.doc_id, {kind} as document_type, {language} as language, cast(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: length(w) > 1)) as int) as total_words, coalesce(n, 0) as total_sections, cast(coalesce(w, 0) as bigint) as sections_with_statistics, cast({' + '.join(f"len(regexp_extract_all(text, {q(p)}, 0, '{c}'))" for _, p, c in FAMILIES)} as int) as statistical_items, coalesce(array_to_string({uniq('cats')}, '|'), '') as categories from k left join s using (doc_id)",
        "q_extract_section": f"with {segments()}, m as (select *, strip_accents(lower(name)) as low from sec), g as (select doc_id, list(name order by pos) as names, first(name order by pos) filter (where contains(low, 'metodologia') or contains('metodologia', category) or contains(category, 'metodologia')) as name, first(category order by pos) filter (where contains(low, 'metodologia') or contains('metodologia', category)) as category, string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by pos) filter (where contains(low, 'metodologia') or contains('metodologia', category)) as content from m group by 1)"
        f" select d.doc_id, name is not null as found, name, category, content, cast(length(content) as int) as content_length, coalesce(array_to_string({uniq('names')}, '|'), '') as available from documents d left join g using (doc_id) where d.text is not null",
        "q_citations": f"with r as (select doc_id, {refs} as refs from documents where text is not null), n as (select doc_id, refs, regexp_extract_all(refs, '\\[(\\d+)\\]\\s*([^\\[]{{10,500}})', 1) as i, regexp_extract_all(refs, '\\[(\\d+)\\]\\s*([^\\[]{{10,500}})', 2) as t, list_filter(list_transform(list_filter(string_split(refs, chr(10)), lambda v: length({trimmed('v')}) > 20)[1:100], lambda v: {squeeze('v')}), lambda v: regexp_matches(v, '\\b(?:19|20)\\d{{2}}\\b')) as ls from r where refs <> ''),"
        f" e as (select doc_id, cast(unnest(i) as int) as \"index\", unnest(list_transform(t, lambda v: {squeeze('v')})) as entry, false as lined from n union all select doc_id, cast(generate_subscripts(ls, 1) as int), unnest(ls), true from n where len(i) = 0) select doc_id, \"index\", substr(entry, 1, 300) as entry, trim(case when lined then regexp_extract(entry, '^([^(,.]+)', 1) else regexp_extract(entry, '^([^,.]+)', 1) end) as authors, {year} as year from e",
        "q_doc_type": f"select doc_id, {kind} as kind from ({types})",
        "q_language_id": f"select doc_id, {language} as detected from documents where text is not null",
        "q_summary_budget": f"with {seg}, b as (select *, {rank} as rank, min(pos) over (partition by doc_id, name) as first, least(length(content), cast(floor(4000 / least(count(*) over (partition by doc_id), 6)) as int)) as take from sec), u as (select *, coalesce(sum(take) over (partition by doc_id order by rank, pos rows between unbounded preceding and 1 preceding), 0) as used from b) select doc_id, cast(row_number() over (partition by doc_id order by first, rank, pos) as int) as pos, name, category, cast(used as int) as used_before, substr(content, 1, cast(least(take, 4000 - used) as int)) as preview from u where used < 4000",
        "q_enrich": f"with {enrichment()} select seq, score, title, array_to_string(authors, '|') as authors, year, doi, abstract, pdf_url, university, {DISTINCT_GOT} as fields, {SCORE} as new_score from e4",
        "q_recovered_enrich": f"with {enrichment()} select field, count(*) as n from (select unnest({uniq('got')}) as field from e4) group by 1",
        "q_updated": f"with {enrichment()} select p.seq, case when e4.seq is not null then e4.year else p.year end as year, case when e4.seq is not null then e4.doi else p.doi end as doi, case when e4.seq is not null then e4.university else p.university end as university from papers p left join (select * from e4 where len(got) > 0) e4 on e4.seq = p.seq",
        "q_details_table": f"with {details} select * from det",
        "q_details_enrich": f"with {details}, p as (select p.*, d.page_id as k, d.title as dt, string_split(d.authors, '|') as da, d.year as dy, d.doi as dd, d.abstract as db, d.pdf_url as du, d.university as dn from papers p left join det d on d.page_id - 1 = p.seq and {need})"
        f" select seq, case when {has('dt')} and (title is null or title in ('', 'Sin título')) then dt else title end as title, array_to_string(case when k is not null and len(da) > 0 and coalesce(authors[1] = 'Autor Desconocido', false) then da else authors end, '|') as authors, case when (year is null or year = 0) and dy is not null and dy <> 0 then dy else year end as year, case when {has('dd')} and (doi is null or doi = '') then dd else doi end as doi,"
        f" case when coalesce(length(db) > coalesce(length(abstract), 0), false) then db else abstract end as abstract, case when {has('du')} then du else pdf_url end as pdf_url, case when {has('dn')} and (university is null or university in ('', 'Universidad Peruana', 'Universidad', 'Universidad Nacional')) then dn else university end as university, case when {has('du')} and {has('pdf_url')} then pdf_url end as enrichment_url from p",
        "q_simple_enrich": "with m as (select p.seq, min(r.rec_id) as rec_id from (select seq, lower(substr(title, 1, 20)) as part from papers where length(title) >= 1) p join repo_records r on contains(lower(r.title), p.part) group by 1), f as (select m.seq, r.year as fy, r.title as fa, length(r.title) as fc from m join repo_records r using (rec_id)) select p.seq, case when coalesce(length(abstract), 0) < 150 and length(fa) > coalesce(length(abstract), 0) then fa else abstract end as abstract, case when year is null or year = 0 then coalesce(fy, year) else year end as year, coalesce(nullif(citation_count, 0), fc) as citation_count from papers p left join f on f.seq = p.seq and not coalesce(length(p.abstract), 0) > 200",
        "q_handle_rewrite": f"with {dim}, l as (select rec_id, case when rec_id % 3 = 0 then 'https://other.example/handle/' else 'http://hdl.handle.net/' end || handle as link from repo_records where handle is not null), m as (select l.rec_id, arg_min(struct_pack(pattern := pattern, base := base, name := name), ord) as m from l join dim on pattern <> '' and contains(link, pattern) group by 1) select l.rec_id, link, case when contains(link, 'hdl.handle.net') and m is not null then m.base || '/' || substr(link, instr(link, m.pattern)) else link end as resolved, m.name as repository from l left join m using (rec_id)",
        "q_university_lookup": "with a as (select regexp_extract(id, '(20\\.500\\.\\d+)', 1) as key, arg_min(university, seq) as name from papers where id like '20.500.%' and university <> '' group by 1), b as (select split_part(id, '_', 1) as key, arg_min(university, seq) as name from papers where contains(id, '_') and university <> '' and split_part(id, '_', 1) <> '' group by 1), p as (select seq, university, case when regexp_extract(id, '(20\\.500\\.\\d+|\\d{4,})', 1) <> '' then regexp_extract(id, '(20\\.500\\.\\d+|\\d{4,})', 1) else regexp_extract(coalesce(handle_url, ''), 'handle/(20\\.500\\.\\d+|\\d+)', 1) end as p, split_part(id, '_', 1) as a from papers) select seq, case when university is null or university in ('', 'Universidad Peruana', 'Universidad') then coalesce(a.name, b.name, university) else university end as university from p left join a on a.key = p.p left join b on b.key = p.a",
        "q_doi_by_name": f"with f as (select seq, {last} as author, cast(year as varchar) as y, year from papers), g as (select * from f where author <> '' and regexp_matches(y, '^(?:19|20)\\d\\d')), r as (select rec_id, year, list_transform(authors, lambda a: strip_accents(lower(a))) as authors, doi, row_number() over (partition by year order by rec_id) as n from repo_records where doi <> ''), j as (select seq, doi, rec_id, coalesce(len(list_filter(authors, lambda a: contains(a, author))) > 0, false) as hit from g join r on r.year = g.year where n <= 50) select seq, arg_min(doi, (case when hit then 0 else 1 end, rec_id)) as doi from j group by 1",
        "q_full_text": f"with p as (select seq, pdf_url, {bare('doi')} as d from papers), x as (select p.*, u.u, s.u as s, c.u as c, coalesce(d <> '', false) as has, case when regexp_matches(pdf_url, '^https?://', 'i') then pdf_url end as own from p left join (select key, nullif(pdf_url, '') as u from {first_by_doi('pdf_url', "pdf_url like '%fulltext%'")}) u on u.key = d left join (select key, nullif(pdf_url, '') as u from {first_by_doi('pdf_url', "pdf_url like '%.pdf'")}) s on s.key = d left join (select key, nullif(pdf_url, '') as u from {first_by_doi('pdf_url', "pdf_url <> ''")}) c on c.key = d)"
        " select seq, case when has then coalesce(u, s, c, 'https://doi.org/' || d) else own end as location, case when has then case when u is not null then 'unpaywall' when s is not null then 'semantic' when c is not null then 'core' else 'doi' end when own is not null then 'own' else 'none' end as step, case when has then case when u is not null then 'unpaywall' when s is not null then 'unpaywall>semantic' when c is not null then 'unpaywall>semantic>core' else 'unpaywall>semantic>core>doi' end else '' end as steps from x",
        "q_file_stages": f"with p as (select seq, pdf_url, handle_url, case when seq % 7 = 0 then 'https://x.example/PMC' || seq else url end as url, {bare('doi')} as d from papers), x as (select seq, case when regexp_matches(lower(pdf_url), '\\.pdf(?:[?#]|$)') then pdf_url end as a, 'https://pmc.ncbi.nlm.nih.gov/articles/' || nullif(upper(regexp_extract(concat_ws(' ', url, pdf_url, handle_url), '(PMC\\d+)', 1, 'i')), '') || '/pdf/' as b, 'https://doi.org/' || nullif(d, '') as c, case when contains(handle_url, '/handle/') then handle_url end as e, case when regexp_matches(url, '^https?://', 'i') then url end as f from p) select seq, case when a is not null then 'direct' when b is not null then 'pmc' when c is not null then 'doi' when e is not null then 'repository' when f is not null then 'page' else 'none' end as stage, coalesce(a, b, c, e, f) as url from x",
        "q_route_kinds": f"with l as (select unnest([pdf_url, url, handle_url, doi, '/tmp/' || id]) as x from papers) select coalesce({link_kind}, 'unknown') as kind, count(*) as n from l where x is not null group by 1",
        "q_resolution_error": f"with p as (select seq, doi, source, {bare('doi')} as x from papers where doi <> ''), k as (select *, {link_kind} as kind from p) select seq, concat_ws(chr(10), 'No full text found for: ' || doi, 'Tried: ' || array_to_string(string_split(source, 'a'), ', '), case kind when 'local' then 'The path cannot be reached from here; give a link or a DOI.' when 'doi' then 'The publisher may not offer an open copy; try the repository of the authors.' else 'Check the link, or give the DOI of the work.' end) as message from k",
        "q_convert_chain": "with m as (select file_id, min(markdown) as l from markdown_results group by 1) select file_id, coalesce(nullif(l, ''), nullif(text, '')) as content, case when l <> '' then 'local' when text <> '' then 'text' else 'error' end as engine from pdf_texts left join m using (file_id)",
        "q_via": "select seq, 'Redalyc (via OpenAlex)' as source from papers",
        "q_page_abstract": f"with p as (select page_id, {page_text} as a from scraped_pages) select page_id, case when page_id % 4 = 3 then null when length(trim(a)) <= 50 then null else trim(case when page_id % 4 = 0 then a else regexp_replace(a, 'resumen:?|abstract:?', '', 'gi') end) end as abstract from p",
        "q_bitstreams": "with p as (select page_id, regexp_extract(url, '^(https://[^/]+)', 1) as o, regexp_extract(url, '^(https://[^?#]*/)', 1) as f, regexp_extract(url, 'handle/([^/?]+/[^/?]+)', 1) as h from scraped_pages where url like 'https://%') select page_id, case page_id % 3 when 0 then o || '/bitstream/' || page_id || '/a.pdf ' || f || 'files/c.pdf?x=1' when 1 then 'https://o.example/api/core/bitstreams/' || page_id || '/content' else case when h <> '' then o || '/bitstream/handle/' || h || '/1/Tesis.pdf' else '' end end as links from p",
        "q_best_file": "with p as (select source, seq, pdf_url, regexp_extract(pdf_url, '([^/]*)$', 1) || '.pdf' as n, coalesce(citation_count, 0) * 20000 / 1048576.0 as mb from papers where pdf_url <> ''), s as (select *, case when regexp_matches(n, 'licen|autorizacion|declaracion|formulario|similitud|turnitin', 'i') then -100 else 0 end + case when regexp_matches(n, 'resumen|abstract|portada|indice|anexo|apendice', 'i') then -50 else 0 end + case when regexp_matches(n, 'tesis|trabajo_de_grado|proyecto|investigacion|completo|main', 'i') then 50 else 0 end + case when mb > 1 then 10 else 0 end + case when mb > 5 then 20 else 0 end as score from p) select source, arg_max(pdf_url, (score, -seq)) as best from s group by 1",
        "q_shell_pages": "select page_id from scraped_pages where page_id % 5 in (0, 2)",
        "q_challenge_pages": "select page_id from scraped_pages where page_id % 5 = 1 or regexp_matches(coalesce(title, ''), 'captcha|cloudflare|checking your browser|access denied|verify you are human|anubis|proof-of-work|challenge-platform|just a moment|ddos protection', 'i')",
        "q_preferred_link": "with l as (select seq, list_filter([url, pdf_url || '.jpg', handle_url, pdf_url], lambda x: x is not null) as l from papers), k as (select seq, list_filter(l, lambda x: not regexp_matches(lower(x), '\\.(?:jpg|jpeg|png|gif|svg|xml|docx|doc|ppt|pptx|xls|xlsx)$|thumbnail|preview')) as k from l) select seq, coalesce(list_filter(k, lambda x: lower(x) like '%.pdf')[1], list_filter(k, lambda x: lower(x) like '%.txt')[1], k[1]) as link from k",
        "q_pdf_bytes": "select file_id, file_id % 2 = 0 and octet_length(encode('%PDF-' || text)) > 1500 as pdf from pdf_texts where text is not null",
        "q_dspace7": "select cast(rec_id as varchar) as id, nullif(title, '') as title, array_to_string(list_append(coalesce(authors, []), 'Z'), '|') as authors, cast(nullif(regexp_extract(date_issued, '(\\d{4})', 1), '') as int) as year, 'Here' as university from repo_records",
        "q_portuguese": "select seq, trim(replace(" + "x" + ", chr(1), '')) as query from (select seq, " + "regexp_replace(" * len(pt) + "lower(concat_ws(' ', matched_query, 'análisis de la calidad'))" + "".join(f", '\\b{a}\\b', '{b}', 'g')" for a, b in pt) + " as x from papers)",
        "q_fallback": f"with a as ({byq("source = 'alixia'")}), b as ({byq("source = 'renata'")}), c as ({byq("source = 'indexa'")}), x as (select *, 0 as level, 'Main' as source from a union all select *, 1, 'Main (via openalex)' from b union all select *, 2, 'Main (via scielo)' from c) select query_id, seq, source, level > 0 as is_fallback from (select *, min(level) over (partition by query_id) as first from x where query_id is not null) where level = first",
        "q_merged_fallback": f"with a as (select query_id, seq % 50 as id from ({byq("source = 'renata'")})), b as (select query_id, seq % 50 as id from ({byq("source = 'alixia'")})), n as (select query_id, count(*) as n from a group by 1) select * from a union all select b.query_id, b.id from b left join n using (query_id) where coalesce(n, 0) < 5 and not exists (select 1 from a where a.query_id = b.query_id and a.id = b.id)",
        "q_record_page": f"with p as (select page_id, trim(regexp_replace(replace(regexp_replace(coalesce(abstract, ''), '[<>]', '', 'g'), '&#', '#'), '\\s+', ' ', 'g')) as a from scraped_pages) select page_id, case when length(a) > 50 and not contains(a, 'Repositorio Institucional') then trim(regexp_replace(regexp_replace({_entities('a')}, '\\.{{2,3}}\\s*descripci[oó]n completa\\s*$', '', 'i'), '\\s+', ' ', 'g')) end as abstract, 'https://hdl.handle.net/1/' || page_id as handle, '/bitstream/' || page_id || '/x.pdf' as pdf_url from p",
        "q_record_id": f"select seq, 'rec_' || lower(to_base(abs(h), 36)) as record_id from (select seq, list_reduce(list_prepend(0::bigint, list_transform(string_split(x, ''), lambda c: ascii(c)::bigint)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) as h from (select seq, strip_accents(lower(url)) || '|' || regexp_replace(strip_accents(lower(title)), '[^\\x00-\\x7f]', '', 'g') as x from papers where url is not null and title is not null))",
        "q_recover": f"with r0 as (select p.seq, p.title as t0, {bare('p.doi')} as d from papers p where p.doi <> ''), r1 as (select r0.*, a.key is not null as ga, coalesce(nullif(a.title, ''), t0) as title, case when len(a.authors) > 0 then a.authors else [] end as authors, case when a.year <> 0 then a.year end as year, coalesce(nullif(a.abstract, ''), '') as abstract, nullif(a.university, '') as university, nullif(a.pdf_url, '') as pdf_url, list_filter([case when a.title <> '' then 'title' end, case when a.abstract <> '' then 'abstract' end, case when a.year <> 0 then 'year' end, case when len(a.authors) > 0 then 'authors' end, case when a.university <> '' then 'university' end, case when a.pdf_url <> '' then 'pdf_url' end], lambda x: x is not null) as got from r0 left join {first_by_doi('title,authors,year,abstract,university,pdf_url', "source = 'indexa'")} a on a.key = d),"
        f" r2 as (select r1.seq, r1.d, r1.title, r1.authors, r1.university, r1.pdf_url, case when length(r1.abstract) < 100 and length(c.abstract) > length(r1.abstract) then c.abstract else r1.abstract end as abstract, case when length(case when length(r1.abstract) < 100 and length(c.abstract) > length(r1.abstract) then c.abstract else r1.abstract end) is not null and length(r1.abstract) < 100 and (r1.year is null or r1.year = 0) and c.year <> 0 then c.year else r1.year end as year, got || case when length(r1.abstract) < 100 and coalesce(length(c.abstract) > length(r1.abstract), false) then ['abstract'] else [] end || case when length(r1.abstract) < 100 and (r1.year is null or r1.year = 0) and coalesce(c.year <> 0, false) then ['year'] else [] end as got from r1 left join {first_by_doi('abstract,year', 'length(abstract) > 0')} c on c.key = d),"
        f" r3 as (select r2.seq, r2.d as doi, r2.title, case when len(r2.authors) = 0 and len(o.authors) > 0 then o.authors else r2.authors end as authors, r2.university, case when r2.pdf_url is null and o.pdf_url <> '' then o.pdf_url else r2.pdf_url end as pdf_url, case when o.abstract <> '' and length(r2.abstract) < 50 then o.abstract else r2.abstract end as abstract, r2.year, got || case when len(r2.authors) = 0 and coalesce(len(o.authors) > 0, false) then ['authors'] else [] end || case when coalesce(o.abstract <> '', false) and length(r2.abstract) < 50 then ['abstract'] else [] end || case when r2.pdf_url is null and coalesce(o.pdf_url <> '', false) then ['pdf_url'] else [] end as got from r2 left join {first_by_doi('authors,abstract,pdf_url', "pdf_url like '%.pdf'")} o on o.key = d)"
        f" select seq, title, array_to_string(list_filter(authors, lambda a: a is not null), '|') as authors, year, abstract, pdf_url, {DISTINCT_GOT} as fields, case when length(title) > 10 then 15 else 0 end + case when length(abstract) > 100 then 25 else 0 end + case when year <> 0 then 10 else 0 end + case when doi <> '' then 15 else 0 end + case when pdf_url <> '' then 15 else 0 end + case when len(authors) > 0 then 10 else 0 end + case when university <> '' then 10 else 0 end as score from r3",
        "q_plain_query": "select seq, trim(regexp_replace(regexp_replace(lower(title), '[^A-Za-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as query from papers",
        "q_cache_key": "select seq, 'search:{' || concat_ws(',', '\"source\":\"' || source || '\"', '\"year\":' || year) || '}' as cache_key from papers",
        "q_query_budget": "select asked, cast(least(60, greatest(20, ceil(least(asked, 120) / (asked % 6 + 1)) + 10)) as int) as budget from range(1, 201) t(asked)",
        "q_merged_stats": "select source, count(*) as found, cast(sum(length(title)) as bigint) as time, 0 as errors from papers group by 1",
        "q_seeded_sample": "select doc_id from documents order by md5(doc_id || ':42'), doc_id limit 30",
        "q_low_first": f"select seq, score from (select seq, {SCORE} as score from papers) where score < 70 order by score, seq limit 50",
        "q_block_counts": "with l as (select md_id, string_split(markdown, chr(10)) as l from markdown_results where markdown is not null) select md_id, " + ", ".join(f"nullif(cast(len(list_filter(l, lambda x: regexp_matches(x, '{p}'))) as int), 0) as {n}" for n, p in (("headings", "^#+\\s"), ("rows", "^\\s*\\|"), ("texts", "^\\p{L}"))) + " from l",
        "q_cache_age": "select count(*) as entries, max(epoch_us(ts)) - min(epoch_us(ts)) as oldest_micros from events",
        "q_serial_queue": "select event_id, max(epoch_us(ts) - n * 2000000) over (order by ts, event_id) + n * 2000000 as start from (select *, row_number() over (order by ts, event_id) as n from events)",
        "q_backoff": "select attempt, cast(2 * power(2, attempt) as int) as seconds, cast(3 * power(3, attempt) as int) as slow from range(6) t(attempt)",
        "q_ndjson": "with l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as l from documents where text is not null) select doc_id, cast(generate_subscripts(l, 1) as int) as pos, unnest(l) as line from l",
        "q_formats": "select case when regexp_matches(lower(pdf_url), '\\.pdf$') then 'pdf' when regexp_matches(lower(pdf_url), '\\.docx?$') then 'docx' when regexp_matches(lower(pdf_url), '\\.pptx?$') then 'pptx' when regexp_matches(lower(pdf_url), '\\.xlsx?$') then 'xlsx' when regexp_matches(lower(pdf_url), '\\.(?:png|jpg|jpeg)$') then 'image' when regexp_matches(lower(pdf_url), '\\.html$') then 'html' else 'unknown' end as kind, count(*) as n from papers where pdf_url is not null group by 1",
        "q_formulas": "with m as (select md_id, '$$a+b$$ x \\(c\\) $$ a+b $$ ' || markdown as x from markdown_results where markdown is not null), f as (select md_id, list_transform(regexp_extract_all(x, '\\$\\$.+?\\$\\$', 0, 's') || regexp_extract_all(x, '\\\\\\[.+?\\\\\\]', 0, 's') || regexp_extract_all(x, '\\$[^\\n$]+\\$', 0) || regexp_extract_all(x, '\\\\\\(.+?\\\\\\)', 0, 's'), lambda v: trim(v)) as f from m) select md_id, array_to_string(list_filter(f, lambda v, i: list_position(f, v) = i), '|') as found from f",
        "q_smart_truncate": "with m as (select md_id, markdown as x, substr(markdown, 1, 1000) as h from markdown_results where markdown is not null), c as (select *, length(regexp_extract(h, '^(.*)\\n#{1,6}\\s', 1, 's')) as a, length(regexp_extract(h, '^(.*)\\n---', 1, 's')) as b, length(regexp_extract(h, '^(.*)\\n\\n', 1, 's')) as d, length(regexp_extract(h, '^(.*)\\n', 1, 's')) as e from m), k as (select *, case when a > 700 then a when b > 700 then b when d > 700 then d when e > 700 then e else 1000 end as cut from c) select md_id, case when length(x) <= 1000 then x else substr(x, 1, cut) || chr(10) || chr(10) || '[... Contenido truncado. ' || format('{:,}', length(x) - cut) || ' caracteres restantes ...]' end as kept from k",
    }
