"""Analysis of document text: sections, statistics, citations, language, type, budgets."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Section names, categories and patterns, in order of priority.
SECTIONS = [
    ("Resumen / Abstract", "front", "resumen|abstract|sumario"),
    ("Palabras Clave / Keywords", "front", r"palabras\s+clave|keywords|key\s+words"),
    ("Introducción / Introduction", "intro", r"introducci[oó]n|introduction"),
    ("Planteamiento del Problema", "intro", r"planteamiento\s+del\s+problema|problem\s+statement|formulaci[oó]n\s+del\s+problema|definici[oó]n\s+del\s+problema"),
    ("Justificación", "intro", "justificaci[oó]n|justification|importancia|relevancia|motivation"),
    ("Objetivos", "intro", "objetivos?|objectives?|goals?|aims?"),
    ("Hipótesis", "intro", "hip[oó]tesis|hypothesis|hypotheses"),
    ("Marco Teórico", "theory", r"marco\s+te[oó]rico|theoretical\s+framework|fundamento\s+te[oó]rico|bases\s+te[oó]ricas|theoretical\s+background|state\s+of\s+the\s+art"),
    ("Antecedentes", "theory", r"antecedentes|background|related\s+work|literature\s+review|revisi[oó]n\s+de\s+literatura|estado\s+del\s+arte|trabajos\s+previos|prior\s+work"),
    ("Bases Conceptuales", "theory", r"bases\s+conceptuales|marco\s+conceptual|conceptual\s+framework|definici[oó]n\s+de\s+t[eé]rminos|glosario"),
    ("Marco Legal", "theory", r"marco\s+legal|marco\s+normativo|legal\s+framework|regulatory\s+framework"),
    ("Metodología / Methods", "methods", r"metodolog[ií]a|methods?|methodology|materiales?\s+y\s+m[eé]todos?|materials?\s+and\s+methods?|procedimiento|approach|proposed\s+method|dise[ñn]o\s+metodol[oó]gico"),
    ("Población y Muestra", "methods", r"poblaci[oó]n\s+y\s+muestra|population\s+and\s+sample|sample\s+size|muestra|participants?|participantes|sujetos"),
    ("Instrumentos", "methods", r"instrumentos?\s+de\s+recolecci[oó]n|instruments?|herramientas|cuestionario|encuesta|survey|data\s+collection"),
    ("Diseño Experimental", "methods", r"dise[ñn]o\s+experimental|experimental\s+design|experimental\s+setup|setup|implementaci[oó]n|implementation"),
    ("Resultados / Results", "results", "resultados|results|findings|hallazgos"),
    ("Análisis de Datos", "results", r"an[aá]lisis\s+de\s+(?:datos|resultados)|data\s+analysis|analysis\s+of\s+results|an[aá]lisis\s+estad[ií]stico|statistical\s+analysis"),
    ("Discusión / Discussion", "results", "discusi[oó]n|discussion|interpretaci[oó]n"),
    ("Conclusiones / Conclusions", "conclusion", r"conclusi[oó]n|conclusions?|concluding\s+remarks"),
    ("Recomendaciones", "conclusion", r"recomendaciones|recommendations|sugerencias|suggestions|future\s+work|trabajo\s+futuro|trabajos?\s+futuros?"),
    ("Referencias / References", "back", r"referencias|references|bibliograf[ií]a|bibliography|works\s+cited"),
    ("Anexos / Appendix", "back", r"anexos?|appendix|appendices|ap[eé]ndices?|supplementary|material\s+complementario"),
]
# Families of statistical expressions.
STATISTICS = [
    ("p-value", r"p\s*[<>=≤≥]\s*0?\.\d+"), ("percentage", r"\d+[.,]\d*\s*%"), ("mean_std", r"(?:media|mean|promedio|average|M)\s*[=:]\s*\d+[.,]?\d*"), ("correlation", r"r\s*[=]\s*[+-]?0?\.\d+"),
    ("chi_square", r"(?:chi|χ)[²2]\s*[=()]\s*\d+[.,]?\d*"), ("confidence_interval", r"(?:IC|CI)\s*[=:(\[]\s*\d+"), ("t_test", r"t\s*[=(]\s*\d+[.,]?\d*"), ("f_test", r"F\s*[=(]\s*\d+[.,]?\d*"),
    ("n_sample", r"(?:n|N)\s*[=]\s*\d+"), ("alpha", r"(?:α|alfa|alpha)\s*[=]\s*0?\.\d+"), ("r_squared", r"R[²2]\s*[=]\s*0?\.\d+"), ("anova", r"ANOVA|an[aá]lisis\s+de\s+varianza"),
    ("regression", r"regresi[oó]n\s+(?:lineal|log[ií]stica|m[uú]ltiple)|(?:linear|logistic|multiple)\s+regression"), ("table_reference", r"(?:tabla|table|cuadro|figure|figura)\s+\d+"),
]
PRIORITY = ["front", "conclusion", "results", "methods", "intro", "theory"]
SPANISH, ENGLISH = "de|en|la|el|los|las|del|para|por|con|una|que|como", "the|and|of|in|to|for|with|that|this|from|are|was"
EXACT_CASE = ("percentage", "n_sample")
EDGES = r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$"
WORD, ENDS = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def whole(pattern: str) -> str:
    """A lower-case pattern between ASCII word boundaries, for lower-cased text."""
    return f"{WORD}(?:{pattern}){ENDS}"


def trimmed(column: Column) -> Column:
    return F.regexp_replace(column, EDGES, "")


def section_number(line: Column) -> Column:
    """The number of the first section pattern in a line, or null. Most lines fit none, which one pattern of all tells."""
    low = F.lower(line)
    number = None
    for k, (_, _, pattern) in enumerate(SECTIONS):
        number = F.when(low.rlike(whole(pattern)), k) if number is None else number.when(low.rlike(whole(pattern)), k)
    return F.when(low.rlike(whole("|".join(p for _, _, p in SECTIONS))), number)


def _hits(text: Column, low: int, high: int, headings: bool) -> Column:
    """Array of (line, k): 0-based lines of ``low`` to ``high`` characters, or Markdown headings, that name section k."""
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("line"), trimmed(line).alias("t")))
    if headings:
        lines = F.transform(lines, lambda s: F.struct(s["line"].alias("line"), trimmed(F.regexp_extract(s["t"], r"^#{1,4}\s+(.+)", 1)).alias("t")))
    near = F.filter(lines, lambda s: F.length(s["t"]).between(low, high))
    return F.filter(F.transform(near, lambda s: F.struct(s["line"].alias("line"), section_number(s["t"]).alias("k"))), lambda s: s["k"].isNotNull())


def _kept(hits: Column) -> Column:
    """Hits without those of the same name as the last kept one that stand at most three lines below it."""
    empty = F.array().cast("array<struct<line:int,k:int>>")

    def step(kept: Column, hit: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        return F.when(last.isNull() | (last["k"] != hit["k"]) | (hit["line"] - last["line"] > 3), F.concat(kept, F.array(hit))).otherwise(kept)

    return F.aggregate(hits, empty, step)


def segments(documents: DataFrame, key: str, text: str, route: str = "analysis") -> DataFrame:
    """(key, pos, name, category, start, content): sections from header to header, in order; ``start`` is a 0-based character.

    Three routes. ``detect``: Markdown headings if two or more name a section, else lines of 1 to 79 characters. ``analysis``: lines of 3 to 99
    characters, of which close repetitions do not count. ``summary``: headings if three or more, else as analysis. No shuffle: all of it
    happens inside a document's row. Null texts and texts without a header have no row.
    """
    column = F.col(text)
    plain = _hits(column, 1, 79, False) if route == "detect" else _kept(_hits(column, 3, 99, False))
    rows = documents.where(column.isNotNull())
    if route == "analysis":
        rows = rows.select(key, column.alias("_text"), plain.alias("_heads"))
    else:
        rows = rows.select(key, column.alias("_text"), plain.alias("_plain"), F.when(column.contains("#"), _hits(column, 1, 1 << 30, True)).alias("_marked"))
        rows = rows.select(key, "_text", F.when(F.size("_marked") >= (2 if route == "detect" else 3), F.col("_marked")).otherwise(F.col("_plain")).alias("_heads"))
    starts = F.transform("_heads", lambda h: F.struct(h["k"].alias("k"), F.when(h["line"] == 0, 0).otherwise(F.length(F.call_function("substring_index", F.col("_text"), F.lit("\n"), h["line"])) + 1).alias("start")))
    rows = rows.where(F.size("_heads") > 0).select(key, "_text", starts.alias("_starts"))
    rows = rows.select(key, "_text", "_starts", F.posexplode("_starts").alias("_p", "_s"))
    end = F.coalesce(F.try_element_at("_starts", F.col("_p") + 2)["start"], F.length("_text"))
    table = lambda n: F.element_at(F.array(*(F.lit(x[n]) for x in SECTIONS)), F.col("_s.k") + 1)
    content = trimmed(F.substring("_text", F.col("_s.start") + 1, end - F.col("_s.start")))
    return rows.select(key, (F.col("_p") + 1).alias("pos"), table(0).alias("name"), table(1).alias("category"), F.col("_s.start").alias("start"), content.alias("content"))


def sections(documents: DataFrame, key: str, text: str, most: int = 3000) -> DataFrame:
    """(key, pos, name, category, start, content): detected sections, each with at most ``most`` characters."""
    return segments(documents, key, text, "detect").withColumn("content", F.substring("content", 1, most))


def statistics_of(text: Column) -> Column:
    """Array of (family, n, matches): number of expressions of each family in a text and the first 20 different ones."""
    found = []
    for name, pattern in STATISTICS:
        flags = "" if name in EXACT_CASE else "(?i)" if pattern.isascii() else "(?iu)"
        all_ = F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(0))
        found.append(F.struct(F.lit(name).alias("family"), F.size(all_).alias("n"), F.slice(F.array_distinct(F.transform(all_, trimmed)), 1, 20).alias("matches")))
    return F.filter(F.array(*found), lambda s: s["n"] > 0)


def statistics(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, family, n, matches): one row for each family found in a text."""
    return documents.where(F.col(text).isNotNull()).select(key, F.explode(statistics_of(F.col(text))).alias("x")).select(key, "x.family", "x.n", "x.matches")


def analysed_sections(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, name, category, content, content_length, statistics, has_numbers): each section with what stands in its first 8,000 characters."""
    rows = segments(documents, key, text).withColumn("part", F.substring("content", 1, 8000)).withColumn("statistics", statistics_of(F.col("part")))
    numbers = (F.size("statistics") > 0) | F.col("part").rlike(r"\d+[.,]\d+")
    return rows.select(key, "pos", "name", "category", F.substring("part", 1, 5000).alias("content"), F.length("content").alias("content_length"), "statistics", numbers.alias("has_numbers"))


def analysis(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, document_type, language, total_words, total_sections, sections_with_statistics, statistical_items, categories): one row for each text.

    ``categories`` are those of the sections in order of appearance. Null texts have no row; a text without a section has empty categories.
    """
    parts = analysed_sections(documents, key, text).select(F.col(key).alias("_k"), "pos", "category", (F.size("statistics") > 0).cast("int").alias("with"))
    parts = parts.groupBy("_k").agg(F.count("*").alias("total_sections"), F.sum("with").alias("sections_with_statistics"), F.sort_array(F.collect_list(F.struct("pos", "category"))).alias("_all"))
    rows = documents.where(F.col(text).isNotNull()).select(
        key, document_type(F.col(text)).alias("document_type"), language(F.col(text)).alias("language"), F.size(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 1)).alias("total_words"),
        F.aggregate(statistics_of(F.col(text)), F.lit(0), lambda n, s: n + s["n"]).alias("statistical_items"),
    )
    categories = F.array_join(F.array_distinct(F.transform("_all", lambda s: s["category"])), "|")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.join(parts, rows[key] == parts["_k"], "left").select(key, "document_type", "language", "total_words", zero("total_sections"), zero("sections_with_statistics"), "statistical_items", F.coalesce(categories, F.lit("")).alias("categories"))


def named_like(name: Column, category: Column, asked: str) -> Column:
    """Whether a section answers to what was asked: the name contains it, it contains the category or the reverse, or a word of more than three letters stands in either."""
    fold = lambda x: "".join(c for c in unicodedata.normalize("NFD", x.lower()) if not "\u0300" <= c <= "\u036f")
    query, low = fold(asked), F.lower(name)
    for title, _, _ in SECTIONS:
        low = F.when(name == title, fold(title)).otherwise(low)
    test = low.contains(query) | F.lit(query).contains(category) | category.contains(query)
    for word in query.split():
        if len(word) > 3:
            test = test | low.contains(word) | category.contains(word)
    return test


def extracted_section(documents: DataFrame, key: str, text: str, asked: str) -> DataFrame:
    """(key, found, name, category, content, content_length, statistics, available): all sections that answer to ``asked``, joined whole.

    ``available`` are the names of all sections in order. Null texts have no row; a text without a section has an empty list and nothing found.
    """
    rows = segments(documents, key, text).withColumn("_like", named_like(F.col("name"), F.col("category"), asked)).withColumnRenamed(key, "_k")
    parts = rows.groupBy("_k").agg(
        F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("_names"), F.sort_array(F.collect_list(F.when(F.col("_like"), F.struct("pos", "name", "category", "content")))).alias("_parts"),
    )
    base = documents.where(F.col(text).isNotNull()).select(key)
    first = F.try_element_at("_parts", F.lit(1))
    content = F.when(F.size("_parts") > 0, F.array_join(F.transform("_parts", lambda s: s["content"]), "\n\n---\n\n"))
    out = base.join(parts, base[key] == parts["_k"], "left").select(key, first["name"].alias("name"), first["category"].alias("category"), content.alias("content"), F.coalesce(F.array_join(F.array_distinct(F.transform("_names", lambda s: s["name"])), "|"), F.lit("")).alias("available"))
    return out.select(key, F.col("name").isNotNull().alias("found"), "name", "category", "content", F.length("content").alias("content_length"), statistics_of(F.col("content")).alias("statistics"), "available")


def language(text: Column) -> Column:
    """es, en or mixed, by function words in the first 5000 characters; compared in whole numbers."""
    head = F.lower(F.substring(text, 1, 5000))
    es, en = (F.regexp_count(head, F.lit(f"(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])")) for words in (SPANISH, ENGLISH))
    return F.when(2 * es > 3 * en, "es").when(2 * en > 3 * es, "en").otherwise("mixed")


def document_type(text: Column) -> Column:
    """thesis, article or unknown, by indicators in the first 10,000 characters, which are lower-cased once; fixed words are looked for before any pattern."""
    low = F.lower(F.substring(text, 1, 10000))
    any_of = lambda words: functools.reduce(lambda a, b: a | b, (low.contains(w) for w in words.split("|")))
    one = lambda test: F.when(test, 1).otherwise(0)
    thesis = (
        one(any_of("tesis|tesina|disertación|disertacion|dissertation|thesis")) + one(low.contains("optar") & low.rlike(r"para\s+optar\s+(?:el|al)\s+(?:t[ií]tulo|grado)"))
        + one(any_of("asesor|advisor|tutor") | (low.contains("director") & low.rlike(r"director\s+de\s+tesis"))) + one(any_of("universidad|university|facultad|faculty") | (low.contains("escuela") & low.rlike(r"escuela\s+de")))
        + one(any_of("bachiller|licenciatura|maestría|maestria|doctorado|master|phd"))
    )
    word = lambda w: F.lit(f"{WORD}{w}{ENDS}")
    after = F.substring(low, F.regexp_instr(low, word("abstract")), F.lit(1 << 30))
    article = (
        one(low.contains("abstract") & low.contains("introduction") & (F.regexp_instr(low, word("abstract")) > 0) & (F.regexp_instr(after, word("introduction")) > 0)) + one(any_of("journal|revista|proceedings|conference"))
        + one(low.contains("doi:") & low.rlike(r"doi:\s*10\.\d+")) + one((low.contains("submitted") | low.contains("published")) & low.rlike(whole(r"submitted\s+to|published\s+in")))
    )
    return F.when(thesis >= 2, "thesis").when(article >= 2, "article").when(thesis > article, "thesis").when(article > thesis, "article").otherwise("unknown")


def citations(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, index, entry, authors, year): entries after the first heading word of a list of references.

    Numbered entries of 10 to 500 characters; where there is none, the lines of more than 20 characters that hold a year, of the first 100, numbered in order.
    """
    refs = F.regexp_extract(text, rf"(?is){WORD}((?:references|bibliography|works\s+cited){ENDS}.*)$", 1)
    squeeze = lambda c: F.regexp_replace(trimmed(c), r"\s+", " ")
    pattern = F.lit(r"\[(\d+)\]\s*([^\[]{10,500})")
    numbered = F.arrays_zip(F.regexp_extract_all("_refs", pattern, F.lit(1)).alias("i"), F.regexp_extract_all("_refs", pattern, F.lit(2)).alias("t"))
    numbered = F.transform(numbered, lambda x: F.struct(x["i"].cast("int").alias("index"), squeeze(x["t"]).alias("entry"), F.lit(r"^([^,.]+)").alias("until")))
    lines = F.slice(F.filter(F.split("_refs", "\n"), lambda x: F.length(trimmed(x)) > 20), 1, 100)
    dated = F.filter(F.transform(lines, squeeze), lambda x: x.rlike(rf"{WORD}(?:19|20)\d{{2}}{ENDS}"))
    lined = F.transform(dated, lambda x, i: F.struct((i + 1).alias("index"), x.alias("entry"), F.lit(r"^([^(,.]+)").alias("until")))
    rows = documents.where(F.col(text).isNotNull()).select(key, refs.alias("_refs")).where("_refs <> ''").select(key, numbered.alias("_n"), lined.alias("_l"))
    rows = rows.select(key, F.explode(F.when(F.size("_n") > 0, F.col("_n")).otherwise(F.col("_l"))).alias("x")).select(key, "x.index", "x.entry", "x.until")
    year = F.nullif(F.regexp_extract("entry", rf"{WORD}((?:19|20)\d{{2}}){ENDS}", 1), F.lit(""))
    author = F.when(F.col("until") == r"^([^,.]+)", F.regexp_extract("entry", r"^([^,.]+)", 1)).otherwise(F.regexp_extract("entry", r"^([^(,.]+)", 1))
    return rows.select(key, "index", F.substring("entry", 1, 300).alias("entry"), F.trim(author).alias("authors"), year.alias("year"))


def summary(documents: DataFrame, key: str, text: str, total: int = 8000) -> DataFrame:
    """(key, pos, name, category, used_before, preview): by priority of category, how much of each section fits into ``total`` characters.

    ``pos`` is the order in which sections are shown: by the first section of the same name, and within a name by priority.
    """
    rows = segments(documents, key, text, "summary")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("category")), F.lit(0))
    by = W.partitionBy(key)
    rows = rows.withColumns({"rank": F.when(rank == 0, 99).otherwise(rank), "first": F.min("pos").over(W.partitionBy(key, "name")), "cap": F.floor(F.lit(total) / F.least(F.count("*").over(by), F.lit(6))).cast("int")})
    rows = rows.withColumn("take", F.least(F.length("content"), F.col("cap")))
    before = F.coalesce(F.sum("take").over(by.orderBy("rank", "pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    rows = rows.withColumn("used_before", before).where(F.col("used_before") < total)
    shown = F.row_number().over(by.orderBy("first", "rank", "pos"))
    return rows.select(key, shown.alias("pos"), "name", "category", "used_before", F.substring("content", F.lit(1), F.least("take", F.lit(total) - F.col("used_before"))).alias("preview"))
