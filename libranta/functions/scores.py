"""Scores of records; whole numbers, so results are exact on any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import missing, no_number

NO_AUTHOR, NO_UNIVERSITY = "Autor Desconocido", "Universidad Peruana"


def _points(*rules: tuple[Column, int]) -> Column:
    total = F.lit(0)
    for test, points in rules:
        total = total + F.when(test, points).otherwise(0)
    return total


def completeness(sentinels: bool = True) -> Column:
    """0 to 100: how much of a record is filled in; without ``sentinels`` placeholders count as values."""
    if not sentinels:
        return _points(
            (F.length("title") > 10, 15), (F.length("abstract") > 100, 25), (~no_number(F.col("year")), 10), (~missing(F.col("doi")), 15), (~missing(F.col("pdf_url")), 15), (F.size("authors") > 0, 10), (~missing(F.col("university")), 10),
        )
    author = F.coalesce(F.try_element_at("authors", F.lit(1)), F.lit(""))
    return _points(
        (F.length("title") > 10, 15), (F.length("abstract") > 100, 25), (~no_number(F.col("year")), 10), (~missing(F.col("doi")), 15), (~missing(F.col("pdf_url")), 15),
        ((F.size("authors") > 0) & (author != NO_AUTHOR), 10), (~missing(F.col("university")) & (F.col("university") != NO_UNIVERSITY), 10),
    )


def quality() -> Column:
    """0 to 90: by what the best of several records is chosen."""
    link = ~missing(F.col("pdf_url")) | ~missing(F.col("url")) | ~missing(F.col("handle_url"))
    points = _points((~missing(F.col("doi")), 20), (link, 15), (F.length("abstract") > 80, 20), (F.size("authors") > 0, 10), (~no_number(F.col("year")), 10), (~missing(F.col("university")), 5))
    return points + F.least(F.lit(10), F.coalesce("citation_count", F.lit(0))).cast("int")


def needs_enhancement() -> Column:
    tail = F.trim("abstract").rlike(r"(?iu)(\.\.\.|…|\[\.\.\.\]|\.\.\.\s*descripci[oó]n\s+completa)$")
    author = F.coalesce(F.try_element_at("authors", F.lit(1)) == NO_AUTHOR, F.lit(False))
    return author | F.col("abstract").isNull() | (F.length("abstract") < 80) | tail | missing(F.col("pdf_url")) | missing(F.col("university")) | (F.col("university") == NO_UNIVERSITY)


def file_score(name: Column, octets: Column) -> Column:
    """How likely a file is the main document of an item."""
    mb = octets / F.lit(1048576.0)
    admin = r"(?i)licen|autorizacion|declaracion|formulario|similitud|turnitin"
    return F.lit(0) + F.when(name.rlike(admin), -100).otherwise(0) + F.when(name.rlike("(?i)resumen|abstract|portada|indice|anexo|apendice"), -50).otherwise(0) + F.when(
        name.rlike("(?i)tesis|trabajo_de_grado|proyecto|investigacion|completo|main"), 50
    ).otherwise(0) + F.when(mb > 1, 10).otherwise(0) + F.when(mb > 5, 20).otherwise(0)
