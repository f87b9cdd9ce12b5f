"""Which values are genuine: neither missing, nor a placeholder, nor a notice in place of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholders and notices, lower-cased.
PLACEHOLDERS = "n/a|na|n.d.|s/n|null|none|nan|-|--|.|?|unknown|desconocido|sin datos|no especificado|not specified"
NO_TITLE = "sin título|sin titulo|untitled|no title|sem título|sans titre"
NO_NAME = "autor desconocido|anónimo|anonimo|anonymous|anônimo|et al.|et al|varios autores|arxiv author|pubmed author|scopus author|google scholar"
NO_PLACE = "universidad|universidad peruana|latinoamérica|latinoamerica|universidade|university|perú|peru"
NOTICE = (
    r"(?i)^\W*(sin resumen|no abstract|abstract not|not available|res[uú]m(en|o|é)s? (no |in|non )|el autor no ha|o autor não|the author has not"
    r"|l'auteur n'a|©|todos los derechos|all rights reserved|todos os direitos|tous droits|texto no disponible|ver documento|see (the )?(full|pdf)|véase)"
)


def listed(column: Column, *lists: str) -> Column:
    """Whether the trimmed, lower-cased value stands in one of the lists."""
    return F.lower(F.trim(column)).isin([x for one in lists for x in one.split("|")])


def genuine_text(column: Column) -> Column:
    """A text of its own; notices are short, so a long text that opens like one is kept."""
    notice = (F.length(column) < 100) & column.rlike(NOTICE)
    short = F.length(F.trim(column)) < 100  # as all placeholders are
    return column.isNotNull() & (F.trim(column) != "") & ~(short & listed(column, PLACEHOLDERS)) & ~notice


def genuine_title(column: Column) -> Column:
    return column.isNotNull() & (F.trim(column) != "") & ~listed(column, PLACEHOLDERS, NO_TITLE)
