"""P4: for each work with several rows, the row whose value survives, attribute by attribute.

Rows are grouped into works by the links of ``matches``; then a single aggregation takes, for each attribute, the maximum of
a composite struct (genuine value, time, arrival), so nothing is sorted and no group is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..tables import checkpointed, small_hashed
from .cuts import judged
from .genuine import NO_PLACE, PLACEHOLDERS, listed
from .matches import candidates, compared, hot_codes, prepared

# Names of files that go with a work but are not its full text.
OTHER_FILES = r"(licen[sc]|car[aá]tula|portada|cover|autorizaci|authori[sz]ation|reporte_similitud|similitud|turnitin|formulario|form\b|acta|declaraci|thumb|resumen|abstract|indice)"


def works(papers: DataFrame, key: str = "seq", source_id: str = "id") -> DataFrame:
    """(key, work): rows of one work share ``work``. Rows delivered again under one source id belong together whatever else they say."""
    members, classes, sent, buckets = prepared((papers, key, "l"))
    links = compared(small_hashed(candidates(buckets, False, checkpointed(hot_codes(classes, sent)))), classes, sent).select("a", "b")
    ids = papers.where(F.col(source_id).isNotNull() & (F.trim(source_id) != "")).select(F.col(key).cast("long").alias("id"), F.col(source_id).alias("own"))
    own = members.join(ids, "id").groupBy("own", "sig").agg(F.lit(1).alias("one")).select("own", "sig")
    firsts = own.groupBy("own").agg(F.min("sig").alias("a"), F.max("sig").alias("z")).where("a <> z").drop("z")
    again = own.join(firsts, "own").where("sig <> a").select("a", F.col("sig").alias("b"))
    roots = components(links.unionByName(again))
    return members.join(roots, F.col("sig") == F.col("node"), "left").select(F.col("id").alias(key), F.coalesce("root", "sig").alias("work"))


def particular(university: Column) -> Column:
    """Whether a value names a particular institution."""
    return university.isNotNull() & (F.trim(university) != "") & ~listed(university, PLACEHOLDERS, NO_PLACE)


def full_text(url: Column) -> Column:
    """Whether a link leads to the full text of the work, not to a page, cover, picture, licence or form."""
    whole = F.trim(url)
    path = F.when(whole.contains("?") | whole.contains("#"), F.regexp_replace(whole, r"[?#].*$", "")).otherwise(whole)
    name = F.lower(F.substring_index(path, "/", -1))
    return F.coalesce(F.lower(F.trim(url)).rlike(r"^https?://") & name.endswith(".pdf") & ~name.rlike(OTHER_FILES), F.lit(False))


def survivors(papers: DataFrame, key: str = "seq", work: DataFrame | None = None) -> DataFrame:
    """(key, field): for each work with two rows or more, the row whose abstract, university and pdf_url survive.

    Of several genuine values the one fetched last is taken, then the smallest key; an attribute without any gives no row.
    Null times come before all others. Repeated rows count as rows. ``work`` is (key, work) if it is known already.
    """
    work = works(papers, key) if work is None else work
    whole = judged(papers, "abstract").where("how is null").select(F.col("seq").alias("whole"))
    rows = papers.select(F.col(key).cast("long").alias(key), "university", "pdf_url", F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("at"))
    rows = rows.join(work, key).join(whole.distinct(), F.col(key) == F.col("whole"), "left")
    rank = F.struct(F.coalesce("at", F.lit(-(1 << 62))).alias("at"), (-F.col(key)).alias("order"))
    best = rows.groupBy("work").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("whole").isNotNull(), rank)).alias("abstract"),
        F.max(F.when(particular(F.col("university")), rank)).alias("university"), F.max(F.when(full_text(F.col("pdf_url")), rank)).alias("pdf_url"),
    ).where("n > 1")
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}.order").alias("order")) for f in ("abstract", "university", "pdf_url")))
    return best.select(F.explode(fields).alias("x")).where("x.order is not null").select((-F.col("x.order")).alias(key), "x.field")


def merged(papers: DataFrame, key: str = "seq") -> DataFrame:
    """(work, n, abstract, university, pdf_url): the surviving record of each work with two rows or more."""
    work = checkpointed(works(papers, key))
    chosen = survivors(papers, key, work)
    counts = work.groupBy("work").agg(F.count("*").alias("n"))
    values = chosen.join(papers.select(F.col(key).cast("long").alias(key), "abstract", "university", "pdf_url"), key).join(work, key)
    pick = lambda f: F.max(F.when(F.col("field") == f, F.col(f))).alias(f)
    return values.groupBy("work").agg(*(pick(f) for f in ("abstract", "university", "pdf_url"))).join(counts, "work")


