"""P10: texts that look the same but differ in their characters.

A longest-match transducer over grapheme clusters rewrites widths, composed and decomposed accents,
kinds of blank, invisible characters, ligatures and look-alike letters in one pass. Its table is compiled
once and checked for conflicts: every output is a fixed point, so normalising twice changes nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import checkpointed

# Letters of other scripts that are drawn like Latin ones (after Unicode's list of confusables).
CYRILLIC = dict(zip("аеіорсухѕјԁһԛԝАВЕЅІЈКМНОРСТХУԚԜ", "aeiopcyxsjdhqwABESIJKMHOPCTXYQW", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναϲϳ", "ABEZHIKMNOPTYXovacj", strict=True))
ARMENIAN = dict(zip("օսոհցՕՍԼ", "ounhgOUL", strict=True))
OTHERS = dict(zip("ѵѴүҮӏӀɡɑ", "vVyYlIga", strict=True))
HYPHENS = dict.fromkeys("\u2010\u2011", "-")
# Characters that show nothing.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"
JOINERS = "\u200c\u200d"


def _singles() -> dict[str, str]:
    """Each character that has another, equal-looking form, from Unicode's decompositions by rule."""
    table = {}
    for code in range(0x80, 0x2FA20):
        char = chr(code)
        if unicodedata.category(char) == "Zs":
            table[char] = " "
            continue
        kind = unicodedata.decomposition(char)
        if kind.startswith(("<wide>", "<narrow>")) or 0xFB00 <= code <= 0xFB06:
            table[char] = unicodedata.normalize("NFKC", char)
        elif kind and not kind.startswith("<") and (same := unicodedata.normalize("NFC", char)) != char:
            table[char] = same
    table |= CYRILLIC | GREEK | ARMENIAN | OTHERS | HYPHENS | {"µ": "μ"}
    for code in [*range(0x386, 0x3D0), *range(0x400, 0x530)]:  # an accent on a look-alike
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and parts[0] in table and len(same := unicodedata.normalize("NFC", table[parts[0]] + parts[1])) == 1:
            table[chr(code)] = same
    return table


@lru_cache(1)
def compiled() -> tuple[re.Pattern, re.Pattern, re.Pattern, dict[str, str], dict[int, str]]:
    """Patterns of what must be rewritten, of what needs a look at its neighbours, and of all clusters; the table twice."""
    table = _singles()
    for _ in range(4):  # chains such as a full-width letter whose narrow form has a look-alike
        table = {k: "".join(table.get(c, c) for c in v) for k, v in table.items()}
    if bad := [k for k, v in table.items() if any(c in table for c in v)]:
        raise ValueError(f"conflicting mappings: {bad[:5]}")
    marks = "\u0300-\u036f\u0483-\u0487\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff"
    inside = "".join(re.escape(c) for c in table)
    return (
        re.compile("[^\x00-\x9f\xa1-\xac\xae-\xb4\xb6-\xff\u2013\u2014\u2018-\u201d\u2026]"),  # a small set of what surely stays; a set of all that changes is slow
        re.compile(f"[{marks}{JOINERS}]"),
        re.compile(f"[^\n](?:[{INVISIBLE}]*[{marks}])+|[{INVISIBLE}]+|[{inside}]"),
        table,
        {ord(k): v for k, v in table.items()} | dict.fromkeys(map(ord, INVISIBLE), ""),
    )


def _joined_script(char: str) -> bool:
    """Characters beside which a joiner is visible: pictographs, Arabic, Indic and South-East Asian letters."""
    code = ord(char)
    return code >= 0x1F000 or 0x2190 <= code <= 0x2BFF or code == 0xFE0F or 0x0600 <= code <= 0x08FF or 0x0900 <= code <= 0x109F


def one_form(text: str) -> str:
    """``text`` with every cluster in its single agreed form. Most texts need no cluster or only single characters and are done without looking at neighbours."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():
        return text
    special, context, clusters, table, codes = compiled()
    if not special.search(text):
        return text
    if not context.search(text):
        return text.translate(codes)

    def rewrite(match: re.Match) -> str:
        found = match[0]
        if found[0] in INVISIBLE:
            kept = "".join(c for c in found if c in JOINERS)
            return kept if kept and match.start() and _joined_script(text[match.start() - 1]) else ""
        if len(found) == 1:
            return table[found]
        bare = "".join(table.get(c, c) for c in found if c not in INVISIBLE)
        return "".join(table.get(c, c) for c in unicodedata.normalize("NFC", bare))

    return clusters.sub(rewrite, text)


def normalised(frame: DataFrame, column: str = "text", into: str = "text_one_form") -> DataFrame:
    """``frame`` with ``into``, the one form of ``column``; null stays null, the empty text stays empty."""

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(one_form, na_action="ignore")

    return frame.withColumn(into, convert(column))


def look_alikes(frame: DataFrame, key: str = "doc_id", column: str = "text", group_rows: int = 2000) -> DataFrame:
    """All pairs (doc_a, doc_b), doc_a < doc_b, whose non-empty texts have one form but are different strings.

    Only 16-byte digests leave the scan. Forms that stand for a single string, however often copied, are
    dropped by a partial aggregate before anything is joined; a form with many rows is split into blocks of about
    ``group_rows`` rows on either side, so no task holds a whole group. Null and empty texts give no pair;
    rows repeated under one key give one pair.
    """

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import blake2b

        for batch in batches:
            texts = batch["text"].tolist()
            yield pd.DataFrame(
                {
                    "key": batch["key"],
                    "form": [blake2b(one_form(t).encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts],
                    "exact": [blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts],
                }
            )

    rows = frame.select(F.col(key).cast("long").alias("key"), F.col(column).alias("text")).where("key is not null and length(text) > 0")
    marked = checkpointed(rows.mapInPandas(digests, "key long, form binary, exact binary"))  # read twice below; the texts only once
    mixed = (
        marked.groupBy("form")
        .agg(F.min("exact").alias("low"), F.max("exact").alias("high"), F.count("*").alias("n"))
        .where("low <> high")
        .select("form", F.ceil(F.col("n") / group_rows).cast("int").alias("blocks"))
    )
    kept = marked.join(mixed, "form")
    left = kept.select("form", F.col("key").alias("doc_a"), F.col("exact").alias("ea"), F.pmod(F.xxhash64("key"), "blocks").cast("int").alias("block"))
    right = kept.select("form", F.col("key").alias("doc_b"), F.col("exact").alias("eb"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return left.join(right, ["form", "block"]).where("doc_a < doc_b and ea <> eb").select("doc_a", "doc_b").distinct()
