"""P2: values that were cut by a field limit or broke off in transfer, and each source's share of them.

Per source and column, histograms of lengths in characters and in bytes are tested for a spike at the
maximum; values at such a length without terminal punctuation are cut. A source that cuts between words has a soft
limit, a band of lengths as wide as a word. Marks of omission are cut elsewhere too. What broke off in transfer has no
fixed length, so the endings of all whole sentences of the corpus are counted, and an unfinished last sentence
counts as whole only if whole sentences that open like it end like it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import checkpointed
from .genuine import genuine_text

L = r"[^\W\d_]"
OMITTED = r"(?:\.\s?\.\s?\.|…)"
MARK = re.compile(
    rf"(?<!\betc)(?<!\betc\.)(?<!\betc\.\.){OMITTED}\s*[\])]?(?:\s*{L}+){{0,3}}\s*[\])]?$|[\[(](?:{OMITTED}|cont(?:inúa|inua|inues|\.)?|more|más|sigue|truncated|truncado)[\])]$"
    r"|\b(?:ver más|leer más|read more|see more|ler mais|lire la suite|texto completo|descripción completa)$",
    re.IGNORECASE,
)
TAGS = re.compile(r"</?[a-zA-Z][^<>]*>|&nbsp;")
LAST_TAGS = re.compile(r"(?:</?[a-zA-Z][^<>\s]{0,40}>|\s)+$")
TAIL = re.compile(r"(?:<(?:/?[a-zA-Z][^<>\s]{0,40})?>?|&#?\w{0,6};?|[\"“”«»'’\s])+$")
TRAILING = "\"“”«»'’"
BREAK = re.compile(r"([.!?][\"”»)]?)\s+(?=[A-ZÀ-ÖØ-Þ¿¡«“\"(\[])")
LABELLED = re.compile(rf"([A-ZÀ-ÖØ-Þ](?:{L}|-)+(?:\s{L}+)?)\s?:\s")
LINK = re.compile(r"\shttps?://\S+$")
LONE_DIGIT = re.compile(rf"(?:^|[^\W\d_]\s|<\s)\d\.$")
DIGIT = re.compile(r"\d")
NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
NAMES = re.compile(rf"(?<=[\s'’])[A-ZÀ-ÖØ-Þ](?:{L}|-)*(?:\s[A-ZÀ-ÖØ-Þ](?:{L}|-)*)*")
LAST_WORD = re.compile(r"[^\s'’]*$")
OPENING = re.compile(r"[^,]{3,24},\s(?=[a-zß-ÿ])")
SCANNED = {
    "seq": pa.int64(), "source": pa.string(), "field": pa.string(), "size": pa.int32(), "octets": pa.int32(), "ends": pa.string(),
    "alike": pa.int64(), "ended": pa.int64(), "sure": pa.bool_(), "label": pa.string(), "end": pa.string(), "key": pa.int64(), "digest": pa.int64(),
}
LIMITS = ("hard_chars", "hard_bytes", "soft_chars", "soft_bytes")
BAND = 16  # lengths below a limit at which a cut between words may fall
FACTS = r"\s\|\s"


def values(papers: DataFrame, *columns: str) -> DataFrame:
    """(seq, source, field, value): one row for each value that holds text; facts joined by bars are no running text."""
    rows = papers.select(
        F.col("seq").cast("long").alias("seq"), "source",
        F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns))).alias("x"),
    )
    facts = F.col("value").contains("|") & F.col("value").rlike(FACTS)
    return rows.select("seq", "source", "x.field", "x.value").where(genuine_text(F.col("value")) & ~facts)


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(parts)) - (1 << 63)


def keys(sentence: str) -> tuple[int, int, int]:
    """What a sentence opens and ends like (three and two words), its very last word, and its number of words.

    Numbers are one word and so are runs of capitalised words; an opening phrase before a comma does not count.
    """
    opening = OPENING.match(sentence)
    rest = sentence[opening.end() :] if opening else sentence
    closing = rest.rsplit(" ", 6)
    head, tail = _head(" ".join(rest.split(" ", 7)[:7])), _tail(" ".join(closing[-6:]))
    return xxhash.xxh3_64_intdigest(f"{head}\x1f{tail}") - (1 << 63), _last(closing[-1]), rest.count(" ") + 1


@lru_cache(50_000)
def _head(words: str) -> str:
    return "\x1f".join(_shape(words).split(" ", 3)[:3])


@lru_cache(50_000)
def _tail(words: str) -> str:
    return "\x1f".join(_shape(" " + words.removesuffix(".")).rsplit(" ", 2)[-2:])


@lru_cache(50_000)
def _last(word: str) -> int:
    last = LAST_WORD.search(word)[0].removesuffix(".").lower()
    return _hash("word", NUMBER.sub("0", last) if last[-1:].isdigit() else last)


def _shape(part: str) -> str:
    low = part.lower()
    if part[1:] != low[1:]:
        low = NAMES.sub("P", part).lower()
    return NUMBER.sub("0", low) if DIGIT.search(low) else low


def _marked(tail: str) -> bool:
    """Whether a mark of omission stands at the end; where a full stop does, only two more before it can make one."""
    return not (tail[-1:] == "." and tail.count(".", -5) < 3) and MARK.search(tail) is not None


def _read(value: str, whole: set[int]) -> tuple[str, str | None]:
    """How a value ends (mark, stop or open) and its unfinished last sentence; keys of its whole sentences go to ``whole``."""
    text = TAGS.sub(" ", value) if "<" in value or "&" in value else value
    head, tail = text[:-90], text[-90:]
    bare = (head + (TAIL.sub("", tail) if tail[-1:] in TRAILING or tail[-1:].isspace() or "<" in tail or "&" in tail else tail)).rstrip()  # no other text has such an end
    end = value[-90:]
    marked = _marked(LAST_TAGS.sub("", end) if end[-1:] == ">" or end[-1:].isspace() else end) or _marked(bare[-60:])
    stop = bare[-1:] in (".", "!", "?") and not LONE_DIGIT.search(bare[-8:])
    parts = BREAK.sub("\\1\x01", bare).split("\x01")
    for part in parts[: None if stop and not marked else -1]:
        whole.update(keys(part)[:2])
    return ("mark" if marked else "stop" if stop else "open"), (None if marked or stop else parts[-1])


def _scanned(rows: DataFrame) -> DataFrame:
    """One pass over the texts: a row for each value, and the distinct keys of whole sentences in each batch as rows without ``seq``."""

    def batches(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches:
            whole: set[int] = set()
            out = []
            for seq, source, field, value in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                ends, open_part = _read(value, whole)
                octets = value.encode("utf-8", "replace")
                row = [seq, source, field, len(value), len(octets), ends, None, None, None, None, None, None, xxhash.xxh3_64_intdigest(octets) - (1 << 63)]
                if open_part is not None:
                    alike, word, n = keys(open_part)
                    label = LABELLED.match(open_part)
                    blank = value[-1:].isspace() and value.rstrip()[-1:].isalpha()
                    sure = True if LINK.search(open_part) else False if blank or n <= 3 else None
                    row[6:11] = [alike, word, sure, label[1].lower() if label else None, " ".join(open_part.split(" ")[-2:]).lower()]
                out.append(row)
            out += [[None] * 11 + [key, None] for key in whole]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), SCANNED.values(), strict=True)], list(SCANNED))

    kinds = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean"}
    return rows.select("seq", "source", "field", "value").mapInArrow(batches, ", ".join(f"{name} {kinds[kind]}" for name, kind in SCANNED.items()))


def limits(rows: DataFrame, least: int = 5, factor: float = 4.0) -> DataFrame:
    """(source, field, hard_chars, hard_bytes, soft_chars, soft_bytes): the lengths at which a source's column is cut.

    Different texts without terminal punctuation are counted by length. A hard limit is a length held by ``least`` of them or more, and by
    ``factor`` times the mean of the 20 lengths on either side; a soft limit is the top of BAND lengths that together are so much
    above the 2 * BAND on either side. The highest spike is taken; where the tests hold at several
    lengths in a row, the one with most texts. The histogram has at most one row for each length, so its windows stay small however many
    values a source has. A source without a spike has no row.
    """
    texts = rows.where("ends <> 'stop'").select("source", "field", "size", "octets", "digest").distinct()
    sized = texts.select("source", "field", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("size").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("octets").alias("size")))).alias("x")).select("source", "field", "x.*")
    histogram = sized.groupBy("source", "field", "unit", "size").agg(F.count("*").alias("n"))
    by = W.partitionBy("source", "field", "unit").orderBy("size")
    around = lambda low, high: F.coalesce(F.sum("n").over(by.rangeBetween(low, high)), F.lit(0))
    tests = {"hard": (around(0, 0), around(-20, -1), around(1, 20), 20), "soft": (around(1 - BAND, 0), around(1 - 3 * BAND, -BAND), around(1, 2 * BAND), 2)}
    found = None
    for kind, (inside, below, above, times) in tests.items():
        part = histogram.select("source", "field", "unit", "size", inside.alias("inside"), below.alias("below"), above.alias("above"))
        part = part.where((F.col("inside") >= (least if kind == "hard" else 2 * least)) & (F.col("inside") * times > factor * F.greatest("below", "above")))
        new = F.when(F.col("size") - F.lag("size").over(by) > BAND, 1).otherwise(0)  # lengths in a row are one spike
        part = part.withColumn("spike", new).withColumn("spike", F.sum("spike").over(by))
        top = part.groupBy("source", "field", "unit", "spike").agg(F.max(F.struct("inside", (-F.col("size")).alias("size"))).alias("x"))
        top = top.groupBy("source", "field", "unit").agg(F.max(F.struct("spike", (-F.col("x.size")).alias("size"))).alias("x")).select("source", "field", F.concat(F.lit(kind + "_"), "unit").alias("limit"), "x.size")
        found = top if found is None else found.unionByName(top)
    return found.groupBy("source", "field").agg(*(F.max(F.when(F.col("limit") == c, F.col("size"))).alias(c) for c in LIMITS))


def _scan(papers: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return checkpointed(_scanned(values(papers, *(columns or ("abstract", "snippet")))))


def judged(papers: DataFrame, *columns: str) -> DataFrame:
    """(seq, source, field, size, octets, how): every text value; ``how`` is limit, mark, broken or null for a whole one.

    The length tests come first: a value at a hard limit that does not end a sentence is cut by it, and so is one in the band of
    a soft limit that has a mark or an unfinished sentence. Null, empty, placeholder and notice values and lists of facts have no row. Repeated rows
    keep their own. The texts are read once; what is known of them is a few numbers a value, written to the checkpoint folder.
    """
    return _judged(_scan(papers, columns))


def _judged(scanned: DataFrame) -> DataFrame:
    rows = scanned.where("seq is not null").drop("key")
    known = scanned.where("key is not null").select("key").distinct()
    hold = lambda name: known.select(F.col("key").alias(name), F.lit(True).alias(f"has_{name}"))
    unsure = rows.where("ends = 'open'").withColumns({k: F.coalesce(k, "digest") for k in ("alike", "ended")})
    unsure = unsure.join(hold("alike"), "alike", "left").join(hold("ended"), "ended", "left")
    lists = unsure.where("label is not null").groupBy("label", "end").agg(F.count("*").alias("n_end"))
    lists = lists.join(lists.groupBy("label").agg(F.sum("n_end").alias("n_label")), "label").where("n_end >= 2 and n_end * 20 >= n_label").select("label", "end", F.lit(True).alias("usual"))
    unsure = unsure.join(lists, ["label", "end"], "left")
    seen = F.col("has_alike").isNotNull() & F.col("has_ended").isNotNull()
    finished = F.when(F.col("label").isNotNull(), F.coalesce("usual", F.lit(False))).otherwise(F.coalesce("sure", seen))
    fields = ("seq", "source", "field", "size", "octets", "ends")
    ended = rows.where("ends = 'mark'").select(*fields, F.lit(False).alias("finished")).unionByName(unsure.select(*fields, finished.alias("finished"))).join(limits(rows), ["source", "field"], "left")
    at = lambda c, kind: F.coalesce(F.col(c).between(F.col(f"{kind}") - (0 if kind.startswith("hard") else BAND - 1), F.col(kind)), F.lit(False))
    hard = at("size", "hard_chars") | at("octets", "hard_bytes")
    soft = at("size", "soft_chars") | at("octets", "soft_bytes")
    how = F.when(hard | (soft & ~F.col("finished")), "limit").when(F.col("ends") == "mark", "mark").when(~F.col("finished"), "broken")
    whole = rows.where("ends = 'stop'").select(*fields[:-1], F.lit(None).cast("string").alias("how"))
    return whole.unionByName(ended.select(*fields[:-1], how.alias("how")))


def cut_values(papers: DataFrame) -> DataFrame:
    """(seq, field): each value that stops before its text ends."""
    return judged(papers).where("how is not null").select("seq", "field").distinct()


def cut_report(papers: DataFrame) -> DataFrame:
    """Per source and field: values, cut ones by kind, the percentage of cut ones and the limits found; sources without text have no row."""
    scanned = _scan(papers, ())
    rows = _judged(scanned)
    counts = rows.groupBy("source", "field").agg(
        F.count("*").alias("n_values"), F.count("how").alias("n_cut"),
        F.count_if(F.col("how") == "limit").alias("n_at_limit"), F.count_if(F.col("how") == "mark").alias("n_marked"), F.count_if(F.col("how") == "broken").alias("n_broken"),
    )
    return counts.withColumn("percent_cut", F.round(100 * F.col("n_cut") / F.col("n_values"), 2)).join(limits(scanned.where("seq is not null")), ["source", "field"], "left")
