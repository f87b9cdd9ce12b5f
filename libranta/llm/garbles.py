"""P3: text decoded with the wrong character encoding, found and given back as first written.

A smoothed character n-gram model is trained on clean values. Every chain of encoding and decoding is tried on each
word that holds unusual characters, and the likeliest result is taken if it beats the word as it stands by more than
a margin. Chains that lose characters leave marks in their place; there the likeliest letter stands against the mark. The
margins are validated on all values that training did not see, as they are and garbled on purpose. Words are judged one by
one, so a text may be garbled in part.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .once import Sent

# Code pages by which UTF-8 or one another are commonly misread.
PAGES = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859-15", "cp1254")
SINGLE = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251")
MARKS = re.compile(r"[\ufffd\x80-\x9f]|(?<=[^\W\d_])\?(?=[^\W\d_])")  # what stands where a chain lost a character
LETTERS = re.compile(r"[^\W\d_]+")
UNUSUAL = re.compile(r"[^\x00-\x7f]+")
TOKEN = re.compile(r"[^ \t\r\n]*(?:[^\x00-\x7f]|&#\d+;|&[A-Za-z]+;|[^\W\d_]\?[^\W\d_])[^ \t\r\n]*")
ENTITY = re.compile(r"&#\d+;|&#x[0-9a-fA-F]+;|&(?:[A-Za-z]{4,8});")
DIGIT = re.compile(r"\d")
SLOTS = (1 << 16, 1 << 18, 1 << 20)  # of the tables of single characters, pairs and triples: their size is fixed whatever the corpus
DOUBT = 6.0  # a value with a reading likelier by so much is not trained on
HELD = 8  # one value of so many is held out of training
KINDS = ("utf8", "pages", "lost")


def _bytes(text: str, page: str) -> bytes | None:
    """``text`` in a code page; bytes that the page leaves undefined count as themselves, as lenient decoders show them."""
    try:
        return text.encode(page)
    except UnicodeEncodeError:
        if page not in ("cp1252", "cp1250", "cp1251", "cp1254"):
            return None
    out = bytearray()
    for char in text:
        try:
            out += char.encode(page)
        except UnicodeEncodeError:
            if ord(char) > 0xFF:
                return None
            out.append(ord(char))
    return bytes(out)


def as_utf8(text: str) -> list[str]:
    """What ``text`` reads if its characters are bytes of UTF-8 seen through some code page."""
    found = []
    for page in PAGES:
        raw = _bytes(text, page)
        if raw is not None:
            try:
                read = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if read != text and read not in found:
                found.append(read)
    return found


@lru_cache(40_000)
def readings(run: str) -> dict[tuple, str]:
    """What a run of unusual characters reads by each chain: up to three misread UTF-8 steps, with a pair of code pages before or after the first, or alone."""
    found: dict[tuple, str] = {}

    def utf8(start: tuple, text: str) -> list[tuple]:
        fresh = []
        for page in PAGES:
            raw = _bytes(text, page)
            if raw is not None:
                try:
                    read = raw.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if read != text:
                    found[(*start, page)] = read
                    fresh.append((*start, page))
        return fresh

    def pages(start: tuple, text: str) -> list[tuple]:
        fresh = []
        for shown in SINGLE:
            raw = _bytes(text, shown)
            if raw is not None:
                for true in SINGLE:
                    if true != shown:
                        try:
                            read = raw.decode(true)
                        except UnicodeDecodeError:
                            continue
                        if read != text:
                            found[(*start, (shown, true))] = read
                            fresh.append((*start, (shown, true)))
        return fresh

    first = utf8((), run)
    second = [x for chain in first for x in utf8(chain, found[chain])]
    for chain in second:
        utf8(chain, found[chain])
    for chain in first:
        pages(chain, found[chain])
    for chain in pages((), run):
        utf8(chain, found[chain])
    return found


def candidates(token: str) -> dict[str, bool]:
    """All readings of a word, each with whether a misread UTF-8 step or a reference is in its chain, which chance hardly makes."""
    start = html.unescape(token) if "&" in token else token
    runs = UNUSUAL.findall(start)
    out = {start: True} if start != token else {}
    if not runs:
        return out
    tables = [readings(run) for run in runs]
    between = UNUSUAL.split(start)
    least = min(tables, key=len)
    for chain in least:
        parts = [table.get(chain) for table in tables]
        if None not in parts:
            read = "".join(x for pair in zip(between, [*parts, ""], strict=True) for x in pair)
            sure = start != token or any(isinstance(step, str) for step in chain)
            if read != token:
                out[read] = out.get(read, False) or sure
    return out


def _even(match: re.Match) -> str:
    run = match[0]
    return run.lower() if run[1:].islower() or run.isupper() or len(run) == 1 else run


def regular(token: str) -> str:
    """A word as the model sees it: case is folded in each run of letters unless it changes inside the run, digits are one."""
    return DIGIT.sub("0", f"  {LETTERS.sub(_even, token)} ")


def slot(gram: str) -> int:
    """The place of one to three characters in their table."""
    k = len(gram) - 1
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % SLOTS[k]


class Model:
    """Log-likelihood of words under character trigrams, smoothed by pairs and single characters (Dirichlet priors)."""

    def __init__(self, sent: tuple[list[np.ndarray], list[str], dict[str, float]]):
        self.tables, self.letters, self.margins = sent
        self.total = int(self.tables[0].sum()) + 1
        self.memo: dict[str, tuple[float, str, str]] = {}
        self.logs: dict[str, float] = {}

    def _log(self, gram: str) -> float:
        one, two, three = self.tables
        p = (int(one[slot(gram[2])]) + 0.01) / (self.total + 10_000)
        p = (int(two[slot(gram[1:])]) + 5 * p) / (int(one[slot(gram[1])]) + 5)
        p = (int(three[slot(gram)]) + 5 * p) / (int(two[slot(gram[:2])]) + 5)
        if len(self.logs) > 400_000:
            self.logs.clear()
        value = self.logs[gram] = math.log(p)
        return value

    def score(self, token: str) -> float:
        text, logs = regular(token), self.logs
        total = 0.0
        for i in range(len(text) - 2):
            gram = text[i : i + 3]
            value = logs.get(gram)
            total += self._log(gram) if value is None else value
        return total

    def gain(self, token: str) -> tuple[float, str, str]:
        """How much the best other reading is likelier than the word as it stands, that reading, and the kind of its chain.

        The reading that exceeds the margin of its kind by most is taken. Where characters were lost the reading is the word as it stands.
        """
        if (known := self.memo.get(token)) is not None:
            return known
        own = self.score(token)
        best = (-math.inf, token, "pages")
        for other, sure in candidates(token).items():
            if not MARKS.search(other):
                kind = "utf8" if sure else "pages"
                value = self.score(other) - own
                if value - self.margins[kind] > best[0] - self.margins[best[2]]:
                    best = (value, other, kind)
        if MARKS.search(token) and not best[0] > self.margins[best[2]]:
            best = (self._filled(token, own), token, "lost")
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[token] = best
        return best

    def _filled(self, token: str, own: float) -> float:
        """How much likelier the word is with the likeliest letters in place of its marks, one after the other."""
        value, upper = own, "".join(c for c in token if c.isalpha()).isupper()
        while self.letters and (found := MARKS.search(token)):
            value, token = max((self.score(t), t) for t in (token[: found.start()] + (c.upper() if upper else c) + token[found.end() :] for c in self.letters))
        return value - own

    def mend(self, text: str) -> tuple[str, bool]:
        """The text restored as far as possible, and whether it held garbled characters at all."""
        garbled = False

        def each(match: re.Match) -> str:
            nonlocal garbled
            token = match[0]
            gain, reading, kind = self.gain(token)
            if gain > self.margins[kind]:
                garbled = True
                return reading
            return token

        mended = TOKEN.sub(each, text)
        return mended, garbled


def values(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, field, at, value) of all texts and names; the model is trained on all of them."""
    rows = pages.select(F.col(key).cast("long").alias("key"), F.explode(F.array(
        F.struct(F.lit("title").alias("field"), F.array("title").alias("values")), F.struct(F.lit("abstract").alias("field"), F.array("abstract").alias("values")), F.struct(F.lit("authors").alias("field"), F.col("authors").alias("values")),
    )).alias("x"))
    return rows.select("key", "x.field", F.posexplode("x.values").alias("at", "value")).where("value is not null")


def unusual(rows: DataFrame) -> DataFrame:
    """Those values with a word that can be garbled at all (TOKEN): with characters beyond ASCII, references to such, or a mark between letters."""
    return rows.where(F.col("value").rlike(r"[^\x00-\x7f]|&#?\w+;|\p{L}\?\p{L}"))


def _held(value: str) -> bool:
    return zlib.crc32(value.encode("utf-8", "surrogatepass")) % HELD == 0


@lru_cache(200_000)
def _suspect(token: str) -> bool:
    return bool(MARKS.search(token) or ENTITY.search(token) or any(isinstance(chain[0], str) for run in UNUSUAL.findall(token) for chain in readings(run)))


def trusted(value: str, first: Model | None) -> list[str]:
    """The words of a value that are clean: by their looks, or once there is a first model all of them if it finds no reading of any likelier by DOUBT."""
    if first is None:
        return [word for word in value.split() if word.isascii() and "?" not in word and "&" not in word or not _suspect(word)]
    return value.split() if not MARKS.search(value) and all(first.gain(token)[0] <= DOUBT for token in TOKEN.findall(value)) else []


def train(rows: DataFrame, first: Sent | None = None) -> tuple[list[np.ndarray], list[str]]:
    """Counts of characters, pairs and triples over all trusted values that are not held out, in tables of fixed size, and the unusual letters of a hundred-thousandth or more."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = first.get() if first else None
        for frame in frames:
            words: Counter[str] = Counter()
            for value in frame["value"]:
                if not _held(value):
                    words.update(trusted(value, known))
            counts: Counter[tuple[int, int]] = Counter()
            letters: Counter[str] = Counter()
            for word, n in words.items():
                text = regular(word)
                for i in range(len(text) - 2):
                    gram = text[i : i + 3]
                    for part in (gram, gram[1:], gram[2]):
                        counts[len(part) - 1, slot(part)] += n
                    if not gram[2].isascii() and gram[2].isalpha():
                        letters[gram[2]] += n
                for part in (text[:2], text[0], text[1]):
                    counts[len(part) - 1, slot(part)] += n
            yield pd.DataFrame([(k, at, None, n) for (k, at), n in counts.items()] + [(-1, 0, c, n) for c, n in letters.items()], columns=["k", "at", "letter", "n"])

    found = rows.select("value").mapInPandas(batches, "k int, at int, letter string, n long").groupBy("k", "at", "letter").agg(F.sum("n").alias("n")).toPandas()
    tables = []
    for k, size in enumerate(SLOTS):
        part = found[found["k"] == k]
        table = np.zeros(size, np.int64)
        table[part["at"].to_numpy(np.int64)] = part["n"].to_numpy(np.int64)
        tables.append(table)
    letters = found[found["k"] == -1]
    return tables, sorted(letters["letter"][letters["n"] * 100_000 >= letters["n"].sum()])


def spoilt(token: str, kind: str, pick: int) -> str | None:
    """A clean word garbled on purpose by a chain of one kind, which ``pick`` chooses; None if the chain changes nothing or fails."""
    if kind == "lost":
        return UNUSUAL.sub("?" if pick % 2 else "\ufffd", token, count=1)
    pairs = [(a, b) for a in SINGLE for b in SINGLE if a != b]
    page = PAGES[pick % len(PAGES)] if kind == "utf8" else pairs[pick % len(pairs)]
    try:
        shown = token.encode("utf-8").decode(page) if kind == "utf8" else token.encode(page[1]).decode(page[0])
    except UnicodeError:
        return None
    return shown if shown != token else None


def validated_margins(tables: list[np.ndarray], letters: list[str], rows: DataFrame, first: Sent, most: float = 1e-3, lost: float = 0.005, least: float = 2.0) -> dict[str, float]:
    """For each kind of chain the gain from which a reading is taken, from all held-out values.

    Clean words of held-out values are judged as they are and garbled on purpose; histograms of their gains, in half units, come
    back. The margin lies midway between the gain that all but ``most`` of the clean words stay below and the one that
    all but ``lost`` of the garbled ones reach, and above the first in any case. It is never under ``least``.
    """
    sent = Sent(rows.sparkSession, (tables, letters, dict.fromkeys(KINDS, 0.0)), Model)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known = sent.get(), first.get()
        for frame in frames:
            counts: Counter[tuple[str, bool, int]] = Counter()
            words: Counter[str] = Counter()
            for value in frame["value"]:
                if _held(value) and trusted(value, known):
                    words.update(set(TOKEN.findall(value)))
            for word, n in words.items():
                gain, _, kind = model.gain(word)
                if gain > -math.inf:
                    counts[kind, False, int(2 * max(-200.0, min(gain, 200.0)))] += n
                pick = zlib.crc32(word.encode("utf-8", "surrogatepass"))
                for k, kind in enumerate(KINDS):
                    bad = spoilt(word, kind, pick >> (4 * k))
                    if bad and TOKEN.search(bad):
                        gain, _, told = model.gain(bad)
                        if told == kind:
                            counts[kind, True, int(2 * max(-200.0, min(gain, 200.0)))] += n
            yield pd.DataFrame([(*key, n) for key, n in counts.items()], columns=["kind", "bad", "gain", "n"])

    found = unusual(rows).select("value").mapInPandas(batches, "kind string, bad boolean, gain int, n long").groupBy("kind", "bad", "gain").agg(F.sum("n").alias("n")).collect()
    margins = {}
    for kind in KINDS:
        good, bad = (sorted((r["gain"] / 2, r["n"]) for r in found if r["kind"] == kind and r["bad"] == b) for b in (False, True))
        top = _reached(good[::-1], most) if good else 0.0
        low = _reached(bad, lost) if bad else top
        margins[kind] = max(least, top + 0.5, (top + low) / 2)
    return margins


def _reached(histogram: list[tuple[float, int]], share: float) -> float:
    """The value at which a share of the counts is passed."""
    left = share * sum(n for _, n in histogram)
    for value, n in histogram:
        left -= n
        if left < 0:
            return value
    return histogram[-1][0]


def trained(rows: DataFrame) -> tuple[list[np.ndarray], list[str], dict[str, float]]:
    """Tables, letters and margins: a first model of values that look clean tells which values a second one is trained on and validated with."""
    first = Sent(rows.sparkSession, (*train(rows), dict.fromkeys(KINDS, 0.0)), Model)
    tables, letters = train(rows, first)
    return tables, letters, validated_margins(tables, letters, rows, first)


def mended(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, field, at, value, restored, garbled): every value with unusual characters; ``at`` is its place in the field.

    Null, empty and plain ASCII values have no row. ``restored`` equals ``value`` where nothing is garbled; characters that were
    lost for good stay as they are.
    """
    rows = values(pages, key)
    sent = Sent(pages.sparkSession, trained(rows), Model)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.get()
        for frame in frames:
            done = [model.mend(v) for v in frame["value"]]
            yield frame.assign(restored=[d[0] for d in done], garbled=[d[1] for d in done])

    return unusual(rows).mapInPandas(batches, "key long, field string, at int, value string, restored string, garbled boolean").withColumnRenamed("key", key)


def garbled_values(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, field): each value that holds garbled characters, restorable or not; several names of a page give one row."""
    return mended(pages, key).where("garbled").select(key, "field").distinct()
