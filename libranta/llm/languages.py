"""P7: the language of every title, abstract and segment, against a label that may be missing or wrong.

Word-first backoff: a word that the training rows know is scored by its log frequency in each language; any other
falls back to shorter and shorter character n-grams, at a discount. Sentences are the segments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .genuine import genuine_text, genuine_title
from .once import Sent

LANGUAGES = ("es", "en", "pt", "fr")
# Notations of labels that name one language.
NOTATIONS = {
    "es": "es spa español espanol spanish castellano castilian esp",
    "en": "en eng english inglés ingles anglais",
    "pt": "pt por português portugues portuguese portugués",
    "fr": "fr fra fre français francais french francés",
}
WORD = re.compile(r"[^\W\d_]+(?:['’](?=[^\W\d_]))?")
SEGMENT = re.compile(r"(?<=[.!?])[\"”»)]?\s+(?=[A-ZÀ-ÖØ-Þ¿¡«“\"(\[])|\n+|\s+[/|]\s+")
LISTED = re.compile(r"^\W*[^\W\d_]+(?:[\s-][^\W\d_]+)?\s?:\s[^.]*,[^.]*$")
MARKUP = re.compile(r"<[^<>]{0,40}>|&\w{1,6};|https?://\S+|[\"“«][^\"”»]{0,60}[\"”»]")
DISCOUNT = 0.25  # weight of a word that only its n-grams speak for


def label_language(label: Column) -> Column:
    """The language that a label names, or null if it names none, several or another one."""
    base = F.lower(F.trim(label))
    table = F.create_map(*(F.lit(x) for code, names in NOTATIONS.items() for name in names.split() for x in (name, code)))
    return F.coalesce(F.try_element_at(table, base), F.try_element_at(table, F.regexp_extract(base, r"^([a-z]{2,3})[_-][a-z]{2}$", 1)))


class Model:
    """Scores of words by language; what is computed for unseen words is remembered up to a bound."""

    def __init__(self, counts: list[tuple[str, str, int]], top: int = 5):
        totals = dict.fromkeys(LANGUAGES, 1.0)
        words: dict[str, np.ndarray] = {}
        grams: dict[str, np.ndarray] = {}
        gram_totals = np.ones((top + 1, len(LANGUAGES)))
        for word, language, n in counts:
            k = LANGUAGES.index(language)
            totals[language] += n
            words.setdefault(word, np.zeros(len(LANGUAGES)))[k] += n
            bounded = f"^{word}$"
            for size in range(1, top + 1):
                for i in range(len(bounded) - size + 1):
                    grams.setdefault(bounded[i : i + size], np.zeros(len(LANGUAGES)))[k] += min(n, 50)
                    gram_totals[size, k] += min(n, 50)
        total = np.array([totals[x] for x in LANGUAGES])
        self.top = top
        self.rows = [np.zeros(len(LANGUAGES))]
        self.index: dict[str, int] = {}
        for word, n in words.items():
            if n.sum() >= 3:
                self.index[word] = len(self.rows)
                self.rows.append(np.log((n + 0.5) / (total + 1)))
        self.grams = {g: np.log((n + 0.5) / gram_totals[len(g)]) for g, n in grams.items() if n.sum() >= 3}
        self.known = len(self.rows)
        self.matrix = self._centred(self.rows)

    @staticmethod
    def _centred(rows: list[np.ndarray]) -> np.ndarray:
        matrix = np.array(rows)
        return np.clip(matrix - matrix.mean(axis=1, keepdims=True), -4, 4)

    def backoff(self, word: str) -> np.ndarray:
        """The longest n-grams that training knows, shorter ones where it does not."""
        bounded, i, total, n = f"^{word}$", 0, np.zeros(len(LANGUAGES)), 0
        while i < len(bounded):
            for size in range(min(self.top, len(bounded) - i), 0, -1):
                found = self.grams.get(bounded[i : i + size])
                if found is not None:
                    total, n = total + (found - found.mean()), n + 1
                    i += max(1, size - 1)
                    break
            else:
                i += 1
        return DISCOUNT * np.clip(total / max(1, n), -4, 4)

    def places(self, words: list[str]) -> list[int]:
        index = self.index
        found = list(map(index.get, words))
        if None in found:
            for k, (word, at) in enumerate(zip(words, found, strict=True)):
                if at is None:
                    at = index.get(word)
                    if at is None:
                        at = index[word] = len(self.rows)
                        self.rows.append(self.backoff(word))
                    found[k] = at
        return found

    def table(self) -> np.ndarray:
        if len(self.matrix) < len(self.rows):
            self.matrix = np.vstack([self.matrix, np.array(self.rows[len(self.matrix) :])])
        return self.matrix

    def trim(self) -> None:
        """Between batches: unseen words are forgotten when they are too many."""
        if len(self.rows) > self.known + 200_000:
            del self.rows[self.known :]
            self.matrix = self.matrix[: self.known]
            self.index = {w: k for w, k in self.index.items() if k < self.known}


def training_counts(papers: DataFrame, sample_rows: int = 20_000, words: int = 60_000) -> list[tuple[str, str, int]]:
    """Word counts by label over the labelled ones among ``sample_rows`` rows chosen by hash: the bounded training sample.

    At most ``words`` commonest (word, language) pairs come to the driver.
    """
    labelled = papers.select("seq", F.col("abstract").alias("text"), label_language(F.col("metadata")["language"]).alias("language"))
    share = min(1.0, sample_rows / max(1, papers.count()))
    labelled = labelled.where(F.pmod(F.xxhash64("seq"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sample = labelled.where(F.col("language").isNotNull() & genuine_text(F.col("text")))
    tokens = sample.select("language", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counts = tokens.groupBy("word", "language").agg(F.count("*").alias("n")).where("n >= 2")
    return [(r["word"], r["language"], r["n"]) for r in counts.orderBy(F.desc("n"), "word", "language").limit(words).collect()]


def _segments(text: str) -> list[tuple[str, bool]]:
    """(segment, whole sentence?) without markup, addresses, short quotations and lists after a label."""
    parts = [p for p in SEGMENT.split(MARKUP.sub(" ", text)) if p and p.strip()]
    return [(p.lower(), p.rstrip()[-1:] in ".!?" or p.rstrip()[-2:-1] in ".!?") for p in parts if not LISTED.match(p)]


def segmented(papers: DataFrame, counts: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """(seq, label, title_lang, title_conf, segments): every title and abstract with languages and confidences.

    ``segments`` holds one struct (lang, conf, words, whole) for each sentence of a genuine abstract, in order. A missing,
    placeholder or notice value has null or no segments; a text without a scorable word has no language. Rows are kept one to one.
    """
    counts = training_counts(papers) if counts is None else counts
    sent = Sent(papers.sparkSession, counts, Model)
    rows = papers.select(
        F.col("seq").cast("long").alias("seq"), label_language(F.col("metadata")["language"]).alias("label"),
        F.when(genuine_title(F.col("title")), F.col("title")).alias("title"), F.when(genuine_text(F.col("abstract")), F.col("abstract")).alias("abstract"),
    )

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.get()
        for frame in frames:
            flat, sizes, owner, whole = [], [], [], []
            titles, abstracts = frame["title"].tolist(), frame["abstract"].tolist()
            for k in range(len(frame)):
                parts = [(titles[k].lower(), True)] if titles[k] else [("", True)]
                parts += _segments(abstracts[k]) if abstracts[k] else []
                for part, ended in parts:
                    words = WORD.findall(part)
                    flat += words
                    sizes.append(len(words))
                    owner.append(k)
                    whole.append(ended)
            places = np.array(model.places(flat) + [0], dtype=np.int64)
            sizes = np.array(sizes)
            ends = np.cumsum(sizes)
            sums = np.vstack([np.zeros(len(LANGUAGES)), np.cumsum(model.table()[places], axis=0)])
            scores = sums[ends] - sums[ends - sizes]
            best = scores.argmax(axis=1)
            shares = np.exp(scores - scores.max(axis=1, keepdims=True))
            confidence = (1 / shares.sum(axis=1)).round(4)
            language = [LANGUAGES[b] if n else None for b, n in zip(best.tolist(), sizes.tolist(), strict=True)]
            out = [[] for _ in range(len(frame))]
            for k, lang, conf, n, ended in zip(owner, language, confidence.tolist(), sizes.tolist(), whole, strict=True):
                out[k].append((lang, conf, n, ended))
            yield pd.DataFrame(
                {
                    "seq": frame["seq"], "label": frame["label"],
                    "title_lang": [o[0][0] for o in out], "title_conf": [o[0][1] if o[0][0] else None for o in out],
                    "segments": [[{"lang": a, "conf": c, "words": n, "whole": w} for a, c, n, w in o[1:] if a] for o in out],
                }
            )
            model.trim()

    return rows.mapInPandas(batches, "seq long, label string, title_lang string, title_conf double, segments array<struct<lang:string,conf:double,words:int,whole:boolean>>")


def _words_in(code: str) -> Column:
    return F.aggregate(F.filter("segments", lambda s: s["lang"] == code), F.lit(0), lambda a, s: a + s["words"])


def relabelled(papers: DataFrame, least_words: int = 5, least_confidence: float = 0.9) -> DataFrame:
    """(seq, label, main, title_lang, title_conf, langs, affected): each row's languages and whether its label is to be mended.

    ``main`` is the language of most words of the abstract, or the title's; ``langs`` are main and each second language in
    which at least one full, clear sentence of ``least_words`` words stands.
    """
    rows = segmented(papers)
    totals = F.array(*(F.struct(_words_in(code).alias("n"), F.lit(code).alias("lang")) for code in LANGUAGES))
    top = F.array_max(totals)
    rows = rows.withColumn("main_abstract", F.when(top["n"] > 0, top["lang"]))
    clear = F.filter("segments", lambda s: s["whole"] & (s["words"] >= least_words) & (s["conf"] >= least_confidence))
    langs = F.when(F.col("main_abstract").isNotNull(), F.array_distinct(F.concat(F.array("main_abstract"), F.transform(clear, lambda s: s["lang"]))))
    rows = rows.withColumns({"main": F.coalesce("main_abstract", "title_lang"), "langs": langs})
    affected = F.col("label").isNull() | F.coalesce(F.col("label") != F.col("main"), F.lit(False)) | F.coalesce(F.size("langs") > 1, F.lit(False))
    return rows.withColumn("affected", affected).drop("main_abstract")


def found(papers: DataFrame) -> DataFrame:
    """(seq, field, lang) of all affected rows: one for the title, one for each language of the abstract."""
    rows = relabelled(papers).where("affected")
    one = F.filter(F.array(F.struct(F.lit("title").alias("field"), F.col("title_lang").alias("lang"))), lambda x: x["lang"].isNotNull())
    many = F.coalesce(F.transform("langs", lambda x: F.struct(F.lit("abstract").alias("field"), x.alias("lang"))), F.array().cast("array<struct<field:string,lang:string>>"))
    return rows.select("seq", F.explode(F.concat(one, many)).alias("x")).select("seq", "x.field", "x.lang").distinct()


