"""P9: passages of held-out items inside corpus documents.

Each shard of the corpus gets a suffix array over words. Every suffix of every item is looked up in it by binary search:
the interval of suffixes that open alike is narrowed word by word, so the depth reached is the longest verbatim
match, and the suffixes that fall out on the way tell where shorter matches stand. The places say which part of which item
stands in which document. Letter case, accents, marks, spacing and character forms are gone before, and a few
changed words only break one match into two.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import checkpointed
from .looks import one_form
from .once import Sent

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.?!])\s+")
SEED = 5  # words: shorter matches are scraps
MOST_KNOWN = 400_000  # words of documents that a worker remembers for each block of items
BLOCK = 20_000  # items held by a task at a time; results do not depend on it
SHARD = 2_000_000  # words of documents in one suffix array, when there are several blocks


def plain(word: str) -> str:
    """A word without case and accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.casefold()) if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    return [plain(w) for w in WORD.findall(one_form(text))]


class Items:
    """The words of one block of items: (item, sentences), each sentence its words and whether it asks. Shared instructions are gone already."""

    def __init__(self, rows: list[tuple[int, list[tuple[list[str], bool]]]]):
        self.ids = np.array([key for key, _ in rows], dtype=np.int64)
        self.vocabulary: dict[str, int] = {}
        self.known: dict[str, int] = {}  # corpus words as written, bounded by the caller
        flat, owner, question, start, sizes = [], [], [], [], []
        for k, (_, sentences) in enumerate(rows):
            start.append(len(flat))
            sizes.append(sum(len(w) for w, _ in sentences))
            for sentence, asks in sentences:
                for word in sentence:
                    flat.append(self.vocabulary.setdefault(word, len(self.vocabulary) + 1))
                    owner.append(k)
                    question.append(asks)
            flat += [0] * SEED
            owner += [-1] * SEED
            question += [True] * SEED
        self.size, self.flat, self.owner, self.start = np.array(sizes), np.array(flat, dtype=np.int64), np.array(owner, dtype=np.int64), np.array(start, dtype=np.int64)
        self.question = np.array(question, dtype=bool)
        self.asked = np.concatenate([[0], np.cumsum(self.question)])
        self.longest = int(self.size.max()) if len(sizes) else 0
        self.per = packed_words(len(self.vocabulary) + 1)

    def ids_of(self, found: list[str]) -> np.ndarray:
        """Numbers of a document's words in the vocabulary of the items, 0 for others."""
        known = self.known
        if len(known) > MOST_KNOWN:
            known.clear()  # between documents: all words of this one are looked up next
        for word in set(found) - known.keys():
            known[word] = self.vocabulary.get(plain(word), 0)
        return np.fromiter(map(known.get, found, [0] * len(found)), np.int64, len(found))


def packed_words(base: int) -> int:
    """How many word numbers below ``base`` fit into one key of 63 bits."""
    return max(1, 63 // max(1, int(base).bit_length()))


def packed(flat: np.ndarray, at: np.ndarray, base: int, per: int) -> np.ndarray:
    """For each place the ``per`` words that begin there as one number, in the order of the words; beyond the end there are zeros."""
    bits, n = int(base).bit_length(), len(flat)
    keys = np.zeros(len(at), np.int64)
    for j in range(per):
        inside = at + j < n
        keys <<= bits
        keys[inside] |= flat[at[inside] + j]
    return keys


def runs(flat: np.ndarray, least: int = SEED) -> np.ndarray:
    """Places at which ``least`` known words follow one another."""
    if len(flat) < least:
        return np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(flat > 0)])
    return np.flatnonzero(total[least:] - total[:-least] == least)


def suffix_array(flat: np.ndarray, base: int, depth: int) -> np.ndarray:
    """Places of all suffixes that open with SEED known words, in lexicographic order of their first ``depth`` words.

    Suffixes are sorted by their first packed words; those that tie are sorted by the next ones, until none tie or the
    depth is reached.
    """
    at = runs(flat)
    per = packed_words(base)
    keys = packed(flat, at, base, per)
    order = np.argsort(keys, kind="stable")
    at, keys = at[order], keys[order]
    group = np.cumsum(np.concatenate([[0], (keys[1:] != keys[:-1]).astype(np.int64)])) if len(at) else np.zeros(0, np.int64)
    done = per
    while len(at) and done < depth:
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        keys = packed(flat, at[tied] + done, base, per)
        order = np.lexsort((keys, group[tied]))
        at[tied] = at[tied][order]
        new = np.full(len(at), -1, np.int64)
        new[tied] = keys[order]
        group = np.cumsum(np.concatenate([[0], ((group[1:] != group[:-1]) | (new[1:] != new[:-1])).astype(np.int64)]))
        done += per
    return at


def narrowed(values: np.ndarray, places: np.ndarray, depth: int, low: np.ndarray, high: np.ndarray, word: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of ``word`` at ``depth`` inside each interval of the suffix array: the first place of it, or behind it if ``right``."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) >> 1
        at = places[np.where(open_, middle, 0)] + depth
        found = np.where(at < len(values), values[np.minimum(at, len(values) - 1)], 0)
        below = open_ & ((found <= word) if right else (found < word))
        low = np.where(below, middle + 1, low)
        high = np.where(open_ & ~below, middle, high)


def matches(items: Items, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest verbatim matches (place in items, place in shard, words) of SEED words or more, each once, at the place where it begins."""
    base = len(items.vocabulary) + 1
    places = suffix_array(flat, base, items.longest)
    test = runs(items.flat)
    out: list[tuple[np.ndarray, np.ndarray, int]] = []
    low, high = np.zeros(len(test), np.int64), np.full(len(test), len(places), np.int64)
    depth = min(items.per, SEED)
    if len(places) and len(test):
        have, want = packed(flat, places, base, depth), packed(items.flat, test, base, depth)
        low, high = np.searchsorted(have, want, "left"), np.searchsorted(have, want, "right")
    while True:
        kept = low < high
        test, low, high = test[kept], low[kept], high[kept]
        if not len(test):
            break
        at = test + depth
        word = np.where(at < len(items.flat), items.flat[np.minimum(at, len(items.flat) - 1)], 0)
        ended = word == 0  # the item ends: every suffix left has its longest match here
        new_low = np.where(ended, high, narrowed(flat, places, depth, low, high, word, False))
        new_high = np.where(ended, high, narrowed(flat, places, depth, new_low, high, word, True))
        if depth >= SEED:
            for a, b in ((low, new_low), (new_high, high)):
                count = b - a
                if count.any():
                    rows = np.repeat(np.arange(len(test)), count)
                    place = places[np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count) + a[rows]]
                    t = test[rows]
                    before = (t > 0) & (place > 0)
                    before[before] = (items.flat[t[before] - 1] == flat[place[before] - 1]) & (flat[place[before] - 1] > 0)
                    out.append((t[~before], place[~before], depth))
        low, high = new_low, new_high
        depth += 1
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.concatenate([t for t, _, _ in out]), np.concatenate([p for _, p, _ in out]), np.concatenate([np.full(len(t), d) for t, _, d in out])


def own_sentences(items: DataFrame, key: str, column: str, shared: int = 3) -> DataFrame:
    """(item, sentences): what each item says itself. A sentence of four words or more in ``shared`` items or more is an instruction and goes.

    Sentences are counted over all items, so it does not matter how items are searched later. Null keys and empty texts have no row.
    """

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key_, text in zip(frame["item"], frame["text"], strict=True):
                for at, sentence in enumerate(SENTENCE.split(text)):
                    found = words(sentence)
                    out.append((key_, text, at, found, sentence.rstrip().endswith("?"), xxhash.xxh3_64_intdigest(" ".join(found)) - (1 << 63)))
            yield pd.DataFrame(out, columns=["item", "text", "at", "words", "asks", "hash"])

    rows = items.where(f"{key} is not null and length({column}) > 0").select(F.col(key).cast("long").alias("item"), F.col(column).alias("text")).distinct()
    sentences = checkpointed(rows.mapInPandas(split, "item long, text string, at int, words array<string>, asks boolean, hash long"))
    often = sentences.where("size(words) >= 4").groupBy("hash", "item").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= shared).select("hash", F.lit(True).alias("often"))
    marked = sentences.join(often, "hash", "left").withColumn("own", F.col("often").isNull() | (F.size("words") < 4))
    kept = F.sort_array(F.collect_list(F.when(F.col("own"), F.struct("text", "at", "words", "asks"))))
    return marked.groupBy("item").agg(F.transform(kept, lambda s: F.struct(s["words"].alias("words"), s["asks"].alias("asks"))).alias("sentences"))


def passages(documents: DataFrame, items: DataFrame, key: str = "doc_id", column: str = "text", item_key: str = "item_id", least: float = 1 / 3) -> DataFrame:
    """(item_id, doc_id, share, words, places): each document that holds ``least`` of an item's words in passages of SEED words or more,
    one of them of nearly twice SEED unless half of the item is there (turns of phrase that items share are short).

    ``places`` are the passages: their first word in the item's own words, their first word in the document, both from 0, and their
    number of words. Instructions that several items share do not count, nor does a question without its passage. The
    corpus is read once: a task holds BLOCK items at a time and looks up each shard in all blocks. Null and empty texts leak
    nothing; a document that is there several times under one key may have several rows.
    """
    spark = documents.sparkSession
    own = checkpointed(own_sentences(items, item_key, "text"))
    blocks = max(1, -(-own.count() // BLOCK))
    parts = []
    for block in range(blocks):  # the driver holds BLOCK items at a time
        part = own if blocks == 1 else own.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        parts.append(Sent(spark, sorted((r["item"], [(list(s["words"]), s["asks"]) for s in r["sentences"]]) for r in part.collect()), Items))
    return _search(documents, parts, key, column, least)


def _search(documents: DataFrame, blocks: list, key: str, column: str, least: float) -> DataFrame:
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, texts in _shards(frames, 1 if len(blocks) == 1 else SHARD):
            found = [WORD.findall(one_form(text)) for text in texts]
            rows = [(item, keys[k], *more) for block in blocks for item, k, *more in leaks_of(block.get(), found, least)]
            if rows:
                yield pd.DataFrame(rows, columns=["item_id", key, "share", "words", "places"])

    rows = documents.select(F.col(key).cast("long").alias("key"), F.col(column).alias("text")).where("key is not null and length(text) > 0")
    return rows.mapInPandas(batches, f"item_id long, {key} long, share double, words long, places array<struct<item_at: long, doc_at: long, words: long>>")


def _shards(frames: Iterator[pd.DataFrame], least: int) -> Iterator[tuple[list, list]]:
    """Keys and texts of batches put together until they have about ``least`` words, so that few shards are looked up in many blocks."""
    keys, texts, size = [], [], 0
    for frame in frames:
        keys += frame["key"].tolist()
        texts += frame["text"].tolist()
        size += int(frame["text"].str.len().sum()) // 6
        if size >= least:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def leaks_of(items: Items, documents: list[list[str]], least: float) -> Iterator[tuple]:
    """(item, document's place, share, words, places) of what one shard holds of a block of items."""
    parts, starts, owners, total = [], [], [], 0
    for k, found in enumerate(documents):
        ids = items.ids_of(found)
        if (ids > 0).sum() >= SEED:
            parts += [ids, np.zeros(SEED, np.int64)]
            starts.append(total)
            owners.append(k)
            total += len(ids) + SEED
    if not parts:
        return
    test, place, size = matches(items, np.concatenate(parts))
    asked = items.asked[test + size] - items.asked[test]
    real = asked < size  # not only a question
    shard = np.searchsorted(np.array(starts), place, "right") - 1
    covered: dict[tuple[int, int], set] = {}
    spots: dict[tuple[int, int], list] = {}
    for a, b, n, d in zip(test[real].tolist(), place[real].tolist(), size[real].tolist(), shard[real].tolist(), strict=True):
        pair = (int(items.owner[a]), d)
        covered.setdefault(pair, set()).update(range(a, a + n))
        spots.setdefault(pair, []).append((a, b, n))
    for (i, d), places in covered.items():
        n, longest = len(places), max(s[2] for s in spots[i, d])
        if n >= least * items.size[i] and (longest >= 2 * SEED - 1 or 2 * n >= items.size[i]):
            yield int(items.ids[i]), owners[d], n / int(items.size[i]), n, sorted((a - int(items.start[i]), b - starts[d], m) for a, b, m in spots[i, d])


def leaked(documents: DataFrame, items: DataFrame, key: str = "doc_id", column: str = "text", item_key: str = "item_id", least: float = 1 / 3) -> DataFrame:
    """(item_id, doc_id, share, words): the pairs of ``passages``, each once; repeated rows of a document give one row."""
    found = passages(documents, items, key, column, item_key, least)
    return found.groupBy("item_id", key).agg(F.max("share").alias("share"), F.max("words").alias("words"))


def without_leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that hold no item."""
    return documents.join(leaked(documents, items, key).select(key).distinct(), key, "left_anti")
