"""P5: spellings of one person or institution, linked by tries walked with Levenshtein automata.

Both words and whole names are sharded into tries, which are walked with a Levenshtein automaton (one edit, neighbouring
letters swapped counting as one). The words of all names are sharded by length and first or last letters; each rare word
walks to the far commoner word that it misspells. Names are taken apart whatever the order of their words, and each is sharded by
all of its parts but one: in a shard the parts left out are the trie, so names that differ in one part meet wherever it stands, and
names of the same parts in another order meet in the shard of all their parts. Shortened names are linked
by keys of what they still tell, if only one person has that key. All steps are joins and aggregates on keys.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import checkpointed
from .genuine import NO_NAME, NO_PLACE, PLACEHOLDERS, listed

# Short forms that do not begin like the name they stand for.
NICKNAMES = {
    "manolo": "manuel", "nando": "fernando", "paty": "patricia", "pati": "patricia", "betty": "beatriz", "bety": "beatriz", "lalo": "eduardo", "mary": "maria", "charly": "carlos",
    "susy": "susana", "susi": "susana", "pepe": "jose", "rosita": "rosa", "anita": "ana", "paco": "francisco", "pancho": "francisco", "lucho": "luis", "beto": "alberto", "nacho": "ignacio",
    "quique": "enrique", "tono": "antonio", "memo": "guillermo", "chela": "graciela", "gaby": "gabriela", "gabi": "gabriela", "vicho": "vicente", "quino": "joaquin", "chio": "rocio", "juanita": "juana", "juanito": "juan", "olguita": "olga", "lucha": "lucia", "pepa": "josefa", "toño": "antonio", "kike": "enrique", "moni": "monica",
}
# Words of institutions' names in other languages.
TRANSLATED = {
    "university": "universidad", "universidade": "universidad", "universite": "universidad", "institute": "instituto", "institut": "instituto", "pontifical": "pontificia", "catholic": "catolica",
    "national": "nacional", "private": "privada", "technological": "tecnologica", "federal": "federal", "autonomous": "autonoma", "agrarian": "agraria", "higher": "superior", "pedagogical": "pedagogico",
}
TYPE_WORDS = {*TRANSLATED.values(), "pontificia", "escuela"}
PART = re.compile(r"^(facultad|fac|faculty|escuela|school|dpto|depto|departamento|department|sede|campus|seccion|centro|programa|filial)\b")
ACRONYM = re.compile(r"^(?:[A-Z]{3,8}|(?:[A-Z]\.){3,8})$")
MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff]+")
LETTERS = re.compile(r"[^\W\d_]+")


def plain(text: str) -> str:
    """Without accents and case."""
    return text.lower() if text.isascii() else MARKS.sub("", unicodedata.normalize("NFKD", text.casefold()))


class Trie:
    """Words with weights; ``near`` walks it by a Levenshtein automaton of one edit whose states are rows of distances."""

    def __init__(self):
        self.root: dict = {}

    def add(self, word: str, weight: int) -> None:
        node = self.root
        for char in word:
            node = node.setdefault(char, {})
        node[""] = weight

    def near(self, word: str, most: int = 1) -> list[tuple[str, int]]:
        """All words within ``most`` edits (not the word itself); subtrees whose state can no longer accept are left out."""
        found, size = [], len(word)
        stack = [(self.root, "", list(range(size + 1)), None)]
        while stack:
            node, prefix, row, above = stack.pop()
            for char, child in node.items():
                if char == "":
                    if row[size] <= most and prefix != word:
                        found.append((prefix, child))
                    continue
                new = [row[0] + 1]
                for j in range(1, size + 1):
                    cost = min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (word[j - 1] != char))
                    if above is not None and j > 1 and word[j - 2] == char and word[j - 1] == prefix[-1]:
                        cost = min(cost, above[j - 2] + 1)
                    new.append(cost)
                if min(new) <= most:
                    stack.append((child, prefix + char, new, row))
        return found


def _edits(a: str, b: str) -> int:
    """0, 1 or 2 (two or more edits), by what two words share at either end."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > 1:
        return 2
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    if head + tail >= max(n, m) - 1:
        return 1
    return 1 if n == m == head + tail + 2 and a[head] == b[head + 1] and a[head + 1] == b[head] else 2


def by_key(frame: DataFrame) -> DataFrame:
    """``frame`` for a join in which both sides are sorted by key, however small Spark takes it for: what grows with the names is never held by the driver."""
    return frame.hint("merge")


def names_of(papers: DataFrame) -> DataFrame:
    """(kind, name, n): each distinct spelling with its number of rows; placeholders are no names."""
    authors = papers.select(F.lit("author").alias("kind"), F.explode("authors").alias("name"))
    places = papers.select(F.lit("university").alias("kind"), F.col("university").alias("name"))
    rows = authors.unionByName(places).where(F.col("name").isNotNull() & (F.trim("name") != ""))
    none = F.when(F.col("kind") == "author", listed(F.col("name"), PLACEHOLDERS, NO_NAME)).otherwise(listed(F.col("name"), PLACEHOLDERS, NO_PLACE))
    return rows.where(~none).groupBy("kind", "name").agg(F.count("*").alias("n"))


def _words(kind: str, name: str) -> list[str]:
    return LETTERS.findall(plain(name))


def word_shards(word: str, spread: int) -> list[str]:
    """Shards in which a word of four letters or more meets all words of one edit: an edit leaves half of a word as it is.

    Words that others may stand for have ``spread`` 0, words that ask have 1: the other is one letter longer or shorter.
    Of words of three letters those with two letters swapped are left out.
    """
    found = set()
    for size in range(len(word) - spread, len(word) + spread + 1):
        k = max(2, min(4, (size - 2) // 2))
        found |= {f"<{size} {word[:k]}", f">{size} {word[-k:]}"} | ({f"^{size} {word[:1]}{word[-1:]}"} if size <= 4 else set())
    return sorted(found)


def in_shards(asking: DataFrame, known: DataFrame, walk: Callable[[pd.DataFrame], pd.DataFrame], schema: str, group_rows: int = 20_000) -> DataFrame:
    """``walk`` over each shard: rows of both frames (equal columns, with ``shard``), marked by ``asks``; small shards go several to a call.

    A shard with many asking rows is split into parts of about ``group_rows``, each with all known rows of the shard.
    """
    parts = asking.groupBy("shard").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("parts"))
    ask = asking.join(by_key(parts), "shard").withColumn("part", F.pmod(F.xxhash64(*(c for c in asking.columns if c != "shard")), "parts").cast("int")).withColumn("asks", F.lit(True)).drop("parts")
    have = known.join(by_key(parts), "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("asks", F.lit(False)).drop("parts")
    rows = ask.unionByName(have).withColumn("bucket", F.when(F.col("part") > 0, F.xxhash64("shard", "part")).otherwise(F.pmod(F.xxhash64("shard"), F.lit(4096))))

    def each(bucket: pd.DataFrame) -> pd.DataFrame:
        out = [walk(shard) for _, shard in bucket.groupby(["shard", "part"], sort=False) if shard["asks"].any()]
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split(" ")[0] for c in schema.split(", ")])

    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism  # a walk takes long for its bytes, so partitions are not put together by size
    return rows.repartition(tasks, "bucket").groupBy("bucket").applyInPandas(each, schema)


def misspelt(names: DataFrame, ratio: int = 10, only: int = 4, shortest: int = 3) -> DataFrame:
    """(kind, word, right): words that are one edit from a word at least ``ratio`` times as common, the commonest if several, or ``only``
    times if a word of five letters or more has no other neighbour."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: LETTERS.findall(plain(t)))

    @F.pandas_udf("array<string>")
    def own(words: pd.Series) -> pd.Series:
        return words.map(lambda w: word_shards(w, 0))

    @F.pandas_udf("array<string>")
    def near(words: pd.Series) -> pd.Series:
        return words.map(lambda w: word_shards(w, 1))

    words = checkpointed(names.select("kind", "n", F.explode(split("name")).alias("word")).where(f"length(word) >= {shortest}").groupBy("kind", "word").agg(F.sum("n").alias("n")))
    shard = lambda parts: words.select("kind", "word", "n", F.explode(parts).alias("part")).select("kind", "word", "n", F.concat("kind", F.lit(" "), "part").alias("shard"))
    known = shard(own("word")).where(F.col("n") >= only)
    top = known.groupBy("shard").agg(F.max("n").alias("top"))
    asking = shard(near("word")).join(by_key(top), "shard").where(F.col("top") >= only * F.col("n")).drop("top")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        trie, asks = Trie(), rows["asks"].to_numpy(bool)
        for word, n in zip(rows["word"][~asks], rows["n"][~asks], strict=True):
            trie.add(word, n)
        out = [(kind, word, n, right, m) for kind, word, n in zip(rows["kind"][asks], rows["word"][asks], rows["n"][asks], strict=True) for right, m in trie.near(word) if m >= only * n]
        return pd.DataFrame(out, columns=["kind", "word", "n", "right", "m"])

    found = in_shards(asking, known, walk, "kind string, word string, n long, right string, m long").distinct()
    best = found.groupBy("kind", "word", "n").agg(F.max(F.struct("m", "right")).alias("x"), F.count("*").alias("others"))
    return best.where((F.col("x.m") >= ratio * F.col("n")) | ((F.col("others") == 1) & (F.length("word") > 4))).select("kind", "word", F.col("x.right").alias("right"))


def given_words(names: DataFrame, least: float = 0.67) -> DataFrame:
    """(word): words that stand mostly after the comma of names with a comma: given names."""

    @F.pandas_udf("array<struct<word:string,given:int>>")
    def sides(texts: pd.Series) -> pd.Series:
        def each(text: str) -> list[dict]:
            left, _, right = text.partition(",")
            return [{"word": w, "given": g} for g, side in ((0, left), (1, right)) for w in LETTERS.findall(plain(side)) if len(w) > 2]

        return texts.map(each)

    rows = names.where("kind = 'author' and name like '%,%'").select(F.explode(sides("name")).alias("x")).select("x.word", "x.given")
    return rows.groupBy("word").agg(F.avg("given").alias("share")).where(f"share >= {least}").select("word")


def taken_apart(name: str, right: dict[str, str], given: set[str]) -> tuple[list[str], list[str]]:
    """(given names, surnames) of a person's name in any order; single letters are initials."""
    fixed = lambda w: NICKNAMES.get(right.get(w, w), right.get(w, w))
    if name.count(",") == 1:
        left, after = name.split(",")
        raw = LETTERS.findall(after)
        givens = [c for w in raw for c in (plain(w) if len(w) <= 3 and w.isupper() and plain(w) not in given else [fixed(plain(w))])]
        return givens, [fixed(plain(w)) for w in LETTERS.findall(left)]
    raw = LETTERS.findall(name)
    words = [fixed(plain(w)) for w in raw]
    packed = lambda w, raw: len(raw) <= 3 and raw.isupper() and w not in given
    if not words:
        return [], []
    n = 0
    if words[0] in given or len(words[0]) == 1 or (packed(words[0], raw[0]) and len(words) > 1):
        while n < len(words) - 1 and (words[n] in given or len(words[n]) == 1):
            n += 1
        return words[: max(n, 1)], words[max(n, 1) :]
    while n < len(words) and words[n] not in given and not (n and packed(words[n], raw[n])):
        n += 1
    return [c for w, r in zip(words[n:], raw[n:], strict=True) for c in (w if packed(w, r) else [w])], words[:n]


def _same_given(a: str, b: str) -> bool:
    if len(a) == 1 or len(b) == 1:
        return a[:1] == b[:1]
    return a == b or (min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a))) or (min(len(a), len(b)) >= 4 and (a.endswith(b) or b.endswith(a))) or (len(a) > 4 and len(b) > 4 and _edits(a, b) == 1 and a[-1] == b[-1])


def merged_keys(keys: DataFrame, ratio: int = 3) -> DataFrame:
    """(s1, s2, g1, t1, t2, h1): full names (two surnames, a given name) that misspell another one, with that one.

    A trie join: the shard of a name is all of its parts but one, whatever their order; the trie holds the parts left out. Parts within one edit, and
    given names of which one is short for the other, are neighbours; so are the same parts in another order. The other name has ``ratio`` times as many rows.
    """

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for s1, s2, g1, n in zip(frame["s1"], frame["s2"], frame["g1"], frame["n"], strict=True):
                for role, rest, word in (("s1", (s2, g1), s1), ("s2", (s1, g1), s2), ("g1", (s1, s2), g1), ("order", tuple(sorted((s1, s2, g1))), "")):
                    out.append((f"{role} {' '.join(rest)}", word, s1, s2, g1, n))
            yield pd.DataFrame(out, columns=["shard", "word", "s1", "s2", "g1", "n"])

    schema = "shard string, word string, s1 string, s2 string, g1 string, n long"
    rows = checkpointed(keys.mapInPandas(entries, schema))
    shared = rows.groupBy("shard").agg(F.max("n").alias("top"), F.min("n").alias("low"), F.count("*").alias("m")).where(F.col("m") > 1).where(F.col("top") >= ratio * F.col("low"))
    rows = rows.join(by_key(shared.select("shard", "top")), "shard")
    asking = rows.where(F.col("top") >= ratio * F.col("n")).drop("top")

    def walk(shard: pd.DataFrame) -> pd.DataFrame:
        asks, role = shard["asks"].to_numpy(bool), shard["shard"].iloc[0].split(" ", 1)[0]
        known: dict[str, list[tuple]] = defaultdict(list)
        trie = Trie()
        for word, n, *key in zip(*(shard[c][~asks] for c in ("word", "n", "s1", "s2", "g1")), strict=True):
            known[word].append((n, *key))
            trie.add(word, n)
        out = []
        for word, n, *key in zip(*(shard[c][asks] for c in ("word", "n", "s1", "s2", "g1")), strict=True):
            near = [word] if role == "order" else [w for w, _ in trie.near(word)] if len(word) > 3 else []
            if role == "g1":
                near = [w for w in known if w != word and _same_given(w, word)]
            best = max((x for w in near for x in known[w] if x[1:] != tuple(key) and x[0] >= ratio * n), default=None)
            if best:
                out.append((*key, *best))
        return pd.DataFrame(out, columns=["s1", "s2", "g1", "m", "t1", "t2", "h1"])

    found = in_shards(asking, rows.drop("top"), walk, "s1 string, s2 string, g1 string, m long, t1 string, t2 string, h1 string")
    best = checkpointed(found.groupBy("s1", "s2", "g1").agg(F.max(F.struct("m", "t1", "t2", "h1")).alias("x")).select("s1", "s2", "g1", "x.t1", "x.t2", "x.h1"))
    again = best.select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.col("g1").alias("h1"), F.col("t1").alias("u1"), F.col("t2").alias("u2"), F.col("h1").alias("i1"))
    return best.join(by_key(again), ["t1", "t2", "h1"], "left").select("s1", "s2", "g1", F.coalesce("u1", "t1").alias("t1"), F.coalesce("u2", "t2").alias("t2"), F.coalesce("i1", "h1").alias("h1"))


def second_names(seconds: list[str]) -> dict[str, str]:
    """For each second given name of one first name and surnames the one it stands for; initials go to the only name that they fit, none to the only name."""
    chosen: dict[str, str] = {}
    full: list[str] = []
    for second in sorted({x for x in seconds if x}, key=lambda x: (-len(x), x)):
        like = [m for m in full if _same_given(m, second)]
        if len(like) == 1:
            chosen[second] = like[0]
        else:
            full.append(second)
            chosen[second] = second
    return {**chosen, "": full[0] if len(full) == 1 else ""}


def signatures(s1: str, s2: str, g1: str, g2: str) -> list[str]:
    """What shortened spellings of a full name may still tell: the first surname, with the other parts whole, shortened or left out."""
    first = {g1, g1[:1], *(g1[:k] for k in range(3, min(len(g1), 7))), *(g1[-k:] for k in (4, 5) if len(g1) > k)}
    second = {"", g2, g2[:1]} if g2 else {"", "*"}
    surname = {"", s2, s2[:1]}
    return sorted({f"{s1}|{a}|{b}|{c}" for a in first for b in second for c in surname} | {f"{s1}|||{c}" for c in surname})


def person_clusters(parsed: DataFrame) -> DataFrame:
    """(name, cluster) of the names that can mean one person only, and of shortened ones that fit no full name (by what they tell)."""
    rows = parsed.where("kind = 'author' and shard <> ''").select("name", "n", F.col("shard").alias("s1"), *(F.coalesce(F.get(c, F.lit(k)), F.lit("")).alias(x) for x, c, k in (("s2", "surnames", 1), ("g1", "given", 0), ("g2", "given", 1))))
    whole = (F.length("g1") > 1) & (F.length("s2") > 1)
    full = rows.where(whole)
    keys = checkpointed(full.groupBy("s1", "s2", "g1").agg(F.sum("n").alias("n")))
    moved = merged_keys(keys)
    now = [F.coalesce(t, s).alias(s) for s, t in (("s1", "t1"), ("s2", "t2"), ("g1", "h1"))]
    full = checkpointed(full.join(by_key(moved), ["s1", "s2", "g1"], "left").select("name", *now, "g2"))

    @F.pandas_udf("array<struct<g2:string,canon:string>>")
    def told(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: [{"g2": a, "canon": b} for a, b in second_names(list(x)).items()])

    seconds = full.groupBy("s1", "s2", "g1").agg(F.collect_set("g2").alias("all")).select("s1", "s2", "g1", F.explode(told("all")).alias("x")).select("s1", "s2", "g1", "x.g2", "x.canon")
    full = full.join(by_key(seconds), ["s1", "s2", "g1", "g2"]).select("name", "s1", "s2", "g1", F.col("canon").alias("g2"))
    full = checkpointed(full.withColumn("cluster", F.concat_ws("|", "s1", "s2", "g1", "g2")))

    def keys_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(key, who) for s1, s2, g1, g2, who in zip(*(frame[c] for c in ("s1", "s2", "g1", "g2", "cluster")), strict=True) for key in signatures(s1, s2, g1, g2)]
            yield pd.DataFrame(out, columns=["key", "who"])

    persons = full.select("s1", "s2", "g1", "g2", "cluster").distinct().mapInPandas(keys_of, "key string, who string")
    unique = persons.groupBy("key").agg(F.min("who").alias("who"), F.max("who").alias("last"))
    loose = rows.where(~whole).withColumn("key", F.concat_ws("|", "s1", "g1", "g2", "s2")).withColumn("bare", F.when(F.col("g2") != "", F.concat_ws("|", "s1", "g1", F.lit("*"), "s2")).otherwise(F.col("key")))
    one = unique.select("key", F.col("who").alias("a"), F.col("last").alias("z"))
    two = unique.select(F.col("key").alias("bare"), F.col("who").alias("ba"), F.col("last").alias("bz"))
    found = loose.join(by_key(one), "key", "left").join(by_key(two), "bare", "left").withColumns({"a": F.coalesce("a", "ba"), "z": F.coalesce("z", "bz")})
    alone = F.concat_ws("|", F.lit("~"), "s1", F.substring("g1", 1, 1), "s2")
    found = found.where("a is null or a = z").select("name", F.coalesce("a", alone).alias("cluster"))
    return full.select("name", "cluster").unionByName(found)


def parted(name: str, right: dict[str, str]) -> tuple[str, str, str]:
    """(type, place, acronym) of an institution's name without its faculties and sites."""
    acronym = ""
    text = name.strip()
    if ACRONYM.match(text):
        return "", "", plain(text.replace(".", ""))
    if found := re.search(r"\(([A-Z]{3,8})\)", text):
        acronym, text = plain(found[1]), text.replace(found[0], " ")
    elif found := re.match(r"([A-Z]{3,8})\s+-\s+", text):
        acronym, text = plain(found[1]), text[found.end() :]
    pieces = [p.strip() for p in re.split(r",\s|\s-\s|(?<=[^\W\d_]{4})(?<!dpto)(?<!inst)(?<!univ)(?<!pont)\.\s", plain(text)) if p.strip()]
    pieces = [p for p in pieces if not PART.match(p)] or pieces[:1]
    if len(pieces) > 1:
        ends = [p for p in pieces if re.search(r"\b(de|of|do|da)$", p)]
        pieces = [*ends, *(p for p in pieces if p not in ends)]
    words = [TRANSLATED.get(right.get(w, w), right.get(w, w)) for w in LETTERS.findall(" ".join(pieces))]
    kind: list[str] = []
    while words and (words[0] in TYPE_WORDS or words[0] in ("de", "of", "do", "da") or len(words[0]) == 1 or any(t.startswith(words[0]) for t in TYPE_WORDS)):
        if words[0] not in ("de", "of", "do", "da"):
            kind.append(words[0])
        words = words[1:]
    return " ".join(_ordered(kind)), " ".join(w for w in words if w not in ("de", "of")), acronym


def _ordered(kind: list[str]) -> list[str]:
    """English word order turned: the noun first, unless the name opens with a church title."""
    if "universidad" in kind[1:] and kind[0] != "pontificia" and len(kind[0]) > 1:
        rest = [w for w in kind if w != "universidad"]
        return ["universidad", *rest]
    if kind and kind[-1] == "instituto":
        return ["instituto", *kind[:-1]]
    if kind == ["pontificia", "catolica", "universidad"]:
        return ["pontificia", "universidad", "catolica"]
    return kind


def _short_of(short: list[str], full: list[str]) -> bool:
    """Whether every word is cut from the full one at its place; a single first letter may stand for any first word."""
    return len(short) == len(full) and all(f.startswith(s) or (i == 0 and len(s) == 1) for i, (s, f) in enumerate(zip(short, full, strict=True)))


def type_of(words: str, types: list[str]) -> str | None:
    """The type of one place's institutions that shortened words stand for; None if several fit, a mark of its own if none does."""
    short = words.split(" ")
    fits = [t for t in types if _short_of(short, t.split(" "))]
    fits = [t for t in fits if t.split(" ")[0].startswith(short[0])] or fits
    return fits[0] if len(fits) == 1 else "?" + words if not fits else None


def institution_clusters(ready: DataFrame) -> DataFrame:
    """(name, cluster): spellings of one institution by place and type."""
    rows = ready.where("kind = 'university'").select("name", F.col("shard").alias("place"), "type")
    whole = F.forall(F.split("type", " "), lambda w: w.isin(sorted(TYPE_WORDS)))
    full = rows.where(whole)
    types = full.groupBy("place").agg(F.collect_set("type").alias("types"))

    @F.pandas_udf("string")
    def told(words: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([type_of(w, sorted(x) if x is not None else []) for w, x in zip(words, lists, strict=True)], dtype=object)

    short = rows.where(~whole).join(by_key(types), "place", "left").select("name", "place", told("type", "types").alias("type")).where("type is not null")
    return full.unionByName(short.select(*full.columns)).select("name", F.concat_ws("|", "place", "type").alias("cluster"))


def linked(papers: DataFrame) -> DataFrame:
    """(kind, name_a, name_b): all pairs of distinct spellings of one person or institution, name_a < name_b by code point.

    Null, empty and placeholder names have none. Only distinct spellings are compared, however many rows have them; an
    abbreviation that fits several entities is linked to none.
    """
    names = checkpointed(names_of(papers))
    right = misspelt(names)
    given = given_words(names).withColumn("is_given", F.lit(True))

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: LETTERS.findall(plain(t)))

    words = names.select("kind", "name", "n", F.explode(split("name")).alias("word")).join(by_key(right), ["kind", "word"], "left")
    words = words.withColumn("now", F.coalesce("right", "word")).join(by_key(given.withColumnRenamed("word", "now")), "now", "left")
    rows = words.groupBy("kind", "name", "n").agg(
        F.array_distinct(F.collect_list(F.when(F.col("right").isNotNull(), F.struct("word", "right")))).alias("right"), F.array_distinct(F.collect_list(F.when(F.col("is_given"), F.col("now")))).alias("given")
    )

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for kind, name, n, fixes, known in zip(frame["kind"], frame["name"], frame["n"], frame["right"], frame["given"], strict=True):
                fix = {x["word"]: x["right"] for x in fixes}
                if kind == "author":
                    g, s = taken_apart(name, fix, {*known, *NICKNAMES, *NICKNAMES.values()})
                    out.append((kind, name, n, s[0] if s else "", g, s, "", ""))
                else:
                    type_, place, acronym = parted(name, fix)
                    out.append((kind, name, n, place, [], [], type_, acronym))
            yield pd.DataFrame(out, columns=["kind", "name", "n", "shard", "given", "surnames", "type", "acronym"])

    parsed = checkpointed(rows.mapInPandas(parse, "kind string, name string, n long, shard string, given array<string>, surnames array<string>, type string, acronym string"))
    spelled = parsed.where("kind = 'university' and acronym <> '' and shard <> ''").groupBy("acronym").agg(F.min(F.struct("type", "shard")).alias("x"), F.count_distinct("type", "shard").alias("m"))
    spelled = spelled.where("m = 1").select(F.col("acronym").alias("a"), F.col("x.type").alias("t"), F.col("x.shard").alias("p"))
    bare = parsed.where("kind = 'university' and shard = '' and acronym <> ''").join(by_key(spelled), F.col("acronym") == F.col("a"))
    bare = bare.select("kind", "name", "n", F.col("p").alias("shard"), "given", "surnames", F.col("t").alias("type"), "acronym")
    ready = parsed.where("shard <> ''").unionByName(bare)
    clusters = person_clusters(parsed).select(F.lit("author").alias("kind"), "name", "cluster").unionByName(institution_clusters(ready).select(F.lit("university").alias("kind"), "name", "cluster"))
    return pairs_of(checkpointed(clusters.distinct()))


def pairs_of(clusters: DataFrame, group_rows: int = 200) -> DataFrame:
    """(kind, name_a, name_b): all pairs within clusters; a cluster of many spellings is split into blocks on one side."""
    sizes = clusters.groupBy("kind", "cluster").agg(F.count("*").alias("m")).where("m > 1").select("kind", "cluster", F.ceil(F.col("m") / group_rows).cast("int").alias("blocks"))
    rows = clusters.join(by_key(sizes), ["kind", "cluster"])
    left = rows.select("kind", "cluster", F.col("name").alias("name_a"), F.pmod(F.xxhash64("name"), "blocks").cast("int").alias("block"))
    right = rows.select("kind", "cluster", F.col("name").alias("name_b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return left.join(by_key(right), ["kind", "cluster", "block"]).where("name_a < name_b").select("kind", "name_a", "name_b").distinct()
