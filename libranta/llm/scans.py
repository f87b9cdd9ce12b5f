"""P6: text from scanned pages, with its noise found kind by kind and repaired into continuous paragraphs.

Words are checked against the vocabulary of the corpus itself. The vocabulary is sharded into tries; a rare word walks the
tries of its shards by a Levenshtein automaton in which letter groups that scanners confuse cost less than other edits,
so all commoner words that it may stand for are its candidates. Those that the words around it call for are taken.
Running headers, footers and page numbers are told from tables and repeated lines of the text by their place
and sequence; then lines are joined again. Counts, candidates and contexts are tables joined by words, and all
thresholds are ratios of counts, so nothing depends on the size of the corpus but the evidence.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import checkpointed
from .once import Sent
from .spellings import in_shards

JOINT = "\x01"  # where a broken word was joined
HYPHENS = "-‐‑¬­"
END = re.compile(rf"([^\W\d_]+)[{HYPHENS}]\s*$")
START = re.compile(r"\s*([^\W\d_]+)")
COMPOUND = re.compile(r"[^\W\d_]+(?:[-‐‑][^\W\d_]+)+")
TOKEN = re.compile(r"[^\W_]+(?:[|!†$][^\W_]*)*|[|!†][^\W_]+")
SLOT = re.compile(rf"[^\W_{JOINT}](?:[^\W_]|[|!†$]|{JOINT})*|[|!†][^\W_]+")
MIXED = re.compile(r"(?=.*[^\W\d_])(?:.*[^\W\d_][01568|!†$]|[01568|!†$][^\W\d_])")
# What scanners read for what stands there.
CONFUSED = [("0", "o"), ("1", "l"), ("1", "i"), ("|", "i"), ("|", "l"), ("!", "i"), ("!", "l"), ("5", "s"), ("8", "b"), ("6", "b"), ("†", "t"), ("$", "s"), ("ii", "u"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("li", "h"), ("c", "e"), ("e", "c"), ("m", "rn"), ("h", "li"), ("d", "cl"), ("u", "ii"), ("l", "i"), ("i", "l"), ("n", "ri"), ("f", "t"), ("t", "f")]
# The same letter groups written out in one notation: words that differ by confusions only are equal in it.
WRITTEN_OUT = str.maketrans({"m": "rri", "n": "ri", "d": "ci", "w": "vv", "h": "ii", "u": "ii", "e": "c", "l": "i", "f": "t", "0": "o", "1": "i", "|": "i", "!": "i", "5": "s", "8": "b", "6": "b", "†": "t", "$": "s"})
EDIT, CONFUSION, MOST = 4, 1, 5  # costs: one edit with one confusion, or up to five confusions
RARE, SURE = 10, 50  # how many times commoner the right word must be, with and without words around it that call for it
NUMBERED = re.compile(r"(?i)^[\W_]*(?:(?:p[áa]g(?:ina)?|page|p)\.?\s*)?(\d{1,4})(?:\s*(?:de|of|sur|/)\s*\d{1,4})?[\W_]*$")
NUMBERED_END = re.compile(r"(?i)(?:p[áa]gina|page|p[áa]g\.)\s(\d{1,4})(?:\s(?:de|of|sur|/)\s\d{1,4})?\s*$")
BESIDE = re.compile(r"^(?:(\d{1,4})(?:\s+\||\s{2,}|\s+[·—-])\s*(\D{3,})|(\D{3,}?)(?:\s*\||\s{2,}|\s[·—-]\s)\s*(\d{1,4}))$")
ROW = re.compile(r"^\W*(?:(?:19|20)\d\d)\b[\s|]*(?:\d+[.,]\d+)?[\s|]*$")
TABLE = re.compile(r"(?i)^\W*(?:tabla|tabela|table|tableau|figura|figure)\s+\d+\W*$|^\s*\|")
SOURCE = re.compile(r"(?i)^\W*(?:fuente|source|fonte|elaboraci[óo]n)\b")
MARKUP = re.compile(r"^[#*_>\s]+|[*_\s]+$")


def plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def tokens(text: str) -> tuple[list[str], list[str]]:
    """Words of the text in order, and those that were joined from two lines."""
    joined = []
    lines = text.replace("\x0c", "\n").split("\n")
    out = []
    for i, line in enumerate(lines):
        found = END.search(line) if line.rstrip()[-1:] in HYPHENS else None
        if found:
            following = next((x for x in lines[i + 1 : i + 4] if x.strip()), "")
            if rest := START.match(following):
                joined.append((found[1] + rest[1]).lower())
            line = line[: found.start()]
        out += [t.lower() for t in TOKEN.findall(line)]
    return out, joined


def pair_hash(a: str, b: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{a} {b}") - (1 << 63)


class Automaton:
    """A trie of words with weights, walked by a Levenshtein automaton with cheap confusions; states are rows of costs."""

    def __init__(self, words: list[tuple[str, int]]):
        self.root: dict = {}
        for word, n in words:
            node = self.root
            for char in word:
                node = node.setdefault(char, {})
                node["most"] = max(n, node.get("most", 0))
            node[""] = n
        self.single: dict[str, list[str]] = {}
        self.double: dict[str, list[str]] = {}
        for wrong, right in CONFUSED:
            (self.single if len(right) == 1 else self.double).setdefault(right, []).append(wrong)

    def near(self, word: str, least: int, edits: bool = True) -> list[tuple[str, int, int]]:
        """(right word, its weight, cost) of all words of weight ``least`` or more within MOST."""
        found, size, most = [], len(word), MOST if edits else EDIT - 1
        stack = [(self.root, "", [EDIT * j for j in range(size + 1)], None)]
        while stack:
            node, prefix, row, above = stack.pop()
            for char, child in node.items():
                if char == "":
                    if row[size] <= most and child >= least and prefix != word:
                        found.append((prefix, child, row[size]))
                    continue
                if char == "most" or child["most"] < least:
                    continue
                new = [row[0] + EDIT]
                low = new[0]
                for j in range(1, size + 1):
                    cost = row[j - 1] if word[j - 1] == char else row[j - 1] + EDIT
                    if row[j] + EDIT < cost:
                        cost = row[j] + EDIT
                    if new[j - 1] + EDIT < cost:
                        cost = new[j - 1] + EDIT
                    new.append(cost)
                    low = min(low, cost)
                for wrong in self.single.get(char, ()):
                    low = min(low, _confused(word, wrong, row, new))
                if above is not None and (wrongs := self.double.get(prefix[-1] + char)):
                    for wrong in wrongs:
                        low = min(low, _confused(word, wrong, above, new))
                if low <= most or any(c <= most for c in row):
                    stack.append((child, prefix + char, new, row))
        return found


def _confused(word: str, wrong: str, start: list[int], new: list[int]) -> int:
    """Lowers costs in ``new`` where ``wrong`` ends in the word; the lowest of them."""
    low, at = 1 << 30, word.find(wrong)
    while at >= 0:
        end = at + len(wrong)
        cost = start[at] + CONFUSION
        if cost < new[end]:
            new[end] = cost
            for j in range(end + 1, len(new)):  # what follows may get cheaper by deletions
                if new[j - 1] + EDIT >= new[j]:
                    break
                new[j] = new[j - 1] + EDIT
        low = min(low, cost)
        at = word.find(wrong, at + 1)
    return low


def shards(word: str, spread: int) -> list[str]:
    """Shards in which a word meets all words within one edit and any confusions (of four letters or more, else confusions alone).

    An edit leaves the first or the last half of a word as it is, and confusions leave it as it is when written out. Words of
    the vocabulary have ``spread`` 0; the written-out length of a word that may stand for one is off by 3 at most.
    """
    out = word.translate(WRITTEN_OUT)
    found = set()
    for size in range(len(out) - spread, len(out) + spread + 1):
        k = max(2, min(4, (size - 6) // 2))
        found |= {f"<{size // 4} {out[:k]}", f">{size // 4} {out[-k:]}"}
    return sorted(found)


def candidates(counted: DataFrame, group_rows: int = 20_000) -> DataFrame:
    """(word, n, right, m, cost): all commoner words that a word may stand for, from (word, n).

    ``right`` stands in RARE times as many documents or more. The vocabulary is joined shard by shard; a shard with
    many rare words is split into parts of about ``group_rows``, each with the commoner words of the shard.
    """

    @F.pandas_udf("array<string>")
    def own(words: pd.Series) -> pd.Series:
        return words.map(lambda w: shards(w, 0))

    @F.pandas_udf("array<string>")
    def near(words: pd.Series) -> pd.Series:
        return words.map(lambda w: shards(w, 3))

    letters = F.col("word").rlike(r"^\p{L}+$")
    common = counted.where(letters & (F.length("word") > 2) & (F.col("n") >= RARE)).select("word", "n", F.explode(own("word")).alias("shard"))
    rare = counted.where((letters & (F.length("word") > 3)) | F.col("word").rlike(r"\p{L}.*[01568|!†$]|[01568|!†$].*\p{L}")).select("word", "n", F.explode(near("word")).alias("shard"))
    rare = rare.join(common.groupBy("shard").agg(F.max("n").alias("top")), "shard").where(F.col("top") >= RARE * F.col("n")).drop("top")

    def walk(shard: pd.DataFrame) -> pd.DataFrame:
        asks = shard["asks"].to_numpy(bool)
        trie = Automaton(list(zip(shard["word"][~asks], shard["n"][~asks], strict=True)))
        out = [
            (word, n, right, m, cost)
            for word, n in zip(shard["word"][asks], shard["n"][asks], strict=True)
            for right, m, cost in trie.near(word, RARE * n, len(word) > 3)
            if cost < EDIT or len(right) > 3
        ]
        return pd.DataFrame(out, columns=["word", "n", "right", "m", "cost"])

    return in_shards(rare, common, walk, "word string, n long, right string, m long, cost int", group_rows).groupBy("word", "n", "right", "m").agg(F.min("cost").alias("cost"))


class Filter:
    """A Bloom filter of words. It only saves work: what passes wrongly finds no partner in the join that follows."""

    def __init__(self, sent: tuple[int, np.ndarray]):
        self.bits, self.slots = sent
        self.memo: dict[str, bool] = {}

    def __contains__(self, word: str) -> bool:
        known = self.memo.get(word)
        if known is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            h = xxhash.xxh64_intdigest(word, seed=42)
            known = self.memo[word] = all(self.slots[at >> 6] >> (at & 63) & 1 for at in (int(h & 0xFFFFFFFF) % self.bits, int(h >> 32) % self.bits))
        return known


def word_filter(words: DataFrame, column: str, most_bits: int = 1 << 28) -> tuple[int, np.ndarray]:
    """Bits of a filter of all words, 16 or more for each up to ``most_bits`` (32 MB), however many words there are."""
    bits = 1 << 10
    n = words.count()
    while bits < 16 * n and bits < most_bits:
        bits *= 2
    h = F.xxhash64(column)
    at = F.explode(F.array(F.pmod(h.bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(bits)))).alias("at")
    slots = words.select(at).groupBy(F.shiftright("at", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")).collect()
    out = np.zeros(bits >> 6, np.uint64)
    for row in slots:
        out[row["slot"]] = row["set"] & 0xFFFFFFFFFFFFFFFF
    return bits, out


class Page:
    """One text taken apart."""

    def __init__(self, text: str):
        self.lines = [line for part in text.split("\x0c") for line in (*part.split("\n"), "\x0c")][:-1]
        self.bare = [MARKUP.sub("", line).strip() for line in self.lines]
        self.numbers, self.ends, self.beside = self._numbers()
        self.headers = self._headers()
        self.furniture = self.numbers | self.headers | {i for i, line in enumerate(self.lines) if line == "\x0c"}

    def _numbers(self) -> tuple[set[int], set[int], dict[int, str]]:
        sure, open_, ends, beside = [], [], set(), {}
        for i, (line, bare) in enumerate(zip(self.lines, self.bare, strict=True)):
            if not bare or TABLE.match(line):
                continue
            if found := NUMBERED.match(line.strip()):
                number = int(found[1])
                if re.fullmatch(r"#*\s*\d+[.,;:)%]+", line.strip()):
                    continue  # the end of a sentence or an item of a list
                decorated = not line.strip(" #").isdigit()
                if not decorated and re.fullmatch(r"(?:19|20)\d\d", found[1]):
                    continue
                if decorated and ROW.match(line):
                    continue
                (sure if decorated else open_).append((i, number))
            elif found := NUMBERED_END.search(line):
                ends.add(i)
            elif found := BESIDE.match(bare):
                beside[i] = (int(found[1] or found[4]), plain(found[2] or found[3]).strip(" |·—-"))
        known = Counter(label for _, label in beside.values())
        kept = {i: label for i, (_, label) in beside.items() if known[label] > 1 and not label.startswith(("tabla", "tabela", "table"))}
        lone = {i: label for i, (_, label) in beside.items() if i not in kept and re.fullmatch(r"tesis|tese|these|thesis|report|reporte|informe|rapport|relatorio|articulo|article|artigo", label)}
        kept |= lone
        numbers = {i for i, _ in sure}
        for i, number in open_:
            follows = any(abs(number - other) == abs(rank) and rank for rank, other in self._ranked(i, open_ + sure))
            if follows or (self._edge(i) and number < 1000 and not self._in_table(i)):
                numbers.add(i)
        return numbers, ends, kept

    def _ranked(self, i: int, spots: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """(pages on, number) of the neighbours of a spot among those that are no row of a table."""
        clear = sorted((at, n) for at, n in spots if at == i or not self._in_table(at))
        me = [at for at, _ in clear].index(i)
        return [(k - me, n) for k, (_, n) in enumerate(clear) if 0 < abs(k - me) <= 2] if not self._in_table(i) or self._edge(i) else []

    def _in_table(self, i: int) -> bool:
        """Whether the nearest lines with text are rows or the heading of a table, or the note on its source comes next."""
        before = next((self.bare[j] for j in range(i - 1, max(-1, i - 5), -1) if self.bare[j]), "")
        after = next((self.bare[j] for j in range(i + 1, min(len(self.bare), i + 5)) if self.bare[j]), "")
        return any(ROW.match(x) or TABLE.match(x) for x in (before, after)) or bool(SOURCE.match(after))

    def _edge(self, i: int) -> bool:
        beside = {self.lines[j] for j in (i - 1, i + 1) if 0 <= j < len(self.lines)}
        return "\x0c" in beside or i == 0 or i == len(self.lines) - 1

    def _headers(self) -> set[int]:
        title = self._title()
        spots: dict[str, list[int]] = {}
        for i, (line, bare) in enumerate(zip(self.lines, self.bare, strict=True)):
            if not bare or i in self.numbers or TABLE.match(line) or ROW.match(line) or bare[-1] in ".:;!?" or not any(c.isalpha() for c in bare) or len(bare) > 90:
                continue
            key = re.sub(r"[^a-z]", "", plain(bare))[:14]
            if len(key) >= 5:
                spots.setdefault(key, []).append(i)
        found = set(self.beside)
        for rows in spots.values():
            first = self.bare[rows[0]]
            upper = first.upper() == first
            short = len(first.split()) <= 6 and first[:1].isupper()
            runs_on = plain(first)
            head = bool(title) and (title.startswith(runs_on[:40]) or title[:30] in runs_on)
            if head and not upper and len(rows) > 1 and len(self.bare[rows[0]]) > len(self.bare[rows[-1]]) and plain(self.bare[rows[0]]) == title:
                rows = rows[1:]  # the title itself
                found |= set(rows)
            elif len(rows) > 1 and (upper or short or head or " / " in first):
                keep = rows if not (head and not upper and plain(first) == title and len(rows) == 1) else []
                found |= {i for i in keep if self._breaks(i)} if short and not head and not upper else set(keep)
            elif len(rows) == 1 and head and plain(first) != title and rows[0] > 0 and len(first) >= 25:
                found |= set(rows)
            elif len(rows) == 1 and " / " in first and title[:18] in runs_on:
                found |= set(rows)
        return found

    def _title(self) -> str:
        """The first line of more than five words if it stands by itself: running text goes on in the next line."""
        for i, bare in enumerate(self.bare):
            if len(bare.split()) > 5 and i not in self.numbers and i not in self.ends:
                alone = i + 1 == len(self.lines) or not self.bare[i + 1] or self.lines[i].startswith("#") or i + 1 in self.numbers or len(self.bare[i + 1].split()) <= 5
                after = self.bare[i + 1] if i + 1 < len(self.bare) else ""
                if plain(bare)[:15] == plain(after)[:15]:
                    return plain(after)  # a running header above the title
                return plain(bare) if alone else ""
        return ""

    def _breaks(self, i: int) -> bool:
        """Whether a line stands between lines of running text or beside other furniture, not between blank lines of its own."""
        before = self.lines[i - 1] if i else "\x0c"
        after = self.lines[i + 1] if i + 1 < len(self.lines) else "\x0c"
        return bool(before.strip(" ")) or bool(after.strip(" ")) or i - 1 in self.numbers or i + 1 in self.numbers

    def text_lines(self) -> list[str]:
        """Lines of the text itself, without furniture; blank lines stay."""
        return [NUMBERED_END.sub("", line) if i in self.ends else line for i, line in enumerate(self.lines) if i not in self.furniture and i not in self.beside]

    def joined(self) -> tuple[list[str], list[tuple[str, str]]]:
        """Lines with broken words joined by JOINT, and the two parts of each of these words in order."""
        lines, out, joints = self.text_lines(), [], []
        i = 0
        while i < len(lines):
            line = lines[i].replace(JOINT, " ")
            while found := END.search(line) if line.rstrip()[-1:] in HYPHENS else None:
                j = i + 1
                while j < len(lines) and not lines[j].strip():
                    j += 1
                rest = START.match(lines[j]) if j < len(lines) and j - i <= 3 else None
                if not rest or not rest[1][0].islower() and not found[1].isupper():
                    break
                joints.append((found[1].lower(), rest[1].lower()))
                line = line[: found.end(1)] + JOINT + lines[j].lstrip().replace(JOINT, " ")
                i = j
            out.append(line)
            i += 1
        return out, joints

    def words(self) -> Iterator[tuple[int, str, str, str, int]]:
        """(place, word before, word, word after, kind) of each word that might be misread; kind 2 is surely misread, 1 has digits or strokes, 0 has letters only.

        The places are those of all words, also of the joined ones, over all lines.
        """
        found = [t for line in self.joined()[0] for t in SLOT.findall(line)]
        low = [t.replace(JOINT, "").lower() for t in found]
        for k, token in enumerate(found):
            if JOINT in token:
                continue
            kind = -1
            if MIXED.match(token) and not re.fullmatch(r"[A-Z]{1,4}\d+", token):
                kind = 2 if re.search(r"[^\W\d_][01|!†$][^\W\d_]", token) else 1
            elif token.islower() and len(token) > 3 or token.isupper() and len(token) > 5:
                kind = 0
            if kind >= 0:
                yield k, low[k - 1] if k else "", low[k], low[k + 1] if k + 1 < len(low) else "", kind

    def repaired(self, right: dict[int, str], own: dict[int, bool]) -> str:
        """The text in continuous paragraphs, with the ``right`` words at their places; joints with a hyphen of their ``own`` keep it."""
        lines, _ = self.joined()
        paragraphs, current = [], []
        place = joint = -1

        def each(match: re.Match) -> str:
            nonlocal place, joint
            place += 1
            token, now = match[0], right.get(place)
            for _ in range(token.count(JOINT)):
                joint += 1
                token = token.replace(JOINT, "-" if own.get(joint) else "", 1)
            if now is None:
                return token
            return now.upper() if token.isupper() else now.capitalize() if token[0].isupper() else now

        for at, line in enumerate(lines):
            fixed = SLOT.sub(each, line)
            if not line.strip() and current and current[-1][-1:] not in ".!?:;" and next((x.strip()[0].islower() for x in lines[at + 1 : at + 4] if x.strip()), False):
                continue  # a page ended inside a sentence
            if not line.strip() or TABLE.match(line) or ROW.match(line) or line.lstrip().startswith("#"):
                if current:
                    paragraphs.append(" ".join(current))
                    current = []
                if line.strip():
                    paragraphs.append(fixed.strip())
            else:
                current.append(fixed.strip())
        if current:
            paragraphs.append(" ".join(current))
        return "\n\n".join(paragraphs)


def texts(pdf_texts: DataFrame, markdown_results: DataFrame) -> DataFrame:
    """(tab, row_id, text, sig) of both tables; null and empty texts have no row. ``sig`` tells texts under one id apart."""
    a = pdf_texts.select(F.lit("pdf_texts").alias("tab"), F.col("file_id").cast("long").alias("row_id"), "text")
    b = markdown_results.select(F.lit("markdown_results").alias("tab"), F.col("md_id").cast("long").alias("row_id"), F.col("markdown").alias("text"))
    return a.unionByName(b).where("row_id is not null and length(trim(text)) > 0").withColumn("sig", F.xxhash64("text"))


def counts(rows: DataFrame) -> DataFrame:
    """(word, hash, n, j): in how many texts each word or compound stands whole (n) and broken over two lines (j); pairs of neighbours have a hash instead."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            whole: Counter[str] = Counter()
            broken: Counter[str] = Counter()
            pairs: Counter[int] = Counter()
            for text in frame["text"]:
                found, joined = tokens(text)
                whole.update({*found, *(c.lower().replace("‐", "-").replace("‑", "-") for c in COMPOUND.findall(text))})
                broken.update(set(joined))
                pairs.update({pair_hash(a, b) for a, b in set(zip(found, found[1:])) if a.isalpha() and b.isalpha()})  # noqa: B905
            words = list(whole.keys() | broken.keys())
            yield pd.DataFrame({"word": words, "hash": 0, "n": [whole[w] for w in words], "j": [broken[w] for w in words]})
            if pairs:
                yield pd.DataFrame({"word": None, "hash": list(pairs), "n": list(pairs.values()), "j": 0})

    return rows.select("text").mapInPandas(batches, "word string, hash long, n long, j long").groupBy("word", "hash").agg(F.sum("n").alias("n"), F.sum("j").alias("j"))


FOUND = "tab string, row_id long, sig long, kind string, at int, before string, word string, after string, mixed int"


def findings(rows: DataFrame, suspects: Sent) -> DataFrame:
    """What each text holds: furniture (``at`` is its number), joints, and words that may be misread, by what is in the filter."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = suspects.get()
        for frame in frames:
            out = []
            for tab, row_id, sig, text in zip(frame["tab"], frame["row_id"], frame["sig"], frame["text"], strict=True):
                page = Page(text)
                me = (tab, row_id, sig)
                for kind, n in (("header", len(page.headers)), ("page_number", len(page.numbers) + len(page.ends) + len(page.beside))):
                    if n:
                        out.append((*me, kind, n, "", "", "", 0))
                out += [(*me, "joint", k, left, right, "", 0) for k, (left, right) in enumerate(page.joined()[1])]
                out += [(*me, "word", k, before, word, after, kind) for k, before, word, after, kind in page.words() if kind == 2 or word in known]
            yield pd.DataFrame(out, columns=["tab", "row_id", "sig", "kind", "at", "before", "word", "after", "mixed"])

    return rows.mapInPandas(batches, FOUND)


def own_hyphens(joints: DataFrame, words: DataFrame) -> DataFrame:
    """``joints`` with ``own``: whether a broken word has a hyphen of its own.

    It has if the compound stands in more texts than the joined word, or, where neither stands anywhere whole, if both parts are words that
    are ten times as frequent as this break.
    """
    pairs = joints.select(F.col("before").alias("left"), F.col("word").alias("right")).distinct()
    asked = pairs.select("left", "right", F.posexplode(F.array(F.concat("left", "right"), F.concat("left", F.lit("-"), "right"), "left", "right")).alias("k", "w"))
    counted = asked.join(words.select(F.col("word").alias("w"), "n", "j"), "w", "left")
    n = lambda k, c: F.coalesce(F.max(F.when(F.col("k") == k, F.col(c))), F.lit(0))
    found = counted.groupBy("left", "right").agg(n(0, "n").alias("joined"), n(0, "j").alias("breaks"), n(1, "n").alias("compound"), n(2, "n").alias("nl"), n(3, "n").alias("nr"))
    often = (F.col("nl") >= 10 * F.greatest("breaks", F.lit(1))) & (F.col("nr") >= 10 * F.greatest("breaks", F.lit(1))) & (F.length("left") > 3) & (F.length("right") > 3)
    own = F.when(F.col("joined") + F.col("compound") > 0, F.col("compound") > F.col("joined")).otherwise(often)
    return joints.join(found.select(F.col("left").alias("before"), F.col("right").alias("word"), own.alias("own")), ["before", "word"])


def misread_words(occurrences: DataFrame, near: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tab, row_id, sig, at, right): words that are misread; ``right`` is null where what stands there is unknown.

    Of the candidates those by confusions come first, then those that the words before and after call for, then the commonest. A
    word of letters only might be a word of its own: it is misread if a word beside it calls for the other more than three times as often, or,
    for a confusion, if the other is SURE times as common.
    """

    @F.pandas_udf("long")
    def hashed(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([pair_hash(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")

    rows = occurrences.join(near, "word", "left")
    sides = F.array(*(F.struct(F.lit(k).alias("k"), F.col(a).alias("a"), F.col(b).alias("b")) for k, a, b in ((0, "before", "right"), (1, "before", "word"), (2, "right", "after"), (3, "word", "after"))))
    asked = rows.where("right is not null").select("before", "word", "after", "right").distinct().select("before", "word", "after", "right", F.explode(sides).alias("s"))
    asked = asked.select("before", "word", "after", "right", "s.k", hashed("s.a", "s.b").alias("hash")).join(pairs, "hash", "left")
    side = lambda k: F.coalesce(F.max(F.when(F.col("k") == k, F.col("n"))), F.lit(0))
    told = asked.groupBy("before", "word", "after", "right").agg(side(0).alias("before_right"), side(1).alias("before_word"), side(2).alias("right_after"), side(3).alias("word_after"))
    rows = rows.join(told, ["before", "word", "after", "right"], "left")
    edit = F.col("cost") >= EDIT
    order = F.struct((~edit).alias("confused"), F.col("before_right") + F.col("right_after"), (-F.col("cost")).alias("cost"), "m", "right")
    before = F.col("before_right") > 3 * F.col("before_word")
    after = F.col("right_after") > 3 * F.col("word_after")
    cut = F.col("right").startswith(F.col("word")) | F.col("right").endswith(F.col("word"))  # a letter lost at an end is no letter read wrongly
    likely = (F.col("mixed") > 0) | F.when(edit, ~cut & (F.col("m") >= 20 * F.col("n")) & (before | (after & (F.col("before_right") >= F.col("before_word"))))).otherwise(before | after | (F.col("m") >= SURE * F.col("n")))
    best = rows.groupBy("tab", "row_id", "sig", "at", "mixed").agg(F.max(F.when(F.col("right").isNotNull(), F.struct(order.alias("order"), likely.alias("likely")))).alias("x"))
    right = F.when(F.col("x.likely"), F.col("x.order.right"))
    return best.select("tab", "row_id", "sig", "at", right.alias("right"), "mixed").where("right is not null or mixed = 2").drop("mixed")


def looked_at(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, joints with ``own``, misread words) of all texts."""
    counted = checkpointed(counts(rows))
    words = counted.where("word is not null")
    near = checkpointed(candidates(words.select("word", (F.col("n") + F.col("j")).alias("n"))))
    sent = Sent(rows.sparkSession, word_filter(near.select("word").distinct(), "word"), Filter)
    found = checkpointed(findings(rows, sent))
    joints = own_hyphens(found.where("kind = 'joint'"), words)
    pairs = counted.where("word is null").select("hash", "n")
    return found, joints, misread_words(found.where("kind = 'word'"), near.drop("n").join(words.select("word", (F.col("n") + F.col("j")).alias("n")), "word"), pairs)


def repaired(pdf_texts: DataFrame, markdown_results: DataFrame) -> DataFrame:
    """(tab, row_id, repaired, hyphenation, misread, header, page_number): every text repaired, with the number of findings.

    Null and empty texts have no row; a text under two ids has two. A clean text is only reflowed.
    """
    rows = texts(pdf_texts, markdown_results)
    found, joints, misread = looked_at(rows)
    one = lambda frame, kind, value: frame.select("tab", "row_id", "sig", F.lit(kind).alias("kind"), "at", value.alias("value"))
    fixes = one(found.where("kind in ('header', 'page_number')"), "", F.col("kind")).unionByName(one(joints, "joint", F.col("own").cast("string"))).unionByName(one(misread, "word", F.col("right")))
    fixes = fixes.groupBy("tab", "row_id", "sig").agg(F.collect_list(F.struct("kind", "at", "value")).alias("fixes"))

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for tab, row_id, text, list_ in zip(frame["tab"], frame["row_id"], frame["text"], frame["fixes"], strict=True):
                all_ = [] if list_ is None else list_
                right = {x["at"]: x["value"] for x in all_ if x["kind"] == "word"}
                own = {x["at"]: x["value"] == "true" for x in all_ if x["kind"] == "joint"}
                n = {x["value"]: x["at"] for x in all_ if x["kind"] == ""}
                out.append((tab, row_id, Page(text).repaired(right, own), sum(not x for x in own.values()), len(right), n.get("header", 0), n.get("page_number", 0)))
            yield pd.DataFrame(out, columns=["tab", "row_id", "repaired", "hyphenation", "misread", "header", "page_number"])

    return rows.join(fixes, ["tab", "row_id", "sig"], "left").select("tab", "row_id", "text", "fixes").mapInPandas(batches, "tab string, row_id long, repaired string, hyphenation int, misread int, header int, page_number int")


def noises(pdf_texts: DataFrame, markdown_results: DataFrame) -> DataFrame:
    """(tab, row_id, noise): one row for each kind of noise in a text. The texts are not joined again."""
    found, joints, misread = looked_at(texts(pdf_texts, markdown_results))
    parts = [found.where("kind in ('header', 'page_number')").select("tab", "row_id", "kind"), joints.where("not own").select("tab", "row_id", F.lit("hyphenation").alias("kind")), misread.select("tab", "row_id", F.lit("misread").alias("kind"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct().withColumnRenamed("kind", "noise")
