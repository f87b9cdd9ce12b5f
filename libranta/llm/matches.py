"""P1: records of the same work in sources without a common key, each link with a confidence.

All records give a graph of records, attributes (authors, year, DOI) and tokens; skip-gram vectors trained
on random walks over it, shard by shard, bring together tokens of one meaning (two languages, say), and letters of a token give it a base
vector of its own, so no token is unknown. Sums of token vectors stand for a title, for its parts, and for a surname with the
places or the first words of its record; tables of hyperplanes, of which there are more as codes get longer, hash
them, and only records in one bucket are looked at. Cosines of titles and authors are then computed exactly, and a
logistic curve calibrated on pairs whose DOIs tell turns them into a confidence; pairs below a threshold are dropped. An
exact check of the rest (part numbers, years, other words, other people) follows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from urllib.parse import unquote

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import checkpointed, dropped, small_hashed
from .genuine import NO_NAME, NO_TITLE, PLACEHOLDERS
from .once import Sent
from .spellings import NICKNAMES, _edits, plain

DIMENSIONS, MOST_BITS, SKETCH, FIRM = 48, 32, 64, 48
NEAR_DEGREES, FOUND = 12.0, 0.8  # the title tables are so many that titles at this angle meet in one of them with this chance
HOT = 2000  # rows of a bucket on either side of a comparison in one task
FLUSH = 200_000  # words whose counts a task holds
SHARD = 5000  # records, about, that one walk can reach
TRAINED_WEIGHT = 700  # length of a trained vector beside 1000 of a token's own
PARTS = 4  # of a title: buckets of the others make up for a slip in one, however many records there are
NO_TITLES = {plain(x) for x in f"{NO_TITLE}|{PLACEHOLDERS}".split("|")}
NO_NAMES = {plain(x) for x in f"{NO_NAME}|{PLACEHOLDERS}".split("|")}
OPENER = re.compile(r"^\s*(?:\[[^\]]{2,20}\]|<[^>]{1,6}>|(?:tesis|thesis|tese|these|articulo|article|artigo|informe|report)\s*:)\s*")
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
MARKER = re.compile(r"[\s:,(\[-]+(parte?|partie|tomo|volumen|volume|vol|informe|reporte?|rapport|relatorio)\.?\s+([ivx]{1,4}|\d{1,4})\W*(?:</?\w+>)?\W*$")
DOI = re.compile(r"10\.\d{4,9}/\S+")
WORDS = re.compile(r"[a-z0-9]+")
LETTERS = re.compile(r"[^\W\d_]+")
# Small words that tell the language of a title.
SMALL = {
    "es": "el la los las de del en y con para un una entre como sobre", "en": "the of in and for a an on from to with how between among", "pt": "o a os as em da do das dos na no e um uma com para de",
    "fr": "le la les des du de et dans chez une un avec sur parmi pour",
}
SMALL = {code: set(words.split()) for code, words in SMALL.items()}
SMALLEST = set().union(*SMALL.values())
SCHEMA = "sig long, title string, other string, marker string, authors string, year int, doi string"
TWO_TITLES = re.compile(r"\s+=\s+")


def title_parts(title: str | None) -> tuple[list[str], str]:
    """Words of a title without its opener, and its part or report number in one notation."""
    text = plain(title or "")
    if text.strip() in NO_TITLES:
        return [], ""
    text = OPENER.sub("", text)
    if "<" in text:
        text = re.sub(r"<[^>]{1,6}>", " ", text)
    marker = ""
    if found := MARKER.search(text):
        number = ROMAN.get(found[2]) or (int(found[2]) if found[2].isdigit() else 0)
        if number:
            marker = f"{'p' if found[1][0] in 'ptv' else 'r'}{number}"
            text = text[: found.start()]
    return WORDS.findall(text), marker


def both_titles(title: str | None) -> tuple[str, str, str]:
    """Words of a title, words of the same title in another language if an equals sign joins the two, and the part or report number."""
    first, *more = TWO_TITLES.split(title, maxsplit=1) if title and "=" in title else (title,)
    words, marker = title_parts(first)
    other, marker_ = title_parts(more[0]) if more and len(words) > 3 else ([], "")
    return " ".join(words), " ".join(other), marker or marker_


def author_parts(names) -> list[str]:
    """Each name as its plain words, those after a comma marked by a plus; initials and placeholders are left out."""
    return [part for name in ([] if names is None else names) if name and (part := _author_part(name))]


@lru_cache(50_000)
def _author_part(name: str) -> str:
    if plain(name.strip()) in NO_NAMES:
        return ""
    left, comma, right = name.partition(",")
    before, after = LETTERS.findall(left), [(w, plain(w)) for w in LETTERS.findall(right)]
    words = [plain(w) for w in before if len(w) > 2 or not w.isupper()] + [f"+{x}" for w, x in after if len(w) > 2]
    if comma and name.count(",") == 1:
        initials = "".join(x[0] for _, x in after)
    else:
        initials = "".join(plain(w) for w in before if len(w) <= 2 and w.isupper())
    return " ".join([*(w for w in words if len(w) > 1), f"={initials}"])


def doi_part(doi: str | None) -> str:
    found = DOI.search(unquote(doi or "").lower())
    return found[0].rstrip(".,;)") if found else ""


def featured(records: DataFrame, key: str, side: str) -> DataFrame:
    """(side, id, sig, title, marker, authors, year, doi): plain attributes; ``sig`` is equal for records that agree in all."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key_, title, authors, year, doi in zip(frame["id"], frame["title"], frame["authors"], frame["year"], frame["doi"], strict=True):
                words, other, marker = both_titles(title)
                year = int(year) if year == year and year and 1000 < year < 3000 else 0
                row = (words, other, marker, "|".join(author_parts(authors)), year, doi_part(doi))
                out.append((key_, xxhash.xxh3_64_intdigest("\x1f".join(map(str, row))) - (1 << 63), *row))
            yield pd.DataFrame(out, columns=["id", "sig", "title", "other", "marker", "authors", "year", "doi"])

    rows = records.select(F.col(key).cast("long").alias("id"), "title", "authors", F.col("year").cast("int").alias("year"), "doi").where("id is not null")
    return rows.mapInPandas(batches, f"id long, {SCHEMA}").select(F.lit(side).alias("side"), "*")


@lru_cache(50_000)
def base_vector(token: str) -> np.ndarray:
    """A token's own vector, of whole numbers: the sum of pseudo-random vectors of its letter trigrams."""
    bounded = f"^{token}$"
    total = np.zeros(DIMENSIONS)
    for i in range(len(bounded) - 2):
        total += _gram(bounded[i : i + 3])
    return np.rint(1000 * total / (np.linalg.norm(total) or 1)).astype(np.int64)


def base_vectors(tokens: list[str]) -> np.ndarray:
    """``base_vector`` of each token, as rows of floats."""
    sizes = np.array([len(t) for t in tokens], np.int64)
    grams = [t[i : i + 3] for t in (f"^{t}$" for t in tokens) for i in range(len(t) - 2)]
    at, names = pd.factorize(np.array(grams, object))
    total = np.zeros((len(tokens), DIMENSIONS))
    total[sizes > 0] = _runs(np.array([_gram(g) for g in names]).reshape(-1, DIMENSIONS), (np.cumsum(sizes) - sizes)[sizes > 0], at)
    norms = np.linalg.norm(total, axis=1, keepdims=True)
    return np.rint(1000 * total / np.where(norms == 0, 1, norms))


@lru_cache(30_000)
def _gram(gram: str) -> np.ndarray:
    return np.random.default_rng(xxhash.xxh3_64_intdigest(gram)).standard_normal(DIMENSIONS)


@lru_cache(1)
def planes() -> tuple[np.ndarray, np.ndarray]:
    """Hyperplanes for titles (sketch and tables) and for the other vectors; whole numbers, so that sums are exact in any order."""
    drawn = np.random.default_rng(20).integers(-1000, 1000, (DIMENSIONS, FIRM + SKETCH + tables_for(MOST_BITS) * MOST_BITS)).astype(np.float64)
    return drawn[:, FIRM:], drawn[:, :FIRM]


def tables_for(bits: int) -> int:
    """How many tables of so many bits let titles NEAR_DEGREES apart meet with the chance FOUND."""
    return int(np.ceil(np.log(1 - FOUND) / np.log(1 - (1 - NEAR_DEGREES / 180) ** bits)))


def walk_vectors(records: list[list[str]], two: list[bool] | None = None) -> dict[str, np.ndarray]:
    """Vectors of the nodes of ``records``, trained at once."""
    names, inner, _ = skip_grams(records, two)
    return finished(names, inner)


def finished(names: list[str], inner: np.ndarray) -> dict[str, np.ndarray]:
    """Trained vectors without what all have in common, of one length, in whole numbers; those of words and surnames."""
    if not names:
        return {}
    inner = inner - inner.mean(axis=0)  # what all nodes share tells nothing
    norms = np.linalg.norm(inner, axis=1, keepdims=True)
    inner = inner / np.where(norms == 0, 1, norms)
    return {t: np.rint(TRAINED_WEIGHT * inner[i]).astype(np.int64) for i, t in enumerate(names) if t[:2] not in ("y:", "d:")}


def skip_grams(records: list[list[str]], two: list[bool] | None = None, seed: int = 7, walks: int = 1, more: int = 20, most: float = 0.05, length: int = 2, window: int = 3, epochs: int = 2, rate: float = 0.2) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Nodes, their skip-gram vectors with negative samples, trained on random walks record, node, record, node ... over the records' graph, and how many records have each.

    A record is the list of its nodes: title words, surnames (@), year (y:) and DOI (d:). Walks leave a record by a node that few records share;
    from records with ``two`` titles in different languages there are ``more`` walks, which bring both languages together. Nodes of more
    than ``most`` of the records tell nothing and are left out. A node's vector starts from its own name, so that what shards learn can be added up.
    """
    rng = np.random.default_rng(seed)
    records = [set(nodes) for nodes in records]
    count = Counter(chain.from_iterable(records))
    vocabulary = {t: i for i, t in enumerate(sorted(t for t, n in count.items() if 2 <= n <= max(20, most * len(records))))}
    n, size = len(vocabulary), DIMENSIONS
    if n < 50:
        return [], np.zeros((0, size), np.float32), np.zeros(0, np.int64)
    held = [sorted([vocabulary[t] for t in nodes if t in vocabulary]) for nodes in records]
    often = np.array([more if t else walks for t, ids in zip(two or [False] * len(held), held, strict=True) if ids])
    held = [ids for ids in held if ids]
    sizes = np.array([len(ids) for ids in held])
    nodes, owner = np.concatenate([np.array(ids) for ids in held]), np.repeat(np.arange(len(held)), sizes)
    first = np.cumsum(sizes) - sizes
    back = np.argsort(nodes, kind="stable")
    holders, rarity = owner[back], np.bincount(nodes, minlength=n)
    starts = np.cumsum(rarity) - rarity
    here, steps = np.repeat(np.arange(len(held)), often), []
    for _ in range(length):  # all walks go on together: some nodes of the record, the last of which leads on
        drawn = nodes[first[here][:, None] + (rng.random((len(here), 4)) * sizes[here][:, None]).astype(np.int64)]
        node = drawn[np.arange(len(here)), np.argmin(rarity[drawn], axis=1)]
        steps += [drawn[:, 0], drawn[:, 1], drawn[:, 2], node]
        here = holders[starts[node] + (rng.random(len(here)) * rarity[node]).astype(np.int64)]
    walk = np.column_stack(steps)
    pairs = np.concatenate([np.column_stack([walk[:, : -k].ravel(), walk[:, k:].ravel()]) for k in range(1, window + 1)])
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    pairs = np.concatenate([pairs, pairs[:, ::-1]])
    inner, outer = np.array([0.1 * _gram(t) for t in vocabulary], np.float32), np.zeros((n, size), np.float32)
    right = np.array([1.0, 0.0, 0.0, 0.0], np.float32)[:, None]
    for _ in range(epochs):
        pairs = pairs[rng.permutation(len(pairs))]
        for start in range(0, len(pairs), 8192):
            a, b = pairs[start : start + 8192].T
            target = np.concatenate([b, rng.integers(0, n, 3 * len(a))]).reshape(4, -1)  # the first is right, the others are drawn
            va, vb = inner.take(a, axis=0), [outer.take(t, axis=0) for t in target]
            gradient = rate * (right - 1 / (1 + np.exp(-np.clip([np.einsum("jd,jd->j", va, v) for v in vb], -8, 8))))
            gradient = gradient.astype(np.float32)[:, :, None]
            step = gradient[0] * vb[0]
            for k in range(1, 4):
                step += np.multiply(gradient[k], vb[k], out=vb[k])
            _add(inner, a, step)
            for k in range(4):
                _add(outer, target[k], np.multiply(gradient[k], va, out=vb[k]))
    return list(vocabulary), inner, rarity


def _add(matrix: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds values to rows; of those that come several times the sum counts as its square root, so that no step is too long."""
    order = _sorted(rows, len(matrix))
    ends = rows.take(order)
    at = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]]))
    by, sizes, sums = _long_first(values, at, order)
    sums /= np.sqrt(sizes, dtype=np.float32)[:, None]
    matrix[ends.take(at.take(by))] += sums


def _sorted(numbers: np.ndarray, most: int) -> np.ndarray:
    """Stable order of numbers below ``most``; small ones are sorted by their digits."""
    return np.argsort(numbers.astype(np.uint16) if most <= 1 << 16 else numbers, kind="stable")


def _long_first(rows: np.ndarray, starts: np.ndarray, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of rows (of those at ``places``) from the longest to the shortest, how long they are and their sums: all first rows, then all second ones and so on, which is faster than one run after the other."""
    sizes = np.diff(np.append(starts, len(rows) if places is None else len(places)))
    longest = int(sizes.max(initial=0))
    order = _sorted(longest - sizes, longest + 1)
    starts, sizes = starts.take(order), sizes.take(order)
    left = np.searchsorted(-sizes, -np.arange(longest), side="left").tolist()
    sums = rows[:0]
    for k, n in enumerate(left):
        at = starts[:n] + k
        part = rows.take(at if places is None else places.take(at), axis=0)
        if k:
            sums[:n] += part
        else:
            sums = part
    return order, sizes, sums


def _runs(rows: np.ndarray, starts: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
    """The sum of each run of rows (of those at ``places``)."""
    order, _, sums = _long_first(rows, starts, places)
    out = np.empty_like(sums)
    out[order] = sums
    return out


class _Places(dict):
    """The rows of tokens' vectors; a new token, with its mark before it, goes to the end of ``tokens``."""

    def __init__(self, mark: str, tokens: list[str]):
        self.mark, self.tokens = mark, tokens

    def __missing__(self, token: str) -> int:
        at = self[token] = len(self.tokens)
        self.tokens.append(self.mark + token)
        return at


class _Persons(dict):
    """What a name tells: given names, surnames and initials, read once for each name."""

    def __init__(self, given: set[str]):
        self.given = given

    def __missing__(self, name: str) -> tuple[set[str], list[str], set[str]]:
        *words, initials = name.split(" ")
        given = {NICKNAMES.get(w.lstrip("+"), w.lstrip("+")) for w in words if w[0] == "+" or w in self.given or w in NICKNAMES}
        surnames = [w for w in words if w[0] != "+" and w not in self.given and w not in NICKNAMES]
        found = self[name] = (given, surnames, {w[0] for w in given} | set(initials[1:]))
        return found


class Space:
    """Vectors and hashes of records, from what was ``learned``."""

    def __init__(self, sent: tuple):
        self.trained, self.share, self.given, n, *more = sent
        self.lasting: set[str] = more[0] if more else set()
        self.forenames = self.given.union(NICKNAMES)
        self.bits = int(min(MOST_BITS, max(16, round(np.log2(max(2, n))) + 4)))  # codes grow with the records, and the tables with the codes
        self.tables = tables_for(self.bits)
        # what titles have in common; of a few titles it would be the titles themselves, and all fit into small buckets anyway
        self.center = np.zeros(DIMENSIONS) if n < 1000 else np.rint(sum((self.share[t] * v for t, v in zip(sorted(self.share), self._vectors(sorted(self.share)), strict=True)), np.zeros(DIMENSIONS)))
        self.trim(0)

    def _vectors(self, tokens: list[str]) -> np.ndarray:
        """Vectors of tokens, their own and what training found; title words are weighted by rarity. A # marks a word beside a surname, an @ a surname."""
        out = base_vectors(tokens)
        for k, token in enumerate(tokens):
            found = self.trained.get(token[1:] if token[0] == "#" else token)
            if found is not None:
                out[k] += found
            if token[0] not in "#@":
                s = self.share.get(token, 0.0)
                out[k] *= 1 if s > 0.05 else 3 if s > 0.01 else 5 if s > 0.003 else 9
        return out

    def places(self, tokens: Iterable[str], n: int, mark: str = "") -> np.ndarray:
        """The rows of vectors of ``n`` tokens, with a mark before each."""
        return np.fromiter(map(self.index[mark].__getitem__, tokens), np.int64, n)

    def vectors(self, places: np.ndarray) -> np.ndarray:
        if len(self.matrix) < len(self.tokens):
            self.matrix = np.vstack([self.matrix, self._vectors(self.tokens[len(self.matrix) :])])
        return self.matrix.take(places, axis=0)

    def trim(self, most: int = 60_000) -> None:
        """Between batches: vectors are forgotten when they are too many."""
        if not most or len(self.tokens) > most:
            self.tokens: list[str] = []
            self.index = {mark: _Places(mark, self.tokens) for mark in ("", "#", "@")}
            self.matrix = np.zeros((0, DIMENSIONS))
        if not most or len(self.persons) > most:
            self.persons = _Persons(self.given)

    def rare(self, words: list[str]) -> list[str]:
        """Words of a title that few titles have, or that titles in all languages have: mostly names of places."""
        return sorted({w for w in words if (w not in self.share or w in self.lasting) and not w.isdigit() and len(w) > 2})

    def keys(self, unusual: list[str]) -> list[list[str]]:
        """What a surname is hashed with: each of these words by itself, and together those that a hundredth of titles have if there are no others."""
        return [[w] for w in unusual if self.share.get(w, 0) <= 0.01] or ([unusual] if unusual else [])

    def surnames(self, authors: str) -> list[str]:
        return sorted({w for w in authors.replace("|", " ").split(" ") if w and w[0] not in "+=" and w not in self.forenames})

    def _sums(self, lists: list[list[str]], mark: str = "") -> tuple[np.ndarray, np.ndarray]:
        """For each list of tokens, with a mark before each, the sum of their vectors, and whether it has any."""
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        has = sizes > 0
        out = np.zeros((len(lists), DIMENSIONS))
        if has.any():
            n = int(sizes.sum())
            places = self.places(chain.from_iterable(lists), n, mark)
            self.vectors(places[:0])
            out[has] = _runs(self.matrix, (np.cumsum(sizes) - sizes)[has], places)
        return out, has

    def _by_place(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sums of vectors weighted by place: for each list of PARTS words or more those that leave out one part each, and which lists these are; for each of more than five the first nine words, and which."""
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        long, more = np.flatnonzero(sizes >= PARTS), np.flatnonzero(sizes > 5)
        if not len(long):
            return np.zeros((0, PARTS, DIMENSIONS)), long, np.zeros((0, DIMENSIONS)), more
        sizes = sizes[long]
        starts = np.cumsum(sizes) - sizes
        places = self.places(chain.from_iterable(lists[k] for k in long.tolist()), int(sizes.sum()), "#")
        rows = self.vectors(places)
        rows *= (2 + np.arange(len(rows)) - np.repeat(starts, sizes))[:, None]
        bounds = (starts[:, None] + np.arange(PARTS) * sizes[:, None] // PARTS).ravel()
        parts = _runs(rows, bounds).reshape(len(long), PARTS, DIMENSIONS)
        first = np.minimum(sizes, 9)[sizes > 5]
        at = np.repeat(starts[sizes > 5] - np.cumsum(first) + first, first) + np.arange(first.sum())
        return parts.sum(axis=1, keepdims=True) - parts, long, _runs(rows, np.cumsum(first) - first, at), more

    def blocks(self, titles: list[str], authors: list[str], dois: list[str]) -> tuple[np.ndarray, ...]:
        """(record, code) of every bucket, and (sketch, names) of every record: bits of its title and its surnames."""
        words = [t.split(" ") if t else [] for t in titles]
        surnames = [self.surnames(a) for a in authors]
        owner = np.repeat(np.arange(len(titles)), [len(x) for x in surnames])
        unusual = [self.rare(x) for x in words]
        names = _spread(surnames)
        wide, firm = planes()
        wide = wide[:, : SKETCH + self.tables * self.bits]
        title, known = self._sums(words)
        bits = _above(title[known] - self.center, wide)  # without what all titles have in common, so that buckets are even
        sketch = np.zeros(len(titles), np.int64)
        sketch[known] = _numbers(bits[:, :SKETCH]).view(np.int64)
        at = np.flatnonzero(known)
        records, codes = [], []
        for table in range(self.tables):
            start = SKETCH + table * self.bits
            records.append(at)
            codes.append(_numbers(bits[:, start : start + self.bits]).astype(np.int64) | (table << 40))
        sums, long, head, more = self._by_place(words)
        for part in range(PARTS if len(long) else 0):
            records.append(long)
            codes.append(_numbers(_above(sums[:, part], firm)).astype(np.int64) | (4 + part << 56))
        doi = [[d, *x[:3]] if d else [] for d, x in zip(dois, words, strict=True)]
        sums, has = self._sums(doi, "#")
        records.append(np.flatnonzero(has))
        codes.append(_numbers(_above(sums[has], firm)).astype(np.int64) | (3 << 56) | (1 << 62))
        if len(owner):
            places = self.places(chain.from_iterable(surnames), len(owner), "@")
            own = self.vectors(places)
            part = firm[:, : min(FIRM, self.bits + 10)]
            first = np.cumsum([0, *map(len, surnames)]).tolist()
            keys = [self.keys(x) for x in unusual]
            named = [(k, at, key) for k, each in enumerate(keys) for at in range(first[k], first[k + 1]) for key in each]
            if named:
                sums = self._sums([key for _, _, key in named], "#")[0]
                records.append(np.array([k for k, _, _ in named], np.int64))
                codes.append(_numbers(_above(3 * own.take([at for _, at, _ in named], axis=0) + 2 * sums, part)).astype(np.int64) | (1 << 56) | (1 << 62))
            heads, alone = np.zeros((len(titles), DIMENSIONS)), [[d] if d and not x else [] for d, x in zip(dois, words, strict=True)]
            heads[more] = head
            alone, has_doi = self._sums(alone, "#")
            for kind, factor, sums, has_, planes_ in ((2, 12, heads, np.isin(np.arange(len(titles)), more), part), (4, 1, alone, has_doi, firm)):
                rows = has_[owner]
                records.append(owner[rows])
                codes.append(_numbers(_above(2 * factor * own[rows] + 2 * sums[owner[rows]], planes_)).astype(np.int64) | (kind << 56) | (1 << 62))
        return np.concatenate(records), np.concatenate(codes), sketch, names


def _above(rows: np.ndarray, planes_: np.ndarray, step: int = 24) -> np.ndarray:
    """On which side of each plane every row lies. Few rows at a time: products so small stay in one thread, where more threads only wait for each other."""
    out = np.empty((len(rows), planes_.shape[1]), bool)
    whole = len(rows) // step * step
    np.greater(rows[:whole].reshape(-1, step, rows.shape[1]) @ planes_, 0, out=out[:whole].reshape(-1, step, planes_.shape[1]))
    out[whole:] = rows[whole:] @ planes_ > 0
    return out


def _spread(lists: list[list[str]]) -> np.ndarray:
    """For each list of words 64 bits, one of them set for each word."""
    out = np.zeros(len(lists), np.uint64)
    for k, words in enumerate(lists):
        bits = 0
        for word in words:
            bits |= 1 << (xxhash.xxh3_64_intdigest(word) & 63)
        out[k] = bits
    return out.view(np.int64)


def _numbers(bits: np.ndarray) -> np.ndarray:
    """Each row of up to 64 bits as one number."""
    packed = np.packbits(bits, axis=1)
    whole = np.zeros((len(bits), 8), np.uint8)
    whole[:, 8 - packed.shape[1] :] = packed
    return whole.view(">u8").ravel().astype(np.uint64)


def counted(classes: DataFrame) -> DataFrame:
    """(kind, code, w, n, m): in how many records each word stands, from one pass. Kind 0: in a title of the language ``code``; 1: in a second title only;
    2: in names, behind a comma ``n`` times and elsewhere ``m`` times; 3: in names with a comma, before it. The empty word of kind 0 counts the titles.

    A task hands on its counts when it holds FLUSH words, so it never holds more, whatever the number of records.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Counter[str]] = defaultdict(Counter)
        others, behind, elsewhere, before = Counter(), Counter(), Counter(), Counter()

        def flushed() -> pd.DataFrame:
            out = [(0, code, w, n, 0) for code, found in words.items() for w, n in found.items()] + [(1, "", w, n, 0) for w, n in others.items()]
            out += [(2, "", w, behind[w], elsewhere[w]) for w in {**behind, **elsewhere}] + [(3, "", w, n, 0) for w, n in before.items()]
            for counts in (words, others, behind, elsewhere, before):
                counts.clear()
            return pd.DataFrame(out, columns=["kind", "code", "w", "n", "m"])

        for frame in frames:
            for title, other, authors in zip(*(frame[c].tolist() for c in ("title", "other", "authors")), strict=True):
                found = title.split(" ") if title else []
                different = {*found, ""} if found else set()
                if found:
                    words[tongue(found)].update(different)
                if other:
                    others.update({*other.split(" ")} - different - {""})
                for name in authors.split("|") if authors else []:
                    long = [w for w in name.split(" ") if len(w) > 2 and w[0] != "="]
                    rest = [w for w in long if w[0] != "+"]
                    if "+" in name:
                        behind.update([w[1:] for w in long if w[0] == "+"])
                        before.update(rest)
                    elsewhere.update(rest)
            if sum(map(len, (*words.values(), others, behind, elsewhere, before))) > FLUSH:
                yield flushed()
        if words or others or elsewhere or behind:
            yield flushed()

    rows = classes.select("title", "other", "authors").mapInPandas(batches, "kind int, code string, w string, n long, m long")
    return checkpointed(rows.groupBy("kind", "code", "w").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))


def lasting(counts: DataFrame, least: float) -> tuple[dict[str, int], set[str]]:
    """Words that ``least`` titles have, each with its titles, and those of them that a translation keeps, such as names of places; small words are none.

    Of the languages' shares of titles with the word, the third is a tenth of the first or more; of a word too rare for
    that (fewer than 30 titles), at most four fifths are in one language.
    """
    titles = counts.where("kind = 0")
    often = titles.groupBy("w").agg(F.sum("n").alias("all")).where((F.col("all") >= least) | (F.col("w") == ""))
    total, found = {}, defaultdict(dict)
    for r in titles.join(often, "w").select("code", "w", "n").collect():
        if r["w"]:
            found[r["w"]][r["code"]] = r["n"]
        else:
            total[r["code"]] = r["n"]
    return {w: sum(n.values()) for w, n in found.items()}, {w for w, n in found.items() if w not in SMALLEST and kept_in_translation(n, total)}


def kept_in_translation(found: dict[str, int], total: dict[str, int]) -> bool:
    n = sum(found.values())
    if n < 30:
        return max(found.values()) <= 0.8 * n
    rates = sorted(m / total[code] for code, m in found.items())
    return len(rates) > 2 and rates[-3] >= 0.1 * rates[-1]


def nodes_of(title: str, other: str, authors: str, year: int, doi: str) -> list[str]:
    """The nodes of a record in the graph."""
    return [*f"{title} {other}".split(), *(f"@{w}" for w in authors.replace("|", " ").split(" ") if len(w) > 2 and w[0] not in "+="), *([f"y:{year}"] if year else []), *([f"d:{doi}"] if doi else [])]


def trained_on_all(classes: DataFrame, kept: set[str]) -> dict[str, np.ndarray]:
    """Vectors of the ``kept`` nodes, trained on all records: each shard by itself, then the mean over shards, weighted by a node's records.

    A shard has all records of some first authors, so its graph is as dense as that of all; a large one is taken in pieces. What goes to the driver is as
    long as ``kept``, whatever the number of records.
    """
    sent = Sent(classes.sparkSession, kept, set)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, sums, counts = sent.get(), {}, Counter()

        def learn(rows: list[tuple]) -> None:
            rows = sorted(rows)  # whatever the order in which they come
            names, inner, rarity = skip_grams([nodes_of(*x) for x in rows], [bool(x[1]) for x in rows])
            for name, vector, m in zip(names, np.rint(1e6 * inner.astype(np.float64)).astype(np.int64), rarity.tolist(), strict=True):
                if name in known:
                    sums[name] = sums.get(name, 0) + m * vector
                    counts[name] += m

        held, at = [], None
        for frame in frames:
            for shard, *row in zip(*(frame[c].tolist() for c in ("shard", "title", "other", "authors", "year", "doi")), strict=True):
                if held and (shard != at or len(held) == 2 * SHARD):
                    learn(held)
                    held = []
                at = shard
                held.append(tuple(row))
        if held:
            learn(held)
        if sums:
            yield pd.DataFrame({"name": list(sums), "n": [counts[x] for x in sums], "v": [x.tolist() for x in sums.values()]})

    parts = classes.select("shard", "title", "other", "authors", "year", "doi").mapInPandas(batches, "name string, n long, v array<long>")
    rows = sorted(tuple(r) for r in parts.groupBy("name").agg(F.sum("n").alias("n"), *(F.sum(F.get("v", F.lit(k))).alias(f"v{k}") for k in range(DIMENSIONS))).collect())
    return finished([name for name, *_ in rows], np.array([np.array(v) / m / 1e6 for _, m, *v in rows]))


def learned(classes: DataFrame) -> tuple[dict[str, np.ndarray], dict[str, float], set[str], int, set[str]]:
    """Trained vectors, shares of title words that a thousandth of records have, given names, number of records, ``lasting`` ones of the words.

    All records count and all are trained on. The lists are bounded whatever the number of records: words of a thousandth of them cannot be more than a thousand times
    a title's length, given names of a hundred-thousandth not more than that many times the names of a record, and nodes that have a vector, of
    which a 2500th of the records or more share each, not more than that many times the nodes of a record.
    """
    n = max(1, classes.count())
    counts = counted(classes)
    words = counts.where("kind < 2 and w <> ''").groupBy("w").agg(F.sum("n").alias("k")).where(F.col("k") >= max(2, n / 2500))
    kept = {r["w"] for r in words.collect()}
    names = counts.where("kind = 2").select("w", "n", "m")
    before = counts.where("kind = 3").select("w", F.col("n").alias("k"))
    given = names.where(F.col("n") > n / 100_000).join(before, "w", "left").where("n > 2 * coalesce(k, 0)").select("w")
    kept |= {f"@{r['w']}" for r in names.where(F.col("m") >= max(2, n / 2500)).select("w").collect()}
    given = {r["w"] for r in given.collect()}
    often, last = lasting(counts, max(5, n / 1000))
    dropped(counts)
    return trained_on_all(classes, kept), {w: k / n for w, k in often.items()}, given, n, last


# ---- exact comparison ----


def tongue(words: list[str]) -> str:
    """The language whose small words are most frequent in a title."""
    small = [w for w in words if w in SMALLEST]
    return max(SMALL, key=lambda code: sum(w in SMALL[code] for w in small))


def _tally(short: list[str], long: list[str]) -> tuple[int, int]:
    """Words of ``short`` that ``long`` has too, as they are or with one slip, and words of ``long`` left over."""
    left: dict[str, int] = {}
    for word in long:
        left[word] = left.get(word, 0) + 1
    odd = []
    for word in short:
        if left.get(word, 0) > 0:
            left[word] -= 1
        else:
            odd.append(word)
    same = len(short) - len(odd)
    if not 0 < len(odd) < 4:
        return same, len(long) - same
    rest = [word for word, n in left.items() for _ in range(n)]
    for word in odd:
        if word.isdigit():
            continue
        for k, other in enumerate(rest):
            if not other.isdigit() and len(word) > 2 and abs(len(word) - len(other)) < 2 and _edits(word, other) == 1:
                same += 1
                del rest[k]
                break
    return same, len(rest)


def titles_agree(a: list[str], b: list[str]) -> str:
    """same, short (one is a beginning or a section of the other), or nothing."""
    if not a or not b:
        return ""
    if a == b:
        return "same"
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    same, left = _tally(short, long)
    years_a, years_b = {w for w in a if len(w) == 4 and w.isdigit()}, {w for w in b if len(w) == 4 and w.isdigit()}
    if years_a and years_b and years_a != years_b:
        return ""
    missing = len(short) - same
    if missing == 0 and left == 0 or (missing + left <= 2 and abs(len(short) - len(long)) == 1 and "".join(short) == "".join(long)):
        return "same"
    head = missing <= 1 and short[:-1] == long[: len(short) - 1] and long[len(short) - 1].startswith(short[-1])
    if len(short) >= 4 and (missing == 0 or head):
        return "short"
    return ""


def _persons_agree(a: tuple, b: tuple) -> bool:
    """Whether two names can mean one person: a common surname, no clash of given names or initials."""
    (ga, sa, ia), (gb, sb, ib) = a, b
    if not sa or not sb:
        return False
    shared = len(set(sa) & set(sb))
    if not shared and not any(len(x) > 4 and _edits(x, y) == 1 for x in sa for y in sb):
        return False
    if len(sa) > 1 and len(sb) > 1 and shared < 2 and not all(any(x == y or _edits(x, y) == 1 for y in sb) for x in sa):
        return False
    if ga and gb and not (ga & gb) and not any(x.startswith(y) or y.startswith(x) or _edits(x, y) == 1 for x in ga for y in gb):
        return False
    return bool(not ia or not ib or ia & ib)


def authors_agree(a: str, b: str, persons: dict[str, tuple]) -> float | None:
    """Share of the shorter list's authors found in the other, or None if a list is empty."""
    if not a or not b:
        return None
    if a == b:
        return 1.0
    short, long = sorted((a.split("|"), b.split("|")), key=len)
    known = set(long)
    if known.issuperset(short):
        return 1.0
    parts = [persons[y] for y in long]
    return sum(x in known or any(_persons_agree(persons[x], y) for y in parts) for x in short) / len(short)


def places_agree(space: Space, a: list[str], b: list[str]) -> str:
    """same, near (but for one slip or one place more), or nothing, for the places that two titles name; words of a hundredth of titles only count if no title has others."""
    few = [[w for w in x if space.share.get(w, 0) <= 0.01] for x in (a, b)]
    if not any(few):
        return "same" if a and a == b else ""
    short, long = sorted(few, key=len)
    if not short or len(long) - len(short) > 1:
        return ""
    if short == long:
        return "same"
    odd = [w for w in short if w not in long]
    slip = len(long) == len(short) and len(odd) == 1 and len(odd[0]) > 5 and any(_edits(odd[0], w) == 1 for w in long if w not in short)
    return "near" if slip or not odd else ""


def same_work(space: Space, a: tuple, b: tuple) -> str:
    """The ground on which two records (title, other title, marker, authors, year, doi) describe one work, or nothing."""
    (ta, oa, *rest_a), (tb, ob, *rest_b) = a, b
    found = _same_work(space, (ta, *rest_a), (tb, *rest_b))
    if not found and (oa or ob):
        pairs = [(x, y) for x in (ta, oa) for y in (tb, ob) if x and y and (x, y) != (ta, tb)]
        found = next((ground for x, y in pairs if (ground := _same_work(space, (x, *rest_a), (y, *rest_b)))), "")
    return found


def _same_work(space: Space, a: tuple, b: tuple) -> str:
    (ta, ma, na, ya, da), (tb, mb, nb, yb, db) = a, b
    gap = abs(ya - yb) if ya and yb else 0
    wa, wb = ta.split(" ") if ta else [], tb.split(" ") if tb else []
    titles = titles_agree(wa, wb)
    if ma != mb and not (titles == "short" and (not ma and len(wa) < len(wb) or not mb and len(wb) < len(wa)) and gap == 0):
        return ""
    if not wa or not wb:
        authors = authors_agree(na, nb, space.persons)
        return "doi" if da and da == db and authors is not None and authors >= 0.5 and gap <= 2 else ""
    if not titles and len(wa) == len(wb) and sum(x == y for x, y in zip(wa, wb, strict=True)) > len(wa) - 2:
        return ""  # one other word: another work
    if titles and gap > (3 if titles == "same" else 2):
        return ""
    if titles:
        authors = authors_agree(na, nb, space.persons)
        if authors is None:
            if da and da == db:
                return "doi"
            clash = da and db and da != db
            if titles == "same":
                return "same" if gap <= 3 and not clash else ""
            return "short" if ya and ya == yb and not clash and min(len(wa), len(wb)) >= 8 else ""
        return titles if authors >= 0.5 else ""
    places = places_agree(space, space.rare(wa), space.rare(wb))
    if places == "same" and gap <= 2 or places == "near" and ya and yb and gap <= 1:
        common = len(set(wa) & set(wb)) / min(len(wa), len(wb))
        authors = authors_agree(na, nb, space.persons)
        if authors is not None and authors >= 0.75 and common < 0.75 and tongue(wa) != tongue(wb):
            return "translated"
    return ""


def hot_codes(classes: DataFrame, sent: Sent, every: int = 16) -> DataFrame:
    """(code, blocks): title buckets with more than about HOT rows, told from one record of ``every`` by hash. They only spread work: all rows are compared anyway."""
    some = hashed(classes.where(F.pmod(F.xxhash64("sig"), F.lit(every)) == 0), sent).where("code < (1L << 58)")
    return some.groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") * every > HOT).select("code", F.ceil(F.col("n") * every / HOT).cast("int").alias("blocks"))


def candidates(buckets: DataFrame, two: bool, hot: DataFrame) -> DataFrame:
    """(a, b): distinct pairs of classes that share a bucket, of side 1 and side 2 if ``two``.

    Inside the join titles are ruled out whose sketches are far apart, that have no surname in common unless they are all but equal, years far apart and
    different part numbers; a slip in a rare word sets titles far apart, so in the buckets of parts they may be, if most surnames are common; in the buckets of surnames most surnames (with a place), or a third (with first words), have to be common. One exchange serves both sides. The rows of a ``hot`` bucket of titles meet in as many blocks as it has HOT rows, so no task holds it.
    """
    apart, common = "bit_count(x.sketch ^ y.sketch)", "bit_count(x.names & y.names)"
    fewer = "least(bit_count(x.names), bit_count(y.names))"
    share = f"(x.names = 0 or y.names = 0 or {common} > 0)"
    near = (
        f"(case when x.code < (1L << 58) then {apart} <= 6 or ({apart} <= 16 and {share}) when x.code < (1L << 62) then ({apart} <= 16 and {share}) or x.names = 0 or y.names = 0 or ({apart} <= 20 and 2 * {common} > {fewer})"
        f" when (x.code >> 56) & 63 = 1 then 2 * {common} > {fewer} when (x.code >> 56) & 63 = 2 then 3 * {common} >= {fewer} else true end)"
        " and (x.year = 0 or y.year = 0 or abs(x.year - y.year) <= 3) and (x.marker = y.marker or x.marker * y.marker = 0)"
    )
    order = "(x.side & 1) + (y.side & 2) = 3 and x.sig <> y.sig" if two else "x.sig < y.sig"
    some = not hot.isEmpty()
    cool = buckets.join(hot.select("code"), "code", "left_anti") if some else buckets
    pairs = cool.alias("x").join(cool.alias("y"), F.expr(f"x.code = y.code and {near} and {order}")).select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b"))
    if not some:
        return pairs.distinct()
    rows = checkpointed(buckets.where("code < (1L << 58)").join(hot, "code"))
    left = rows.withColumn("block", F.pmod(F.xxhash64("sig"), "blocks").cast("int"))
    right = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = left.alias("x").join(right.alias("y"), F.expr(f"x.code = y.code and x.block = y.block and {near} and {order}")).select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b"))
    return pairs.unionByName(split).distinct()


def hashed(classes: DataFrame, sent: Sent) -> DataFrame:
    """(sig, code, sketch, names, year, marker, side): one row for each bucket of a class; ``side`` is 1, 2 or both."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space = sent.get()
        for frame in frames:
            two = frame[frame["other"] != ""]
            frame = pd.concat([frame, two.assign(title=two["other"])], ignore_index=True)
            record, code, sketch, names = space.blocks(*(frame[c].tolist() for c in ("title", "authors", "doi")))
            space.trim()
            out = pd.DataFrame({"sig": frame["sig"].to_numpy()[record], "code": code, "sketch": np.where(code < (1 << 62), sketch[record], 0)})
            plain_ = {c: frame[c].to_numpy()[record] for c in ("year", "marker", "side")}
            yield out.assign(names=names[record], **plain_).drop_duplicates(["sig", "code"])

    marked = classes.withColumns({"side": F.aggregate("sides", F.lit(0), lambda n, s: n + F.when(s == "l", 1).otherwise(2)), "marker": F.when(F.col("marker") == "", 0).otherwise(F.abs(F.hash("marker")) + 1)})
    return marked.mapInPandas(batches, "sig long, code long, sketch long, names long, year int, marker long, side int")


FIELDS = ("title", "other", "marker", "authors", "year", "doi")
FEATURES = ("cos_title", "cos_authors", "both_authors", "year_gap")


def _full(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    one = lambda p: classes.select(F.col("sig").alias(p), *(F.col(c).alias(f"{c}_{p}") for c in FIELDS))
    return pairs.join(one("a"), "a").join(one("b"), "b")


def features(space: Space, frame: pd.DataFrame) -> np.ndarray:
    """Exact cosines of titles (the best of two titles each) and of authors, whether both have authors, and the years between, for each pair of a batch.

    Vectors are summed once for each record of the batch, however many pairs it has.
    """
    sides = []
    for x in ("a", "b"):
        at, records = pd.factorize(frame[x]) if x in frame else (np.arange(len(frame)), frame.index)
        first = np.zeros(len(records), np.int64)
        first[at[::-1]] = np.arange(len(frame))[::-1]
        title, other, authors = (frame[f"{c}_{x}"].to_numpy()[first] for c in ("title", "other", "authors"))
        titles = [space._sums([t.split(" ") if t else [] for t in title])] + ([space._sums([t.split(" ") if t else [] for t in other])] if any(other) else [])
        sides.append((at, titles, space._sums([space.surnames(t) for t in authors], "@")))
    (ia, ta, (va, ha)), (ib, tb, (vb, hb)) = sides
    best = np.zeros(len(frame))
    for sums_a, has_a in ta:
        for sums_b, has_b in tb:
            both = has_a[ia] & has_b[ib]
            best[both] = np.maximum(best[both], _cosines(sums_a, ia[both], sums_b, ib[both]))
    both = ha[ia] & hb[ib]
    people = np.zeros(len(frame))
    people[both] = _cosines(va, ia[both], vb, ib[both])
    ya, yb = frame["year_a"].to_numpy(), frame["year_b"].to_numpy()
    gap = np.where((ya > 0) & (yb > 0), np.minimum(np.abs(ya - yb), 5), 1)
    return np.column_stack([best, people, both, gap])


def _cosines(a: np.ndarray, ia: np.ndarray, b: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Cosines of the rows ``ia`` of ``a`` and ``ib`` of ``b``; sums of whole numbers are exact in any order."""
    norms = np.sqrt(np.einsum("ij,ij->i", a, a)).take(ia) * np.sqrt(np.einsum("ij,ij->i", b, b)).take(ib)
    return np.einsum("ij,ij->i", a.take(ia, axis=0), b.take(ib, axis=0)) / np.where(norms == 0, 1, norms)


def calibrated(pairs: DataFrame, classes: DataFrame, sent: Sent) -> tuple[np.ndarray, float]:
    """Weights of a logistic curve over the features, and the confidence from which pairs are looked at.

    It is fitted to all candidate pairs of which both have a DOI: equal DOIs are matches, different ones are not. They come as counts of
    equal features, cosines in hundredths, so their number is bounded. The threshold is a quarter of what all but a five-hundredth of the pairs with equal DOIs reach that the exact check accepts too.
    """
    told = classes.where("doi <> ''").select("sig")
    both = pairs.join(told.withColumnRenamed("sig", "a"), "a", "left_semi").join(told.withColumnRenamed("sig", "b"), "b", "left_semi")
    columns = [*FEATURES, "same", "ok"]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, fields = sent.get(), [*(f"{f}_a" for f in FIELDS), *(f"{f}_b" for f in FIELDS)]
        for frame in frames:
            x = np.rint(100 * features(space, frame)) / 100
            same = (frame["doi_a"] == frame["doi_b"]).to_numpy()
            ok = np.zeros(len(frame), bool)
            ok[same] = [bool(same_work(space, row[:6], row[6:])) for row in zip(*(frame[c][same].tolist() for c in fields), strict=True)]
            space.trim()
            yield pd.DataFrame({**{f: x[:, k] for k, f in enumerate(FEATURES)}, "same": same.astype(float), "ok": ok}).groupby(columns, as_index=False).size()

    rows = _full(both, classes).mapInPandas(batches, ", ".join(f"{f} double" for f in FEATURES) + ", same double, ok boolean, size long").groupBy(*columns).agg(F.sum("size").alias("n")).orderBy(*columns).toPandas()
    x, y, n = np.column_stack([rows[list(FEATURES)].to_numpy(float), np.ones(len(rows))]), rows["same"].to_numpy(float), rows["n"].to_numpy(float)
    weights = np.array([5.0, 10.0, -5.0, -2.5, -3.5])
    if n.sum() > 200 and 20 < (n * y).sum() < n.sum() - 20:
        prior = weights.copy()
        for _ in range(30):  # Newton steps, held near the prior
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            slope = x.T @ (n * (y - p)) - 0.5 * (weights - prior)
            weights = weights + np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(weights)), slope)
    sure = rows["ok"].to_numpy(bool) & (y > 0)
    confidence = (1 / (1 + np.exp(-x @ weights)))[sure]
    order = np.argsort(confidence)
    below = np.cumsum(n[sure][order])
    return weights, float(confidence[order][np.searchsorted(below, 0.002 * below[-1])]) / 4 if len(below) and below[-1] > 20 else 0.02


def compared(pairs: DataFrame, classes: DataFrame, sent: Sent) -> DataFrame:
    """(a, b, ground, confidence) of the candidate pairs that describe one work: those of enough confidence, by their cosines, that pass the exact check.

    An equal DOI raises the confidence and lets the exact check decide.
    """
    weights, least = calibrated(pairs, classes, sent)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space = sent.get()
        for frame in frames:
            logit = np.column_stack([features(space, frame), np.ones(len(frame))]) @ weights
            same = (frame["doi_a"] == frame["doi_b"]) & (frame["doi_a"] != "")
            confidence = 1 / (1 + np.exp(-np.clip(logit + 3.0 * same.to_numpy(), -30, 30)))
            frame = frame.assign(confidence=confidence)[(confidence >= least) | same.to_numpy()]
            columns = [frame[c].tolist() for c in ("a", "b", "confidence", *(f"{f}_a" for f in FIELDS), *(f"{f}_b" for f in FIELDS))]
            out = [(row[0], row[1], ground, round(row[2], 4)) for row in zip(*columns, strict=True) if (ground := same_work(space, row[3:9], row[9:15]))]
            space.trim()
            yield pd.DataFrame(out, columns=["a", "b", "ground", "confidence"])

    return _full(pairs, classes).mapInPandas(batches, "a long, b long, ground string, confidence double")


def prepared(*tables: tuple[DataFrame, str, str]) -> tuple[DataFrame, DataFrame, Sent, DataFrame]:
    """Members (side, id, sig), classes (one row for equal records), what was learned, and all buckets; buckets are hashed where they are read."""
    members = featured(*tables[0])
    for table in tables[1:]:
        members = members.unionByName(featured(*table))
    members = checkpointed(members)
    spark = members.sparkSession
    shards = members.count() // SHARD + 1
    author = F.when(F.col("authors") != "", F.xxhash64(F.regexp_extract("authors", r"(\S+) =", 1))).otherwise(F.xxhash64("sig"))
    placed = members.withColumn("shard", F.pmod(author, F.lit(shards)).cast("int")).repartition(max(2 * spark.sparkContext.defaultParallelism, shards // 20), "shard")
    classes = checkpointed(placed.groupBy("shard", "sig", *FIELDS).agg(*(F.max(F.when(F.col("side") == x, 1)).alias(x) for x in "lr")).select("shard", "sig", *FIELDS, F.array_compact(F.array(*(F.when(F.col(x) == 1, x) for x in "lr"))).alias("sides")).sortWithinPartitions("shard", "sig"))
    sent = Sent(spark, learned(classes), Space)
    return members.select("side", "id", "sig"), classes, sent, hashed(classes, sent)


def linked(papers: DataFrame, records: DataFrame, left_key: str = "seq", right_key: str = "rec_id") -> DataFrame:
    """(left_key, right_key, ground, confidence): all pairs of rows of the two tables that describe one work.

    Equal rows are compared once and expanded at the end, so copies cost nothing. Null or empty titles can only be
    linked by DOI and authors; rows without any usable attribute are linked to none. Extra columns are not looked at.
    """
    members, classes, sent, buckets = prepared((papers, left_key, "l"), (records, right_key, "r"))
    both = classes.where("size(sides) = 2").select(F.col("sig").alias("a"), F.col("sig").alias("b"))
    scored = checkpointed(compared(small_hashed(candidates(buckets, True, checkpointed(hot_codes(classes, sent))).unionByName(both)), classes, sent))
    a = members.where("side = 'l'").select(F.col("id").alias(left_key), F.col("sig").alias("a"))
    b = members.where("side = 'r'").select(F.col("id").alias(right_key), F.col("sig").alias("b"))
    return scored.join(a, "a").join(b, "b").groupBy(left_key, right_key).agg(F.max("ground").alias("ground"), F.max("confidence").alias("confidence"))
