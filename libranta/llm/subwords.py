"""P8: exact ids of a public byte-level BPE vocabulary, by a streaming transducer with bounded lookahead.

The merge list is never replayed over a whole piece. For each prefix of a piece there is exactly one last token
of its encoding; it is found from earlier prefixes alone, because a token may follow another exactly
if the two together encode to themselves. How many bytes to the right can bear on a boundary is computed from the
merge list (``lookahead``); tokens further back are stable and leave the transducer, so its memory is constant.
"""

from __future__ import annotations

import base64
import codecs
import json
import os
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokeniser's pattern that belongs to this vocabulary.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A blank between two visible characters always starts a piece, so a text may be cut there.
CUT = regex.compile(r"(?<=[^\s\x1c-\x1f])(?= [^\s\x1c-\x1f])")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public file lies: LIBRANTA_TOKENIZERS if set, else the folder of the installed package."""
    if folder := os.environ.get("LIBRANTA_TOKENIZERS"):
        return os.path.join(folder, name)
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


class Vocabulary:
    """Ranks of byte strings; ids are ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}
        self.bytes = {rank: word for word, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.whole: dict[bytes, bool] = {}

    def replay(self, word: bytes) -> list[bytes]:
        """The merge list on a short byte string, lowest rank first and leftmost among equals."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def reachable(self, token: bytes) -> bool:
        """Whether the token encodes to itself."""
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = len(self.replay(token)) == 1
        return known

    def may_follow(self, left: bytes, right: bytes) -> bool:
        """Whether ``left`` and ``right`` stay two tokens side by side; the memo is bounded."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > 400_000:
                self.fits.clear()
            known = self.fits[left, right] = self.replay(left + right) == [left, right]
        return known

    @cached_property
    def lookahead(self) -> int:
        """Bytes to the right of a boundary that can bear on whether it stays: the longest chain of the merge list.

        A boundary goes if a merge (u, v) crosses it. Whether v stands there depends on the v bytes and on whether its own right
        boundary is crossed before that merge's turn, that is by an earlier merge whose left part stands at the right edge of v:
        v itself or a part that v is made of. The same holds for that merge in turn, and turns only get earlier, so
        chains are finite and the longest is found in one pass over the merges in their order.
        """
        parts: dict[bytes, tuple[bytes, bytes]] = {}
        reach: dict[bytes, int] = {}  # by left part, the most bytes that a merge seen so far depends on
        most = 0
        for word, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(word) == 1 or (made := self._last_merge(word, rank)) is None:
                continue
            left, right = parts[word] = made
            further, edge = reach.get(right, 0), right
            while edge in parts:
                edge = parts[edge][1]
                further = max(further, reach.get(edge, 0))
            reach[left] = max(reach.get(left, 0), len(right) + further)
            most = max(most, len(right) + further)
        return most

    def _last_merge(self, word: bytes, rank: int) -> tuple[bytes, bytes] | None:
        """The two tokens that a token is merged from, or None if the merge list never makes it."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 2:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best >= rank:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]


class Transducer:
    """Feed bytes of one piece in any portions; ids come out as soon as they are stable."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.tail = b""  # the bytes since the last emitted boundary
        self.last: list[int] = [0]  # for each prefix of tail: length of its last token, 0 at the boundary, -1 if no encoding ends there
        self.before = b""  # the last emitted token

    def feed(self, portion: bytes) -> list[int]:
        out: list[int] = []
        for k in range(len(portion)):
            self.tail += portion[k : k + 1]
            end = len(self.tail)
            self.last.append(self._length(end))
            if end >= self.room:
                out += self._settle()
        return out

    @property
    def room(self) -> int:
        """Bytes held at most: a portion to emit, the longest token and the lookahead, which is only computed for pieces beyond a kilobyte."""
        return 1024 if len(self.tail) < 1024 else max(1024, self.v.lookahead + self.v.longest + 256)

    def _length(self, end: int) -> int:
        tail, last = self.tail, self.last
        for start in range(max(0, end - self.v.longest), end):
            token = tail[start:end]
            if token in self.v.ranks and last[start] >= 0 and self.v.reachable(token):
                left = tail[start - last[start] : start] if start else self.before
                if not left or self.v.may_follow(left, token):
                    return end - start
        return -1

    def _chain(self, end: int) -> list[int]:
        ends = []
        while end > 0:
            ends.append(end)
            end -= self.last[end]
        return ends[::-1]

    def _settle(self) -> list[int]:
        """Emits the tokens that end further back than the lookahead."""
        stable = len(self.tail) - self.v.lookahead
        return self._emit([end for end in self._chain(len(self.tail)) if end <= stable])

    def _emit(self, ends: list[int]) -> list[int]:
        out, start = [], 0
        for end in ends:
            self.before = self.tail[start:end]
            out.append(self.v.ranks[self.before])
            start = end
        self.tail = self.tail[start:]
        self.last = [0, *(length if length <= k else -1 for k, length in enumerate(self.last[start + 1 :], 1))]
        return out

    def close(self) -> list[int]:
        """The rest of the piece; the transducer is then ready for another."""
        out = self._emit(self._chain(len(self.tail)))
        self.tail, self.last, self.before = b"", [0], b""
        return out


class Encoder:
    """Ids of whole texts; ids of short pieces are remembered, up to ``memo`` of them."""

    def __init__(self, path: str, memo: int = 150_000):
        self.v, self.memo, self.known = Vocabulary(path), memo, {}

    def _run(self, part: str) -> tuple[int, ...]:
        transducer, out = Transducer(self.v), []
        for piece in PIECES.findall(part):
            out += transducer.feed(piece.encode("utf-8", "replace"))
            out += transducer.close()
        if len(part) <= 40:
            if len(self.known) >= self.memo:
                self.known.clear()
            self.known[part] = tuple(out)
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        known, run = self.known, self._run
        if "  " in text or not text.isprintable():
            parts = CUT.split(text)
        else:
            first, *rest = text.split(" ")
            parts = [first, *(" " + word for word in rest)]
            if rest and (not rest[-1] or not first):
                parts = CUT.split(text)
        return list(chain.from_iterable(known.get(part) or run(part) for part in parts if part))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)


class Decoder:
    """Ids to text in any portions: bytes of an unfinished character wait for the next id."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.state = vocabulary, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return "".join(self.state.decode(self.v.bytes[i]) for i in ids)

    def close(self) -> str:
        return self.state.decode(b"", final=True)


def encoded(frame: DataFrame, key: str = "doc_id", column: str = "text", path: str | None = None) -> DataFrame:
    """(``key``, ids): one row for each row of ``frame``; the empty text has an empty list, and so has null.

    No shuffle: the scan's partitions are encoded where they are read.
    """
    where = path or vocabulary_path()

    def batches(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(where)
        for batch in record_batches:
            ids = [own.encode(text) if text else [] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return frame.select(F.col(key), F.col(column)).mapInArrow(batches, f"{key} long, ids array<int>")


def decoded(frame: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(``key``, text) from (``key``, ids); null ids give the empty text."""
    where = path or vocabulary_path()

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = encoder(where).v
        for batch in frames:
            texts = []
            for ids in batch["ids"]:
                machine = Decoder(v)
                texts.append(machine.feed([] if ids is None else list(ids)) + machine.close())
            yield pd.DataFrame({key: batch[key], "text": texts})

    return frame.select(key, "ids").mapInPandas(batches, f"{key} long, text string")


def ids_of_json(path: str) -> dict[str, int]:
    """The same vocabulary from its JSON file, for tests."""
    with open(path, encoding="utf-8") as file:
        return json.load(file)["model"]["vocab"]
