"""Exact byte-pair encoding of a text column by dynamic programming over prefixes.

The rank file and the split pattern of a public tokenizer are parameters; nothing is trained.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Entries a worker keeps of encoded words, and the longest word it keeps.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 48


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path of a rank file of the installed public tokenizers, and the pattern that splits text before it."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


class PrefixEncoder:
    """Byte-pair encoding of one vocabulary.

    For every prefix of a word exactly one token can be the last of the prefix's encoding. Among the
    tokens that end at that place (found by an automaton over the vocabulary) it is the one that is
    compatible with the last token of the prefix before it. Two tokens are compatible if merging the
    bytes of both gives just these two. Time is linear in the text, also for words without an end.
    """

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.words = regex.compile(pattern)
        self.compatible: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                self.halves[rank] = self._halves(token, rank)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.known: dict[str, bytes] = {}

    def _halves(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge made this one."""
        for cut in range(1, len(token)):
            left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if left is not None and right is not None and max(self._made(left), self._made(right)) < rank:
                if self._apart(left, right, rank):
                    return left, right
        raise ValueError(f"token {rank} is not a merge of two others")

    def _made(self, token: int) -> int:
        """When a token was made: its rank, or -1 for a single byte."""
        return token if len(self.bytes[token]) > 1 else -1

    def _apart(self, left: int, right: int, before: int) -> bool:
        """Whether merges of ranks under `before` leave these neighbours as they are.

        Goes back in time: the later made of the two is undone, and the pair at the boundary must not
        have had a merge that came first. Of equal merges the one further left comes first.
        """
        while True:
            merged = self.ranks.get(self.bytes[left] + self.bytes[right])
            if merged is not None and merged < before:
                return False
            a, b = self._made(left), self._made(right)
            if a < 0 and b < 0:
                return True
            if a > b:
                before, left = a, self.halves[left][1]
            else:
                before, right = b + 1, self.halves[right][0]

    def pair(self, left: int, right: int) -> bool:
        """_apart for all merges, remembered."""
        key = (left, right)
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > CACHE_ENTRIES:
                self.compatible.clear()
            known = self.compatible[key] = self._apart(left, right, 1 << 60)
        return known

    def word(self, word: str) -> list[int]:
        """Ids of one piece of the split pattern."""
        data = word.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        last = [-1] * (len(data) + 1)
        back = [0] * (len(data) + 1)
        for end, (token, size) in self.automaton.iter(data.decode("latin-1")):
            start, end = end + 1 - size, end + 1
            if last[end] < 0 and (start == 0 or self.pair(last[start], token)):
                last[end], back[end] = token, start
        ids, at = [], len(data)
        while at:
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def packed(self, chunk: str) -> bytes:
        """Ids of a text as 32-bit integers; pieces are looked up first."""
        known = self.known
        out = []
        for piece in self.words.findall(chunk):
            ids = known.get(piece)
            if ids is None:
                ids = array("i", self.word(piece)).tobytes()
                if len(piece) <= CACHE_CHARS:
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)


class Chunks(dict):
    """Encoded text from one single space to the next: pieces never cross a space before a visible character."""

    def __init__(self, encoder: PrefixEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encoder.packed(" " + chunk)
        if len(chunk) <= CACHE_CHARS:
            self[chunk] = ids
        return ids


#: a space that does not start a chunk
LOOSE = re.compile(r" (?=\s|\Z)")
_encoders: dict[tuple[str, str], Chunks] = {}


def chunks(path: str, pattern: str) -> Chunks:
    """This worker's encoder, made once."""
    found = _encoders.get((path, pattern))
    if found is None:
        found = _encoders[(path, pattern)] = Chunks(PrefixEncoder(path, pattern))
    return found


def encode(text: str | None, cache: Chunks) -> bytes:
    """All ids of a text as 32-bit integers; none for an empty or null text."""
    if not text:
        return b""
    parts = text.split(" ")
    if LOOSE.search(text):
        joined = [parts[0]]
        for part in parts[1:]:
            if part and not part[0].isspace():
                joined.append(part)
            else:
                joined[-1] += " " + part
        parts = joined
    if len(cache) > CACHE_ENTRIES:
        cache.clear()
    if len(cache.encoder.known) > CACHE_ENTRIES:
        cache.encoder.known.clear()
    return cache.encoder.packed(parts[0]) + b"".join([cache[part] for part in parts[1:]])


def token_ids(
    df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """(key, ids): the ids of each text, without special tokens.

    Strings that look like special tokens are ordinary text. Empty and null texts give the empty list,
    texts are encoded whole at any length, repeated rows come out as often as they come in, an empty
    table gives no rows. Other columns, whatever their names, are neither read nor returned. No shuffle:
    each Arrow batch is encoded where it is read.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # looked up where it is opened, as a worker may have it elsewhere
        cache = chunks(*((path, pattern) if path and pattern else vocabulary()))
        for batch in batches:
            packed = [encode(x, cache) for x in batch.column(1).to_pylist()]
            ends = [0]
            for x in packed:
                ends.append(ends[-1] + len(x) // 4)
            if ends[-1] >= 2**31:
                raise ValueError("set spark.sql.execution.arrow.maxRecordsPerBatch lower for such texts")
            flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(packed))])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["_key", "ids"])

    rows = df.select(df[key].alias("_key"), df[text].alias("_text"))
    return rows.mapInArrow(run, f"_key {kind}, ids array<int>").withColumnRenamed("_key", key)


def token_counts(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The columns of keep and `tokens`, the number of ids of each text (0 for empty and null texts)."""
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pattern = vocabulary()
        cache = chunks(path or own, pattern)
        for batch in batches:
            sizes = pa.array([len(encode(x, cache)) // 4 for x in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], sizes], [*keep, "tokens"])

    rows = df.select(*(df[c] for c in keep), df[text].alias("_text"))
    return rows.mapInArrow(run, f"{fields}, tokens bigint")
