"""Byte-level BPE encoding of a corpus, exact and in linear time, by backtracking over longest token matches.

Encoder. An Aho-Corasick automaton over the vocabulary gives the longest token that starts at each byte. The encoder
takes it if the pair with the token before is one that the merges themselves could leave side by side, else the next
shorter token that is a prefix of it, and steps back when none fits. Whether two tokens may stand side by side is read
from a table of the merges (which two parts made each token), so no merge loop runs over the text. Positions that
proved impossible are remembered, which keeps the whole walk linear in the bytes.

Decoder. All token bytes lie in one buffer with a table of offsets; decoding is slicing and joining.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The public pattern that splits a text into the pieces inside which merges happen.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern over texts of ASCII only, for the standard library's engine.
ASCII_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t\n\x0b\x0c\r A-Za-z0-9]+|[\t\n\x0b\x0c\r ]+(?![^\t\n\x0b\x0c\r ])|[\t\n\x0b\x0c\r ]+"""

CACHED_PIECES = 400_000
CACHED_BYTES = 48
NO_ID = (1 << 32) - 1


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The installed rank file; TIDEWELL_TOKENIZERS names another folder."""
    folder = os.environ.get("TIDEWELL_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id, from a rank file (base64 token and rank a line)."""
    with open(path, "rb") as f:
        ranked = {int(r): base64.b64decode(t) for t, r in (line.split() for line in f if line.strip())}
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError("ranks must be 0..n-1")
    return [ranked[i] for i in range(len(ranked))]


def may_follow(pairs: dict[int, int], parts: list[tuple[int, int]], left: int, right: int) -> bool:
    """Whether the merges leave `left` and `right` side by side.

    Undoes the later of the two tokens' last merges again and again; if at any stage the two tokens that touch at the
    border would have merged earlier than what was undone, the border could not have survived.
    """
    limit = NO_ID
    while True:
        made = pairs.get(left << 32 | right)
        if made is not None and made < limit:
            return False
        if left > right:
            limit, left = left, parts[left][1]
            if left == limit:
                limit, right = right + 1, parts[right][0]
                if right + 1 == limit:
                    return True
        else:
            limit, right = right + 1, parts[right][0]
            if right + 1 == limit:
                limit, left = left, parts[left][1]
                if left == limit:
                    return True


def merge_tables(tokens: list[bytes]) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """(pairs, parts): which pair makes each token, in both directions. Single bytes are parts of themselves."""
    ids = {t: i for i, t in enumerate(tokens)}
    pairs: dict[int, int] = {}
    parts: list[tuple[int, int]] = []
    for i, t in enumerate(tokens):
        made = (i, i)
        for k in range(1, len(t)):
            a, b = ids.get(t[:k], NO_ID), ids.get(t[k:], NO_ID)
            if a < i and b < i and may_follow(pairs, parts, a, b):
                made = (a, b)
                pairs[a << 32 | b] = i
                break
        parts.append(made)
    return pairs, parts


class Encoder:
    """Encodes and decodes with one vocabulary. Built from `tables(...)`, which is what is shipped to executors."""

    def __init__(self, tokens: list[bytes], pairs: dict[int, int], parts: list[tuple[int, int]]):
        import ahocorasick
        import regex

        self.tokens, self.pairs, self.parts = tokens, pairs, parts
        ids = {t: i for i, t in enumerate(tokens)}
        self.shorter = [next((ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ids), -1) for t in tokens]
        self.length = [len(t) for t in tokens]
        self.single = [ids.get(bytes([b]), -1) for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.whole = ids
        self.split = regex.compile(PIECES).findall
        self.split_ascii = re.compile(ASCII_PIECES).findall
        self.offsets = np.concatenate([[0], np.cumsum(self.length)])
        self.buffer = b"".join(tokens)
        self.memory: dict[str, tuple[int, ...]] = _Pieces(self)

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        if not data:
            return ()
        n = len(data)
        longest = [self.single[b] for b in data]
        length, tokens = self.length, self.tokens
        for end, i in self.automaton.iter(data.decode("latin-1")):
            start = end + 1 - length[i]
            if length[i] > length[longest[start]]:
                longest[start] = i
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        pairs, parts, shorter = self.pairs, self.parts, self.shorter
        while at < n:
            last = out[-1] if out else -1
            while True:
                end = at + length[token]
                if open_at[end] and (last < 0 or may_follow(pairs, parts, last, token)):
                    out.append(token)
                    at = end
                    token = longest[end] if end < n else -1
                    break
                if shorter[token] >= 0:
                    token = shorter[token]
                    continue
                open_at[at] = 0
                out.pop()
                at -= length[last]
                token = last
                break
        return tuple(out)

    def pieces(self, text: str) -> list[str]:
        return (self.split_ascii if text.isascii() else self.split)(text)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens. An empty or null text has no ids: []. Strings that look like
        special tokens are ordinary text. A lone surrogate is read as U+FFFD."""
        return list(chain.from_iterable(map(self.memory.__getitem__, self.pieces(text)))) if text else []

    def decode(self, ids: list[int]) -> str:
        b = self.buffer
        o = self.offsets
        return b"".join(b[o[i] : o[i + 1]] for i in ids).decode("utf-8", "replace")


class _Pieces(dict):
    """Ids by piece. Bounded: long pieces are not kept, and a full memory starts anew."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "replace") if piece.isascii() else piece.encode("utf-8", "surrogatepass").decode("utf-8", "replace").encode()
        whole = self.encoder.whole.get(data)
        ids = (whole,) if whole is not None else self.encoder.encode_bytes(data)
        if len(data) <= CACHED_BYTES:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids


def tables(path: str | None = None) -> tuple[list[bytes], dict[int, int], list[tuple[int, int]]]:
    tokens = read_ranks(path or vocabulary_path())
    return tokens, *merge_tables(tokens)


_encoders: dict[str, Encoder] = {}


def _encoder(key: str, shared) -> Encoder:
    """One encoder a worker process and vocabulary, whatever the number of tasks the process runs."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(*shared.value)
    return _encoders[key]


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every row of `docs`, whole texts, one output row per input row.

    No shuffle: a scan and one Arrow pass. The tables (a fixed vocabulary, a few MB) are built once on the driver and
    broadcast. Texts that repeat, in whole or in pieces, are found in the worker's memory of pieces, so a hot text is
    cheap and stays where it was read. Defined cases: null and empty texts give []; white space is encoded as it is;
    extra columns are not carried; an empty table gives no rows.
    """
    path = path or vocabulary_path()
    key = f"{path}:{os.path.getsize(path)}"
    shared = docs.sparkSession.sparkContext.broadcast(tables(path))
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shared)
        get, pieces = encoder.memory.__getitem__, encoder.pieces
        for batch in batches:
            counts, parts = np.zeros(batch.num_rows + 1, np.int32), []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    ids = np.fromiter(chain.from_iterable(map(get, pieces(text))), np.int32)
                    counts[k + 1] = len(ids)
                    parts.append(ids)
            values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)
