"""Documents that contain passages of held-out evaluation items.

Every window of `width` words of the corpus is compared with every window of the items, through an embedding of edit
distance into Hamming distance: a random walk reads a window one word a step and moves on to the next word or stays,
as a random bit of (step, word) says, so windows at a small edit distance give strings that agree at most places.
Repeated samples of a few places of these strings are the keys of hash tables over the item windows; a corpus window
that hits a table is verified by its exact edit distance.

Recall. Equal windows give equal walks, hence equal keys: distance 0 is always found, by a single walk. For windows at
a distance of one or more words, `walks_for` gives the independent walks that the target recall asks for (measured in
the tests over all kinds of edits).

Cost. Walks run over the words where they lie: the walks of all windows of a block advance together, a step being a
few array operations, so the cost of a window does not hang on its words.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Windows of the width that makes a case (words in a row), and the places sampled of each walk.
WIDTH, SAMPLED = 12, 4
#: Share of windows within the allowed edits that must be found; least chance over the kinds of edits that one walk with
#: its samples survives an edit.
TARGET, SURVIVES = 0.985, 0.36
#: One pass over the corpus takes this many items and characters of prompts at most; more items take more passes.
ITEMS_A_PASS, CHARS_A_PASS = 200_000, 100_000_000
#: Windows that are walked at once, so that a step's arrays stay in the cache.
BLOCK = 1 << 15
#: Bits of the filter in front of each table.
_FILTER = 18

_HIDDEN = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e01ef]")
#: ASCII characters that are no letter or digit separate words.
_ASCII = "".join(chr(i) if chr(i).isalnum() else " " for i in range(128))
_BREAK = re.compile(r"<\s*+/?\s*+(?:br|p|div|li|ul|ol|td|th|tr|table|h[1-6]|hr|blockquote|pre|section|article)\b[^<>]*+>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*+>")
_LONG_REFERENCE = re.compile(r"&#[0-9]{9,}+;?")
_WORD = re.compile(r"[^\W_]+")


def _without_comments(text: str) -> str:
    """`text` without <!-- ... -->; one that never closes is text."""
    parts, at = [], 0
    while (lo := text.find("<!--", at)) >= 0 and (hi := text.find("-->", lo + 4)) >= 0:
        parts.append(text[at:lo])
        at = hi + 3
    return "".join(parts) + text[at:] if parts else text


def words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits, after markup and invisible characters are taken out.

    Inline tags vanish (they may stand inside a word), block tags separate; character references are read. Every step
    is linear in the text.
    """
    if "<" in text:
        text = _BREAK.sub(" ", text)
        text = _TAG.sub("", _without_comments(text) if "<!--" in text else text)
    if "&" in text:
        # A number too long for any character names none; the parser would refuse it.
        text = html.unescape(_LONG_REFERENCE.sub("�", text) if "&#" in text else text)
    if not text.isascii():
        if _HIDDEN.search(text):
            text = _HIDDEN.sub("", text)
        return _WORD.findall(text.lower())
    return text.lower().translate(_ASCII).split()


def walks_for(max_edits: int, target: float = TARGET) -> int:
    """Independent walks that find windows at `max_edits` edits with a chance of at least `target`."""
    p = SURVIVES**max_edits
    return 1 if max_edits <= 0 else math.ceil(math.log(1 - target) / math.log(1 - p))


class ItemIndex:
    """Hash tables over all windows of the items of one pass. Bounded by the items, never by the corpus."""

    def __init__(self, items: list[tuple[int, str]], width: int = WIDTH, max_edits: int = 0, sampled: int = SAMPLED, seed: int = 20):
        # Two steps a word bring a walk to the end of a window; one number holds its bits, so wide windows are walked in part.
        self.width, self.max_edits, steps = width, max_edits, min(2 * width, 62)
        walks = walks_for(max_edits)
        texts = [(i, words(p)) for i, p in items]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in texts for w in ws}))}
        rng = np.random.default_rng(seed)
        size = len(self.vocabulary) + 2  # 0 is any word that no item has, the last is the end of a window
        symbols = rng.integers(1, 1 << 62, size, dtype=np.int64)
        #: By walk and word: bit s says whether step s moves on.
        self.moves = rng.integers(0, 1 << 63, (walks, size), dtype=np.int64)
        # One place in each stretch of the walk, so that a key speaks of the whole window.
        cuts = np.linspace(0, steps, min(sampled, steps) + 1).astype(int)
        self.places = [rng.integers(cuts[:-1], cuts[1:]) for _ in range(walks)]
        with np.errstate(over="ignore"):
            self.values = [[symbols * (2 * int(m) + 1) for m in rng.integers(1, 1 << 62, len(p), dtype=np.int64)] for p in self.places]
        windows: dict[bytes, list[int]] = defaultdict(list)
        for i, ws in texts:
            ids = np.fromiter((self.vocabulary[w] for w in ws), np.int32, len(ws))
            for k in range(len(ids) - width + 1):
                known = windows[ids[k : k + width].tobytes()]
                if i not in known:
                    known.append(i)
        self.owners = list(windows.values())
        self.rows = np.array([np.frombuffer(b, np.int32) for b in windows], np.int32).reshape(-1, width)
        # One table a walk: keys in order, the window of each, and the filter of their first bits.
        self.tables = []
        for key in self.keys(self.rows.ravel(), np.arange(len(self.rows)) * width):
            here = np.zeros(1 << _FILTER, bool)
            here[self._first_bits(key)] = True
            self.tables.append((np.sort(key), np.argsort(key, kind="stable"), here))

    @staticmethod
    def _first_bits(key: np.ndarray) -> np.ndarray:
        return (key ^ (key >> 31)) >> (64 - _FILTER) & ((1 << _FILTER) - 1)

    def keys(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """For each walk, the keys of the windows of `ids` that begin at `starts`."""
        ids = np.append(ids, 0)
        end, last = len(self.moves[0]) - 1, starts + self.width
        at, bit = np.empty_like(starts), np.empty_like(starts)
        for moves, places, values in zip(self.moves, self.places, self.values, strict=True):
            here = moves[ids]
            key = np.zeros(len(starts), np.int64)
            np.copyto(at, starts)
            taken = 0
            for step in range(int(places[-1]) + 1):
                if step == places[taken]:
                    symbol = ids[at]
                    symbol[at == last] = end
                    key += values[taken][symbol]
                    taken += 1
                np.take(here, at, out=bit, mode="clip")
                np.right_shift(bit, step, out=bit)
                np.bitwise_and(bit, 1, out=bit)
                np.add(at, bit, out=at)
                np.minimum(at, last, out=at)
            yield key

    def search(self, ids: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, window number, edits) of each verified match of the windows of `ids` at `starts`."""
        out: list[tuple[int, int, int]] = []
        for lo in range(0, len(starts), BLOCK):
            some = starts[lo : lo + BLOCK]
            base = int(some[0])
            out += [(base + s, w, e) for s, w, e in self._search(ids[base : int(some[-1]) + self.width], some - base)]
        return out

    def _search(self, ids: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
        n, offsets = max(1, len(self.rows)), np.arange(self.width)
        if len(starts) * self.width < len(ids):  # few of the windows: only their own words are walked
            ids, walked = ids[starts[:, None] + offsets].ravel(), np.arange(len(starts)) * self.width
        else:
            walked = starts
        pairs = []
        for (known, window, here), own in zip(self.tables, self.keys(ids, walked), strict=True):
            hit = np.nonzero(here[self._first_bits(own)])[0]
            lo, hi = np.searchsorted(known, own[hit], "left"), np.searchsorted(known, own[hit], "right")
            count = hi - lo
            k = np.repeat(hit, count)
            at = np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            pairs.append(k * n + window[at])
        both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        found = []
        for lo in range(0, len(both), 1 << 17):
            k, w = both[lo : lo + (1 << 17)] // n, both[lo : lo + (1 << 17)] % n
            edits = edit_distances(ids[walked[k][:, None] + offsets], self.rows[w], self.max_edits)
            ok = edits <= self.max_edits
            found += zip(starts[k[ok]].tolist(), w[ok].tolist(), edits[ok].tolist(), strict=True)
        return found


def edit_distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Levenshtein distances of the rows of two arrays of words, all pairs at once. Distances above `most` come out as
    some number above it: cells further than that from the diagonal are not filled in."""
    if most <= 0:
        return (a != b).any(axis=1).astype(np.int64)
    n, width, other = len(a), a.shape[1], b.shape[1]
    far = most + 1
    before = np.full((n, other + 1), far, np.int64)
    before[:, : min(most, other) + 1] = np.arange(min(most, other) + 1)
    for i in range(width):
        row = np.full_like(before, far)
        if i < most:
            row[:, 0] = i + 1
        for j in range(max(0, i - most), min(other, i + most + 1)):
            step = np.minimum(before[:, j + 1], row[:, j]) + 1
            row[:, j + 1] = np.minimum(step, before[:, j] + (b[:, j] != a[:, i]))
        before = row
    return before[:, -1]


_indexes: dict[tuple[str, int, int], ItemIndex] = {}


def _index(key: str, shared, width: int, max_edits: int) -> ItemIndex:
    """One index a worker process and set of items."""
    if (key, width, max_edits) not in _indexes:
        _indexes.clear()
        _indexes[key, width, max_edits] = ItemIndex(shared.value, width, max_edits)
    return _indexes[key, width, max_edits]


def leaked_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "eval_id", prompt: str = "prompt",
                 width: int = WIDTH, max_edits: int = 0) -> DataFrame:
    """(id, item, windows, edits): documents with a window of `width` words within `max_edits` edits of an item's.

    The tables of the items are broadcast, ITEMS_A_PASS items and CHARS_A_PASS characters at most; more items take
    several passes over the corpus, each with a share of the items that their hash picks. A pass scans whole texts,
    without a shuffle. Windows with more than `max_edits` words that no item has cannot match and are not walked.
    Defined cases: null, empty and short texts contain nothing; an item shorter than the width is never found;
    repeated items are found each; repeated document rows give a row each.
    """
    named = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(prompt).alias("p")).where("p is not null and i is not null")
    size = named.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("p")), F.lit(0)).alias("chars")).first()
    passes = max(1, -(-size.n // ITEMS_A_PASS), -(-size.chars // CHARS_A_PASS))
    if passes > 1:
        passes *= 2  # shares by hash are uneven: half full on average
    share = F.pmod(F.xxhash64("i"), F.lit(passes))
    parts = (sorted((r.i, r.p) for r in named.where(share == k).collect()) for k in range(passes))
    return reduce(DataFrame.unionByName, [_one_pass(docs, part, id_col, text_col, width, max_edits) for part in parts])


def _one_pass(docs: DataFrame, rows: list[tuple[int, str]], id_col: str, text_col: str, width: int, max_edits: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    key = hashlib.sha256(repr(rows).encode()).hexdigest()
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(key, shared, width, max_edits)
        number = index.vocabulary.get
        for batch in batches:
            found: list[tuple] = []
            names, texts = batch.column(0), batch.column(1).to_pylist()
            for lo in range(0, len(texts), 500):
                parts, lengths = [], []
                for text in texts[lo : lo + 500]:
                    ws = words(text) if text else []
                    parts.append(np.fromiter(map(number, ws, repeat(0)), np.int32, len(ws)))
                    lengths.append(len(ws))
                ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
                if len(ids) < width:
                    continue
                unknown = np.concatenate([[0], np.cumsum(ids == 0)])
                owner = np.repeat(np.arange(len(lengths)), lengths)
                starts = np.nonzero((unknown[width:] - unknown[:-width] <= max_edits) & (owner[: len(ids) - width + 1] == owner[width - 1 :]))[0]
                if not len(starts):
                    continue
                best: dict[tuple[int, int], list[int]] = {}
                for start, w, edits in index.search(ids, starts):
                    for item in index.owners[w]:
                        seen = best.setdefault((int(owner[start]), item), [0, edits])
                        seen[0] += 1
                        seen[1] = min(seen[1], edits)
                found += [(names[lo + d].as_py(), item, n, e) for (d, item), (n, e) in sorted(best.items())]
            cols = list(zip(*found, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32())],
                names=["id", "item", "windows", "edits"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"id {id_type}, item bigint, windows bigint, edits int")
