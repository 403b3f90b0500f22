"""Texts that were cut inside a word or a sentence, found by joining their ends with prefixes of longer copies.

Values join by prefix first: every word position of the corpus gives the hash of its text so far, and a text whose own
hash is among these is a strict prefix of a longer copy, unless it stands whole elsewhere; so is one that goes on there with a word which its last one
begins. Few cut texts have a longer copy of the whole value, so the same join is made for sentences. A cut sentence is a strict prefix of a sentence that stands whole somewhere else. Sentences are compared word by word
with names and numbers masked, so that "raised its target for BTC to" finds every sentence that goes on from there.
Prefixes are hashed: each word position of the corpus gives the hash of its sentence so far, and of its last four, two
and one words for sentences whose beginning is rare, with whether the sentence went on or ended there. The end of every
text is looked up among these. Words are treated alike: an ending that is never a whole word elsewhere but begins a
longer one was cut inside the word.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

#: A context must have been seen this often to speak.
SUPPORT = 2
#: A sentence that so many different texts trail off with, and none goes on from, is a way to end a text.
TEASER = 5
KINDS = ("full", "four", "two", "one", "word", "stem", "value", "begun")

_TAG = re.compile(r"<[^<>]*+>")
_LONG_REFERENCE = re.compile(r"&#[0-9]{9,}+;?")
_OPEN_REFERENCE = re.compile(r"&(?:#?\w{0,8})$")
_MORE = re.compile(r"(?:more|read more|continued?|cont|…|\.\.\.|\s)*+[\])}]", re.I)
_INVITE = re.compile(r"\b(?:continue reading|keep reading|read more|read on|see more|full story|read the full (?:story|article))\s*+[→»>]*+\s*+$", re.I)
_URL = re.compile(r"https?://|www\.")
_QUOTES = "\"'“”‘’«»„()[]{}"
_TRAILING = "…‥"
#: Marks that are no decoration.
_MEANT = ".!?。！？%,;:–—$€£¥#@&+/-" + _QUOTES + _TRAILING
#: Marks that end a sentence, and what may close after them.
_STOPS, _CLOSERS = ".!?。！？", "\"'”’»)]"
_ABBREVIATION = re.compile(r"^(?:[A-Za-z]\.)+$|^(?:approx|vs|etc|Inc|Ltd|Corp|Co|No|Mr|Mrs|Ms|Dr|St|cf|Fig|Sec|Art|al|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)\.$")
#: "27." may be the beginning of "27.2%"; "$970." ends a sentence.
_SHORT_NUMBER = re.compile(r"^[^\w\s]?\d{1,2}\.$")
_DIGITS = re.compile(r"\d+")
#: Marks after which a sentence always goes on.
_DANGLING = ",;:–—$€£¥#@&+/([{“‘„«-"


def clean(text: str) -> str:
    text = _TAG.sub("", text) if "<" in text else text
    if "&" not in text:
        return text
    # A number too long for any character names none; the parser would refuse it.
    return html.unescape(_LONG_REFERENCE.sub("�", text) if "&#" in text else text)


def stops(token: str) -> bool:
    """Whether a token ends with a stop, perhaps within quotes or brackets."""
    core = token.rstrip(_CLOSERS)
    return bool(core) and core[-1] in _STOPS


def _undecorated(t: str) -> tuple[str, bool] | None:
    """`t` without one decoration at its end, and whether that is a sign of a cut; None if it has none. `t` ends with
    no blank."""
    c = t[-1]
    if c in "])}":
        lo = max(t.rfind("["), t.rfind("("), t.rfind("{"))
        if lo >= 0 and _MORE.fullmatch(t, lo + 1):
            return t[:lo], True
    if c in _TRAILING:
        return t.rstrip(_TRAILING), True
    if t.endswith("..."):
        return t.rstrip("."), True
    last = t.rsplit(None, 1)[-1]
    m = _URL.search(last)
    if m:
        return t[: len(t) - len(last) + m.start()], False
    if c.isalpha() or c in "→»>":
        m = _INVITE.search(t)
        if m and t[: m.start()].rstrip().endswith((".", "…", "!", "?", "]")):
            return t[: m.start()], False
    if c == ")":
        lo = t.rfind("(")
        if lo > 0 and t[lo - 1].isspace() and ")" not in t[lo:-1]:
            return t[:lo], False
    n = len(t)
    while n and not (t[n - 1].isalnum() or t[n - 1] in _MEANT):  # emoji and the like, and blanks among them
        n -= 1
    return (t[:n], False) if n < len(t) else None


def ending(text: str) -> tuple[str, bool]:
    """(the text without decorations at its end, whether one of them is a sign of a cut).

    Decorations are ellipses, bracketed forms of "more", invitations to read on after a stop, links, asides in parentheses, symbols, and tags or character
    references, whole or broken off. Linear in the text for each decoration taken off.
    """
    sign = False
    t = text.rstrip()
    lo = t.rfind("<")
    if lo >= 0 and ">" not in t[lo:] and (lo == len(t) - 1 or t[lo + 1] in "/!" or (t[lo + 1].isascii() and t[lo + 1].isalpha())):
        t, sign = t[:lo].rstrip(), True
    m = _OPEN_REFERENCE.search(t, max(0, len(t) - 10))
    if m:
        t, sign = t[: m.start()].rstrip(), True
    t = clean(t).rstrip()
    while t and (shorter := _undecorated(t)):
        t, sign = shorter[0].rstrip(), sign or shorter[1]
    return t, sign


class _Tokens(dict):
    """By raw token: (mask, word, whether it stops, core, hash of the token itself). Bounded."""

    def __missing__(self, raw: str) -> tuple[int, int, bool, str, int]:
        ends = stops(raw) and not _ABBREVIATION.match(raw.strip(_QUOTES))
        core = raw.strip(_QUOTES).rstrip(".,;:!?…").strip(_QUOTES)
        if raw.endswith(("…", "...")):
            ends = False
        digits = _DIGITS.search(core)
        if digits:
            first = True

            def run(m: re.Match) -> str:
                nonlocal first
                out, first = "0" if first else "0" * len(m.group()), False
                return out

            # The written form of a number is its word: "$64,0" is none where "$0,000" is.
            core = mask = _DIGITS.sub(run, core)
        else:
            mask = "X" if core[:1].isupper() else core.lower()
        h = lambda s: xxhash.xxh64_intdigest(s)
        out = (h("m:" + mask), h("w:" + core) if core else 0, ends, core, h(raw))
        if len(self) > 500_000:
            self.clear()
        self[raw] = out
        return out


_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _P[0]
    return x ^ (x >> np.uint64(29))


def _contexts(masks: np.ndarray, place: np.ndarray) -> dict[str, np.ndarray]:
    """Keys of every word position: hashes of its sentence so far, and of its last four, two and one words.
    `place` is the position in the sentence; words before its start count as nothing."""
    n = len(masks)
    back = [np.where(place >= k, np.concatenate([np.zeros(k, np.uint64), masks[: n - k]]) if k <= n else np.uint64(0), np.uint64(0)) for k in range(4)]
    terms = _mix(masks + place.astype(np.uint64) * _P[1])
    total = np.cumsum(terms)
    start = np.arange(n) - place
    full = total - np.where(start > 0, total[start - 1], np.uint64(0))
    two = _mix(back[0] * _P[1] + back[1] * _P[2])
    return {
        "full": _mix(full ^ _P[4]),
        "four": _mix(two * _P[3] + _mix(back[2] * _P[1] + back[3] * _P[2]) + np.uint64(4)),
        "two": _mix(two + np.uint64(2)),
        "one": _mix(back[0] * _P[3] + np.uint64(1)),
    }


def _values(raw: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text up to and without, and up to and with, every word position."""
    n, sizes = len(raw), np.array(lengths)
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    total = np.cumsum(_mix(raw + (np.arange(n) - start).astype(np.uint64) * _P[2]))
    before = np.concatenate([np.zeros(1, np.uint64), total[:-1]])
    base = before[start]
    return _mix((before - base) ^ _P[3]), _mix((total - base) ^ _P[3])


def _places(ends: list[bool]) -> np.ndarray:
    out, k = np.zeros(len(ends), np.int64), 0
    for i, s in enumerate(ends):
        out[i] = k
        k = 0 if s else k + 1
    return out


def _stem_key(prefix: str) -> int:
    return xxhash.xxh64_intdigest("s:" + prefix)


def _with_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, list[str], bool, int]]]:
    """(text, words, whole, words that it begins with like its neighbours in the order) of sorted rows, batch by batch.
    The first and the last row of a partition have neighbours elsewhere: all their words count."""
    text, raws, whole, back = None, None, None, None
    for batch in batches:
        out = []
        for t, is_whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ws = clean(t).split()
            if not ws:
                continue
            if raws is None:
                text, raws, whole, back = t, ws, is_whole, len(ws)
                continue
            shared = 0
            for x, y in zip(raws, ws, strict=False):
                if x != y:
                    break
                shared += 1
            out.append((text, raws, whole, max(back, shared)))
            text, raws, whole, back = t, ws, is_whole, shared
        yield out
    if raws is not None:
        yield [(text, raws, whole, len(raws))]


def evidence(texts: DataFrame) -> DataFrame:
    """(key, went_on, ended, trailed) over all texts (columns text, whole): how often each hashed context went on,
    ended its sentence, or trailed off at the end of a text. The end of a text without a stop speaks only if `whole`
    is true (a headline). Counts are combined inside each batch before anything is shuffled.

    The texts (distinct ones) are sorted, so those with a common beginning stand side by side: only the prefixes that a
    text shares with a neighbour go into the join of values, as nobody can ask for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, known = _Tokens(), set()
        for some in _with_neighbours(batches):
            infos, lengths, flags, places, stems, spoken = [], [], [], [], [], []
            if len(known) > 500_000:
                known.clear()
            for text, raws, is_whole, shared in some:
                info = [memory[r] for r in raws]
                ends = [i[2] for i in info]
                flag = [2 if e else 1 for e in ends]  # 1 went on, 2 ended, 3 trailed off, 0 says nothing
                if not ends[-1]:
                    flag[-1] = 2 if is_whole else 3 if raws[-1].endswith(("…", "...")) and len(raws[-1]) > 3 else 0
                infos += info
                lengths.append(len(info))
                # Words that are known to be whole tell how the text before them goes on; decorations and a last word
                # without a stop do not, so a text never speaks for itself.
                said = len(ending(text)[0].split())
                said = len(info) if flag[-1] == 2 else said if said and info[said - 1][2] else said - 1
                said = min(said, shared + 2)  # longer prefixes are its own; a decoration may hide that one more is shared
                spoken += [0 < k < said for k in range(len(info))]
                flags += flag
                places.append(_places(ends))
                for i in info[: len(info) - (flag[-1] != 2)]:
                    core = i[3]
                    if i[1] and core not in known:
                        known.add(core)
                        stems += [_stem_key(core[:k]) for k in range(1, min(len(core), 32))]
            if not infos:
                continue
            f, sizes = np.array(flags, np.int8), np.array(lengths)
            masks, word, raw = (np.fromiter((i[k] for i in infos), np.uint64, len(infos)) for k in (0, 1, 4))
            lasts = np.cumsum(sizes) - 1
            word[lasts[f[lasts] != 2]] = 0
            w = word[word != 0]
            before, upto = _values(raw, lengths)
            before, upto = before[np.array(spoken)], upto[lasts[f[lasts] == 2]]
            all_keys = np.concatenate([*_contexts(masks, np.concatenate(places)).values(), w, np.array(stems, np.uint64), before, upto])
            all_flags = np.concatenate([f, f, f, f, np.ones(len(w) + len(stems) + len(before), np.int8), np.full(len(upto), 2, np.int8)])
            told = all_flags > 0
            u, inverse = np.unique(all_keys[told], return_inverse=True)
            counts = [np.bincount(inverse[all_flags[told] == k], minlength=len(u)) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), *[pa.array(c) for c in counts]], names=["key", "a", "b", "c"])

    ordered = texts.select("text", "whole").repartitionByRange("text", "whole").sortWithinPartitions("text", "whole")
    seen = ordered.mapInArrow(run, "key bigint, a bigint, b bigint, c bigint")
    return seen.groupBy("key").agg(F.sum("a").alias("went_on"), F.sum("b").alias("ended"), F.sum("c").alias("trailed"))


def candidates(rows: DataFrame) -> DataFrame:
    """(tbl, id, sign, dangling, kind, key) for each of `rows` (tbl, id, text, title) that doesn't end like a whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Tokens()
        for batch in batches:
            asked, infos, lengths, places = [], [], [], []
            for k, (text, title) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if not text or text == title:
                    continue
                tail, sign = ending(text)
                raws = tail.split()
                if not raws:
                    continue
                last = raws[-1]
                if stops(last) and not _ABBREVIATION.match(last.strip(_QUOTES)) and not _SHORT_NUMBER.search(last):
                    continue
                info = [memory[r] for r in raws]
                infos += info
                lengths.append(len(info))
                places.append(_places([i[2] for i in info[:-1]] + [False]))
                asked.append((k, sign, tail[-1] in _DANGLING, _stem_key(info[-1][3]) if info[-1][1] else 0))
            if not asked:
                continue
            masks, word, raw = (np.fromiter((i[k] for i in infos), np.uint64, len(infos)) for k in (0, 1, 4))
            lasts = np.cumsum(lengths) - 1
            before, upto = (v[lasts] for v in _values(raw, lengths))
            rows_, sign, dangling, stem = zip(*asked, strict=True)
            keys = [*(v[lasts] for v in _contexts(masks, np.concatenate(places)).values()), word[lasts], np.array(stem, np.uint64), upto, before]
            keep = np.concatenate([np.ones(4 * len(asked), bool), word[lasts] != 0, word[lasts] != 0, np.ones(len(asked), bool), np.array(lengths) > 1])
            at = np.tile(np.array(rows_), len(KINDS))[keep]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.tile(np.array(sign), len(KINDS))[keep]), pa.array(np.tile(np.array(dangling), len(KINDS))[keep]),
                    pa.array(np.repeat(np.arange(len(KINDS), dtype=np.int32), len(asked))[keep]), pa.array(np.concatenate(keys).view(np.int64)[keep]),
                ],
                names=["tbl", "id", "sign", "dangling", "kind", "key"],
            )

    return rows.select("tbl", "id", "text", "title").mapInArrow(run, "tbl string, id bigint, sign boolean, dangling boolean, kind int, key bigint")


def _decided() -> tuple[Column, Column]:
    """(whether the text was cut, the rule that decided), over the evidence for one text. The join of whole values comes
    first, then that of sentences, the longest context that was seen often enough; a sign tips a tie."""
    on, end, trail = (lambda k, c=c: F.coalesce(F.max(F.when(F.col("kind") == k, F.col(c))), F.lit(0)) for c in ("went_on", "ended", "trailed"))
    has_word = F.max(F.when(F.col("kind") == 4, 1)).isNotNull()
    sign = F.max("sign")
    broken = has_word & (on(4) == 0) & (on(5) > 0)
    rules = [
        ("mark", F.max("dangling"), F.lit(True)),
        ("value", on(6) > end(6), F.lit(True)),
        ("value, inside a word", broken & (on(7) > 0), F.lit(True)),
        # Texts that trail off alike again and again are a way to end (a teaser); one of them may be this text.
        ("teaser", (on(0) == 0) & (trail(0) >= TEASER), F.lit(False)),
        ("inside a word", broken, F.lit(True)),
    ]
    for k in range(4):
        ended = end(k) + (F.greatest(trail(k) - 1, F.lit(0)) if k == 0 else F.lit(0))
        rules.append((f"sentence, {KINDS[k]}", on(k) + ended >= SUPPORT, (on(k) > ended) | (sign & (on(k) == ended))))
    cut, rule = sign, F.lit("sign")
    for name, holds, verdict in reversed(rules):
        cut, rule = F.when(holds, verdict).otherwise(cut), F.when(holds, name).otherwise(rule)
    return cut, rule


def cut_texts(rows: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(tbl, id, rule) of the rows (tbl, id, text, title) whose text was cut, with the rule that decided it.

    `others` (text, whole) adds texts to learn from. Shuffles: the distinct texts, the hashed contexts after partial
    aggregation, and the contexts of texts that may be cut; a context shared by very many rows (a third of them
    may end alike) is split by the engine's skew join, as the evidence has one row a key. Defined cases: null, empty
    and blank texts and texts equal to their title are no case; repeated rows are judged alike.
    """
    texts = rows.where("text is not null").select("text", F.lit(False).alias("whole"))
    heads = rows.where("title is not null").select(F.col("title").alias("text"), F.lit(True).alias("whole"))
    corpus = texts.unionByName(heads)
    if others is not None:
        corpus = corpus.unionByName(others.select("text", "whole"))
    known = evidence(corpus.distinct())
    asked = candidates(rows)
    cut, rule = _decided()
    judged = asked.join(known, "key", "left").groupBy("tbl", "id").agg(cut.alias("cut"), rule.alias("rule"))
    return judged.where("cut").select("tbl", "id", "rule")
