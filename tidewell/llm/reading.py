"""Reading level of documents: a linear pairwise ranker over syntax and vocabulary features, calibrated by isotonic
regression.

Vocabulary features are means over the words of a text: function words, word length, derivational endings. Syntax
features are means over its pairs of adjacent words: the kinds of both (determiner, pronoun, preposition, conjunction,
subordinator, connective, auxiliary, adverb, content word), so runs of content words, chains of prepositions and the
openings of clauses count. Neither sees layout, letter case or punctuation, and a fitted score is one number a word and
one a pair, so the corpus is scored in one pass over its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Common English function words, by kind.
KINDS = {
    "determiner": """the a an this that these those each every either neither some any no all both such same other another what which whose my your his its our their mine""",
    "pronoun": """who whom i you he she it we they me him her us them itself themselves one oneself none nothing something anything""",
    "preposition": """of in to for on with at by from into onto upon over under between among through during before after against about within without towards despite except since until till
        per concerning regarding notwithstanding""",
    "conjunction": "and or but nor so yet",
    "subordinator": "because although though while whereas if unless whether as than provided insofar inasmuch when where why how once",
    "connective": """hence thus therefore thereby therein thereof hereby herein hereof whereby wherein whereof moreover furthermore however nevertheless nonetheless conversely consequently
        accordingly otherwise likewise""",
    "auxiliary": """is are was were be been being am do does did done has have had having can could may might must shall should will would ought""",
    "adverb": """not never ever only just even also too very much more most less least rather quite then there here now again still already always often up down out off away back well own""",
}
FUNCTION_WORDS = [w for ws in KINDS.values() for w in ws.split()]

#: Frequent words of other languages that English does not use, to tell a foreign passage.
FOREIGN_WORDS = """
der die das und ist nicht ein eine einen dem den des mit auf für von zu im sich auch nach wurde werden sind als oder aus
bei um am bis durch über zum zur laut mehr wie
el la los las un una unos unas y en que de del por con para se su al lo como más pero sus le ya según tras después este
le les des une et est dans pour qui sur pas plus par avec au aux ce cette sont ont du ne se selon après leur
o os as um uma e em do da dos das não com uma por ao à no na nos nas mais foi que segundo após sua seu
""".split()

#: Endings of derived words.
ENDINGS = ("tion", "sion", "ment", "ness", "ity", "ism", "ance", "ence", "able", "ible", "ical", "ive", "ous", "ize", "izes", "ised", "ized", "ing", "ed", "ly", "al")

LEVELS = ("basic", "intermediate", "advanced")
#: A text's mean counts together with so many words at the mean of the graded samples: a few words say little.
PRIOR_WORDS = 20
#: Prose has at least this share of function words.
PROSE = 1 / 8
BLOCK = 16
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_ASCII_WORD = re.compile(r"[A-Za-z]+(?:'[A-Za-z]+)?")
_FUNCTION = {w: k for k, w in enumerate(dict.fromkeys(FUNCTION_WORDS))}
_FOREIGN = set(FOREIGN_WORDS) - set(FUNCTION_WORDS)
_LENGTHS = (3, 5, 7, 9, 11, 13)
_WORD_FEATURES = len(_FUNCTION) + 1 + 1 + len(_LENGTHS) + len(ENDINGS)
#: Kind of each function word, by number; any other word is of the last kind.
_KIND = {w: k for k, ws in enumerate(KINDS.values()) for w in ws.split()}
_CONTENT = len(KINDS)
N_FEATURES = _WORD_FEATURES + (_CONTENT + 1) ** 2


def tokens(text: str) -> list[str]:
    return (_ASCII_WORD if text.isascii() else _WORD).findall(text.lower())


def word_features(word: str) -> list[tuple[int, float]]:
    """(feature, value) of one word."""
    word = word.replace("’", "'")
    k = _FUNCTION.get(word)
    base = len(_FUNCTION)
    out = [(base + 1, float(min(len(word), 20)))]
    if k is not None:
        return [(k, 1.0), (base, 1.0), *out]
    for j, n in enumerate(_LENGTHS):
        if len(word) >= n:
            out.append((base + 2 + j, 1.0))
    if len(word) > 5:
        for j, e in enumerate(ENDINGS):
            if word.endswith(e):
                out.append((base + 2 + len(_LENGTHS) + j, 1.0))
    return out


def language_of(word: str) -> int:
    """1 English function word, 2 foreign function word, 4 letters outside the Latin script, 0 any other."""
    if word in _FUNCTION:
        return 1
    if word in _FOREIGN:
        return 2
    c = ord(max(word))
    return 4 if c > 0x24F and c not in (0x2019,) else 2 if any(0xC0 <= ord(x) <= 0x24F for x in word) else 0


def english_blocks(flags: np.ndarray) -> np.ndarray:
    """Which words stand in blocks that read as English; a foreign block inside an English text is left out."""
    n = len(flags)
    keep = np.zeros(n, bool)
    for lo in range(0, n, BLOCK):
        hi = n if n - lo < 2 * BLOCK else lo + BLOCK
        f = flags[lo:hi]
        en, other = int((f == 1).sum()), int((f == 2).sum() + (f == 4).sum())
        keep[lo:hi] = other <= en if en else other == 0
        if hi == n:
            break
    return keep


def features(text: str) -> np.ndarray:
    """Mean features of the English part of a text."""
    ws = tokens(text)
    flags = np.fromiter((language_of(w) for w in ws), np.int8, len(ws))
    ws = [w for w, k in zip(ws, english_blocks(flags), strict=True) if k]
    x = np.zeros(N_FEATURES)
    for w in ws:
        for f, v in word_features(w):
            x[f] += v
    x /= max(1, len(ws))
    kinds = np.array([kind_of(w) for w in ws], np.int64)
    x[_WORD_FEATURES:] = np.bincount(kinds[:-1] * (_CONTENT + 1) + kinds[1:], minlength=(_CONTENT + 1) ** 2) / max(1, len(ws) - 1)
    return x


def kind_of(word: str) -> int:
    return _KIND.get(word.replace("’", "'"), _CONTENT)


def fit_ranker(x: np.ndarray, level: np.ndarray, ridge: float = 1.0, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and scale of a linear ranker: logistic loss on the difference of every pair of unlike level."""
    scale = x.std(axis=0) + 1e-4
    z = x / scale
    hi, lo = np.nonzero(level[:, None] > level[None, :])
    d = z[hi] - z[lo]
    w = np.zeros(x.shape[1])
    # Newton steps with a ridge; the problem is convex and small (one column a feature).
    for _ in range(min(steps, 25)):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        gradient = -(d * p[:, None]).sum(axis=0) / len(d) + ridge / 100 * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge / 100 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale, scale


def fit_isotonic(score: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, levels): the non-decreasing step function nearest to the levels, by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, y in zip(score[order], level[order].astype(float), strict=True):
        blocks.append([s, s, y, 1.0])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            _, b, y2, n2 = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [a[0], b, (a[2] * a[3] + y2 * n2) / (a[3] + n2), a[3] + n2]
    xs = [v for a, b, *_ in blocks for v in (a, b)]
    ys = [y for _, _, y, _ in blocks for _ in (0, 1)]
    return np.array(xs), np.array(ys)


class Model:
    """Fitted weights (one number a feature), the calibration from scores to the scale 0 (basic) to 2 (advanced), and the
    mean score of the samples."""

    def __init__(self, weights: np.ndarray, xs: np.ndarray, ys: np.ndarray, mean: float):
        self.weights, self.xs, self.ys, self.mean = weights, xs, ys, mean
        self.pairs = weights[_WORD_FEATURES:]

    def word_score(self, word: str) -> float:
        return float(sum(self.weights[f] * v for f, v in word_features(word)))

    def level(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.xs, self.ys)


def train(samples: list[tuple[str, str]], ridge: float = 1.0) -> Model:
    """Fits on graded texts (text, level). They are a small fixed table; see `grade_documents` for its bound."""
    if len({v for _, v in samples}) < 2:
        raise ValueError("at least two levels are needed to learn from")
    x = np.array([features(t) for t, _ in samples])
    y = np.array([LEVELS.index(v) for _, v in samples])
    w, _ = fit_ranker(x, y, ridge)
    raw, n = x @ w, np.array([len(tokens(t)) for t, _ in samples])
    mean = float(raw.mean())
    return Model(w, *fit_isotonic(shrunk(raw, n, mean), y), mean)


def shrunk(score, n, mean: float):
    """A mean over n words together with PRIOR_WORDS words at `mean`."""
    return (n * score + PRIOR_WORDS * mean) / (n + PRIOR_WORDS)


class _Words(dict):
    """(score, language, kind) by word; bounded."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> tuple[float, int, int]:
        out = (self.model.word_score(word), language_of(word), kind_of(word))
        if len(self) > 500_000:
            self.clear()
        if len(word) <= 40:
            self[word] = out
        return out


class Rating(NamedTuple):
    score: float | None
    error: float | None
    level: float | None
    english: bool | None
    prose: bool | None
    n_words: int
    n_other: int


def rate(model: Model, memory: _Words, text: str | None) -> Rating:
    """Score, its standard error and level of the English part of a text, whatever its length, and beside them whether
    the text is mostly English and whether that part is prose. Nothing where a text has no word, no score where it
    has no English one."""
    ws = tokens(text) if text else []
    if not ws:
        return Rating(None, None, None, None, None, 0, 0)
    known = np.array([memory[w] for w in ws])
    keep = english_blocks(known[:, 1].astype(np.int8))
    n = int(keep.sum())
    if not n:
        return Rating(None, None, None, False, False, 0, len(ws))
    words, kinds = known[keep, 0], known[keep, 2].astype(np.int64)
    mean = float(words.mean())
    if n > 1:
        mean += float(model.pairs[kinds[:-1] * (_CONTENT + 1) + kinds[1:]].mean())
    score = shrunk(mean, n, model.mean)
    error = float(words.std() / n**0.5) if n > 1 else None
    prose = int((known[keep, 1] == 1).sum()) >= PROSE * n
    return Rating(score, error, float(model.level(np.array([score]))[0]), 2 * n >= len(ws), prose, n, len(ws) - n)


#: The graded samples are a training set on the driver; a larger table must be cut to this many rows by the caller.
MOST_SAMPLES = 20_000


def grade_documents(docs: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, error, level, grade, english, prose, n_words, n_other) of every document, whole texts, in one pass
    without a shuffle.

    `level` is on the scale 0 (basic) to 2 (advanced), `error` the standard error of the score. Defined cases: null,
    empty and blank texts, and those without a word in letters, have nulls throughout; texts without an English word
    have no score and are not `english`; lists, code and the like are rated and not `prose`; repeated rows give a row
    each; without two graded levels there is nothing to learn and an error is raised.
    """
    rows = samples.select("text", "level").where("text is not null and level is not null").limit(MOST_SAMPLES + 1).collect()
    if len(rows) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} graded samples")
    model = train([(r.text, r.level) for r in sorted(rows)])
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.xs, model.ys, model.mean))
    id_type = dict(docs.dtypes)[id_col]
    kinds = {"score": pa.float64(), "error": pa.float64(), "level": pa.float64(), "english": pa.bool_(), "prose": pa.bool_(), "n_words": pa.int32(), "n_other": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        memory = _Words(own)
        for batch in batches:
            rated = [rate(own, memory, t) for t in batch.column(1).to_pylist()]
            columns = {k: pa.array([getattr(r, k) for r in rated], t) for k, t in kinds.items()}
            grade = pa.array([None if r.level is None else LEVELS[min(2, int(r.level + 0.5))] for r in rated], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns.values(), grade], names=["id", *columns, "grade"])

    return docs.select(id_col, text_col).mapInArrow(
        run, f"id {id_type}, score double, error double, level double, english boolean, prose boolean, n_words int, n_other int, grade string"
    )
