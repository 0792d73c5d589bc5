"""Language identification by a string kernel.

The kernel counts the character n-grams (blended, 1 to 4) that two texts share, each once, and
divides by the geometric mean of both texts' own counts. Nystroem features come from landmark texts; a
kernel ridge regression for each language against the rest is fitted on them. As the kernel is linear in
n-gram presence, a text's scores are one product of its presence vector with a matrix over the
landmarks' n-grams, made for many texts at a time. Characters of every script count: one or two stand for
themselves, three or four are hashed to 48 bits.

Fitting takes a bounded sample: TRAIN_ROWS labelled rows shared out evenly over the languages (the
LANGUAGES most frequent values), none longer than TRAIN_CHARS. Prediction reads every whole text. Null texts and texts
without a letter (Unicode category L) get `und` and score 0; so does every text if no labelled row can be
learned from, as in an empty table. Ties go to the language that sorts first. Repeated rows get equal answers. A very
long text is one presence vector. Only the named columns are read; others can have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.llm.pretokens import mixed
from siteledger.llm.shared import annotated

TRAIN_ROWS, TRAIN_CHARS, LANDMARKS, RIDGE, LANGUAGES = 2400, 20_000, 200, 0.05, 500
MAX_N = 4
#: Characters that one array pass takes, and pairs of n-grams and landmarks that one product takes.
CHUNK, PAIRS = 300_000, 500_000
#: Bits of an n-gram's code; the rest of a key numbers the texts of one pass.
BITS = np.uint64(48)
BLANKS = re.compile(r"\s+")


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def plain(text: str) -> str:
    return BLANKS.sub(" ", text).lower()


def presence(cps: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, code) of each text's distinct n-grams; owner rises along the code points."""
    m = len(cps) - n + 1
    if m < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    code = cps[:m].copy()
    for k in range(1, n):
        code = code << np.uint64(21) | cps[k : m + k] if k < 2 else mixed(code * np.uint64(0x110000) + cps[k : m + k])
    if n > 2:
        code >>= np.uint64(16)
    key = owner[:m].astype(np.uint64) << BITS | code
    if n > 1:
        key = key[owner[:m] == owner[n - 1 :]]
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> BITS).astype(np.int64), key & np.uint64((1 << 48) - 1)


def laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    return np.concatenate(parts).astype(np.uint64), np.repeat(np.arange(len(texts)), [len(p) for p in parts])


def passes(sizes: list[int], most: int = 512) -> Iterator[slice]:
    """Runs of texts with about CHUNK characters and at most so many texts."""
    at = size = 0
    for i, n in enumerate(sizes):
        if i > at and (size + n > CHUNK or i - at >= most):
            yield slice(at, i)
            at, size = i, 0
        size += n
    if len(sizes) > at:
        yield slice(at, len(sizes))


@dataclass
class Grams:
    """For each n the sorted codes of the landmarks' n-grams with a row of weights for each."""

    codes: list[np.ndarray]
    weights: list[np.ndarray]

    def products(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's presence vector times the weights, and the text's kernel with itself."""
        out, own = np.zeros((len(texts), self.weights[0].shape[1])), np.zeros(len(texts))
        cps, owner = laid_out(texts)
        for n, (codes, weights) in enumerate(zip(self.codes, self.weights, strict=True), 1):
            who, code = presence(cps, owner, n)
            own += np.bincount(who, minlength=len(texts))
            if not len(codes):
                continue
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = codes[at] == code
            who, at = who[hit], at[hit]
            for c in range(weights.shape[1]):
                out[:, c] += np.bincount(who, weights[at, c], len(texts))
        return out, own


@dataclass
class Landmarks:
    """For each n the sorted codes, and which landmarks hold each: holders[start[k] : start[k + 1]] for code k."""

    own: np.ndarray
    codes: list[np.ndarray]
    starts: list[np.ndarray]
    holders: list[np.ndarray]

    @classmethod
    def of(cls, texts: list[str]) -> Landmarks:
        out = cls(np.zeros(len(texts)), [], [], [])
        cps, owner = laid_out(texts)
        for n in range(1, MAX_N + 1):
            who, code = presence(cps, owner, n)
            out.own += np.bincount(who, minlength=len(texts))
            order = np.argsort(code, kind="stable")
            codes, counts = np.unique(code, return_counts=True)
            out.codes.append(codes)
            out.starts.append(np.concatenate([[0], np.cumsum(counts)]))
            out.holders.append(who[order])
        return out

    def kernel(self, texts: list[str]) -> np.ndarray:
        """The normalised kernel of texts with the landmarks. Shared n-grams are counted in bounded runs."""
        width = len(self.own)
        rows = []
        for part in passes([len(t) for t in texts]):
            held = texts[part]
            shared, own = np.zeros(len(held) * width), np.zeros(len(held))
            cps, owner = laid_out(held)
            for n, (codes, starts, holders) in enumerate(zip(self.codes, self.starts, self.holders, strict=True), 1):
                who, code = presence(cps, owner, n)
                own += np.bincount(who, minlength=len(held))
                if not len(codes):
                    continue
                at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                hit = codes[at] == code
                who, at = who[hit], at[hit]
                many = starts[at + 1] - starts[at]
                after = np.cumsum(many)
                k = 0
                while k < len(at):
                    stop = max(k + 1, int(np.searchsorted(after, after[k] - many[k] + PAIRS)))
                    m, base = many[k:stop], after[k] - many[k]
                    inside = np.arange(m.sum()) - np.repeat(after[k:stop] - m - base, m)
                    shared += np.bincount(np.repeat(who[k:stop], m) * width + holders[np.repeat(starts[at[k:stop]], m) + inside], minlength=len(shared))
                    k = stop
            rows.append(shared.reshape(len(held), width) / np.sqrt(np.maximum(own, 1))[:, None] / np.sqrt(np.maximum(self.own, 1)))
        return np.concatenate(rows)

    def weighted(self, weights: np.ndarray) -> Grams:
        """weights: a row for each landmark. Each n-gram gets the sum over the landmarks that hold it."""
        scaled = weights / np.sqrt(np.maximum(self.own, 1))[:, None]
        of = [np.repeat(np.arange(len(c)), np.diff(s)) for c, s in zip(self.codes, self.starts, strict=True)]
        return Grams(self.codes, [np.stack([np.bincount(o, scaled[h, c], len(k)) for c in range(weights.shape[1])], 1) for o, h, k in zip(of, self.holders, self.codes, strict=True)])


@dataclass
class Model:
    languages: list[str]
    grams: Grams | None
    bias: np.ndarray | None

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        asked = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        for part in passes([len(texts[i]) for i in asked]):
            out, own = self.grams.products([plain(texts[i]) for i in asked[part]])
            out = out / np.sqrt(np.maximum(own, 1))[:, None] + self.bias
            best = out.argmax(1)
            for k, b, s in zip(asked[part], best.tolist(), out[np.arange(len(best)), best].tolist(), strict=True):
                lang[k], score[k] = self.languages[b], min(1.0, max(0.0, (s + 1) / 2))
        return lang, score


def fit(rows: list[tuple[str, str]]) -> Model:
    """rows: (text, language) of the sample. Landmarks are the first rows of each language in turn, long ones before short ones."""
    rows = [(plain(t), c) for t, c in rows if has_letter(t)]
    languages = sorted({c for _, c in rows})
    if not languages:
        return Model([], None, None)
    by = {c: [t for t, k in rows if k == c] for c in languages}
    share = max(1, LANDMARKS // len(languages))
    chosen = [t for c in languages for t in sorted(by[c], key=lambda t: len(t) < 200)[:share]]
    landmarks = Landmarks.of(chosen)
    values, vectors = np.linalg.eigh(landmarks.kernel(chosen))
    big = values > 1e-6 * values[-1]
    root = vectors[:, big] / np.sqrt(values[big])
    features = landmarks.kernel([t for t, _ in rows]) @ root
    mean = features.mean(0)
    target = np.where(np.array([[c == k for k in languages] for _, c in rows]), 1.0, -1.0)
    offset = target.mean(0)
    centred = features - mean
    solved = np.linalg.solve(centred.T @ centred + RIDGE * np.eye(len(mean)), centred.T @ (target - offset))
    return Model(languages, landmarks.weighted(root @ solved), offset - mean @ solved)


def sample(docs: DataFrame, allowed: Column, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """About TRAIN_ROWS labelled rows, the same number for each language where there are as many."""
    rows = docs.where(allowed & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) <= TRAIN_CHARS))
    counts = {r[0]: r["n"] for r in rows.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), lang_col).limit(LANGUAGES).collect()}
    if not counts:
        return []
    share = TRAIN_ROWS / len(counts)
    rates = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, share / n))])
    rate = F.coalesce(F.element_at(rates, F.col(lang_col)), F.lit(0.0))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    got = rows.where(draw < rate).select(draw.alias("d"), F.col(text_col), F.col(lang_col)).orderBy("d", text_col).limit(2 * TRAIN_ROWS).collect()
    return [(r[1], r[2]) for r in got]


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """row (the kept columns), lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks' n-grams: bounded by LANDMARKS * TRAIN_CHARS * MAX_N

    def answer(texts: list[str | None]) -> Iterator[list]:
        for k in range(0, len(texts), 512):
            yield list(shared.value.predict(texts[k : k + 512]))

    return annotated(docs, keep, text_col, answer, "lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    return fit(sample(docs, ~held_out(id_col), id_col, text_col, lang_col))
