"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

Words are runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage
return. A document fails the base rules if it has under MIN_WORDS words or if over half of them lie in
3-word windows that the text holds twice or more. Of the others, those stay whose content lines, as
decoded by Viterbi, hold at least MIN_CONTENT of the words.

Fitting takes a bounded sample of TRAIN_DOCS labelled documents, none longer than TRAIN_CHARS: lines
of good documents count as content, lines of bad ones as boilerplate. Scoring reads every
whole text; a very long one is decoded as one chain. Null and empty texts have no words and fail. If there are no labels,
or labels of one kind only, all lines are content. Null and unknown labels don't count. Repeated rows get equal answers. An empty
table gives no rows. Only the named columns are read, so others can have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.llm.pretokens import mixed, powers
from siteledger.llm.shared import annotated

MIN_WORDS, MIN_CONTENT = 50, 0.5
TRAIN_DOCS, TRAIN_CHARS, STEPS = 1500, 20_000, 80
#: Bytes of text that one array pass takes; a longer text is a pass of its own.
CHUNK = 400_000
#: Chains of like length that are decoded one by one.
FEW_CHAINS = 8
SYMBOLS = b"#*$%&|<>"
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
KINDS = {
    "symbol": np.isin(np.arange(256), list(SYMBOLS)), "upper": np.isin(np.arange(256), list(range(65, 91))), "lower": np.isin(np.arange(256), list(range(97, 123))),
    "digit": np.isin(np.arange(256), list(range(48, 58))), "mark": np.isin(np.arange(256), list(b"!?.,;:")), "start": (np.arange(256) & 0xC0) != 0x80,
}
#: Steps of the ratios that become features of a line.
STEPS_OF_RATIO = (0.005, 0.03, 0.1, 0.3, 0.6)
N_FEATURES = 2 + 4 + 6 * len(STEPS_OF_RATIO)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[s:e] for each span; data can be of any length."""
    sums = np.zeros(len(data) + 1, np.uint64)
    up, down = power_of(len(data) + 1)
    np.cumsum(mixed(data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def power_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(False), powers(True)
    while len(up) < n:
        up = np.concatenate([up, up * up[-1] * up[1]])
        down = np.concatenate([down, down * down[-1] * down[1]])
    return up, down


def inner(n: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of len(n) groups of n items."""
    after = np.cumsum(n)
    return np.arange(after[-1] if len(n) else 0) - np.repeat(after - n, n)


def twice(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key comes twice or more, and whether it comes after an equal one."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order][1:] == keys[order][:-1]
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order] = same
    any_[order] = same | np.append(same[1:], False)
    return any_, later


@dataclass
class Measured:
    """Counts of each text, and the lines that have a word: their text, words and features."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_text: np.ndarray
    line_words: np.ndarray
    features: np.ndarray


def measure(texts: list[bytes]) -> Measured:
    n = len(texts)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    text_end = np.cumsum([len(t) + 1 for t in texts])
    white = WHITE[data]
    edge = np.flatnonzero(np.diff(white, prepend=True))
    word_at, word_end = edge[::2], edge[1::2]
    word_text = np.searchsorted(text_end, word_at, "right")
    line_end = np.flatnonzero(data == 10)
    line_at = np.append(0, line_end[:-1] + 1)
    word_line = np.searchsorted(line_end, word_at)
    # words in repeated windows
    h = hashes(data, word_at, word_end)
    covered = np.zeros(len(h) + 2, bool)
    if len(h) >= 3:
        whole = word_text[:-2] == word_text[2:]
        key = mixed(mixed(h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:] + word_text[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = np.flatnonzero(whole)
        hit = at[twice(key[at])[0]]
        for k in range(3):
            covered[hit + k] = True
    covered = covered[: len(h)]
    per_line = np.bincount(word_line, minlength=len(line_end))
    full = np.flatnonzero(per_line)
    at, end = line_at[full], line_end[full]
    line_text = np.searchsorted(text_end, at, "right")
    any_dup, dup = twice(hashes(data, at, end) + line_text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def sums(flags: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[b] - total[a]

    ink = sums(KINDS["start"][data] & ~white, at, end)
    counts = {k: sums(KINDS[k][data], at, end) for k in ("symbol", "upper", "lower", "digit", "mark")}
    words = per_line[full]
    again = np.bincount(word_line, covered, len(line_end))[full]
    letters = np.maximum(counts["upper"] + counts["lower"], 1)
    ratios = [counts["symbol"] / ink, counts["upper"] / letters, counts["digit"] / ink, counts["mark"] / ink, again / words, counts["symbol"] / words]
    features = [np.ones(len(full)), any_dup, words < 3, words < 10, words > 60, ink / words > 9]
    features += [r > s for r in ratios for s in STEPS_OF_RATIO]
    return Measured(
        np.bincount(word_text, minlength=n), np.bincount(line_text, ink, n).astype(np.int64), np.bincount(line_text, counts["symbol"], n).astype(np.int64),
        np.bincount(line_text, dup, n).astype(np.int64), np.bincount(word_text, covered, n).astype(np.int64), line_text, words, np.stack(features, 1).astype(np.float64),
    )


@dataclass
class Field:
    """Weights of a chain with two labels (0 boilerplate, 1 content): of features for label 1, of steps, of the first label."""

    weights: np.ndarray
    step: np.ndarray
    first: np.ndarray


def padded(features: np.ndarray, line_text: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of label 1, time by chain, chains with the most lines first; the lines' places; chain lengths."""
    chains, n = np.unique(line_text, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = np.stack([inner(n), np.repeat(rank, n)])
    scores = np.zeros((int(n.max()), len(n)))
    scores[place[0], place[1]] = features @ weights
    return scores, place, n[order]


def viterbi(field: Field, features: np.ndarray, line_text: np.ndarray) -> np.ndarray:
    """The best label of each line. Ties go to content.

    Chains of like length (within a factor of two) run side by side, so the grid has at most twice as many cells as lines.
    """
    out = np.zeros(len(line_text), np.int64)
    n = np.bincount(line_text)[line_text] if len(line_text) else np.empty(0, np.int64)
    size = np.frexp(n)[1]
    for s in np.unique(size):
        mine = np.flatnonzero(size == s)
        edges = np.flatnonzero(np.diff(line_text[mine], prepend=-1, append=-2))
        if len(edges) > FEW_CHAINS:
            out[mine] = alike(field, features[mine], line_text[mine])
            continue
        scores = features[mine] @ field.weights
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            out[mine[a:b]] = alone(field, scores[a:b].tolist())
    return out


def alone(field: Field, scores: list[float]) -> list[int]:
    """Viterbi decoding of one chain, whose lines are in a row."""
    (s00, s01), (s10, s11) = field.step.tolist()
    a, b = float(field.first[0]), float(field.first[1]) + scores[0]
    turns = []
    for x in scores[1:]:
        to_a, to_b = b + s10 >= a + s00, b + s11 >= a + s01
        turns.append((to_a, to_b))
        a, b = b + s10 if to_a else a + s00, (b + s11 if to_b else a + s01) + x
    now = int(b >= a)
    out = [now]
    for turn in reversed(turns):
        now = int(turn[now])
        out.append(now)
    return out[::-1]


def alike(field: Field, features: np.ndarray, line_text: np.ndarray) -> np.ndarray:
    """Viterbi decoding of chains side by side."""
    scores, place, n = padded(features, line_text, field.weights)
    best = np.stack([np.full(len(n), field.first[0]), field.first[1] + scores[0]])
    back = np.zeros((len(scores), 2, len(n)), np.int8)
    for t in range(1, len(scores)):
        m = int(np.searchsorted(-n, -t))  # chains longer than t
        stay, turn = best[None, 0, :m] + field.step[0, :, None], best[None, 1, :m] + field.step[1, :, None]
        back[t, :, :m] = turn >= stay
        best[:, :m] = np.maximum(stay, turn)
        best[1, :m] += scores[t, :m]
    label = np.zeros(scores.shape, np.int8)
    now = (best[1] >= best[0]).astype(np.int8)
    for t in range(len(scores) - 1, -1, -1):
        m = int(np.searchsorted(-n, -t))
        label[t, :m] = now[:m]
        if t:
            now[:m] = back[t, now[:m], np.arange(m)]
    return label[place[0], place[1]].astype(np.int64)


def marginals(field: Field, scores: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(label 1) by time and chain, and expected counts of steps, by forward and backward sums."""
    size = scores.shape
    forward, backward = np.zeros((*size, 2)), np.zeros((*size, 2))
    forward[0] = np.stack([np.full(size[1], field.first[0]), field.first[1] + scores[0]], 1)
    for t in range(1, size[0]):
        m = int(np.searchsorted(-n, -t))
        forward[t, :m] = np.logaddexp(forward[t - 1, :m, None, 0] + field.step[0], forward[t - 1, :m, None, 1] + field.step[1])
        forward[t, :m, 1] += scores[t, :m]
    for t in range(size[0] - 2, -1, -1):
        m = int(np.searchsorted(-n, -(t + 1)))
        nxt = backward[t + 1, :m].copy()
        nxt[:, 1] += scores[t + 1, :m]
        backward[t, :m] = np.logaddexp(nxt[:, :1] + field.step[:, 0], nxt[:, 1:] + field.step[:, 1])
    total = np.logaddexp(*(forward[0] + backward[0]).T)
    p = np.exp(forward[..., 1] + backward[..., 1] - total)
    steps = np.zeros((2, 2))
    for t in range(1, size[0]):
        m = int(np.searchsorted(-n, -t))
        for a in (0, 1):
            for b in (0, 1):
                steps[a, b] += np.exp(forward[t - 1, :m, a] + field.step[a, b] + (scores[t, :m] if b else 0) + backward[t, :m, b] - total[:m]).sum()
    return p, steps


def fit(rows: list[tuple[str, int]]) -> Field | None:
    """rows: (text, 1 for good or 0 for bad). Likelihood with a small ridge, by Adam from zero."""
    rows = [(t.encode(), q) for t, q in rows if t]
    if len({q for _, q in rows}) < 2:
        return None
    m = measure([t for t, _ in rows])
    good = np.array([q for _, q in rows])[m.line_text].astype(np.float64)
    field = Field(np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros(2))
    _, place, n = padded(m.features, m.line_text, field.weights)
    grid = np.full((int(n.max()), len(n)), -1)
    grid[place[0], place[1]] = good
    seen = np.array([[((grid[:-1] == a) & (grid[1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    started = np.array([(grid[0] == y).sum() for y in (0, 1)], float)
    theta, mean, var = np.zeros(N_FEATURES + 6), np.zeros(N_FEATURES + 6), np.zeros(N_FEATURES + 6)
    for k in range(1, STEPS + 1):
        field = Field(theta[:N_FEATURES], theta[N_FEATURES : N_FEATURES + 4].reshape(2, 2), theta[N_FEATURES + 4 :])
        scores, place, n = padded(m.features, m.line_text, field.weights)
        p, steps = marginals(field, scores, n)
        gap = good - p[place[0], place[1]]
        slope = np.concatenate([m.features.T @ gap, (seen - steps).ravel(), started - np.array([(1 - p[0]).sum(), p[0].sum()])]) / len(good) - 1e-3 * theta
        mean, var = 0.9 * mean + 0.1 * slope, 0.99 * var + 0.01 * slope**2
        theta = theta + 0.15 * (mean / (1 - 0.9**k)) / (np.sqrt(var / (1 - 0.99**k)) + 1e-8)
    return Field(theta[:N_FEATURES], theta[N_FEATURES : N_FEATURES + 4].reshape(2, 2), theta[N_FEATURES + 4 :])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field | None:
    """Fit on a bounded sample of labelled rows, drawn by the hash of their id."""
    marked = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_id"), "quality")
    n = marked.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64(F.col("_id"), F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    drawn = marked.where(draw < min(1.0, TRAIN_DOCS / n)).limit(2 * TRAIN_DOCS)
    short = docs.where(F.length(text_col) <= TRAIN_CHARS).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # the drawn rows are at most 2 * TRAIN_DOCS
    got = short.join(F.broadcast(drawn), "_id").select("_id", "_text", "quality").collect()
    return fit([(r[1], r[2]) for r in sorted(got, key=lambda r: (r[0], r[1]))])


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def judge(texts: list[bytes], field: Field | None) -> tuple[list[np.ndarray], np.ndarray]:
    m = measure(texts)
    content = viterbi(field, m.features, m.line_text) if field else np.ones(len(m.line_text), np.int64)
    share = np.bincount(m.line_text, m.line_words * content, len(texts)) / np.maximum(m.n_words, 1)
    failed = (m.n_words < MIN_WORDS) | (100 * m.n_repeat_words > 50 * m.n_words)
    return [m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, failed, ~failed & (share >= MIN_CONTENT), share], content


def apply(docs: DataFrame, field: Field | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """row (the kept columns), counts, base_failed, kept and content_share for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # some tens of numbers

    def answer(texts: list[str | None]) -> Iterator[list]:
        blobs = [(t or "").encode() for t in texts]
        at = 0
        while at < len(blobs):
            stop, size = at + 1, len(blobs[at])
            while stop < len(blobs) and size + len(blobs[stop]) <= CHUNK:
                size += len(blobs[stop])
                stop += 1
            yield judge(blobs[at:stop], shared.value)[0]
            at = stop

    return annotated(docs, keep, text_col, answer, COLUMNS)
