"""Token ids of many texts, with one call to the tokenizers library for each distinct pre-token.

A byte-level BPE tokenizer first cuts a text into pre-tokens and then merges inside each one, so
the ids of a text are the ids of its pre-tokens in a row. The cuts are found here with array
operations; the ids always come from the library. Texts with characters whose class can differ
between Unicode versions, or with one of the tokenizer's added tokens, go to the library as they are.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from itertools import chain

import numpy as np

SPACE, LETTER, NUMBER, OTHER, UNSURE = 0, 1, 2, 3, 4
#: Characters that one array pass handles; longer texts are cut between a letter and a space.
CHUNK = 1_000_000
#: Threads of the library in one task, where it runs many.
THREADS = 2
#: New pre-tokens that go to the library as one text.
TOGETHER = 200
#: Pre-tokens kept by a worker before it starts afresh.
KEPT = 1_000_000
SAFE_CUT = re.compile(r"[A-Za-z](?= )")
MULTIPLIER = 0x9E3779B97F4A7C15 | 1


@functools.cache
def classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))
        if kind[0] in "LN":
            out[cp] = LETTER if kind[0] == "L" else NUMBER
        elif kind in ("Cn", "Cs") or 0x1C <= cp <= 0x1F:
            out[cp] = UNSURE
    # fixed values: the code points with the White_Space property
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


@functools.cache
def powers(inverse: bool) -> np.ndarray:
    base = pow(MULTIPLIER, -1, 1 << 64) if inverse else MULTIPLIER
    out = np.empty(2 * CHUNK, np.uint64)
    out[0] = 1
    n = 1
    while n < len(out):
        step = min(n, len(out) - n)
        out[n : n + step] = out[:step] * np.uint64(pow(base, n, 1 << 64))
        n += step
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix, so that near values have unlike hashes."""
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(29)
    return x


@functools.cache
def marks() -> np.ndarray:
    """A 64-bit number for each code point."""
    return mixed(np.arange(1, 0x110001, dtype=np.uint64))


def span_hashes(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of cps[s:e] for each span, all at once."""
    sums = np.zeros(len(cps) + 1, np.uint64)
    np.take(marks(), cps, out=sums[1:], mode="clip")
    sums[1:] *= powers(False)[: len(cps)]
    np.cumsum(sums, out=sums)
    return mixed((sums[ends] - sums[starts]) * powers(True)[starts] + (ends - starts).astype(np.uint64))


def different(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different hashes in order, a place of each, and which of them each one is; np.unique's stable sort takes longer."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.ones(len(hashes), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    inverse = np.empty(len(hashes), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ordered[new], order[new], inverse


def contractions(cps: np.ndarray, cls: np.ndarray, new: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a letter follows an apostrophe that takes one or two letters with it, and how many it takes."""
    at = np.flatnonzero((cps[:-1] == 39) & starts[:-1] & new[1:] & (cls[1:] == LETTER)) + 1
    a, b = cps[at], np.zeros(len(at), np.uint32)
    more = at + 1 < len(cps)
    more[more] = ~new[at[more] + 1]
    b[more] = cps[at[more] + 1]
    # fixed values: the endings that the tokenizer's pattern keeps with the apostrophe
    n = np.where(np.isin(a, [ord(c) for c in "stmd"]), 1, 0)
    for x, y in ("re", "ve", "ll"):
        n[(a == ord(x)) & (b == ord(y))] = 2
    return at[n > 0], n[n > 0]


def gpt_starts(cps: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts laid end to end; text_at has the texts' starts."""
    cls = classes()[cps]
    first = np.zeros(len(cps), bool)
    first[text_at] = True
    new = first.copy()
    new[1:] |= cls[1:] != cls[:-1]
    starts = new.copy()
    # a run of white space before a word gives up its last character: to the word if it is a blank
    space = cls == SPACE
    gives = space[:-1] & ~(space[1:] | first[1:])
    starts[:-1] |= gives
    starts[1:] &= ~(gives & (cps[:-1] == 32))
    at, n = contractions(cps, cls, new & ~first, starts)
    starts[at] = False
    at = at + n
    at = at[at < len(cps)]
    starts[at] |= ~new[at]
    return np.flatnonzero(starts)


def unsure(text: str) -> bool:
    if text.isascii():
        return any(c in text for c in "\x1c\x1d\x1e\x1f")
    return bool((classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)] == UNSURE).any())


def byte_level_joins(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = (cps[starts] == 32) & (ends - starts > 1)
    out[out] = classes()[cps[starts[out] + 1]] != SPACE
    return out


def blank_leads(tok) -> np.ndarray:
    """By id, whether a token begins with a blank: of the tokens of a part that joins, the first one alone does."""
    vocab = tok.get_vocab()
    out = np.zeros(max(vocab.values(), default=0) + 1, bool)
    # fixed values: the letter that stands for a blank in byte-level vocabularies
    out[[k for t, k in vocab.items() if t.startswith("Ġ")]] = True
    return out


def laid_end_to_end(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    n = ends - starts
    return cps[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes().decode("utf-32-le")


class SpanEncoder:
    """encode(texts): ids of all texts in a row, and how many each has. A null counts as an empty text.

    starts(code points, texts' starts) gives the starts of the parts that the tokenizer handles by
    themselves; joins(code points, parts' starts, ends) tells those that part again when they are laid
    end to end; whole(text) tells texts that must go to the library as they are.
    """

    def __init__(self, tok, starts=gpt_starts, joins=byte_level_joins, whole=None):
        self.tok, self.starts, self.joins, self.whole = tok, starts, joins, whole
        self.leads = blank_leads(tok) if joins is byte_level_joins else None
        self.clear()

    def clear(self) -> None:
        # hashes of known pre-tokens and their rows (-1: free), each at the place of its first bits or at the next free one
        self.keys, self.row = np.zeros(1 << 15, np.uint64), np.full(1 << 15, -1, np.int32)
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0
        self.at, self.rows = np.zeros(1 << 14, np.int64), 0  # a row's ids in the pool end where the next row's begin

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The rows of known hashes, -1 for others."""
        place = self._places(hashes)
        rows = self.row[place]
        other = np.flatnonzero(self.keys[place] != hashes)
        place = place[other]
        while len(other):
            taken = rows[other] >= 0
            other, place = other[taken], (place[taken] + 1) % len(self.keys)
            rows[other] = self.row[place]
            differs = self.keys[place] != hashes[other]
            other, place = other[differs], place[differs]
        return rows

    def _learn(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        """Put in new hashes, which all differ; at most half of the places are taken."""
        if 2 * self.rows > len(self.keys):
            old = self.row >= 0
            hashes, rows = np.concatenate([self.keys[old], hashes]), np.concatenate([self.row[old], rows])
            size = 1 << (2 * self.rows).bit_length()
            self.keys, self.row = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        place = self._places(hashes)
        while len(rows):
            free = self.row[place] < 0
            self.row[place[free]] = rows[free]
            # of several that want one place, one gets it
            stays = self.row[place] == rows
            self.keys[place[stays]] = hashes[stays]
            hashes, rows, place = hashes[~stays], rows[~stays], (place[~stays] + 1) % len(self.keys)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _keep(self, ids: np.ndarray, counts: np.ndarray) -> None:
        while self.rows + len(counts) >= len(self.at):
            self.at = np.resize(self.at, 2 * len(self.at))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[self.rows + 1 : self.rows + 1 + len(counts)] = self.used + np.cumsum(counts)
        self.used += len(ids)
        self.rows += len(counts)

    def _add(self, joined: str, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encode new pre-tokens; the order in which they got their rows. Those that begin with a
        blank part again at the blanks, so many go to the library as one text."""
        joins = self.joins(cps, starts, ends)
        apart, rest = np.flatnonzero(joins), np.flatnonzero(~joins)
        runs = [apart[k : k + TOGETHER] for k in range(0, len(apart), TOGETHER)]
        # the quicker call tells no words; a token with a blank in front does
        encode = self.tok.encode_batch if self.leads is None else self.tok.encode_batch_fast
        parts, sizes = [], []
        for run, e in zip(runs, encode([laid_end_to_end(cps, starts[r], ends[r]) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            word = np.array(e.word_ids, np.int64) if self.leads is None else np.cumsum(self.leads[ids]) - 1
            if word[0] != 0 or word[-1] != len(run) - 1:
                raise ValueError("pre-tokens laid end to end don't part again")
            parts.append(ids)
            sizes.append(np.bincount(word, minlength=len(run)))
        if runs:
            self._keep(np.concatenate(parts), np.concatenate(sizes))
        each = [e.ids for e in self.tok.encode_batch_fast([joined[a:b] for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)], add_special_tokens=False)]
        counts = np.fromiter(map(len, each), np.int64, len(each))
        self._keep(np.fromiter(chain.from_iterable(each), np.uint32, int(counts.sum())), counts)
        return np.concatenate([apart, rest])

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.rows > KEPT:
            self.clear()
        joined = "".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        text_at = np.concatenate([[0], np.cumsum(sizes)])
        counts = np.zeros(len(texts), np.int64)
        if not joined:
            return np.empty(0, np.uint32), counts
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = self.starts(cps, np.unique(text_at[:-1][sizes > 0]))
        ends = np.append(starts[1:], len(cps))
        hashes = span_hashes(cps, starts, ends)
        rows = self._find(hashes)
        if (miss := np.flatnonzero(rows < 0)).size:
            new, first, inverse = different(hashes[miss])
            at, base = miss[first], self.rows
            order, added = self._add(joined, cps, starts[at], ends[at]), np.empty(len(new), np.int32)
            added[order] = np.arange(base, self.rows)
            self._learn(new, added)
            rows[miss] = added[inverse]
        at = self.at[rows]
        n = self.at[rows + 1] - at
        after = np.cumsum(n)
        place = np.repeat(at - (after - n), n)
        place += np.arange(len(place))
        ids = self.pool[place]
        total = np.concatenate([[0], after])
        cut_at = total[np.searchsorted(starts, text_at)]
        return ids, np.diff(cut_at)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        parts: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        owner: list[int] = []
        held: list[str] = []
        size = 0

        def flush() -> None:
            nonlocal owner, held, size
            if held:
                ids, n = self._chunk(held)
                parts.append(ids)
                np.add.at(counts, np.array(owner), n)
                owner, held, size = [], [], 0

        for i, text in enumerate(texts):
            if not text:
                continue
            if self.whole and self.whole(text):
                flush()
                parts.append(ids := self._whole(text))
                counts[i] = len(ids)
                continue
            at = 0
            while len(text) - at > CHUNK and (m := SAFE_CUT.search(text, at + CHUNK - 1)) and m.end() < len(text) and m.end() - at < 2 * CHUNK:
                flush()
                owner, held = [i], [text[at : m.end()]]
                at = m.end()
                flush()
            rest = text[at:]
            if len(rest) > 2 * CHUNK - 1:  # no blank far and wide
                flush()
                parts.append(ids := self._whole(rest))
                counts[i] += len(ids)
                continue
            if size + len(rest) > CHUNK:
                flush()
            owner.append(i)
            held.append(rest)
            size += len(rest)
        flush()
        return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), counts


@functools.cache
def encoder(path: str) -> SpanEncoder:
    """One encoder for each worker process; it lives as long as the worker."""
    from tokenizers import Tokenizer

    # every core has a task of its own, and threads that wait for work take CPU time
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tok = Tokenizer.from_file(path)
    added = [t.content for t in tok.get_added_tokens_decoder().values()]
    return SpanEncoder(tok, whole=lambda text: any(a in text for a in added) or unsure(text))
