"""SentencePiece models on the tokenizers library.

The model's protobuf is read field by field. From it come the normaliser (the compiled character map, removal
of extra blanks, the marker for blanks, the marker in front), the pieces with their scores (unigram) or the merges
that the scores imply (BPE), and byte fallback. The result is an ordinary tokenizer of the library.

As no piece holds a marker after another character, a text's parts between markers are independent, and
each distinct part is encoded once by a worker. Parity with the sentencepiece library is verified on
each distinct part too, so it covers every text. A text whose parts don't all agree gets the ids of
the sentencepiece library and parity false. Models without that independence, or with a character map,
go through both libraries text by text.

Null text counts as empty: no ids, round trip and parity true. A text of any length is encoded whole. Repeated rows get equal
results. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import functools
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.llm.pretokens import THREADS, SpanEncoder

MARK = "▁"
# fixed values: kinds of pieces and of models in the format
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview | float]]:
    """Field numbers and values of one protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return out

    while at < len(data):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
        elif wire == 2:
            n = varint()
            yield number, data[at : at + n]
            at += n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            yield number, struct.unpack("<d" if wire == 1 else "<f", data[at : at + n])[0]
            at += n
        else:
            raise ValueError(f"wire type {wire}")


@dataclass
class Proto:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_blanks: bool = True
    escape_blanks: bool = True

    @classmethod
    def read(cls, path: str) -> Proto:
        out = cls()
        # fixed values: field numbers of the format
        for number, value in fields(memoryview(Path(path).read_bytes())):
            if number == 1:
                piece = dict(fields(value))
                out.pieces.append((bytes(piece.get(1, b"")).decode(), float(piece.get(2, 0.0)), int(piece.get(3, NORMAL))))
            elif number == 2:
                trainer = dict(fields(value))
                out.kind, out.byte_fallback = int(trainer.get(3, UNIGRAM)), bool(trainer.get(35, 0))
            elif number == 3:
                spec = dict(fields(value))
                out.charsmap = bytes(spec.get(2, b""))
                out.dummy_prefix, out.remove_blanks, out.escape_blanks = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        return out


def implied_merges(vocab: dict[str, int], pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """All ways to make a piece of two others, by falling score of the piece."""
    found = []
    for k, (piece, score, kind) in enumerate(pieces):
        if kind in (NORMAL, USER):
            found += [(-score, k, vocab[piece[:i]], vocab[piece[i:]]) for i in range(1, len(piece)) if piece[:i] in vocab and piece[i:] in vocab]
    return [(pieces[a][0], pieces[b][0]) for _, _, a, b in sorted(found)]


def rewrites(proto: Proto) -> bool:
    return bool(proto.charsmap) or proto.remove_blanks


def tokenizer(proto: Proto):
    """The library's tokenizer; if the model rewrites no texts, it takes a text with its marker in front already as a blank."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    usable = {p: k for k, (p, _, kind) in enumerate(proto.pieces) if kind in (NORMAL, USER)}
    vocab = {p: k for k, (p, _, _) in enumerate(proto.pieces)}
    unknown = next(k for k, p in enumerate(proto.pieces) if p[2] == UNKNOWN)
    if proto.kind == BPE:
        model = models.BPE(vocab, implied_merges(usable, proto.pieces), unk_token=proto.pieces[unknown][0], byte_fallback=proto.byte_fallback, fuse_unk=True)
    elif proto.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in proto.pieces], unknown, proto.byte_fallback)
    else:
        raise ValueError(f"model type {proto.kind}")
    tok = Tokenizer(model)
    steps = [normalizers.Precompiled(proto.charsmap)] if proto.charsmap else []
    if proto.remove_blanks:
        steps += [normalizers.Replace(Regex(rf"\A +|[ {MARK}]+\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if rewrites(proto) and proto.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    steps += [normalizers.Replace(" ", MARK)] * proto.escape_blanks
    tok.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p in usable):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *[decoders.Strip(" ", 1, 0)] * proto.dummy_prefix])
    return tok


def marker_starts(cps: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    """Parts of texts laid end to end: each begins where a blank or marker follows something else; line ends stand alone."""
    blank = (cps == 32) | (cps == 0x2581)
    line = cps == 10
    new = np.zeros(len(cps), bool)
    new[1:] = blank[1:] & ~blank[:-1] | line[1:] | line[:-1]
    new[text_at] = True
    return np.flatnonzero(new)


def marker_joins(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = (cps[starts] == 32) & (ends - starts > 1)
    out[out] = ~np.isin(cps[starts[out] + 1], (32, 0x2581, 10))
    return out


class Piece:
    """Both libraries over one model file."""

    def __init__(self, path: str):
        import sentencepiece

        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        self.proto = Proto.read(path)
        self.tok = tokenizer(self.proto)
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        long = [p for p, _, kind in self.proto.pieces if kind in (NORMAL, USER) and len(p) > 1]
        self.parts = not rewrites(self.proto) and not any(MARK in p.lstrip(MARK) or "\n" in p for p in long)
        self.bad: set[str] = set()
        self.cached = SpanEncoder(self.tok, marker_starts, marker_joins)
        plain = self.cached._add
        self.cached._add = lambda joined, cps, starts, ends: (self.verify([joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), plain(joined, cps, starts, ends))[1]

    def normal(self, text: str) -> str:
        """The text that decoding gives back."""
        return text.replace(MARK, " ") if not rewrites(self.proto) else self.sp.normalize(text).replace(MARK, " ").removeprefix(" ")

    def front(self, text: str | None) -> str:
        return " " + text if text and self.proto.dummy_prefix and not rewrites(self.proto) else text or ""

    def verify(self, parts: list[str]) -> None:
        """Encode new parts with both libraries and remember those that differ."""
        # a part that begins with a blank stands as the sentencepiece library's own front marker makes it
        fronted = [p for p in parts if p[0] == " " and len(p) > 1 and self.proto.dummy_prefix]
        other = [p for p in parts if not (p[0] == " " and len(p) > 1 and self.proto.dummy_prefix)]
        skip = len(self.sp.encode("\n")) - len([i for i in self.sp.encode("\n") if self.sp.is_byte(i)]) if self.proto.dummy_prefix else 0
        theirs = self.sp.encode([p[1:] for p in fronted], num_threads=THREADS) + [self.sp.encode("\n" + p)[skip + 1 :] for p in other]
        ours = self.tok.encode_batch_fast(fronted + other, add_special_tokens=False)
        self.bad.update(p for p, a, b in zip(fronted + other, ours, theirs, strict=True) if a.ids != b)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all texts in a row, how many each has, and whether both libraries agree."""
        if self.parts:
            ids, n = self.cached.encode([self.front(t) for t in texts])
            odd = [i for i, t in enumerate(texts) if t and self.bad and any(p in t for p in (b.strip() or b for b in self.bad))]
            if not odd:
                return ids, n, np.ones(len(texts), bool)
            rows = np.split(ids, np.cumsum(n)[:-1])
        else:
            odd = range(len(texts))
            rows = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast([self.front(t) for t in texts], add_special_tokens=False)]
        same = np.ones(len(texts), bool)
        for i in odd:
            theirs = np.array(self.sp.encode(texts[i] or ""), np.uint32)
            if not np.array_equal(rows[i], theirs):
                same[i], rows[i] = False, theirs
        return np.concatenate(rows).astype(np.uint32), np.array([len(r) for r in rows], np.int64), same

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(ids, skip_special_tokens=False)


@functools.cache
def piece(path: str) -> Piece:
    return Piece(path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids (little-endian unsigned 32-bit), text_back (decoded), round_trip, parity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = piece(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = part.column(1).to_pylist()
                ids, n, same = both.encode(texts)
                at = np.concatenate([[0], np.cumsum(n)])
                listed = ids.tolist()
                back = both.decode([listed[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
                trip = [b == both.normal(t or "") for b, t in zip(back, texts, strict=True)]
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((at * 4).astype("<i8")), pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), blobs.cast(pa.binary()), pa.array(back, pa.string()), pa.array(trip), pa.array(same)], names=["doc_id", "n_ids", "ids", "text_back", "round_trip", "parity"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_ids long, ids binary, text_back string, round_trip boolean, parity boolean")
