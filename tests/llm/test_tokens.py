"""Encoders, packing and token shards against the libraries themselves."""

import functools
import os
import random
import struct
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from siteledger.llm import packing, pretokens, spm, tokenfile
from siteledger.llm.queries import queries
from siteledger.llm.shared import read_shards

#: Texts that hold an added token, which the library takes for that token.
MARKED = ["hello <|endoftext|> world", "<|endoftext|><|endoftext|>", "a<|endoftext|", "word " * 3000 + "x<|endoftext|> y", "<|endoftext|>\u0378 z"]
BPE, SPM = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EDGE = ["", None, " ", "\n", "it's don't we'll ''s 's", " x\n\n y  \n z", "a\x1cb", "日本 テスト 123 ４５ ¼", "'s", "t", "<|endoftext|>", "hello  world\r\n", "é" * 300, "a" * 5000, "word " * 3000]


@functools.cache
def fresh():
    """A tokenizer as the library loads it."""
    return tokenizers.Tokenizer.from_file(str(BPE))


def per_text(ids, n):
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if len(n) else []


def check_bpe(texts):
    enc = pretokens.encoder(str(BPE))
    assert per_text(*enc.encode(texts)) == [fresh().encode(t or "", add_special_tokens=False).ids for t in texts]


def test_bpe_parity():
    check_bpe(EDGE)
    check_bpe(MARKED)
    enc = pretokens.encoder(str(BPE))
    assert per_text(*enc.encode(MARKED[:1])) == [[31373, 220, 50256, 995]]
    rng = random.Random(1)
    bits = ["a", "s", "t", "re", " ", "  ", "\n", "\t", "'", "'ll", "1", "²", "!", "…", "é", "Ж", "　", "\xa0", "😀", "\r\n", "ve"]
    check_bpe(["".join(rng.choices(bits, k=rng.randrange(40))) for _ in range(800)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_bpe_any_text(texts):
    check_bpe(texts)


def test_long_text_is_cut_safely(monkeypatch):
    monkeypatch.setattr(pretokens, "CHUNK", 64)
    check_bpe(["one two  three\n\nfour's " * 40, "x" * 400, EDGE[5]])


def test_new_words_are_kept_together(monkeypatch):
    enc = pretokens.SpanEncoder(tokenizers.Tokenizer.from_file(str(BPE)))
    kept = []
    keep = enc._keep
    monkeypatch.setattr(enc, "_keep", lambda ids, counts: (kept.append(len(counts)), keep(ids, counts)))
    texts = [f"w{chr(97 + k % 26)}{k}\t{k}x, {k}\u3000" for k in range(3000)]
    ids, n = enc.encode(texts)
    whole = [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(x) for x in whole] and ids.tolist() == [i for x in whole for i in x]
    assert len(kept) <= sum(kept) / 500 + 2


def test_spm_parity():
    both = spm.piece(str(SPM))
    rng = random.Random(2)
    bits = ["a", "the ", " ", "  ", "\n", "\t", "▁", "1", "é", "Ж", "😀", "<s>", "<0x41>", " hello", "한"]
    texts = [*EDGE, *("".join(rng.choices(bits, k=rng.randrange(30))) for _ in range(500))]
    ids, n, same = both.encode(texts)
    assert per_text(ids, n) == [both.sp.encode(t or "") for t in texts]
    assert same.all()
    assert both.decode(per_text(ids, n)) == [both.normal(t or "") for t in texts]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def coded(number, value):
    """A protobuf field: whole numbers, 32-bit floats, bytes."""
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(number << 3) + varint(value)


def unigram_model(charsmap, remove_blanks, byte_fallback, blank_in_front):
    """A small model written down by hand; no pieces are trained."""
    words = {"▁": -3.0, "▁the": -4.0, "▁cat": -5.5, "the": -6.0, "at": -4.5, "he": -5.0, "▁a": -4.2, "th": -6.5, "▁▁": -7.0, "ア": -8.0, "fi": -6.0, "▁ca": -7.0, "t▁t": -9.0} | {c: -7.0 - k / 10 for k, c in enumerate("abcehst1éx")}
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256) if byte_fallback] + [(w, v, 1) for w, v in words.items()]
    out = b"".join(coded(1, coded(1, p.encode()) + coded(2, v) + coded(3, k)) for p, v, k in pieces)
    out += coded(2, coded(3, 1) + coded(35, int(byte_fallback)))
    return out + coded(3, coded(1, b"own") + coded(2, charsmap) + coded(3, int(blank_in_front)) + coded(4, int(remove_blanks)) + coded(5, 1))


@pytest.mark.parametrize("mapped,remove_blanks,byte_fallback,front", [(False, False, True, True), (True, True, False, True), (True, True, True, False), (False, True, True, True)])
def test_unigram_parity(tmp_path, mapped, remove_blanks, byte_fallback, front):
    charsmap = b""
    if mapped:
        proto = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
        charsmap = bytes(next(dict(spm.fields(v))[2] for n, v in spm.fields(memoryview(proto)) if n == 3))
    path = tmp_path / "own.model"
    path.write_bytes(unigram_model(charsmap, remove_blanks, byte_fallback, front))
    both = spm.Piece(str(path))
    rng = random.Random(17)
    bits = ["the", " ", "  ", "cat", "a", "at", "\n", "\t", "ｱ", "①", "ﬁ", "é", "e\u0301", "Ж", "x1", " the cat", "😀", "▁", "​"]
    texts = ["", None, " ", "   ", *("".join(rng.choices(bits, k=rng.randrange(25))) for _ in range(400))]
    ids, n, same = both.encode(texts)
    # whatever the library under test gives, the ids are the sentencepiece library's
    assert per_text(ids, n) == [both.sp.encode(t or "") for t in texts]
    assert same.mean() > 0.98, [t for t, s in zip(texts, same, strict=True) if not s][:5]


def test_blank_parts_that_differ_ask_no_other_text(monkeypatch):
    both = spm.Piece(str(SPM))
    both.bad = {"  "}
    ids, n, same = both.encode(["no such part", "two  blanks"])
    assert same.all() and per_text(ids, n) == [both.sp.encode("no such part"), both.sp.encode("two  blanks")]


def test_registered_model_agrees_everywhere(spark, sf):
    assert queries()["op2_sentencepiece"](spark, sf).where("not parity or not round_trip").isEmpty()


def test_spm_operator(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(EDGE)], "doc_id long, text string, n_ids string")
    rows = {r.doc_id: r for r in spm.encode(df, str(SPM)).collect()}
    assert len(rows) == len(EDGE) and all(r.parity and r.round_trip for r in rows.values()) and rows[1].n_ids == 0


def docs(spark, n=12):
    texts = [*EDGE, *(f"Some words number {i} " * (1 + 97 * i % 400) for i in range(n))]
    return spark.createDataFrame([(5 * i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, start string").repartition(3), {5 * i: t for i, t in enumerate(texts)}


def test_packing(spark):
    df, texts = docs(spark)
    enc = pretokens.encoder(str(BPE))
    rows = packing.pack(df, str(BPE), end_id=1, window=64).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        got = b"".join(bytes(p.ids) for p in sorted(pieces, key=lambda p: p.start))
        want = [*fresh().encode(texts[d] or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(got, "<u4").tolist() == want
        assert {p.doc_tokens for p in pieces} == {len(want)}
    assert sorted(by_seq) == list(range(len(by_seq)))
    for q, pieces in by_seq.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == 64 or q == len(by_seq) - 1
    digest = packing.digest(packing.pack(df, str(BPE), end_id=1, window=64)).where("doc_id = 15 and start = 0").first()
    first = min(by_doc[15], key=lambda p: p.start)
    assert digest.ids_crc32 == zlib.crc32(bytes(first.ids))
    assert packing.pack(df.limit(0), str(BPE), end_id=1).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_grammar_round_trip(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 400, 30)
    ids = rng.integers(0, [3, 20, 1, 65000][seed] + 1, counts.sum()).astype(np.uint32)
    shard = tokenfile.Shard(tokenfile.write_shard(np.arange(30), counts, ids, 0, 65536))
    for k, part in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
        whole = [*part.tolist(), 0]
        assert shard.document(k).tolist() == whole
        a = int(rng.integers(0, len(whole)))
        b = int(rng.integers(a + 1, len(whole) + 1))
        assert shard.ids(k, a, b).tolist() == whole[a:b]


def test_token_files(spark):
    df, texts = docs(spark)
    enc = pretokens.encoder(str(BPE))
    at = 0
    for r in sorted(tokenfile.round_trip(df, str(BPE), end_id=0, first=65536).collect(), key=lambda r: r.doc_id):
        want = [*fresh().encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, np.frombuffer(bytes(r.ids), "<u4").tolist()) == (at, len(want), want)
        at += len(want)
    assert tokenfile.round_trip(df.limit(0), str(BPE), end_id=0, first=65536).count() == 0


def test_no_frequent_pair_stays():
    text = np.random.default_rng(7).integers(0, 50000, 5000)
    ids = np.concatenate([np.append(text, tokenfile.END) for _ in range(20)])
    symbols, rules = tokenfile.compress(ids, 50000)
    assert len(symbols) == 40 and expanded(symbols[0], rules) == text.tolist()


def plain_repair(ids, first, least):
    """One pair at a time, the most frequent first; how many symbols and rules are left."""
    seq, rules = [int(x) for x in ids], 0
    while True:
        counts, i = Counter(), 0
        while i < len(seq) - 1:
            pair = seq[i], seq[i + 1]
            if tokenfile.END not in pair:
                counts[pair] += 1
                i += len(seq) > i + 2 and pair[0] == pair[1] == seq[i + 2]  # alike symbols in a row don't overlap
            i += 1
        if not counts or max(counts.values()) < least:
            return len(seq), rules
        best = min(p for p, n in counts.items() if n == max(counts.values()))
        out, i = [], 0
        while i < len(seq):
            if tuple(seq[i : i + 2]) == best:
                out.append(first + rules)
                i += 2
            else:
                out.append(seq[i])
                i += 1
        seq, rules = out, rules + 1


def test_size_against_plain_repair():
    rng = np.random.default_rng(8)
    words = [rng.integers(0, 400, rng.integers(1, 6)) for _ in range(60)]
    ids = np.concatenate([np.append(np.concatenate([words[k] for k in rng.zipf(1.4, 40) % 60]), tokenfile.END) for _ in range(60)]).astype(np.uint32)
    symbols, rules = tokenfile.compress(ids, 50000)
    n, k = plain_repair(ids, 50000, tokenfile.LEAST)
    assert len(ids) > 5000 and len(symbols) + 2 * len(rules) <= 1.1 * (n + 2 * k)


def test_shards_are_cut_by_size(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "SHARD_IDS", 700)
    rows = [(k, "some words " * 100) for k in range(200)] + [(None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = tokenfile.round_trip(df, str(BPE), end_id=0, first=65536).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((i is not None, i or 0) for i, _ in rows)
    at = 0
    for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        assert r.start == at
        at += r.n_tokens
    assert len({r.shard for r in got}) >= 3


def test_a_shard_ends_with_a_document(spark, monkeypatch):
    """Not with a batch of documents, however many ids that has."""
    monkeypatch.setattr(tokenfile, "SHARD_IDS", 500)
    rows = [(k, "some words " * (400 if k % 7 == 0 else 20)) for k in range(100)] + [(k, None) for k in range(100, 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = tokenfile.round_trip(df, str(BPE), end_id=0, first=65536).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.doc_id):
        by.setdefault(r.shard, []).append(r.n_tokens - 1)
    assert len(got) == 120 and sorted(by) == list(by)
    assert all(sum(n[:-1]) < 500 for n in by.values())


def expanded(symbol, rules):
    out, open_ = [], [int(symbol)]
    while open_:
        s = open_.pop()
        if s < 50000:
            out.append(s)
        else:
            open_ += [int(x) for x in reversed(rules[s - 50000])]
    return out


def test_known_words_stay_in_place_as_they_grow():
    """Hashes that share their first bits, and 0, are told apart while the places are dealt anew."""
    enc = pretokens.SpanEncoder(tokenizers.Tokenizer.from_file(str(BPE)))
    rng = np.random.default_rng(11)
    known, first = np.empty(0, np.uint64), len(enc.keys)
    for k in range(12):
        near = (np.uint64((1 << 64) - 1) >> np.uint64(k)) - np.arange(40, dtype=np.uint64)
        more = np.setdiff1d(np.concatenate([near, rng.integers(0, 1 << 63, 4000).astype(np.uint64), [np.uint64(0)]]), known)
        assert (enc._find(more) == -1).all()
        enc.rows += len(more)
        enc._learn(more, np.arange(len(known), enc.rows, dtype=np.int32))
        known = np.concatenate([known, more])
        assert enc._find(known).tolist() == list(range(len(known)))
    assert len(enc.keys) > first and 2 * len(known) <= len(enc.keys)


def test_starts_of_shards_open_no_file(spark, tmp_path):
    path = str(tmp_path / "shards")
    df, texts = docs(spark)
    tokenfile.write(df, path, str(BPE), end_id=0, first=65536)
    totals = read_shards(spark, path).select("shard", "total")
    shards = {r.shard: tokenfile.Shard(bytes(r.content)) for r in read_shards(spark, path).collect()}
    assert {r.shard: r.total for r in totals.collect()} == {k: int(s.id_ends[-1]) for k, s in shards.items()}
    assert "content" not in totals._jdf.queryExecution().executedPlan().toString()
    # a file that doesn't hold what its folder names is refused
    folder = next(p for p in (tmp_path / "shards").glob("shard=*/total=*"))
    folder.rename(folder.with_name(folder.name + "1"))
    with pytest.raises(Exception, match="that its folder names"):
        tokenfile.read(spark, path).collect()


def test_library_runs_in_one_thread():
    """A core has a task of its own; threads of the library that wait for work would take CPU time."""
    code = "import os, sys; from siteledger.llm import pretokens; pretokens.encoder(sys.argv[1]).encode([' '.join(f'w{k}q' for k in range(3000))]); print(len(os.listdir('/proc/self/task')))"
    few = {k: v for k, v in os.environ.items() if k not in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS")} | {"OPENBLAS_NUM_THREADS": "1", "OMP_NUM_THREADS": "1"}
    assert subprocess.run([sys.executable, "-c", code, str(BPE)], env=few, capture_output=True, text=True, check=True).stdout.strip() == "1"
