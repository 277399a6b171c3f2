from __future__ import annotations

import hashlib

import pytest

from assayer.llm import bpe

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = [
    "", " ", "  ", "\n", "\n\n a", "a  b", "a \n b", "it's we'll I'd DON'T 'tis", "tab\tand nbsp  em", "x\x1cy \x1c z", "\x85 a\x85b", "née 日本語 🙂🙂 emoji 🇫🇷", "<|endoftext|> plain",
    "12345 3.14 1e9 ½ ²", "a" * 5000, "trailing ", " leading", "mixed   runs \r\n of \t\t blanks  ", "word " * 3000, "é combining ‍ joiner ﻿ mark", "...!!! ?a", "　wide　space",
]


def plain():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_ids_are_those_of_the_rank_encoder(make):
    enc = plain()
    rows = list(enumerate(TEXTS)) + [(900, None), (901, TEXTS[11]), (901, TEXTS[11])]
    got = bpe.round_trip(make(rows, extra=True), PATH, P.PATTERN).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        assert by[i].n_tokens == len(ids), repr(t)
        assert by[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), repr(t)
        assert by[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(make([]), PATH, P.PATTERN).count() == 0


def test_offsets_and_decoding_of_split_characters(make):
    rows = list(enumerate(TEXTS))
    coded = bpe.encode(make(rows), PATH, P.PATTERN)
    enc = plain()
    for r in coded.collect():
        t = TEXTS[r.id]
        assert r.ids == enc.encode_ordinary(t)
        if r.ids:
            assert r.starts[0] == 0 and r.ends[-1] == len(t)
            data, at = t.encode(), 0
            for i, s, e in zip(r.ids, r.starts, r.ends, strict=True):
                size = len(enc.decode_single_token_bytes(i))
                touched = data[at : at + size]
                assert touched in t[s:e].encode() and (e - s) <= size
                at += size
    back = {r.id: r.text for r in bpe.decode(coded, PATH, P.PATTERN).collect()}
    assert back == dict(rows)


def test_part_of_a_character_decodes_to_bytes_without_text(spark):
    ids = plain().encode_ordinary("🙂")
    assert len(ids) > 1
    df = spark.createDataFrame([(1, ids[:1]), (2, ids), (3, None), (4, [])], "id long, ids array<int>")
    got = {r.id: (bytes(r.bytes), r.text) for r in bpe.decode(df, PATH, P.PATTERN).collect()}
    assert got[1][1] is None and got[1][0] == "🙂".encode()[: len(got[1][0])]
    assert got[2] == ("🙂".encode(), "🙂") and got[3] == got[4] == (b"", "")


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 10)
    codec = bpe.Codec(PATH, P.PATTERN)
    enc = plain()
    texts = [f"one{k} two{k} three{k} four{k} five{k}" for k in range(20)]
    assert [[int(i) for i in x.split()] for x in codec.encoded(texts)] == [enc.encode_ordinary(t) for t in texts]
