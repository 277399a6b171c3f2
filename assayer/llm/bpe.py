"""Byte-level BPE: encoding by a rank file and decoding, over Arrow batches."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.store import bounded_batches

#: Distinct pieces a worker remembers; beyond it the memory starts anew.
MEMORY = 300_000
#: Distinct pieces that go through the tokenizer as one text, a line each.
TOGETHER = 500


def byte_characters() -> dict[int, str]:
    """The usual byte table: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens whose merge makes this one: merging its bytes by lower ranks only leaves them."""
    parts = [bytes([b]) for b in token]
    limit = ranks[token]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], limit))
        if ranks.get(parts[best] + parts[best + 1], limit) >= limit:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    if len(parts) != 2:
        raise ValueError(f"token of rank {limit} is not a merge of two others")
    return parts[0], parts[1]


class Codec:
    """Encodes and decodes by one rank file. Built once in each worker."""

    _made: dict[tuple[str, str], Codec] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def __init__(self, path: str, pattern: str) -> None:
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, chars = read_ranks(path), byte_characters()
        spell = lambda token: "".join(chars[b] for b in token)
        vocab = {spell(t): r for t, r in ranks.items()}
        merges = [tuple(map(spell, _halves(t, ranks))) for t, r in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1]
        self.tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        back = {c: b for b, c in chars.items()}
        self.bytes_of = {r: bytes(back[c] for c in t) for t, r in vocab.items()}
        self.by_name = {str(r): x for r, x in self.bytes_of.items()}
        self.names = [str(r) for r in range(max(self.bytes_of) + 1)]
        self.line = f" {ranks[bytes([10])]} "
        self.known: dict[str, str] = {}
        self.apart = re.compile(r"\s\s")
        self.cut = re.compile(r"(?<=\S)(?= \S)")

    def pieces(self, text: str) -> list[str]:
        """Parts that the pattern never matches across: a lone blank between two other characters starts a new match."""
        if self.apart.search(text):
            return [p for p in self.cut.split(text) if p]
        first, *rest = text.split(" ")
        parts = [" " + p for p in rest]
        return [first, *parts] if first else parts

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces not yet known; their ids are kept as decimal text.

        A line break before a blank or a word is a match of its own, so pieces without blanks inside go many to a text, a
        line each, and the ids are cut at that token again. All others are encoded one by one.
        """
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > MEMORY:
            self.known = {p: self.known[p] for p in pieces if p in self.known}
        plain, odd = [], []
        for p in sorted(new):
            word = p[1:] if p[0] == " " else p
            (plain if word.split() == [word] else odd).append(p)
        texts = ["\n".join(plain[k : k + TOGETHER]) for k in range(0, len(plain), TOGETHER)]
        coded = []
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            coded += " ".join([self.names[i] for i in e.ids]).split(self.line)
        coded += [" ".join([self.names[i] for i in e.ids]) for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
        self.known.update(zip(plain + odd, coded, strict=True))

    def encoded(self, texts: list[str]) -> Iterator[str]:
        """Each text's ids in decimal, joined by one blank; a few megabytes of text at a time."""
        from assayer.llm.words import slices

        for lo, hi in slices(texts, 2 << 20):
            cut = [self.pieces(t) for t in texts[lo:hi]]
            self.learn({p for c in cut for p in c})
            for c in cut:
                yield " ".join(map(self.known.__getitem__, c))

    def decoded(self, ids: str) -> bytes:
        """Bytes of ids in decimal."""
        return b"".join(map(self.by_name.__getitem__, ids.split(" "))) if ids else b""

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids; tokens may hold parts of characters, so text is made only of the whole."""
        return b"".join([self.bytes_of[i] for i in ids])

    def offsets(self, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First character and end (exclusive) of each token; tokens that share a split character overlap in it."""
        sizes = np.array([len(self.bytes_of[i]) for i in ids], np.int64)
        ends = np.cumsum(sizes)
        data = np.frombuffer(self.decode(ids), np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        return char[ends - sizes], char[ends - 1] + 1


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids, starts, ends): token ids of every row's whole text and the characters each token covers.

    Special tokens' strings are ordinary text. Null text counts as empty and has no tokens. Rows keep their number,
    repeated ones too; extra columns are left out.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for b in batches:
            out = [[int(i) for i in ids.split()] for ids in codec.encoded([t or "" for t in b.column(1).to_pylist()])]
            spans = [codec.offsets(ids) if ids else (np.zeros(0, np.int64),) * 2 for ids in out]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32())), *(pa.array([s[k].astype(np.int32) for s in spans], pa.list_(pa.int32())) for k in (0, 1))], ["id", "ids", "starts", "ends"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "id", ids: str = "ids") -> DataFrame:
    """(id, bytes, text): the bytes that the ids stand for; text is null where they are not UTF-8. Null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for b in batches:
            raw = [codec.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["id", "bytes"])

    kind = tokens.schema[id_col].dataType.simpleString()
    out = tokens.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids}`").alias("ids")).mapInArrow(run, f"id {kind}, bytes binary")
    return out.withColumn("text", F.when(F.expr("is_valid_utf8(cast(bytes as string))"), F.col("bytes").cast("string")))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: digests of the ids in decimal and of the bytes decoded
    from them, made in one pass so that no id list leaves the task. Null text counts as empty."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for b in batches:
            n, ids, raw = [], [], []
            for text in codec.encoded([t or "" for t in b.column(1).to_pylist()]):
                n.append(text.count(" ") + 1 if text else 0)
                ids.append(hashlib.sha256(text.encode()).hexdigest())
                raw.append(hashlib.sha256(codec.decoded(text)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
