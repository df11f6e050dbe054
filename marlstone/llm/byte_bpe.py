"""Byte-level BPE: encoding whole texts to ids and decoding ids to bytes and text (operator 2).

A byte-level vocabulary writes each of the 256 bytes as one printable character. Encoding splits a text by the public
pattern, maps each match's UTF-8 bytes to those characters and lets the ``tokenizers`` model merge them; decoding maps
characters back to bytes. Prose repeats its words, so a task keeps the ids of what stands between two single spaces
and merges each such piece once; the store is bounded and is emptied when full, which changes no result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import held, over_texts, small_batches

#: Pieces that a task keeps at most, and the longest that it keeps.
STORE, LONGEST = 250_000, 64

#: White space that isn't one space between two other characters; cutting there would change the split.
_JOINED = re.compile(r"[^\S ] [^\S ]")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others in order from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


class PieceStore:
    """Packed little-endian ids of texts, by way of a bounded store of pieces. ``encode`` gives the ids of one piece."""

    def __init__(self, encode):
        self.encode, self.ids = encode, {}

    def pack(self, text: str) -> bytes:
        ids = self.encode(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or text[-1] == " " or _JOINED.search(text):
            return self.pack(text)
        first, *rest = text.split(" ")
        known, out = self.ids, [self.pack(first)]
        got = list(map(known.get, rest))
        if None in got:
            if len(known) > STORE:
                known.clear()
            for i, x in enumerate(got):
                if x is None:
                    piece = rest[i]
                    x = known.get(piece)
                    if x is None:
                        x = self.pack(" " + piece)
                        if len(piece) <= LONGEST:
                            known[piece] = x
                    got[i] = x
        return b"".join(out + got)


def rank_store(path: str, pattern: str) -> PieceStore:
    """A store over a rank file, for uses that need ids alone."""

    def make():
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return PieceStore(tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)

    return held(("ids", path, pattern), make)


class ByteBPE:
    """Encoder and decoder over a rank file, with the merges done by the ``tokenizers`` library."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers.models import BPE

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        char = byte_characters()
        self.split, self.table = regex.compile(pattern), {b: ord(c) for b, c in char.items()}
        byte = {c: bytes([b]) for b, c in char.items()}
        vocab = {"".join(char[b] for b in token): i for token, i in ranks.items()}
        self.bytes_of = {i: b"".join(byte[c] for c in token) for token, i in vocab.items()}
        self.model = BPE(vocab=vocab, merges=self._merges(ranks, char))
        self.store = PieceStore(self.encode)

    @staticmethod
    def _merges(ranks: dict[bytes, int], char: dict[int, str]) -> list[tuple[str, str]]:
        """The pair that makes each token: what merging by lower ranks alone leaves of its bytes."""
        out = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: r if (r := ranks.get(parts[i] + parts[i + 1], rank)) < rank else rank)
                if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            if len(parts) == 2:
                out.append(tuple("".join(char[b] for b in p) for p in parts))
        return out

    def mapped(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.table)

    def encode(self, text: str) -> list[int]:
        return [t.id for w in self.split.findall(text) for t in self.model.tokenize(self.mapped(w))]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) in characters; each token that holds a part of a character spans that character."""
        out = []
        for m in self.split.finditer(text):
            at = [m.start() + i for i, c in enumerate(m[0]) for _ in range(len(c.encode()))]
            done = 0
            for t in self.model.tokenize(self.mapped(m[0])):
                n = len(self.bytes_of[t.id])
                out.append((t.id, at[done], at[done + n - 1] + 1))
                done += n
        return out

    def decode(self, ids) -> bytes:
        """Bytes of ids. Characters that were split between tokens are whole again once the bytes are joined."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


def bpe(path: str, pattern: str) -> ByteBPE:
    return held(("bpe", path, pattern), lambda: ByteBPE(path, pattern))


def encode(docs: DataFrame, *, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids array<int>`` of every whole text. Null and empty texts give no ids; repeated rows stay repeated."""

    def make():
        b = bpe(path, pattern)
        return lambda texts: [(memoryview(b.store.packed(x)).cast("I").tolist(),) for x in texts]

    return over_texts(docs, make, "ids array<int>", key=key, text=text)


def encode_spans(docs: DataFrame, *, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, spans array<struct<id, start, end>>``: ids with the characters that each covers (see ByteBPE.spans)."""

    def make():
        b = bpe(path, pattern)
        return lambda texts: [([dict(zip(("id", "start", "end"), s, strict=True)) for s in b.spans(x)],) for x in texts]

    return over_texts(docs, make, "spans array<struct<id:int,start:int,end:int>>", key=key, text=text)


def decode(coded: DataFrame, *, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, bytes binary, text string`` of id arrays (null: empty). Bytes that aren't UTF-8, which only id lists cut
    within a character give, become U+FFFD in ``text`` and stay as they are in ``bytes``."""
    import pyarrow as pa

    kind = coded.schema[key].dataType.simpleString()

    def run(batches):
        b = bpe(path, pattern)
        for batch in batches:
            raw = [b.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())], [key, "bytes", "text"])

    return small_batches(coded).select(F.col(key), F.col(ids)).mapInArrow(run, f"{key} {kind}, bytes binary, text string")


def round_trip(docs: DataFrame, *, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256, n_bytes`` of every whole text, encoded and decoded in one pass.

    The ids never leave the task, so nothing is shuffled. Null texts count as empty ones. One row for each input
    row, none for a table without rows; columns but key and text are not read, whatever their names.
    """

    def make():
        b = bpe(path, pattern)

        def work(texts):
            out = []
            for x in texts:
                packed = b.store.packed(x)
                back = b.decode(memoryview(packed).cast("I"))
                out.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest(), len(back)))
            return out

        return work

    return over_texts(docs, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint", key=key, text=text)
