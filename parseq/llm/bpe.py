"""Operator 1: byte-pair encoding with forced boundaries, and decoding.

A byte pair that lies inside no token of the vocabulary can never be bridged by a merge, so a cut there is certain.
Every pre-token is split at such pairs, the fragments are merged independently and their ids are concatenated.
Distinct pre-tokens are encoded once per worker and kept in a bounded cache; documents never meet, so there is no shuffle.

Defined results: a null text is the empty text (no ids); repeated rows give repeated results; a null id stays null;
texts of any length are encoded whole (the merge loop stays near linear for long fragments); other columns are left out.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from .common import Cache, batch, documents, only, sha, texts

#: Fixed value: the pattern by which the byte-level vocabularies split a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "byte_bpe_50k.json"
RUN = re.compile(r"\s\s")
ALONE = re.compile(r"(?<=\S) (?=\S)")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in a byte-level vocabulary: itself if it is visible, else the next free one from U+0100."""
    visible = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in set(visible))
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class Bpe:
    """An encoder and decoder for a ``tokenizers`` JSON file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        #: Ranks are 0 to 255 for the single bytes, then one for each merge; to_id leads back to the vocabulary's ids.
        ranks, self.to_id = {bytes([b]): b for b in range(256)}, [ids.get(bytes([b]), 0) for b in range(256)]
        for pair in spec["model"]["merges"]:
            token = b"".join(as_bytes(t) for t in (pair.split(" ") if isinstance(pair, str) else pair))
            if token not in ranks:
                ranks[token] = len(ranks)
                self.to_id.append(ids[token])
        self.core = tiktoken.Encoding("fragments", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        #: inside[a * 256 + b]: some token holds the bytes a, b next to each other.
        self.inside = bytearray(1 << 16)
        for t in ids:
            for a, b in zip(t, t[1:]):
                self.inside[a << 8 | b] = 1
        self.cut = regex.compile(PATTERN)
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        #: Whether no token holds a visible character before a space or line feed (a torn character counts as visible).
        self.sure = not any(re.search(r"\S[ \n]", t.decode("utf-8", "replace")) for t in ids)
        self.bare, self.spaced = Cache(self.pack), Cache(lambda piece: self.pack(" " + piece))

    def fragments(self, data: bytes) -> list[bytes]:
        inside = self.inside
        cuts = [i for i, (a, b) in enumerate(zip(data, data[1:]), 1) if not inside[a << 8 | b]]
        return [data[i:j] for i, j in zip([0, *cuts], [*cuts, len(data)])] if cuts else [data]

    def merged(self, data: bytes) -> list[int]:
        """Merge one fragment: always the pair of lowest rank, the leftmost of equals."""
        to_id = self.to_id
        return [to_id[r] for r in self.core(data)]

    def pack(self, text: str) -> bytes:
        """Ids of a text that the pattern may cut freely, as little-endian 32-bit integers."""
        pieces = [text] if text.isalpha() or text[:1] == " " and text[1:].isalpha() else self.cut.findall(text)
        return array("I", [x for piece in pieces for f in self.fragments(piece.encode()) for x in self.merged(f)]).tobytes()

    def ordinary(self, text: str, out: list[bytes]) -> None:
        """A space or line feed that stands alone between two visible characters is a certain cut: no token holds a
        visible byte and then white space, and the pattern's look-ahead only matters in longer runs."""
        if not text:
            return
        spaced, bare = self.spaced.__getitem__, self.bare.__getitem__
        if not self.sure:
            out.append(self.pack(text))
        elif text[0].isspace() or text[-1].isspace() or RUN.search(text):
            first, *rest = ALONE.split(text)
            out.append(bare(first))
            out += map(spaced, rest)
        else:
            for k, line in enumerate(text.split("\n")):
                if k:
                    out.append(bare("\n"))
                first, *rest = line.split(" ")
                out.append(bare(first))
                out += map(spaced, rest)

    def encode_bytes(self, text: str) -> bytes:
        out: list[bytes] = []
        at = 0
        for m in self.specials.finditer(text) if self.specials else ():
            self.ordinary(text[at : m.start()], out)
            out.append(np.array([self.special[m[0]]], dtype="<u4").tobytes())
            at = m.end()
        self.ordinary(text[at:] if at else text, out)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    def decode(self, ids) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32()))])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) of every text."""

    def run(batches):
        coder = bpe(path or vocabulary_path())
        for b in batches:
            yield batch(pa.schema([SCHEMA.field("doc_id"), SCHEMA.field("ids")]), b.column(0), [coder.encode(t) for t in texts(b.column(1))])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of (doc_id, ids); null ids decode to the empty text."""

    def run(batches):
        coder = bpe(path or vocabulary_path())
        for b in batches:
            yield batch(pa.schema([("doc_id", pa.int64()), ("text", pa.string())]), b.column(0), [coder.decode(x.as_py() or ()) for x in b.column(1)])

    return only(tokens, doc_id="long", ids="array<int>").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode each text, decode its ids again, and give the digests of both in one pass, so that no id leaves its task."""

    def run(batches):
        coder = bpe(path or vocabulary_path())
        schema = pa.schema([SCHEMA.field(i) for i in range(4)])
        for b in batches:
            rows = []
            for text in texts(b.column(1)):
                ids = coder.encode_bytes(text)
                rows.append((len(ids) // 4, sha(ids), sha(coder.decode(np.frombuffer(ids, dtype="<u4").tolist()).encode())))
            yield batch(schema, b.column(0), *(zip(*rows) if rows else ([], [], [])))

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
