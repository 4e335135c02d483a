import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from parseq.llm.bpe import bpe, decode, digests, encode, vocabulary_path

HARD = ["", " ", "a  b   c \n\n d\t", "it's we'll I'D don't", "Über naïve ñandú 漢字 🙂🙂 é", "x" * 5000, "ab" * 3000, "!!! ***$$$", "<|endoftext|> a <|endoftext|>b", "\x00\x1f   x", "1234567890 ½ Ⅷ", " \n \n  word", "loweischaftüß" * 300]


@pytest.mark.parametrize("text", HARD)
def test_same_as_library(text):
    lib = Tokenizer.from_file(vocabulary_path())
    lib.no_truncation()
    want = lib.encode(text, add_special_tokens=False).ids
    coder = bpe(vocabulary_path())
    assert coder.encode(text) == want
    assert coder.decode(want) == lib.decode(want, skip_special_tokens=False) == text


def test_fragments_hold_no_forbidden_pair():
    coder = bpe(vocabulary_path())
    for f in coder.fragments("naïve ñ漢字🙂 a,b".encode()):
        assert all(coder.inside[a << 8 | b] for a, b in zip(f, f[1:]))


def test_frame(spark):
    lib = Tokenizer.from_file(vocabulary_path())
    rows = [(i, t, "x", 1) for i, t in enumerate(HARD)] + [(1, HARD[1], "x", 1), (None, "null id", None, 2), (99, None, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = sorted(tuple(r) for r in digests(df).fillna(-1, ["doc_id"]).collect())
    want = []
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((-1 if i is None else i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert digests(df.limit(0)).count() == 0
    back = {r.doc_id: r.text for r in decode(encode(df)).collect()}
    assert all(back[i] == t for i, t in enumerate(HARD))


def test_every_token_is_reached_by_its_merges():
    lib = Tokenizer.from_file(vocabulary_path())
    coder = bpe(vocabulary_path())
    for i, t in list(coder.tokens.items())[::7]:
        try:
            text = t.decode()
        except UnicodeDecodeError:
            continue
        assert coder.encode(text) == lib.encode(text, add_special_tokens=False).ids, (i, t)
