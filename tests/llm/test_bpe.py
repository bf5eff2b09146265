import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from posframe.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def peer():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern_is_the_published_one():
    assert bpe.SPACED_PATTERN == public_tokenizers.PATTERN


def test_equals_the_rank_library(peer):
    random.seed(7)
    alphabet = [" ", "  ", "\n", "\t", "\x1c", " ", "a", "b", "The", "'s", "é", "日", "😀", "12", "<|endoftext|>", ".", "!!", "x" * 60]
    docs = ["".join(random.choices(alphabet, k=random.randrange(30))) for _ in range(4000)] + ["", " ", "   ", "a" * 3000, "x \n y", "x  \n\n  y", "end  ", "\0a b"]
    model = bpe.Vocabulary(RANKS, limit=500)
    for text, ids in zip(docs, model.encode(docs), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == peer.encode_ordinary(text), repr(text)
        assert model.decode(np.frombuffer(ids, "<u4")) == text.encode()


def test_ranks_give_the_ids_of_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    one, other = bpe.encoder(path), bpe.Vocabulary.of(path)
    assert isinstance(one, bpe.Ranked)
    random.seed(9)
    docs = ["".join(random.choices([" ", "\n", "é", "日", "er", "Th", "ation", "<|endoftext|>", "12", "!!", "'s"], k=random.randrange(40))) for _ in range(5000)]
    ids = list(one.encode(docs))
    assert ids == list(other.encode(docs))
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [e.ids for e in plain.encode_batch(docs, add_special_tokens=False)]
    assert np.frombuffer(next(one.encode(["x <|endoftext|> y"])), "<u4").tolist() == [87, 220, 50256, 331]


def test_offsets_and_split_characters():
    model = bpe.Vocabulary.of(RANKS)
    text = "ab 😀é日本"
    ids = np.frombuffer(next(model.encode([text])), "<u4")
    starts, ends = model.offsets(text, ids)
    assert starts[0] == 0 and ends[-1] == len(text) and (ends > starts).all()
    tokens = [model.bytes_of[i] for i in ids]
    assert "".join(bpe.split_chars(tokens)) == text
    for s, e, t in zip(starts, ends, tokens, strict=True):
        assert t in text[s:e].encode()


def test_edges(spark, frame):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "word " * 20000)]
    out = bpe.encode(frame(rows), RANKS, offsets=True)
    back = {(r.doc_id, r.decoded.decode()) for r in bpe.decode(out, RANKS).collect()}
    assert back == {(i, t or "") for i, t in rows}
    assert out.count() == 5
    assert bpe.encode(frame([]), RANKS).count() == 0
