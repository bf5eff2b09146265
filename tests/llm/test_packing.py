import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from posframe.llm import packing
from posframe.llm.common import table

PATH = public_tokenizers.path("byte_bpe_50k.json")


def checked(pieces, texts):
    tk = Tokenizer.from_file(PATH)
    whole = {i: np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, t in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert by_doc.keys() == whole.keys()
    for i, own in by_doc.items():
        own.sort(key=lambda p: p.start)
        at = 0
        for p in own:
            assert p.start == at and p.doc_tokens == len(whole[i]) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(whole[i][at : at + p.length].tobytes())
            at += p.length
        assert at == len(whole[i])
    padding = 0
    for own in by_seq.values():
        own.sort(key=lambda p: p.offset)
        at = 0
        for p in own:
            assert p.offset == at
            at += p.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding, sum(map(len, whole.values()))


def test_pieces(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    padding, total = checked(packing.op3_packing(spark, sf_dir).collect(), docs)
    assert padding < 0.01 * total + 2048


def test_edges(spark, frame):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "word and " * 9000), (-1, "x <|endoftext|> y"), (-2, "<|endoftext|><|endoftext|> \n <|endoftext|>a"), *((k, "x " * (k % 700)) for k in range(5, 300))]
    from pyspark.sql import functions as F

    pieces = packing.pack(frame(rows).coalesce(1), PATH, block_tokens=3000).withColumn("ids_crc32", F.crc32("ids"))
    checked(pieces.collect(), dict(rows))
    assert packing.pack(frame([]), PATH).count() == 0


def test_step_groups_are_even(spark, frame):
    rows = [(k, "x " * (17 * k % 900)) for k in range(400)]
    pieces = packing.pack(frame(rows).coalesce(1), PATH, step_tokens=1 << 14).collect()
    tokens = defaultdict(int)
    for p in pieces:
        tokens[p.step_group] += p.length
    full = sorted(tokens.values())
    assert len(full) > 3 and full[-1] <= (1 << 14) + 2048
