"""Byte-level BPE with the tokenizers library, over Arrow batches.

encode() turns texts into ids with character offsets, decode() turns ids into
bytes again. The vocabulary is a file whose path is a parameter: a tokenizers
JSON, or a rank file (base64 token, rank) from which the same library's model
is built.

Nulls and empties: a null text is an empty one and has no ids. A null id list
decodes to no bytes. Repeated rows are independent. Columns of the input other
than the text are passed through when asked for by name.
"""

from __future__ import annotations

import base64
import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posframe.llm.common import trim

#: The split of the byte-level vocabularies; words may be cut apart at spaces only for it.
SPACED_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space on both sides of a space (or a space run at the end): only there can a match hold a space that does not start it.
_RUN = re.compile(r"\s (?:\s|\Z)")
#: Marks that are neither white space, letters nor numbers.
_MARKS = "!#$%&()*+,-./:;<=>?@[]_{|}"
#: Bytes of text whose unknown words are encoded in one call.
_GROUP_BYTES = 1 << 21


def byte_chars() -> list[str]:
    """The character that stands for each byte: printable ones for themselves,
    the others, in order, for the characters from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def from_ranks(path: str, pattern: str = SPACED_PATTERN):
    """A tokenizers model that merges as the ranks say: of adjacent parts, those
    whose concatenation has the least rank first; a match that is a token stays whole."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    chars = byte_chars()
    shown = {t: "".join(map(chars.__getitem__, t)) for t in ranks}
    merges = [(shown[t[:k]], shown[t[k:]]) for t in sorted(ranks, key=ranks.get) for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    model = models.BPE(vocab={shown[t]: i for t, i in ranks.items()}, merges=merges, ignore_merges=True)
    made = Tokenizer(model)
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


class Vocabulary:
    """A byte-level tokenizer of one process, with the ids of words it has met.

    Between a space and what precedes it there is always a border of two
    matches of SPACED_PATTERN, unless white space stands on both sides of the
    space; so a text is cut at its spaces and each distinct cut is encoded once
    while it is remembered. `limit` bounds the memory, not what is encoded.
    """

    _made: dict = {}

    def __init__(self, path: str, limit: int = 200_000):
        from tokenizers import Tokenizer

        if path.endswith(".tiktoken"):
            self.tokenizer = from_ranks(path)
            self.spaced = True
        else:
            self.tokenizer = Tokenizer.from_file(path)
            shape = json.loads(self.tokenizer.to_str())
            pre = shape.get("pre_tokenizer") or {}
            self.spaced = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not shape.get("normalizer")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit, self.known, self.matches = limit, {}, {}
        self.model, self.chars = self.tokenizer.model, byte_chars()
        self._bytes: list[bytes] | None = None

    @classmethod
    def of(cls, path: str) -> Vocabulary:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    @property
    def bytes_of(self) -> list[bytes]:
        """The bytes of each id: the byte table reversed."""
        if self._bytes is None:
            back = {c: b for b, c in enumerate(byte_chars())}
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
            out = [b""] * (max(vocabulary.values()) + 1)
            for token, i in vocabulary.items():
                out[i] = special[i].encode() if i in special else bytes(map(back.__getitem__, token))
            self._bytes = out
        return self._bytes

    def _cuts(self, text: str) -> list[str]:
        if not self.spaced or "\0" in text or _RUN.search(text) or any(t in text for t in self.special):
            return [text]
        return text.replace(" ", "\0 ").split("\0")

    def _match(self, match: str) -> bytes:
        """Ids of one match of the pattern, which the model merges as it is."""
        if (ids := self.matches.get(match)) is None:
            shown = "".join(map(self.chars.__getitem__, match.encode()))
            ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            if len(match) <= 48:
                self.matches[match] = ids
        return ids

    def _raw(self, pieces: list[str]) -> dict[str, bytes]:
        """A space and letters are one match, and punctuation after them another;
        what has another form goes through the whole tokenizer."""
        out, others = {}, []
        if len(self.matches) + len(pieces) > self.limit:
            self.matches.clear()
        for piece in pieces:
            core = piece.rstrip(_MARKS)
            if self.spaced and core[:1] == " " and core[1:].isalpha() and not any(t in piece for t in self.special):
                out[piece] = self._match(core) + (self._match(piece[len(core) :]) if len(core) < len(piece) else b"")
            else:
                others.append(piece)
        encoded = self.tokenizer.encode_batch_fast(others, add_special_tokens=False) if others else []
        out.update((k, array("I", e.ids).tobytes()) for k, e in zip(others, encoded, strict=True))
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise OSError("ids are kept as little-endian 32-bit integers")
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (size < _GROUP_BYTES or not group):
                group.append(self._cuts(texts[at]))
                size += len(texts[at])
                at += 1
            new = set().union(*group).difference(self.known)
            if len(self.known) + len(new) > self.limit:
                self.known.clear()
                new = set().union(*group)
            found = self._raw(list(new)) if new else {}
            self.known.update((k, v) for k, v in found.items() if len(k) <= 48)
            get = self.known if all(len(k) <= 48 for k in found) else {**self.known, **found}
            for cuts in group:
                yield b"".join(map(get.__getitem__, cuts))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first character of each id and the one after its last. Bytes are
        mapped to the character that holds them; where a character is split
        between ids, each of them spans it whole."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(np.fromiter((len(self.bytes_of[i]) for i in ids.tolist()), dtype=np.int64, count=len(ids)))
        starts = np.r_[0, ends[:-1]][: len(ids)]
        return (char[starts], char[ends - 1] + 1) if len(ids) else (ends, ends)


class Ranked:
    """The ids of a byte-level vocabulary whose merges are in the order of their
    ids: merging by least id is then merging by rank, which a faster library does.
    An added token that stands in a text has its id, as in the tokenizers library."""

    _made: dict = {}

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            shape = json.load(f)
        model, pre = shape["model"], shape.get("pre_tokenizer") or {}
        parts = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"]["".join(m)] for m in parts]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not shape.get("normalizer")
        if not plain or any(a >= b for a, b in zip(made, made[1:], strict=False)):
            raise ValueError("not a byte-level vocabulary in the order of its merges")
        back = {c: b for b, c in enumerate(byte_chars())}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in shape.get("added_tokens", [])):
            raise ValueError("added tokens that take more than their own characters")
        special = {t["content"]: t["id"] for t in shape.get("added_tokens", [])}
        ranks = {bytes(map(back.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}
        self.encoding = tiktoken.Encoding("own", pat_str=SPACED_PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = list(special)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            ids = self.encoding.encode(text, allowed_special="all") if any(t in text for t in self.special) else self.encoding.encode_ordinary(text)
            yield array("I", ids).tobytes()


def encoder(path: str):
    """What encodes texts by the vocabulary at path: by ranks if they give the same ids."""
    if path not in Ranked._made:
        try:
            Ranked._made[path] = Ranked(path)
        except (ValueError, KeyError):
            Ranked._made[path] = Vocabulary.of(path)
    return Ranked._made[path]


def split_chars(tokens: list[bytes]) -> list[str]:
    """The text of each token so that the texts join to the whole: a character
    that is split between tokens goes to the one that completes it; bytes that
    form no character become U+FFFD."""
    import codecs

    reader = codecs.getincrementaldecoder("utf-8")("replace")
    out = [reader.decode(t) for t in tokens]
    if out:
        out[-1] += reader.decode(b"", True)
    return out


def encode(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), offsets: bool = False) -> DataFrame:
    """keep, n_tokens long, ids binary (little-endian unsigned 32-bit integers)
    and, if asked for, char_starts and char_ends (arrays of int)."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    if offsets:
        schema = schema.add("char_starts", T.ArrayType(T.IntegerType())).add("char_ends", T.ArrayType(T.IntegerType()))

    def run(it):
        model = Vocabulary.of(vocabulary)
        for batch in it:
            for part in sliced(batch):
                source = [x or "" for x in part.column(len(keep)).to_pylist()]
                ids = list(model.encode(source))
                columns = [part.column(i) for i in range(len(keep))] + [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if offsets:
                    spans = [model.offsets(s, np.frombuffer(x, "<u4")) for s, x in zip(source, ids, strict=True)]
                    columns += [pa.array([a[k].astype(np.int32) for a in spans], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, so that what is made of them stays small; what was freed goes back in the end."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
    trim()


def decode(encoded: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """keep and decoded, the bytes of the ids in column ids."""
    schema = T.StructType([encoded.schema[c] for c in keep] + [T.StructField("decoded", T.BinaryType())])

    def run(it):
        model = Vocabulary.of(vocabulary)
        for batch in it:
            for part in sliced(batch):
                out = [model.decode(np.frombuffer(x.as_py() or b"", dtype="<u4")) for x in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [pa.array(out, pa.binary())], names=schema.names)

    return encoded.select(*keep, F.col("ids").alias("__ids")).mapInArrow(run, schema)


def op6_bpe_roundtrip(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    from posframe.llm.common import table

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
