"""Byte-pair encoding by forced boundaries.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can never be merged
across, so a text may be cut there and its fragments encoded independently. White space is cut so
before every word; within a word the remaining forced pairs cut again. Fragments repeat, so each
worker keeps a bounded memo of what it has encoded.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fragments that a worker remembers before it starts anew.
MEMO_ENTRIES = 400_000
#: Bytes of a word up to which it is encoded without forced cuts, which give the same ids.
SHORT = 64

# Unicode white space but for space and line feed; and control characters that only
# some libraries take for white space.
OTHER_SPACE = "\t\x0b\x0c\r\x85\xa0                　"
DOUBTFUL = "\x1c\x1d\x1e\x1f"
SPACE_CLASS = "[ \n" + OTHER_SPACE + "]"
#: Up to here every character is its own NFC form and classes don't vary between Unicode versions.
LATIN_END = "ɐ"
# The pre-tokenisers' patterns.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What WORD_PATTERN is in folded ASCII text.
ASCII_WORD_PATTERN = r"'(?:[stmd]|re|ve|ll)|[a-z]+|[0-9]|[^ \t\n\r\f\va-z0-9]+"
#: Stands for the end of a word; no UTF-8 text has this byte.
WORD_END = b"\xff"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: bytes that print stand for
    themselves, the others follow from 256 on in their order."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {chr(b if b in prints else next(rest)): b for b in range(256)}


class Vocabulary:
    """Tokens of a tokenizer file, its merge core and the byte pairs that occur inside tokens."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = byte_alphabet()
        self.ranks: dict[bytes, int] = {}
        for name, number in spec["model"]["vocab"].items():
            if name not in self.special:
                word, end = (name[: -len(self.suffix)], WORD_END) if self.suffix and name.endswith(self.suffix) else (name, b"")
                self.ranks[bytes(alphabet[c] for c in word) + end] = number
        self.core = tiktoken.Encoding("core", pat_str=r"\S+", mergeable_ranks=self.ranks, special_tokens={})._core_bpe
        self.decoded = {number: token.removesuffix(WORD_END) if self.suffix else token for token, number in self.ranks.items()}
        self.decoded.update({number: name.encode() for name, number in self.special.items()})
        self.inside = bytearray(65536)
        for token in self.ranks:
            for a, b in zip(token, token[1:], strict=False):
                self.inside[a << 8 | b] = 1
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def forced(self, piece: bytes) -> list[bytes]:
        """``piece`` cut at every byte pair that occurs inside no token."""
        inside, start, out = self.inside, 0, []
        for k in range(1, len(piece)):
            if not inside[piece[k - 1] << 8 | piece[k]]:
                out.append(piece[start:k])
                start = k
        out.append(piece[start:])
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        encode = self.core.encode_single_piece
        out: list[int] = []
        for fragment in self.forced(piece):
            out += encode(fragment)
        return out


class Encoder:
    """Encodes whole texts as the vocabulary's own library does, fragment by fragment.

    ``pack`` turns the ids of a fragment into what the memo holds.
    """

    def __init__(self, path: str, pack: Callable[[list[int], Vocabulary], object], memo_entries: int = MEMO_ENTRIES) -> None:
        import regex

        self.vocabulary = Vocabulary(path)
        self.pack, self.limit = pack, memo_entries
        self.split = regex.compile(WORD_PATTERN if self.vocabulary.suffix else BYTE_PATTERN).findall
        self.any_fragment = regex.compile(f"{SPACE_CLASS}*[^{SPACE_CLASS[1:]}+|{SPACE_CLASS}+").findall
        self.memo: dict[str, dict[str, object]] = {"": {}, " ": {}, "\n": {}}
        self.pieces, self.join = re.compile(ASCII_WORD_PATTERN).findall, _JOINS.get(pack)
        self.words: dict[str, object] = {}  # what the memo would hold for a word, which stands in many fragments

    def ids(self, fragment: str) -> list[int]:
        """Ids of one fragment, from nothing else."""
        v = self.vocabulary
        if "<|" in fragment or not fragment.isascii() and max(fragment) >= LATIN_END:
            return v.library.encode(fragment, add_special_tokens=False).ids
        out: list[int] = []
        if v.suffix:
            for p in self.split(fragment.lower()):
                out += self._word(p)
        else:
            for p in self.split(fragment):
                out += v.encode_piece(p.encode())
        return out

    def _word(self, p: str) -> list[int]:
        """Ids of one piece of WORD_PATTERN."""
        # Forced cuts don't change the ids; for short words they cost more than they save.
        piece = p.encode() + WORD_END
        return self.vocabulary.core.encode_single_piece(piece) if len(piece) <= SHORT else self.vocabulary.encode_piece(piece)

    def _new(self, fragment: str) -> object:
        """What the memo holds for ``fragment``; where words end in a sign of their own, joined from its words'."""
        v = self.vocabulary
        if not v.suffix or self.join is None or "<|" in fragment or not fragment.isascii() and max(fragment) >= LATIN_END:
            return self.pack(self.ids(fragment), v)
        words, folded = self.words, fragment.lower()
        if folded.isascii():
            pieces = [folded] if folded.isalpha() else self.pieces(folded)
        else:
            pieces = [folded] if folded.isalpha() else self.split(folded)
        found = list(map(words.get, pieces))
        if None in found:
            for at, p in enumerate(pieces):
                if found[at] is None:
                    if len(words) >= self.limit:
                        words.clear()
                    found[at] = words[p] = self.pack(self._word(p), v)
        return found[0] if len(found) == 1 else self.join(found)

    def _look(self, words: list[str], before: str, out: list) -> None:
        memo = self.memo[before]
        found = list(map(memo.get, words))
        if None in found:
            new = self._new
            for at, x in enumerate(found):
                if x is None:
                    w = words[at]
                    x = memo.get(w)
                    if x is None:
                        if len(memo) >= self.limit:
                            memo.clear()
                        x = memo[w] = new(before + w)
                    found[at] = x
        out += found

    def fragments(self, text: str) -> list:
        """What the memo holds for each fragment of ``text``, in order."""
        out: list = []
        if not text:
            return out
        if self.vocabulary.suffix:
            if any(c in text for c in DOUBTFUL):
                out.append(self.pack(self.vocabulary.library.encode(text, add_special_tokens=False).ids, self.vocabulary))
            else:
                # Fragments are folded anyway, but special tokens are found before.
                self._look((text.lower() if text.isascii() and "<|" not in text else text).split(), "", out)
            return out
        if any(special in text for special in self.vocabulary.special):
            return self._with_specials(text)
        plain = not (text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or any(c in text for c in OTHER_SPACE) or any(c in text for c in DOUBTFUL))
        if not plain:
            if any(c in text for c in DOUBTFUL):
                out.append(self.pack(self.vocabulary.library.encode(text, add_special_tokens=False).ids, self.vocabulary))
            else:
                self._look(self.any_fragment(text), "", out)
            return out
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            self._look(words[:1], "\n" if k else "", out)
            self._look(words[1:], " ", out)
        return out

    def _with_specials(self, text: str) -> list:
        v = self.vocabulary
        return [self.pack(v.library.encode(text, add_special_tokens=False).ids, v)]


def _pack_decimal(ids: list[int], v: Vocabulary) -> tuple[str, bytes]:
    return ",".join(map(str, ids)), b"".join([v.decoded[i] for i in ids])


def _join_decimal(packed: list[tuple[str, bytes]]) -> tuple[str, bytes]:
    return ",".join([x[0] for x in packed if x[0]]), b"".join([x[1] for x in packed])


_PACK = [struct.Struct(f"<{n}I").pack for n in range(17)]


def _pack_binary(ids: list[int], _: Vocabulary) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)


#: How what these make of a fragment's words becomes what they make of the fragment.
_JOINS = {_pack_decimal: _join_decimal, _pack_binary: b"".join}


@lru_cache(maxsize=4)
def decimal_encoder(path: str) -> Encoder:
    """This worker's encoder to decimal ids and decoded bytes."""
    return Encoder(path, _pack_decimal)


@lru_cache(maxsize=4)
def binary_encoder(path: str) -> Encoder:
    """This worker's encoder to little-endian ids of four bytes."""
    return Encoder(path, _pack_binary)


def encode_texts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Ids of every whole text, and the text decoded from them.

    Returns the columns ``keep``, ``ids`` (array<int>) and ``decoded``. A null or empty text has no
    ids and decodes to an empty one. Rows don't influence each other; nothing is shuffled.
    """
    schema = T.StructType([*[docs.schema[k] for k in keep], T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = decimal_encoder(path)
        for batch in batches:
            for small in slices(batch):
                rows = [encoder.fragments(t or "") for t in small.column(len(keep)).to_pylist()]
                ids = [[int(i) for f in fs if f[0] for i in f[0].split(",")] for fs in rows]
                decoded = [b"".join([f[1] for f in fs]).decode("utf-8", "replace") for fs in rows]
                yield pa.RecordBatch.from_arrays([*[small.column(k) for k in range(len(keep))], pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=[*keep, "ids", "decoded"])

    return docs.select(*keep, F.col(text).cast("string").alias("_text_in")).mapInArrow(run, schema)


def encode_digests(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As encode_texts(), but with digests in place of ids and decoded text, so that neither is
    written: ``n_tokens``, ``ids_sha256`` (of decimal ids joined by commas), ``decoded_sha256``."""
    schema = T.StructType([*[docs.schema[k] for k in keep], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = decimal_encoder(path)
        for batch in batches:
            for small in slices(batch):
                counts, ids_sha, decoded_sha = [], [], []
                for t in small.column(len(keep)):
                    found = encoder.fragments(t.as_py() or "")
                    ids = ",".join([f[0] for f in found if f[0]])
                    decoded = b"".join([f[1] for f in found]).decode("utf-8", "replace")
                    counts.append(ids.count(",") + 1 if ids else 0)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([*[small.column(k) for k in range(len(keep))], pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(*keep, F.col(text).cast("string").alias("_text_in")).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that only a few texts at a time are Python objects."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
    if batch.num_rows == 0:
        yield batch


def tiktoken_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary in tiktoken's format."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
