"""Byte-pair encoding by one pass over each prefix, exact to the id, and decoding.

BPE has one encoding of every prefix of a piece of text, and that of a longer one ends in a token whose left neighbour
it is compatible with: encoding the two together gives just these two. So the last token of each prefix is found from
left to right: an automaton names the vocabulary's tokens that are suffixes of the prefix, longest first, and the first
one compatible with the stored last token of the prefix before it is stored. Following the stored tokens back from the
end gives the ids. The work grows with the text and the longest token, however long a piece is.
"""

from __future__ import annotations

import json
import re
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwell.llm.shared import free_name

#: Pieces and pairs of tokens that a Python worker remembers at most; a full memory is emptied, which changes no id.
MEMO_PIECES, MEMO_PAIRS = 400_000, 400_000

#: The character that byte-level vocabularies write for each byte; printable ones stand for themselves.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_OF = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

#: Fixed value: how byte-level tokenizers cut a text, for characters reduced to their class (see _Classes).
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\v\f\rA-Za-z0-9]+|[ \t\n\v\f\r]+(?![^ \t\n\v\f\r])|[ \t\n\v\f\r]+")

RESULT = "struct<ids: array<int>, decoded: string>"
_loaded: dict[str, ByteBpe] = {}


class _Classes(dict):
    """For str.translate: other characters as an ASCII one of their class, which is asked of the tokenizer itself."""

    def __init__(self, pre_tokenizer):
        super().__init__({c: c for c in range(128)})
        self.pre = pre_tokenizer

    def __missing__(self, code: int) -> str:
        joined = (mark for mark in "a0." if len(self.pre.pre_tokenize_str(mark + chr(code))) == 1)
        self[code] = next(joined, "\t")
        return self[code]


class _Pieces(dict):
    """Ids of the pieces seen so far; long ones are not kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class ByteBpe:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library (no normalizer, dropout or affixes)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or spec["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or (spec["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take neighbouring characters are not supported")
        self.classes = _Classes(Tokenizer.from_file(path).pre_tokenizer)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        marks = sorted(self.added, key=len, reverse=True)
        self.split_added = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        raw = lambda token: bytes(BYTE_OF[c] for c in token)
        vocab: dict[str, int] = model["vocab"]
        self.bytes_of = {i: raw(t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: rank of the merge of two tokens; and of each merged token its parts and the rank
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            if self.parts.setdefault(vocab[a + b], (vocab[a], vocab[b], r))[2] != r:
                raise ValueError("a token that two merges make is not supported")
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = _Pieces(self.encode_piece)
        self.automaton = ahocorasick.Automaton()
        single = {raw(t)[0]: i for t, i in vocab.items() if len(t) == 1}
        for token, i in vocab.items():
            text = raw(token)
            if i in self.parts or len(text) == 1:
                self.automaton.add_word(text.decode("latin-1"), (i, len(text)))
        self.automaton.make_automaton()
        if len(single) != 256:
            raise ValueError("a byte-level vocabulary has a token for each byte")
        # a token that BPE itself never makes of its own bytes can't occur in an encoding
        for i in [i for i in self.parts if not self._whole(i)]:
            self.automaton.remove_word(self.bytes_of[i].decode("latin-1"))
        self.automaton.make_automaton()

    def _whole(self, token: int) -> bool:
        left, right, _ = self.parts[token]
        return self.compatible(left, right, self.rank[left, right])

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token and the parts of it that stand at its edge, each with the rank of the merge that took it up."""
        out, taken = [], len(self.rank)
        while True:
            out.append((token, taken))
            if token not in self.parts:
                return out
            taken, token = self.parts[token][2], self.parts[token][side]

    def compatible(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether no merge crosses the border of two tokens that stand side by side (of a rank less than `below`).

        A part at the border waits until the merge that takes it up. A crossing merge of a lesser rank comes first; of
        two merges of equal rank the one that begins further left does.
        """
        rank = self.rank
        for a, taken_a in self._edge(left, 1):
            for b, taken_b in self._edge(right, 0):
                r = rank.get((a, b))
                if r is not None and r < taken_a and r <= taken_b and (below is None or r < below):
                    return False
        return True

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one piece as little-endian 32-bit integers."""
        data = piece.encode().decode("latin-1")
        last, pairs = [(-1, 0)] * len(data), self.pairs
        for end, token in self.automaton.iter(data):
            if last[end][0] >= 0:
                continue
            before = end - token[1]
            if before >= 0:
                pair = (last[before][0], token[0])
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) >= MEMO_PAIRS:
                        pairs.clear()
                    fits = pairs[pair] = self.compatible(*pair)
                if not fits:
                    continue
            last[end] = token
        ids, end = [], len(data) - 1
        while end >= 0:
            ids.append(last[end][0])
            end -= last[end][1]
        return np.array(ids[::-1], "<i4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; strings of added tokens stand for these."""
        out, ids = [], self.pieces.__getitem__
        for part in self.split_added.split(text) if self.split_added else [text]:
            if part in self.added:
                out.append(np.array([self.added[part]], "<i4").tobytes())
            elif part.isascii():
                out.extend(map(ids, PIECE.findall(part)))
            else:
                cuts = [0, *(m.end() for m in PIECE.finditer(part.translate(self.classes)))]
                out.extend([ids(part[a:b]) for a, b in pairwise(cuts)])
        return np.frombuffer(b"".join(out), "<i4")

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
        return b"".join([self.bytes_of.get(i, b"") for i in ids]).decode("utf-8", "replace")


def load(path: str) -> ByteBpe:
    """The encoder of a file, made once in a process."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def round_trip(docs: DataFrame, tokenizer: str, text: str | Column = "text", name: str = "tokens") -> DataFrame:
    """docs with a column `name` (as free_name gives it): struct of `ids` and `decoded`, the text of just these ids.

    `tokenizer` is the path of a tokenizers file that all machines have. A null text is an empty one: no ids and an
    empty text. Rows are encoded one by one, so repeated rows, ties and other columns don't matter; an empty table
    gives an empty one.
    """
    from pyspark.sql.functions import arrow_udf

    @arrow_udf(RESULT)
    def done(texts: pa.Array) -> pa.Array:
        bpe = load(tokenizer)
        ids = [bpe.encode(x or "") for x in texts.to_pylist()]
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32))
        flat = pa.array(np.concatenate([*ids, np.empty(0, "<i4")]).astype(np.int32), pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, flat), pa.array([bpe.decode(x.tolist()) for x in ids], pa.string())], names=["ids", "decoded"])

    column = F.col(f"`{text}`") if isinstance(text, str) else text
    return docs.withColumn(free_name(docs, name), done(F.coalesce(column, F.lit(""))))
