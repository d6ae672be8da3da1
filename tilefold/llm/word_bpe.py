"""Word-level byte-pair encoding through a table of distinct words.

Encodes exactly as a ``tokenizers`` file whose model is BPE with an end-of-word suffix over
byte-level words, and whose pre-tokenizer drops white space: no token then crosses a space, so
each distinct word is encoded once. Words of plain letters go through a rank-based merger (the
suffix becomes a byte that UTF-8 never holds); all others, and the pieces that the merger's
regular expression could see otherwise, go through the library itself.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken

from .common import chunk_array, raw_bytes, string_list
from .sentencepiece_codec import ChunkTable

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

_END = b"\xff"
#: Letters whose lower case and composed form are plain in every version of Unicode; marks of ASCII.
_SIMPLE = re.compile("[A-Za-zß-öø-ÿÀ-ÖØ-Þ!-/:-@\\[-`{-~]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[^a-zß-öø-ÿ]+?(?='s|'t|'re|'ve|'m|'ll|'d)|[^a-zß-öø-ÿ]+")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    """One worker's tokenizer and its table of words."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"]["end_of_word_suffix"]
        if not suffix:
            raise ValueError("this vocabulary has no end-of-word suffix")
        byte, special = _byte_of(), {t["content"] for t in spec["added_tokens"]}

        def raw(token: str) -> bytes:
            stem, end = (token[: -len(suffix)], _END) if token.endswith(suffix) else (token, b"")
            return bytes(byte[c] for c in stem) + end

        ranks = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.merger = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.special = tuple(special)
        self.table = ChunkTable(self._encode_many)

    def _encode_many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids: list[list[int]] = [[]] * len(words)
        hard, simple, merge = [], _SIMPLE.fullmatch, self.merger
        for i, word in enumerate(words):
            if word.isascii() and word.isalpha():
                ids[i] = merge(word.lower().encode() + _END)
            elif simple(word) and "<|" not in word and "'" not in word:
                ids[i] = [t for piece in _PIECES.findall(word.lower()) for t in merge(piece.encode() + _END)]
            elif word:
                hard.append(i)
        for i, e in zip(hard, self.library.encode_batch_fast([words[i] for i in hard], add_special_tokens=False), strict=True):
            ids[i] = e.ids
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum())), lengths

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the first id of each text (one more than texts)."""
        raw, offsets = raw_bytes(texts)
        inside = (raw != 0x20) & (raw != 0x0A)  # a part of what the tokenizer takes for white space; the rest stays in the words
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < len(raw)]] = False
        starts = np.flatnonzero(inside & ~before)
        coded = chunk_array(raw[inside], (np.cumsum(inside, dtype=np.int32) - 1)[starts]).dictionary_encode()
        rows = self.table.rows(string_list(coded.dictionary))
        ids, lengths = self.table.gather(rows[np.asarray(coded.indices)])
        return ids, np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[np.searchsorted(starts, offsets)]


_encoders: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    """The worker's encoder; it outlives a task, so tasks share the table of words."""
    if path not in _encoders:
        _encoders[path] = WordBpe(path)
    return _encoders[path]
