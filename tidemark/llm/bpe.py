"""Byte-pair encoding by a trie over distinct words, and decoding.

A greedy merge encoder does the same work again for every word and every shared prefix. Here the
distinct words of a piece of a batch go into one trie, and a depth-first walk gives each prefix one
state: the last token of the prefix's encoding. A token may end a prefix exactly when it is *stable*
next to the last token of what precedes it (no merge of their boundary symbols would have fired
earlier), and exactly one token qualifies. So a prefix that many words share is encoded once, and
a word's ids are read by stepping back from its last state.

The tokenizer file is a parameter; it is read on the executors (``SparkContext.addFile`` ships it)
and never copied into the package.
"""

from __future__ import annotations

import json
import os
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import pieces

#: The code points with the Unicode property White_Space.
WHITE_SPACE = r"\t-\r \x85\xa0  -     　"
#: Distinct words and pairs a task remembers between pieces; the memory is emptied when full, results never change.
REMEMBERED_WORDS = 250_000
REMEMBERED_PAIRS = 400_000
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file defines, with the stability test for neighbouring tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self._require(spec, model)
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.id_of: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for r, (a, b) in enumerate(pairs):
            made = self.id_of[a + b]
            self.rank[self.id_of[a], self.id_of[b]] = r
            self.parts[made], self.born[made] = (self.id_of[a], self.id_of[b]), r
        self._index_tokens()
        self._stable: dict[int, bool] = {}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"[^\s", "[^" + WHITE_SPACE).replace(r"\s", f"[{WHITE_SPACE}]"))
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    @staticmethod
    def _require(spec: dict, model: dict) -> None:
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec.get("decoder"):
            raise ValueError("this encoder reads word-level BPE files with NFC, white-space and lower-case normalizers")

    def _spine(self, token: int, side: int) -> list[tuple[int, float, float]]:
        """(symbol, birth, end) of what stands at one edge of a token while its merges run."""
        out, end = [], float("inf")
        while True:
            born = self.born.get(token, -1)
            out.append((token, born, end))
            if born < 0:
                return out
            token, end = self.parts[token][side], born

    def stable(self, left: int, right: int) -> bool:
        """True if encoding the joined symbols of both tokens gives back these two tokens.

        A merge across the boundary fires while both edge symbols exist; of equal rules the
        leftmost fires first, so the boundary loses a tie to its left and wins one to its right.
        """
        key = (left << 32) | right
        known = self._stable.get(key)
        if known is None:
            rank, known = self.rank, True
            for x, born_x, end_x in self._spine(left, 1):
                for y, born_y, end_y in self._spine(right, 0):
                    r = rank.get((x, y))
                    if r is not None and r > born_x and r > born_y and r < end_x and r <= end_y:
                        known = False
            if len(self._stable) > REMEMBERED_PAIRS:
                self._stable.clear()
            self._stable[key] = known
        return known

    def forget(self) -> None:
        """Drop the remembered pairs."""
        self._stable = {}

    def segments(self, text: str) -> Iterator[str | int]:
        """The text's words after normalization, and the ids of special tokens written in it."""
        for k, part in enumerate(self.marks.split(text) if self.marks else [text]):
            if k % 2:
                yield self.special[part]
            elif part:
                part = unicodedata.normalize("NFC", part)
                yield from self.words.findall("".join(c.lower() for c in part) if "Σ" in part else part.lower())

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words as little-endian 32-bit integers, by one depth-first walk of their trie.

        Sorted words list a trie in depth-first order: the walk steps back to the node that the next
        word shares with the last one and goes down from there. Each node on the current path keeps
        its last token, where that token starts, and which starts some longer token could still use.
        The last byte of a word is a leaf of its own, as only tokens with the word-end mark end there.
        """
        step, token_at, final_at = self.step, self.token_at, self.final_at
        known, stable = self._stable, self.stable
        done: dict[str, bytes] = {}
        last, back, open_at = [-1], [0], [[(0, 0)]]
        path = b""
        for code, word in sorted((w.encode("utf-8"), w) for w in words):
            inner = len(code) - 1
            shared, most = 0, min(inner, len(last) - 1)
            while shared < most and code[shared] == path[shared]:
                shared += 1
            del last[shared + 1 :], back[shared + 1 :], open_at[shared + 1 :]
            path = code
            for depth in range(shared, inner + 1):
                byte, chosen, still_open = code[depth], -1, []
                ending = token_at if depth < inner else final_at
                for start, node in open_at[depth]:
                    node = step.get(node << 8 | byte)
                    if node is not None:
                        still_open.append((start, node))
                        token = ending[node]
                        if chosen < 0 <= token:
                            if start:
                                fits = known.get(last[start] << 32 | token)
                                if fits is None:
                                    fits = stable(last[start], token)
                            if not start or fits:
                                chosen, came = token, start
                if chosen < 0:
                    raise ValueError(f"no token of the vocabulary ends {code[: depth + 1]!r}")
                if depth < inner:
                    last.append(chosen)
                    back.append(came)
                    still_open.append((depth + 1, 0))
                    open_at.append(still_open)
            ids = [chosen]
            while came:
                ids.append(last[came])
                came = back[came]
            done[word] = array("I", ids[::-1]).tobytes() if LITTLE else np.array(ids[::-1], "<u4").tobytes()
        return done

    def _index_tokens(self) -> None:
        """The trie of the vocabulary's own tokens, over bytes: steps and the token that ends at each node."""
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        self.step: dict[int, int] = {}
        self.token_at, self.final_at = [-1], [-1]
        for token, i in self.id_of.items():
            final = bool(self.suffix) and token.endswith(self.suffix)
            node = 0
            for s in token[: len(token) - len(self.suffix)] if final else token:
                key = node << 8 | byte_of[s]
                node = self.step.setdefault(key, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(-1)
                    self.final_at.append(-1)
            (self.final_at if final else self.token_at)[node] = i
        if not self.suffix:
            self.final_at = self.token_at


_loaded: dict[str, Vocabulary] = {}
_token_lists: dict[str, list[str]] = {}


def _local(path: str) -> str:
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def _vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(_local(path))
    return _loaded[path]


def _tokens(path: str) -> list[str]:
    """The tokens by id; decoding needs no more of the file."""
    if path not in _token_lists:
        with open(_local(path), encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec["added_tokens"]}
        tokens = [""] * (1 + max(ids.values()))
        for token, i in ids.items():
            tokens[i] = token
        _token_lists[path] = tokens
    return _token_lists[path]


def _parts(column: pa.Array) -> Iterator[pa.Array]:
    """A batch in parts of about half a megabyte, so that a worker holds no more results than that."""
    arr = column.cast(pa.large_binary())
    sizes = pc.fill_null(pc.binary_length(arr), 0).to_numpy()
    for i, j in pieces(np.concatenate([[0], np.cumsum(sizes)])):
        yield column.slice(i, j - i)


def encode_text(vocabulary: Vocabulary, memory: dict[str, bytes], texts: list[str]) -> list[bytes]:
    """Packed ids of each text. ``memory``: encodings kept between calls."""
    split = [list(vocabulary.segments(t)) for t in texts]
    new = {w for words in split for w in words if w not in memory and isinstance(w, str)}
    if len(memory) + len(new) > REMEMBERED_WORDS:
        memory.clear()
        new = {w for words in split for w in words if isinstance(w, str)}
    memory.update(vocabulary.encode_words(sorted(new)))
    for i in vocabulary.special.values():
        memory[i] = int(i).to_bytes(4, "little")
    return [b"".join(map(memory.__getitem__, words)) for words in split]


def encode(text: Column | str, path: str, df: DataFrame) -> Column:
    """The text's token ids, packed as little-endian unsigned 32-bit integers.

    Null counts as empty, and an empty text has no ids. Equal texts get equal ids.
    """
    df.sparkSession.sparkContext.addFile(path)

    @F.arrow_udf("binary")
    def packed_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary, memory = _vocabulary(path), {}
        try:
            for column in batches:
                for part in _parts(column):
                    yield pa.array(encode_text(vocabulary, memory, [t or "" for t in part.to_pylist()]), pa.binary())
        finally:  # a worker outlives its task, what the task remembered does not
            vocabulary.forget()

    return packed_ids(F.col(text) if isinstance(text, str) else text)


def decode(ids: Column | str, path: str, df: DataFrame) -> Column:
    """The text that packed ids stand for: their tokens, special ones too, joined by spaces."""
    df.sparkSession.sparkContext.addFile(path)

    @F.arrow_udf("string")
    def joined_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token_of = _tokens(path)
        for column in batches:
            for part in _parts(column):
                yield pa.array([" ".join(map(token_of.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in part.to_pylist()], pa.string())

    return joined_tokens(F.col(ids) if isinstance(ids, str) else ids)
