"""Whole-text encoding with the tokenizers library: distinct chunks of a batch are encoded once, pieces of them cached."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_PAIR = re.compile(r"\s\s")
_CUT = re.compile(r"(?<!\s)(?= \S|\n\S)")
_SIMPLE = re.compile(r"(?=[ \n])")
#: Chunks of these characters alone are cut into pieces here; the library cuts all others.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e"
_MARK = r"!-/:-@\[-`{-~"
_PLAIN = re.compile(rf"[ \n]?[{_LETTER}0-9{_MARK}]+").fullmatch
_PIECES = {
    "byte": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[{_MARK}]+|\n").findall,
    "word": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[{_MARK}]+").findall,
}
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def _byte_table() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class _Cache(dict):
    """The ids of pieces; what is missing here and in the generation before is encoded."""

    def __init__(self, encode):
        super().__init__()
        self._encode, self._before = encode, {}

    def __missing__(self, key):
        self[key] = found = self._before.get(key) or self._encode(key)
        return found

    def older(self, key):
        """The ids of a piece of the generation before, or None; it is taken over."""
        found = self._before.get(key)
        if found is not None:
            self[key] = found
        return found

    def turn(self) -> None:
        """Starts a new generation, which takes over what it uses."""
        self._before = dict(self)
        self.clear()


class ChunkEncoder:
    """Encodes texts to bytes of little-endian ids.

    The library encodes each distinct chunk once; a text's ids are those of its chunks in order. Texts are cut only where
    the tokenizer's own pre-tokenizer always ends a piece, so the ids equal those of the whole text: for a byte-level
    tokenizer before a single space or line break between two characters that are no white space; for one that drops
    white space, at any space or line break. A tokenizer of another kind encodes whole texts. Arrow cuts the texts of a
    batch and finds its distinct chunks; numpy puts their ids in the texts' order. The cache holds two generations of about
    ``limit`` pieces of chunks. With ``added``, literals of the tokenizer's added tokens become those
    tokens, as is the library's default; a text that holds one is encoded whole. Without, they are plain text.
    """

    def __init__(self, path: str, limit: int = 400_000, added: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        parts = pre.get("pretokenizers", [{}])
        self.kind = "plain"
        if normal is None and pre == _BYTE_LEVEL:
            self.kind = "byte"
        elif parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and r"[^\s\p{L}\p{N}]+" in parts[0]["pattern"].get("Regex", ""):
            self.kind = "word"
        literals = [t for t in spec.get("added_tokens") or [] if added]
        if normal is not None and any(t.get("normalized") for t in literals):
            self.kind = "plain"  # the literal may arise from normalizing alone
        self.literals = [t["content"] for t in literals]
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.code = {2: "H", 4: "I"}[self.width]
        self.limit, self.table, self.model = limit, _byte_table(), self.tokenizer.model
        self.pieces = _Cache(self._piece)
        self.marks = {m: self._direct([m])[0] for m in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"} if self.kind != "plain" else {}

    def _piece(self, piece: str) -> bytes:
        if piece.isalpha() and piece.isascii():
            shown = piece
        elif piece[0] == " " and piece[1:].isalpha() and piece.isascii():
            shown = "\u0120" + piece[1:]  # the space's printable character
        else:
            shown = piece.encode().decode("latin-1").translate(self.table)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _known(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks. Most are a cached piece, or one of letters and a mark after it."""
        get, older, mark_of, lower, out = self.pieces.get, self.pieces.older, self.marks.get, self.kind == "word", []
        for c in chunks:
            if lower and c.isascii():
                c = c.lower()
            mark = mark_of(c[-1:])
            if mark is not None and c[-2:-1].isalpha():
                found = get(c[:-1]) or older(c[:-1])
                found = found and found + mark
            else:
                found = get(c) or older(c)
            out.append(found or self._chunk(c))
        return out

    def _chunk(self, chunk: str) -> bytes:
        if not _PLAIN(chunk):
            return self._direct([chunk])[0]
        found = _PIECES[self.kind](chunk.lower() if self.kind == "word" else chunk)
        return self.pieces[found[0]] if len(found) == 1 else b"".join(map(self.pieces.__getitem__, found))

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The chunks of all texts in order, and how many the first i texts have."""
        x = pa.array(texts, pa.large_string())
        if self.kind == "word":
            x = pc.split_pattern(pc.replace_substring(x, "\n", " "), " ")
        else:
            odd = ["\0" in t or _PAIR.search(t) is not None for t in texts]
            if any(odd):
                x = pa.array([_CUT.split(t) if o else _SIMPLE.split(t) for t, o in zip(texts, odd, strict=True)], pa.large_list(pa.large_string()))
            else:
                x = pc.split_pattern(pc.replace_substring(pc.replace_substring(x, " ", "\0 "), "\n", "\0\n"), "\0")
        return x.flatten(), np.append(0, np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False)))

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and where those of each text start (and the end)."""
        chunks, at = self._cut(texts)
        coded = chunks.dictionary_encode()
        known = self._known(coded.dictionary.to_pylist())
        ids, sizes = np.frombuffer(b"".join(known), dtype=f"<u{self.width}"), np.fromiter(map(len, known), np.int64, len(known)) // self.width
        index = coded.indices.to_numpy()
        n = sizes[index]
        ends = np.append(0, np.cumsum(n))
        # each chunk's ids start at first[index]; the place in the output less that of the chunk's start is added
        out = ids[np.repeat((np.cumsum(sizes) - sizes)[index] - ends[:-1], n) + np.arange(ends[-1])]
        return out, ends[at]

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and where those of each text start (and the end); null counts as empty."""
        texts = [t or "" for t in texts]
        if self.kind != "plain":
            if len(self.pieces) > self.limit:
                self.pieces.turn()
            whole = [i for i, t in enumerate(texts) if any(x in t for x in self.literals)]
            if not whole:
                return self._batch(texts)
            flat, at = self._batch([t if i not in set(whole) else "" for i, t in enumerate(texts)])
            each = [flat[s:e].tobytes() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            for i, ids in zip(whole, self._direct([texts[i] for i in whole]), strict=True):
                each[i] = ids
        else:
            each = self._direct(texts)
        at = np.append(0, np.cumsum([len(x) // self.width for x in each], dtype=np.int64))
        return np.frombuffer(b"".join(each), dtype=f"<u{self.width}"), at

    def forget(self) -> None:
        """Drops the cached pieces, so that a worker without a task holds the tokenizer alone."""
        self.pieces = _Cache(self._piece)
        pa.default_memory_pool().release_unused()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        flat, at = self.encode_flat(texts)
        return [flat[s:e].tobytes() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_ENCODERS: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, limit: int = 400_000, added: bool = False) -> ChunkEncoder:
    """One encoder per Python worker, path and ``added``; ``limit`` bounds its cache."""
    if (path, added) not in _ENCODERS:
        _ENCODERS[path, added] = ChunkEncoder(path, limit, added)
    return _ENCODERS[path, added]
