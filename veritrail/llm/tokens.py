"""Token ids of whole texts with a tokenizer file.

Tokenizers cut a text into pieces before they merge; a cut always lies before a
space that follows something other than white space, and around a line end
between such characters. What lies between cuts is encoded once and remembered, so common words cost a dictionary lookup. The
memory is bounded; results are those of encoding the text at once.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd

from .common import SPACE, Block, blocks, held

_SPACE_BYTE = "\u0120"  # how byte-level vocabularies write a space
_REMEMBERED = 400_000
_LONG = 64
_BLOCK = 1 << 21


def public_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_names() -> dict[int, str]:
    """How byte-level vocabularies write the bytes that are no printable Latin-1
    character: in their order, from U+0100 on."""
    odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
    return {b: chr(256 + i) for i, b in enumerate(odd)}


_BYTE_NAMES = _byte_names()


def byte_values() -> dict[str, int]:
    """The byte behind every character that byte-level vocabularies use."""
    return {_BYTE_NAMES.get(b, chr(b)): b for b in range(256)}


def encoder(file: str, special: bool = True) -> Encoder:
    """One encoder per worker process and file, so that tasks share what it
    remembers."""
    return held(f"encoder {file} {special}", lambda: Encoder(file, special))


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes. A file name without folder is
    looked up among the public tokenizers, on the executor that uses it. The
    string of a special token inside a text is that token, as the library has it,
    or plain text if `special` is false."""

    def __init__(self, file: str = "byte_bpe_50k.json", special: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(file if os.sep in file else public_path(file))
        self._tokenizer.encode_special_tokens = not special
        vocabulary = self._tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self._written = [i.to_bytes(4, "little") for i in range(size)]
        # Ids whose first byte is a space.
        self._starts = np.zeros(size, bool)
        self._starts[[i for token, i in vocabulary.items() if token.startswith(_SPACE_BYTE)]] = True
        self._tail = {c: self._ids(c.decode()).tobytes() for c in (b".", b",")}
        self._merge = self._tokenizer.model.tokenize
        self._parts: dict[bytes, bytes] = {}

    def vocabulary(self) -> dict[str, int]:
        return self._tokenizer.get_vocab()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _stem(self, stem: bytes, letters: str, spaced: bool) -> bytes:
        """Ids of Latin letters, with or without a space before, which are one
        piece, so the merges apply to them as they are."""
        found = self._parts.get(stem)
        if found is None:
            piece = letters if letters.isascii() else stem[spaced:].decode("latin-1").translate(_BYTE_NAMES)
            found = b"".join([self._written[t.id] for t in self._merge(_SPACE_BYTE + piece if spaced else piece)])
            self._parts[stem] = found
        return found

    def _learn(self, parts: list[bytes]) -> list[bytes]:
        """Ids of distinct parts. A full stop or comma behind letters is a piece
        of its own. Other parts that begin with their only space are encoded many
        in one text: every id that begins with the space byte begins a part."""
        if len(self._parts) > _REMEMBERED:
            self._parts.clear()
        known, together = self._parts, []
        for part in parts:
            if part in known:
                continue
            stem = part[:-1] if part[-1:] in self._tail else part
            spaced = part[:1] == b" "
            letters = stem[spaced:].decode()
            if letters.isalpha() and (letters.isascii() or max(letters) < "\u0250"):
                ids = self._stem(stem, letters, spaced)
                known[part] = ids + self._tail[part[-1:]] if stem is not part else ids
            elif spaced and len(part) > 1 and b" " not in part[1:]:
                together.append(part)
            else:
                known[part] = self._ids(part.decode()).tobytes()
        for i in range(0, len(together), 4096):
            some = together[i: i + 4096]
            ids = self._ids(b"".join(some).decode())
            cuts = (4 * np.append(np.flatnonzero(self._starts[ids]), len(ids))).tolist()
            ids = ids.tobytes()
            known.update((p, ids[a:b]) for p, a, b in zip(some, cuts[:-1], cuts[1:], strict=True))
        found = [known[p] for p in parts]
        for p in [p for p in parts if len(p) > _LONG]:
            known.pop(p, None)
        return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for i, j in blocks(texts, _BLOCK):
            out += self._encode(texts[i:j])
        return out

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        b = Block(texts)
        # Parts begin at cuts and at texts, and end at the next cut or text end.
        start = np.sort(np.concatenate((_cuts(b.data, b.ends), b.starts[b.ends > b.starts])), kind="stable")
        start = start[np.append(True, start[1:] != start[:-1])[: len(start)]]
        text = np.searchsorted(b.starts, start, "right") - 1
        end = np.minimum(np.append(start[1:], len(b.data)), b.ends[text])
        which, some = pd.factorize(b.hashes(start, end))
        place = np.empty(len(some), np.int64)
        place[which[::-1]] = np.arange(len(which))[::-1]
        data = b.data.tobytes()
        distinct = self._learn([data[s:e] for s, e in zip(start[place].tolist(), end[place].tolist(), strict=True)])
        size = np.fromiter(map(len, distinct), np.int64, len(distinct)) // 4
        flat = np.frombuffer(b"".join(distinct), "<u4")
        first = np.cumsum(size) - size
        lengths = size[which]
        upto = np.cumsum(lengths)
        ids = flat[np.repeat(first[which] - upto + lengths, lengths) + np.arange(upto[-1] if len(upto) else 0)].tobytes()
        ends = 4 * np.append(0, upto)[np.searchsorted(text, np.arange(len(texts) + 1))]
        return [ids[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _behind_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place is white space. Some characters
    that end like wide spaces count too, which only makes parts longer."""
    last, second, third = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    return SPACE[last] | (second == 0xC2) & ((last == 0x85) | (last == 0xA0)) | (
        np.isin(third, (0xE1, 0xE2, 0xE3)) & np.isin(second, (0x80, 0x81, 0x9A)))


def _cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places before spaces that follow something else, and before and behind
    line ends between two characters that are no white space."""
    at = np.flatnonzero(data == 32)
    at = at[at > 0]
    at = at[~_behind_space(data, at)]
    inner = data == 10
    inner[ends] = False
    line = np.flatnonzero(inner)
    line = line[line > 0]
    after = data[line + 1]
    line = line[~_behind_space(data, line) & ~SPACE[after] & ~np.isin(after, (0xC2, 0xE1, 0xE2, 0xE3))]
    return np.concatenate((at, line, line + 1))
