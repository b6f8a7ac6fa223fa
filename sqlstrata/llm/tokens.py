"""Whole-text token ids at the cost of the distinct chunks only.

A text is cut before a blank that follows a visible ASCII character or a
Latin-1 letter, and between a letter and a sign such as ``,`` or ``.``. Neither
public vocabulary forms a token across such a point (their pre-tokenizers match
blanks, then one run of letters, digits or signs), so the ids of a text are the
ids of its chunks in a row. Arrow finds the distinct chunks of a slice, the
library encodes those not remembered, and numpy strings the ids together.

A chunk of letters with at most one blank before them is one run for the
pre-tokenizer; such chunks go to the library's model at once, in the byte
alphabet that its pre-tokenizer would have given them.

Rows that hold the string of an added token (``<|endoftext|>``) go to the
library whole, which finds such strings before it cuts anything.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from sqlstrata.llm.common import give_back

_BLANK = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
_LETTER = [*range(0x41, 0x5B), *range(0x61, 0x7B)]
_SIGN = [ord(c) for c in r'!"#$%&()*+,-./:;<=>?@[\]^_`{|}~']  # no apostrophe: it begins 's and the like
_LATIN = [x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]  # second byte of a Latin-1 letter (no times, no division)


def _table(bits: dict[int, list[int]]) -> bytes:
    """For ``bytes.translate``: the sum of the bits of each byte value."""
    return bytes(sum(bit for bit, values in bits.items() if x in values) for x in range(256))


# what a byte is (low bits), and before what it ends a chunk (the same bits, four higher)
_CUT = _table({1: _BLANK, 2: _SIGN, 4: [0xC3], 16: [*range(0x21, 0x7F)], 32: _LETTER, 64: _LATIN})
# a byte of a run of letters: a letter, the first and the second byte of a Latin-1 letter
_PART = _table({1: _LETTER, 2: [0xC3], 4: _LATIN})
_FOLD = bytes(0x20 if x in _BLANK else x + 0x20 if 0x41 <= x < 0x5B else x for x in range(256))

#: Distinct chunks of a generation. A worker remembers two generations: the
#: chunks met since the last change, and those of the one before.
MEMORY = 200_000

# the byte alphabet of byte-level vocabularies (a fixed rule: printable bytes
# stand for themselves, the others follow from 256 on)
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHER = [x for x in range(256) if x not in _SELF]
_ALPHABET = np.arange(256, dtype="<u4")
_ALPHABET[_OTHER] = 256 + np.arange(len(_OTHER))


def chunk_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """First bytes of the chunks of all rows."""
    start = np.zeros(len(data), bool)
    is_a = np.frombuffer(data.tobytes().translate(_CUT), np.uint8)
    ends = is_a >> 4
    start[1:] = (is_a[1:] & ends[:-1] & 3) != 0
    if len(data) > 2:
        start[2:] |= ((is_a[:-2] & ends[1:-1] & 4) != 0) & ((is_a[2:] & 3) != 0)
    start[off[:-1][off[:-1] < off[1:]]] = True
    return np.flatnonzero(start)


def _runs(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which chunks are a run of ASCII and Latin-1 letters, with one space or
    none before it. No chunk is empty."""
    part = np.frombuffer(data.tobytes().translate(_PART), np.uint8)
    fits = (part & 1) != 0
    pair = (part[:-1] & 2 != 0) & (part[1:] & 4 != 0)
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    pair &= ~cut[1:-1]
    fits[:-1] |= pair
    fits[1:] |= pair
    letters = np.diff(np.concatenate([[0], np.cumsum(fits)])[off])
    first = data[off[:-1]] == 0x20
    return (letters > 0) & (letters + first == np.diff(off))


def _cut(data: bytes, off: np.ndarray) -> list[bytes]:
    at = off.tolist()
    return [data[a:b] for a, b in zip(at, at[1:])]


class Encoder:
    """Ids of UTF-8 rows by one tokenizer file, ``add_special_tokens=False``.
    With ``added`` the strings of added tokens in a text are those tokens, as
    the library has it; without, special tokens' strings are ordinary text."""

    def __init__(self, path: str, memory: int = MEMORY, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        # a vocabulary that lower-cases drops blanks too: its chunks fold
        self.fold = "Lowercase" in json.dumps(kind["normalizer"])
        self.model = None
        if "ByteLevel" in json.dumps(kind["pre_tokenizer"]):
            self.model = self.tok.model
        tokens = kind["added_tokens"] if added else []
        self.added = [t["content"].encode("utf-8") for t in tokens]
        self.anywhere = any(t["normalized"] for t in tokens)  # found in normalized text: no row is known not to hold one
        self.memory = memory
        self.old: dict[bytes, bytes] = {}  # ids as little-endian words
        self.new: dict[bytes, bytes] = {}

    def _ids(self, raw: list[bytes]) -> list[bytes]:
        """Ids of chunks, as little-endian words."""
        if not raw:
            return []
        data = np.frombuffer(b"".join(raw), np.uint8)
        off = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])
        run = _runs(data, off) if self.model is not None else np.zeros(len(raw), bool)
        ids: list[int] = []
        n = np.zeros(len(raw), np.int64)
        n[run] = self._model_ids(data, off, run, ids)
        rest = np.flatnonzero(~run)
        slow = rest.tolist()
        for at in range(0, len(slow), 4096):
            words = [raw[i].decode("utf-8") for i in slow[at:at + 4096]]
            found = [e.ids for e in self.tok.encode_batch(words, add_special_tokens=False)]
            n[rest[at:at + 4096]] = [len(x) for x in found]
            for x in found:
                ids += x
        order = np.concatenate([np.flatnonzero(run), rest])
        out = np.empty(len(raw), object)
        out[order] = _cut(np.array(ids, "<u4").tobytes(), 4 * np.concatenate([[0], np.cumsum(n[order])]))
        return out.tolist()

    def _model_ids(self, data: np.ndarray, off: np.ndarray, run: np.ndarray, ids: list[int]) -> list[int]:
        """Append the ids of runs of letters; the number of ids of each."""
        if not run.any():
            return []
        keep = np.repeat(run, np.diff(off))
        begin = data[off[:-1]] == 0x20
        size = np.diff(off)[run]
        if self.fold:
            keep[off[:-1][begin]] = False
            size -= begin[run]
        text = data[keep]
        if self.fold:
            second = np.flatnonzero(text[:-1] == 0xC3) + 1
            second = second[text[second] < 0x9F]  # capital letters
            text[second] += 0x20
        letters = _ALPHABET[text].tobytes().decode("utf-32-le")
        ends = np.cumsum(size)
        tokenize, n = self.model.tokenize, []
        for a, b in zip((ends - size).tolist(), ends.tolist()):
            found = tokenize(letters[a:b])
            ids += [t.id for t in found]
            n.append(len(found))
        return n

    def _look_up(self, chunks: list[bytes]) -> list[bytes]:
        if len(self.new) > self.memory:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        known, unknown = list(map(new.get, chunks)), []
        for i, x in enumerate(known):
            if x is None:
                c = chunks[i]
                known[i] = x = old.get(c)
                if x is None:
                    unknown.append(i)
                else:
                    new[c] = x
        for i, x in zip(unknown, self._ids([chunks[i] for i in unknown])):
            new[chunks[i]] = known[i] = x
        return known

    def _holds_added(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = np.full(len(off) - 1, self.anywhere)
        raw = data.tobytes() if self.added and not self.anywhere else b""
        for x in self.added:
            at = raw.find(x)
            while at >= 0:
                row = int(np.searchsorted(off, at, side="right")) - 1
                out[row] |= at + len(x) <= off[row + 1]
                at = raw.find(x, at + 1)
        return out

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in a row, number of ids of each row)."""
        whole = self._holds_added(data, off)
        if not whole.any():
            return self._encode_chunks(data, off)
        size = np.diff(off)
        texts = [data[off[i]:off[i + 1]].tobytes().decode("utf-8") for i in np.flatnonzero(whole).tolist()]
        self.tok.encode_special_tokens = False
        found = [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        self.tok.encode_special_tokens = True
        rest, n_rest = self._encode_chunks(data[np.repeat(~whole, size)], np.append(0, np.cumsum(size[~whole])))
        n = np.zeros(len(size), np.int64)
        n[whole], n[~whole] = [len(x) for x in found], n_rest
        ids, there = np.zeros(int(n.sum()), np.uint32), np.repeat(whole, n)
        ids[there], ids[~there] = np.array([i for x in found for i in x], np.uint32), rest
        return ids, n

    def _encode_chunks(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(off) - 1
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        s = chunk_starts(data, off)
        text = data.tobytes().translate(_FOLD) if self.fold else np.ascontiguousarray(data)
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(np.append(s, len(data))), pa.py_buffer(text)])
        coded = chunks.dictionary_encode()
        _, at, distinct = coded.dictionary.buffers()
        known = self._look_up(_cut(distinct.to_pybytes(), np.frombuffer(at, np.int64, len(coded.dictionary) + 1)))
        edges = np.zeros(len(known) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, known), np.int32, len(known)), out=edges[1:])
        values = pa.array(np.frombuffer(b"".join(known), np.uint32))
        taken = pa.ListArray.from_arrays(pa.array(edges // 4), values).take(coded.indices)
        ids = taken.flatten().to_numpy()
        ends = taken.offsets.to_numpy()[1:].astype(np.int64) - taken.offsets[0].as_py()
        cum = np.concatenate([[0], ends])
        edge = cum[np.searchsorted(s, off, side="left")]
        return ids, np.diff(edge)

    def rest(self) -> None:
        """Between tasks a worker remembers the ids of recent chunks only."""
        self.old = {}
        give_back()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, memory: int = MEMORY) -> Encoder:
    """One encoder per worker process and file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, memory, added=True)
    return _ENCODERS[path]


def release(path: str) -> None:
    """Forget the encoder of a file. A worker that goes on with other work
    would hold its vocabulary and chunks, and loading them again is short."""
    _ENCODERS.pop(path, None)
    give_back()


def public_path(name: str) -> str:
    """Where the installed vocabulary ``name`` lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
