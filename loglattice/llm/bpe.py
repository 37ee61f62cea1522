"""Byte-level BPE through the tokenizers library, with a bounded memo of text pieces.

A byte-level pre-tokenizer with the usual pattern always begins a new token at a space that is
followed by a non-space, between an ASCII letter and a full stop or comma, and on either side
of a lone line feed between non-spaces.  So a text cut there encodes to the concatenation of
its pieces' ids, and a piece is encoded once per worker while the memo lasts; the memo keeps the
bytes of each piece, and every hit is compared with them.  Added special
tokens hold none of these characters, so they match inside a piece as the library does by
default.  A file for which this can't be shown is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np

from loglattice.llm import textkit as tk

#: Raised with each change of this module that could change a count: counts of older encoders are not reused.
ENCODER = 2
MEMO_ENTRIES = 1_000_000
SLICE_BYTES = 3 << 20
JOINED_BYTES = 16_384

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: First bytes of the encoded Unicode spaces; what they begin is never cut off.
_MAYBE_SPACE = _SPACE.copy()
_MAYBE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_POINT = np.zeros(256, dtype=bool)
_POINT[[44, 46]] = True
_SOLID = ~_SPACE
_SOLID[0x80:] = False


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file, the library's version and ``ENCODER``: counts are only reused within it."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"\0{tokenizers.__version__}\0{ENCODER}".encode()).hexdigest()


def _cuts_hold(spec: dict) -> bool:
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    odd = any(set(t["content"]) & set(" .,\n") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens") or [])
    return bool(plain) and not spec.get("normalizer") and not odd


def piece_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pieces begin in the joined bytes of some texts."""
    n = len(buf)
    cut = np.zeros(n + 1, dtype=bool)
    if n > 1:
        cut[: n - 1] |= (buf[:-1] == 32) & ~_MAYBE_SPACE[buf[1:]]
        cut[1:n] |= _LETTER[buf[:-1]] & _POINT[buf[1:]]
    if n > 2:
        lone = (buf[1:-1] == 10) & _SOLID[buf[:-2]] & ~_MAYBE_SPACE[buf[2:]]
        cut[1 : n - 1] |= lone
        cut[2:n] |= lone
    # What was judged across a border of two texts is put right: a border is a start anyway, and
    # the byte before one, or after one, looks at its own text only.
    edge = off[(off > 0) & (off < n)]
    cut[edge - 1] &= ~((buf[edge - 1] == 32) | (buf[edge - 1] == 10))
    cut[edge[edge + 1 <= n] + 1] &= buf[edge[edge + 1 <= n]] != 10
    again = edge[edge + 1 < n]
    cut[again + 1] |= ((buf[again + 1] == 32) & ~_MAYBE_SPACE[buf[np.minimum(again + 2, n - 1)]] & (again + 2 < n)) | (_LETTER[buf[again]] & _POINT[buf[again + 1]])
    before = edge[edge >= 2] - 1
    cut[before] |= _LETTER[buf[before - 1]] & _POINT[buf[before]] & ~np.isin(before, off)
    cut[off[off < n]] = True
    return np.flatnonzero(cut[:n])


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """The array itself, or one of twice its length or more that holds ``n`` values."""
    if len(x) >= n:
        return x
    out = np.zeros(max(n, 2 * len(x)), dtype=x.dtype)
    out[: len(x)] = x
    return out


class PieceEncoder:
    """encode(buf, off) gives the ids of the texts and each text's offset into them."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.cuts = _cuts_hold(json.load(f))
        self.memo_entries = memo_entries
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.text = np.zeros(1 << 16, dtype=np.uint8)
        self.text_end = np.zeros(1 << 16, dtype=np.int64)
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.end = np.zeros(1 << 16, dtype=np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, keys: list[int], pieces: list[bytes]) -> None:
        """Encode new pieces, the space-led ones many at a time told apart by their offsets."""
        alone = [k for k, p in enumerate(pieces) if p[:1] != b" " or len(p) < 2 or _MAYBE_SPACE[p[1]]]
        out: list = [None] * len(pieces)
        for k, ids in zip(alone, self.whole([pieces[k].decode() for k in alone]), strict=True):
            out[k] = ids
        led = [k for k in range(len(pieces)) if out[k] is None]
        at = 0
        while at < len(led):
            to, size = at, 0
            while to < len(led) and (size < JOINED_BYTES or to == at):
                size += len(pieces[led[to]])
                to += 1
            part = [pieces[k].decode() for k in led[at:to]]
            e = self.tokenizer.encode("".join(part), add_special_tokens=False)
            start = np.cumsum([0] + [len(p) for p in part])
            ids = np.asarray(e.ids, dtype=np.uint32)
            cut = np.searchsorted(np.fromiter((o[0] for o in e.offsets), dtype=np.int64, count=len(ids)), start).tolist()
            for k, a, b in zip(led[at:to], cut[:-1], cut[1:], strict=True):
                out[k] = ids[a:b]
            at = to
        n = len(self.slot)
        base, text_base = (int(x[n - 1]) if n else 0 for x in (self.end, self.text_end))
        ends = base + np.cumsum([len(x) for x in out])
        text_ends = text_base + np.cumsum([len(p) for p in pieces])
        self.end, self.text_end = (_room(x, n + len(out)) for x in (self.end, self.text_end))
        self.ids, self.text = _room(self.ids, int(ends[-1])), _room(self.text, int(text_ends[-1]))
        self.end[n : n + len(out)], self.text_end[n : n + len(out)] = ends, text_ends
        self.ids[base : ends[-1]] = np.concatenate(out)
        self.text[text_base : text_ends[-1]] = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.slot.update(zip(keys, range(n, n + len(out)), strict=True))

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.cuts:
            raw = buf.tobytes()
            got = self.whole([raw[a:b].decode() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
            return np.concatenate([*got, np.zeros(0, dtype=np.uint32)]), np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)
        if not len(buf):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(off), dtype=np.int64)
        start = piece_starts(buf, off)
        size = np.diff(np.append(start, len(buf)))
        h = tk.run_hashes(buf, start, start + size)
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        keys = uniq.tolist()
        if len(self.slot) + len(keys) > self.memo_entries:
            self._clear()
        new = [k for k, x in enumerate(keys) if x not in self.slot]
        if new:
            raw = buf.tobytes()
            a = start[first[new]].tolist()
            b = (start[first[new]] + size[first[new]]).tolist()
            self._learn([keys[k] for k in new], [raw[i:j] for i, j in zip(a, b, strict=True)])
        slot = np.fromiter(map(self.slot.__getitem__, keys), dtype=np.int64, count=len(keys))
        begin, stop, text_begin, text_stop = (np.where(slot + d >= 0, x[slot + d], 0) for x in (self.end, self.text_end) for d in (-1, 0))
        count = (stop - begin)[inverse]
        ids, from_ = self.ids, begin[inverse]
        # A hash only proposes: what the memo has under it must be the piece itself.
        wrong = (text_stop - text_begin)[inverse] != size
        wrong |= ~tk.same_runs(buf, start, self.text, text_begin[inverse], np.where(wrong, 0, size))
        if wrong.any():
            raw = buf.tobytes()
            own = self.whole([raw[i : i + n].decode() for i, n in zip(start[wrong].tolist(), size[wrong].tolist(), strict=True)])
            count[wrong] = [len(x) for x in own]
            from_[wrong] = len(ids) + np.cumsum(count[wrong]) - count[wrong]
            ids = np.concatenate([ids, *own])
        out_end = np.cumsum(count)
        where = np.arange(int(out_end[-1])) + np.repeat(from_ - (out_end - count), count)
        return ids[where], np.concatenate([[0], out_end])[np.searchsorted(start, off)]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
