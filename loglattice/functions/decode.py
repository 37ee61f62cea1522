"""Encoded strings in text: base64, hex, URL, rotation, base58, Unicode escapes, single-byte XOR.

``scan`` is a plain function; ``decoded`` applies it to a column in Arrow batches, since trying
rotations and XOR keys is not expressible with built-in functions.
"""

from __future__ import annotations

import base64
import binascii
import functools
import re
import string
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_CONFIDENCE = 0.5
RESULT = "array<struct<encoder:string,original:string,decoded:string,confidence:double,notes:string>>"
_B58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_COMMON = ("http", "the ", "exe", "cmd", "powershell", "select ", "password", "user", "invoke", "script", "file", "flag", "hello", " and ")
#: Words that match the base64 pattern but are names of programs and settings.
_NOT_BASE64 = frozenset(
    "undefined null true false nan inf infinity base64 base58 encode decode string buffer length format value values object number status public private static "
    "import export default extends return throws throw class const finally instance interface namespace package require exception typeerror referenceerror "
    "syntaxerror assertionerror attributeerror keyerror valueerror zerodivisionerror localhost password username session timeout".split()
)
#: Frequent words that are not tried for a rotation.
_NOT_ROTATED = frozenset(
    "the and for are but not you all any can had her was one our out has have been some them than that this very just also more over such will with would could "
    "should from they what when where which their there each made said does down take into your then many".split()
)
#: Characters of a short token.
_SHORT = 64
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})")
_PERCENT = re.compile(r"%[0-9a-fA-F]{2}")

_PRINTABLE = string.printable.encode()
_PLAIN = (string.ascii_letters + string.digits + " ./:-_").encode()
_ENGLISH = b"etaoinshrdluETAOINSHRDLU "
_LETTERS = string.ascii_lowercase
_TURNED = [_LETTERS[k:] + _LETTERS[:k] for k in range(26)]
_TURN = [str.maketrans(_LETTERS + _LETTERS.upper(), t + t.upper()) for t in _TURNED]
#: For each rotation the letters that it turns into frequent ones.
_TO_ENGLISH = [bytes(c for c in _LETTERS.encode() if t[c - 97].encode() in _ENGLISH) for t in _TURNED]
#: What five telling words look like before they are rotated by k.
_ROTATED = {w.translate(_TURN[-k % 26]): k for k in range(25, 0, -1) for w in ("http", "powershell", "password", "flag{", "hello")}
_ROTATED_RE = re.compile("|".join(map(re.escape, _ROTATED)))


def _keyed(*weights: tuple[float, Iterable[int]]) -> np.ndarray:
    """For each key and byte, the weight of the byte under the key."""
    w = np.zeros(256)
    for x, some in weights:
        w[list(some)] = x
    return w[np.arange(256)[:, None] ^ np.arange(256)]


_KEY = [bytes(b ^ k for b in range(256)) for k in range(256)]
_KEY_PRINTABLE, _KEY_PLAIN, _KEY_ENGLISH = _keyed((1, _PRINTABLE)), _keyed((1, _PLAIN)), _keyed((1, _ENGLISH))
#: Bytes of printable ASCII; those of longer UTF-8 characters; and the balance of these, 0 where each first byte has its others.
_KEY_ASCII, _KEY_LONG = _keyed((1, range(0x20, 0x7F))), _keyed((1, [*range(0x80, 0xC0), *range(0xC2, 0xF5)]))
_KEY_BALANCE = _keyed((1, range(0x80, 0xC0)), (-1, range(0xC2, 0xE0)), (-2, range(0xE0, 0xF0)), (-3, range(0xF0, 0xF5)))


def readable(text: str) -> float:
    """The share of printable ASCII, with a bonus for words that commands and prose hold."""
    if not text:
        return 0.0
    plain = text.encode("ascii", "ignore")
    share = (len(plain) - len(plain.translate(None, _PRINTABLE))) / len(text)
    if share <= 0.85:
        return 0.0
    letters = (len(plain) - len(plain.translate(None, _PLAIN)) + sum(c.isalnum() for c in text if c > "\x7f")) / len(text)
    return min(1.0, 0.5 * share * share + 0.35 * letters + (0.15 if _telling(text) else 0.0))


def _telling(text: str) -> bool:
    low = text.lower()
    return any(w in low for w in _COMMON)


def _wide(raw: bytes) -> bool:
    return len(raw) > 3 and raw[1::2].count(0) > len(raw) * 0.4


def _text(raw: bytes) -> str:
    return raw.decode("utf-16-le" if _wide(raw) else "utf-8", "replace")


def _strict(raw: bytes) -> str | None:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


def _b64(s: str) -> bytes | None:
    try:
        return base64.b64decode(s.replace("-", "+").replace("_", "/") + "=" * (-len(s) % 4))
    except (binascii.Error, ValueError):
        return None


def _base58_number(s: str) -> int:
    """The number that the digits spell; long ones are halved, as the work grows with the square."""
    if len(s) > 256:
        half = len(s) // 2
        return _base58_number(s[:-half]) * 58**half + _base58_number(s[-half:])
    n = 0
    for c in s:
        n = n * 58 + _B58.index(c)
    return n


def _base58(s: str) -> bytes:
    n = _base58_number(s)
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def _xor(raw: bytes) -> tuple[int, str, float] | None:
    """The single-byte key whose text is printable throughout and most like English, or that reads best.

    Keys are ruled out by how often each byte occurs; the texts of the others are read whole.
    """
    if not raw:
        return None
    at = np.frombuffer(raw, dtype=np.uint8)
    count = np.bincount(at, minlength=256)

    def over(weights: np.ndarray) -> np.ndarray:
        """For each key the sum of the weights; they are symmetric."""
        return weights[at].sum(axis=0) if len(at) <= _SHORT else weights @ count

    plain, long = over(_KEY_ASCII), over(_KEY_LONG)
    best = (-1.0, 0)
    whole = np.flatnonzero(plain == len(raw))
    if len(whole):
        english = over(_KEY_ENGLISH)[whole] / len(raw)
        best = (float(english.max()), -int(whole[english.argmax()]))
    for k in np.flatnonzero((long > 0) & (plain + long == len(raw)) & (over(_KEY_BALANCE) == 0)).tolist():
        under = raw.translate(_KEY[k])
        text = _strict(under)
        if text is not None and text.isprintable():
            best = max(best, ((len(under) - len(under.translate(None, _ENGLISH))) / len(text), -k))
    first = None
    if best[0] >= 0 and -best[1] not in (0, 255):
        first = (-best[1], raw.translate(_KEY[-best[1]]).decode(), 0.7)
    # Line breaks, UTF-16 and a few odd bytes: by readability, where no text was found or only this one has a telling word.
    if len(raw) < 8 or _telling(_text(raw)) or (first and _telling(first[1])):
        return first
    keys = np.flatnonzero(0.5 * (over(_KEY_PRINTABLE) / len(raw)) ** 2 + 0.35 * (over(_KEY_PLAIN) / len(raw)) >= 0.6)
    keys = {*keys.tolist(), Counter(raw[1::2]).most_common(1)[0][0]} - {0, 255}
    score, key = max((readable(_text(raw.translate(_KEY[k]))), k) for k in keys) if keys else (0.0, 0)
    text = _text(raw.translate(_KEY[key]))
    return (key, text, score * 0.9) if score >= 0.8 and (best[0] < 0 or _telling(text)) else first


def _rotation(word: str) -> tuple[int, str, float] | None:
    """The rotation of a word, all upper, lower or title case, that makes its letters much more like English."""
    if word.lower() in _NOT_ROTATED or not (word.isupper() or word[1:].islower()):
        return None
    low = word.lower().encode()
    if 1 - len(low.translate(None, _ENGLISH)) / len(low) >= 0.55:
        return None
    score = [(len(low) - len(low.translate(None, t))) / len(low) for t in _TO_ENGLISH]
    best = max(range(26), key=lambda k: score[k])
    gain = score[best] - score[0]
    if gain <= 0.25 or score[best] <= 0.45:
        return None
    return best, word.translate(_TURN[best]), min(0.9, 0.4 + score[best] * 0.4 + gain * 0.2)


def _resolve(text: str) -> str:
    """Escapes replaced by their characters; a surrogate without its partner by the replacement character."""
    found = _ESCAPE.sub(lambda x: chr(int(x[1] or x[2], 16)), text)
    return found.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _bytes_of(encoder: str, s: str, raw: bytes) -> list[tuple]:
    """The findings of a token and the bytes that it stands for: its text, and what is under a key."""
    found = []
    text = _strict(raw)
    confidence = {"hex": 0.8, "base58": 0.6}.get(encoder, 0.9)
    if _wide(raw):
        found.append((encoder, s, _text(raw), max(confidence, readable(_text(raw))), ""))
    elif text is not None:
        if encoder in ("hex", "base58") or any(c.isprintable() for c in text):
            found.append((encoder, s, text, max(confidence, readable(text)), ""))
    elif (r := readable(_text(raw)) - (0.1 if encoder == "base58" else 0)) >= MIN_CONFIDENCE:
        found.append((encoder, s, _text(raw), r, ""))
    elif encoder in ("base64", "base64url"):
        found.append((encoder, s, raw.hex(), 0.5, "binary data"))
    return found


def _base64_token(s: str) -> list[tuple]:
    raw = _b64(s)
    if not raw:
        return []
    bare = s.rstrip("=")
    url = "-" in s or "_" in s
    known = (s.isalpha() and len(s) < 16) or bare.lower() in _NOT_BASE64
    found = [] if known else _bytes_of("base64url" if url else "base64", s, raw)
    if x := _xor(raw):
        found.append(("xor", raw.hex(), x[1], x[2], f"key 0x{x[0]:02x} over base64"))
    return found


def _hex_token(s: str) -> list[tuple]:
    raw = bytes.fromhex(s[2:] if s[:2] == "0x" else s)
    found = _bytes_of("hex", s, raw)
    if len(raw) >= 8 and (x := _xor(raw)):
        found.append(("xor", raw.hex(), x[1], x[2], f"key 0x{x[0]:02x} over hex"))
    return found


def _base58_token(s: str) -> list[tuple]:
    return _bytes_of("base58", s, _base58(s))


def _rotation_word(s: str) -> list[tuple]:
    r = _rotation(s)
    return [("rot", s, r[1], r[2], f"rotated by {r[0]}")] if r else []


#: What short tokens hold is kept, as they recur.
_kept = {f: functools.lru_cache(1 << 16)(f) for f in (_base64_token, _hex_token, _base58_token, _rotation_word)}


def scan(text: str | None) -> list[dict]:
    """Findings of at least MIN_CONFIDENCE, one per encoder and original, the surest first.

    A run of words may hold several rotations: each is a finding.
    """
    if not text:
        return []
    found: dict[tuple[str, str, str], dict] = {}

    def add(encoder: str, original: str, decoded: str, confidence: float, notes: str = "") -> None:
        key = (encoder, original, notes if encoder == "rot" else "")
        if confidence >= MIN_CONFIDENCE and decoded != original and (key not in found or confidence > found[key]["confidence"]):
            found[key] = {"encoder": encoder, "original": original, "decoded": decoded, "confidence": round(min(1.0, confidence), 3), "notes": notes}

    def each(pattern: str, decode: Callable[[str], list[tuple]], fits: Callable[[str], bool] = lambda s: True) -> None:
        for s in {m[0]: None for m in re.finditer(pattern, text)}:
            if fits(s):
                for x in (_kept[decode] if len(s) <= _SHORT else decode)(s):
                    add(*x)

    each(r"[A-Za-z0-9+/]{8,}={0,2}", _base64_token)
    each(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{8,}={0,2}(?![A-Za-z0-9+/_=-])", _base64_token, lambda s: "-" in s or "_" in s)
    each(r"(?:0x)?[0-9a-fA-F]{12,}", _hex_token, lambda s: len(s) % 2 == 0)
    each(rf"[{_B58}]{{20,}}", _base58_token)
    each(rf"(?<![A-Za-z0-9])[{_B58}]{{16,19}}(?![A-Za-z0-9])", _base58_token, lambda s: not re.fullmatch(r"[0-9a-fA-F]+", s) and readable(_text(_base58(s))) >= MIN_CONFIDENCE + 0.1)
    each(r"[A-Za-z]{4,}", _rotation_word)
    if len(_PERCENT.findall(text)) >= 2:
        add("url", text, unquote(text), 0.95)
        for s in re.findall(r"\S+", text):
            if "%" in s and len(_PERCENT.findall(s)) >= 2:
                add("url", s, unquote(s), 0.5 + readable(unquote(s)) / 2)
    if len(_ESCAPE.findall(text)) >= 2:
        add("unicode", text, _resolve(text), 0.9)
        for m in re.finditer(r"(?:\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}){2,}", text):
            add("unicode", m[0], _resolve(m[0]), 0.5 + readable(_resolve(m[0])) / 2)
    if _ROTATED_RE.search(text.lower()):
        for m in re.finditer(r"[A-Za-z][A-Za-z :/.{}_-]{7,}", text):
            for k in sorted({_ROTATED[w] for w in _ROTATED if w in m[0].lower()}):
                add("rot", m[0], m[0].translate(_TURN[k]), 0.6, f"rotated by {k}")
    return sorted(found.values(), key=lambda x: (-x["confidence"], x["encoder"], x["original"], x["notes"]))


def decoded(c: Column) -> Column:
    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(scan)

    return run(c)


def scan_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """A row per finding with the field that it is in, and the other columns."""
    out = None
    for f in fields:
        part = df.withColumn("__d", F.explode(decoded(F.col(f"`{f}`").cast("string")))).withColumn("field", F.lit(f)).select(*df.columns, "field", "__d.*")
        out = part if out is None else out.unionByName(part)
    return out


def frequencies(rows: list[dict]) -> Counter:
    return Counter(r["encoder"] for r in rows)
