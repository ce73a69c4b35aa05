"""Functions that Spark lacks, on whole Arrow arrays; and signed cursors as Columns."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.StringType())
def nfc(texts: pa.Array) -> pa.Array:
    """Unicode composition, of the texts that need it: those with a mark or a sign above Latin 1."""
    some = pc.fill_null(pc.match_substring_regex(texts, r"[^\x00-\x{00FF}]"), False)
    done = pa.array([unicodedata.normalize("NFC", t) for t in texts.filter(some).to_pylist()], pa.string())
    return pc.replace_with_mask(texts, some, done)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def floats_from_bytes(blobs: pa.Array) -> pa.Array:
    """Little-endian 32-bit floats; null for a length that isn't a multiple of four."""
    ok = pc.equal(pc.bit_wise_and(pc.binary_length(blobs), 3), 0)
    blobs = pc.if_else(ok, blobs, pa.scalar(None, blobs.type)).cast(pa.large_binary())
    _, offsets, data = blobs.buffers()
    at = np.frombuffer(offsets, np.int64)[blobs.offset : blobs.offset + len(blobs) + 1]
    values = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view("<f4") if data is not None and len(at) else np.empty(0, "<f4")
    return pa.ListArray.from_arrays(pa.array((at - at[0]) // 4, pa.int32()), pa.array(values, pa.float32()), mask=blobs.is_null())


@F.arrow_udf(T.BinaryType())
def floats_to_bytes(vectors: pa.Array) -> pa.Array:
    at = vectors.offsets.to_numpy()
    values = vectors.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype("<f4") if len(vectors) else np.empty(0, "<f4")
    offsets = ((at - at[0]) * 4).astype(np.int32) if len(vectors) else np.zeros(1, np.int32)
    own = pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])
    return pc.if_else(vectors.is_valid(), own, pa.scalar(None, pa.binary()))


# Thai number words with what they count; "ยี่" stands for two before ten, "เอ็ด" for a last one.
THAI_UNITS = {"ศูนย์": 0, "หนึ่ง": 1, "เอ็ด": 1, "สอง": 2, "ยี่": 2, "สาม": 3, "สี่": 4, "ห้า": 5, "หก": 6, "เจ็ด": 7, "แปด": 8, "เก้า": 9}
THAI_POWERS = {"สิบ": 10, "ร้อย": 100, "พัน": 1000, "หมื่น": 10_000, "แสน": 100_000}
THAI_MILLION = "ล้าน"


def thai_number(words: str | None) -> int | None:
    """The integer that Thai number words spell, None if they don't spell one."""
    rest, total, part, digit, any_ = (words or "").replace(" ", ""), 0, 0, None, False
    while rest:
        for w in sorted([*THAI_UNITS, *THAI_POWERS, THAI_MILLION], key=len, reverse=True):
            if rest.startswith(w):
                break
        else:
            return None
        rest, any_ = rest[len(w) :], True
        if w in THAI_UNITS:
            if digit is not None:
                return None
            digit = THAI_UNITS[w]
        elif w in THAI_POWERS:
            part, digit = part + (1 if digit is None else digit) * THAI_POWERS[w], None
        else:
            total, part, digit = (total + part + (digit or 0) or 1) * 1_000_000, 0, None
    return total + part + (digit or 0) if any_ else None


@F.arrow_udf(T.LongType())
def thai_number_words(texts: pa.Array) -> pa.Array:
    """thai_number for each distinct text of a batch."""
    coded = texts.dictionary_encode()
    return pa.array([thai_number(t) for t in coded.dictionary.to_pylist()], pa.int64()).take(coded.indices)


_WORDS = re.compile("(?:" + "|".join(sorted([*THAI_UNITS, *THAI_POWERS, THAI_MILLION], key=len, reverse=True)) + ")+")


@F.arrow_udf(T.StringType())
def number_words_replaced(texts: pa.Array) -> pa.Array:
    """Runs of Thai number words as digits, where they spell a number; other texts pass untouched."""
    some = pc.fill_null(pc.match_substring_regex(texts, _WORDS.pattern), False)
    digits = lambda m: m[0] if (n := thai_number(m[0])) is None else str(n)
    return pc.replace_with_mask(texts, some, pa.array([_WORDS.sub(digits, t) for t in texts.filter(some).to_pylist()], pa.string()))


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """HMAC-SHA256 in hexadecimal. Inner and outer key are constants of the plan."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = bytes(x ^ 0x36 for x in key), bytes(x ^ 0x5C for x in key)
    first = F.sha2(F.concat(F.lit(bytearray(inner)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)


def sign(state: Column, secret: bytes) -> Column:
    """An opaque cursor: the struct as base64url JSON and its HMAC-SHA256."""
    body = F.translate(F.base64(F.to_json(state).cast("binary")), "+/=\r\n", "-_")  # Spark breaks long ones into lines
    return F.concat(body, F.lit("."), hmac_sha256(body, secret))


def verify(token: Column, secret: bytes, schema: str, target: Column, now_ms: Column, version: int = 1) -> Column:
    """The cursor's state (fields target, expires_ms and v among others), null if it was altered, is of another version or target, or has expired."""
    body, mac = F.substring_index(token, ".", 1), F.substring_index(token, ".", -1)
    padded = F.concat(F.translate(body, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(body), F.lit(4)).cast("int")))
    state = F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), schema)
    good = (mac == hmac_sha256(body, secret)) & (state["v"] == version) & (state["target"] == target) & (state["expires_ms"] > now_ms)
    return F.when(good, state)


def _ends(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings of each list end when they are joined, one list after the other, and the lists' bounds."""
    at = lists.offsets.to_numpy()
    sizes = pc.fill_null(pc.utf8_length(lists.values.slice(at[0], at[-1] - at[0])), 0).to_numpy(zero_copy_only=False)
    return np.cumsum(sizes), at - at[0]


@F.arrow_udf(T.IntegerType())
def shared_ends(a: pa.Array, b: pa.Array) -> pa.Array:
    """How many strings of two lists end at the same place when each list is joined. Null lists are empty."""
    if not len(a):
        return pa.array([], pa.int32())
    (x, at), (y, bt) = _ends(a), _ends(b)
    out = []
    for k in range(len(a)):
        i, j = x[at[k] : at[k + 1]] - (x[at[k] - 1] if at[k] else 0), y[bt[k] : bt[k + 1]] - (y[bt[k] - 1] if bt[k] else 0)
        out.append(len(np.intersect1d(i, j)))
    return pa.array(out, pa.int32())
