"""Canonical JSON, structural hashes, FNV-1a and xorshift: each for Python values and, where rows need it, as Columns."""

from __future__ import annotations

import datetime
import hashlib
import json
import math
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 0xFFFFFFFF
FNV_BASIS, FNV_PRIME = 2166136261, 16777619
DEFAULT_SEED = 123456789


def plain(value):
    """Numbers that are whole become int, so that 1, 1.0 and -0.0 have one text each."""
    if isinstance(value, bool) or value is None or isinstance(value, (str, int)):
        return value
    if isinstance(value, float):
        if not math.isfinite(value):
            return None
        return int(value) if value == int(value) and abs(value) < 2**53 else value
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value]


def canonical_json(value) -> str:
    """Sorted keys, no blanks, minus zero as zero."""
    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def structural_hash(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def stable_hash(value, most_bytes: int = 1_000_000) -> str | None:
    """The structural hash, unless the canonical text is too long to be worth it."""
    text = canonical_json(value).encode()
    return hashlib.sha256(text).hexdigest() if len(text) < most_bytes else None


def fnv1a32(text: str) -> int:
    """Over UTF-16 code units."""
    h, data = FNV_BASIS, text.encode("utf-16-le")
    for k in range(0, len(data), 2):
        h = ((h ^ (data[k] | data[k + 1] << 8)) * FNV_PRIME) & U32
    return h


def normalize_seed(seed) -> int:
    return int(seed) & U32 if isinstance(seed, (int, float)) and math.isfinite(seed) else DEFAULT_SEED


class XorShift32:
    """Shifts 13, 17, 5; the state starts from the seed and a path's FNV hash and is never zero."""

    def __init__(self, seed, path: str = ""):
        self.state = (normalize_seed(seed) ^ fnv1a32(path)) & U32 or 1

    def next(self) -> int:
        x = self.state
        x ^= (x << 13) & U32
        x ^= x >> 17
        x ^= (x << 5) & U32
        self.state = x & U32
        return self.state

    def unit(self) -> float:
        return self.next() / 2**32


def format_value(kind: str, index: int, seed: int) -> str:
    """The value of a format's index-th use, as `format_col` gives it."""
    draw = XorShift32(seed, f"format:{kind}:{index}")
    if kind in ("email", "uri"):
        n, digits = draw.next(), ""
        while n:
            n, d = divmod(n, 36)
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
        return f"user.{digits.zfill(6)}@example.test" if kind == "email" else f"https://example.test/resource/{digits.zfill(6)}"
    if kind == "uuid":
        raw = bytearray(b"".join(draw.next().to_bytes(4, "little") for _ in range(4)))
        return str(uuid.UUID(bytes=bytes(raw), version=4))
    day, second = draw.next() % 365, draw.next() % 86400
    return (datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day, seconds=second)).isoformat() + ".000Z"


def escape_pointer(token: str) -> str:
    return token.replace("~", "~0").replace("/", "~1")


def unescape_pointer(token: str) -> str:
    return token.replace("~1", "/").replace("~0", "~")


def at_pointer(document, pointer: str):
    """The value a JSON pointer (with or without #) leads to; KeyError if there is none."""
    node = document
    for token in pointer.removeprefix("#").split("/")[1:]:
        token = unescape_pointer(token)
        if isinstance(node, list) and token.isdigit() and int(token) < len(node):
            node = node[int(token)]
        elif isinstance(node, dict) and token in node:
            node = node[token]
        else:
            raise KeyError(pointer)
    return node


# --- Columns ----------------------------------------------------------------------------------------------------


def fnv1a32_col(text: Column) -> Column:
    """For text within the basic multilingual plane."""
    units = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(units, F.lit(FNV_BASIS).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME)) % F.lit(2**32))


def xorshift_col(x: Column, times: int = 1) -> Column:
    """A state after `times` steps, as BIGINT from 0 to 2**32 - 1."""
    mask = F.lit(U32).cast("long")
    for _ in range(times):
        x = x.bitwiseXOR(F.shiftleft(x, 13).bitwiseAND(mask))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 17))
        x = x.bitwiseXOR(F.shiftleft(x, 5).bitwiseAND(mask)).bitwiseAND(mask)
    return x


def padded_col(text: Column, width: int) -> Column:
    """Zeros before a text that is shorter than width; longer ones stay whole."""
    return F.when(F.char_length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def base36_col(n: Column, width: int = 6) -> Column:
    return padded_col(F.lower(F.conv(n.cast("string"), 10, 36)), width)


def seeded_col(seed: int, path: Column) -> Column:
    """A generator's first state: the seed and a path's FNV hash, never zero."""
    start = F.lit(normalize_seed(seed)).cast("long").bitwiseXOR(fnv1a32_col(path))
    return F.when(start == 0, F.lit(1).cast("long")).otherwise(start)


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def uuid_col(state: Column) -> Column:
    """RFC 4122 version 4 text from four consecutive states after `state`, each word's bytes in little-endian order."""
    states = F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.array(state), lambda a, _: F.concat(a, F.transform(F.slice(a, -1, 1), lambda x: xorshift_col(x))))

    def text(h: Column) -> Column:
        part = lambda a, n: F.substring(h, a, n)
        nibble = F.get(F.array(*[F.lit(c) for c in "89ab"]), F.conv(part(17, 1), 16, 10).cast("int") % 4)
        return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("4"), part(14, 3)), F.concat(nibble, part(18, 3)), part(21, 12))

    return _let(F.array_join(F.transform(F.slice(states, 2, 4), _little_hex), ""), text)


def _little_hex(w: Column) -> Column:
    h = F.lower(F.lpad(F.hex(w), 8, "0"))
    return F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])


def email_col(state: Column) -> Column:
    return F.concat(F.lit("user."), base36_col(xorshift_col(state)), F.lit("@example.test"))


def uri_col(state: Column) -> Column:
    return F.concat(F.lit("https://example.test/resource/"), base36_col(xorshift_col(state)))


def date_time_col(state: Column) -> Column:
    """A day of the year from 2024 on and a second of the day, one draw each, as UTC text."""

    def text(x: Column) -> Column:
        seconds = F.lit(1704067200).cast("long") + (x % 365) * 86400 + xorshift_col(x) % 86400
        return F.concat(F.regexp_replace(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"), " ", "T"), F.lit(".000Z"))

    return _let(xorshift_col(state), text)


def format_col(kind: str, index: Column, seed: int) -> Column:
    """The value of a format's index-th use: each draws from a generator of its own."""
    draw = {"email": email_col, "uri": uri_col, "uuid": uuid_col, "date-time": date_time_col}[kind]
    return _let(seeded_col(seed, F.concat(F.lit(f"format:{kind}:"), index.cast("string"))), draw)


def structural_hash_col(**values: Column) -> Column:
    """The structural hash of an object of columns, names in order. Strings, integers and booleans, whose JSON text is canonical."""
    return F.sha2(F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)]), {"ignoreNullFields": "false"}), 256)
