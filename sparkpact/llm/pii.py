"""PII: fixed base patterns, and a semi-Markov conditional random field that adds spans they miss.

The field scores whole candidate segments, of one to `LONGEST` tokens, by features of the span (shape, digits, checks)
and of the word before it; dynamic programming with that bound on a segment's tokens chooses boundaries and types
together. It is trained by gradient ascent on the log-likelihood of generated sentences whose spans are known. Base
spans always stay: the field reads only the text between them.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import beside, kept_fields, outputs, table

KINDS = ("email", "ip", "card", "phone")
LONGEST = 6
#: By how much a path with a span must beat the best one without it.
MARGIN = 3.0

# Fixed base patterns, in forms that take time in proportion to the text.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: a run of local characters up to an @, then a domain with a dot."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            out.append((start, last))
        at = text.find("@", max(at + 1, last))
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base patterns, in that order."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m.group().split("."))]
        found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(found)


# --- the field -------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\S+")
_EDGE = "\"'()[]<>{},;:!?|"
_CUES = {"phone": 3, "tel": 3, "call": 3, "mobile": 3, "fax": 3, "card": 2, "visa": 2, "mastercard": 2, "email": 0, "e-mail": 0, "mail": 0, "ip": 1, "host": 1, "address": 1}
_SPELT = re.compile(r"[A-Za-z0-9._-]+ ?[\[(]? ?(?:at|AT) ?[\])]? ?[A-Za-z0-9-]+ ?[\[(]? ?(?:dot|DOT) ?[\])]? ?[A-Za-z]{2,}")
_DOTTED = re.compile(r"[0-9]{1,3}(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}")
_LOCAL_PHONE = re.compile(r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}|00[0-9]{1,2}(?:[ -][0-9]{2,4}){2,4}")
_PARTS = re.compile(r"[0-9]+(?:[ ._/-]{1,2}[0-9]+)*")
_NUMBER = re.compile(r"\(?\+?[0-9]{2,}(?:\)?[ ./-]{0,2}\(?[0-9]{2,})*")
_GROUPS = re.compile(r"[0-9]{4}(?:[ ._/-]+[0-9]{4}){2,3}(?:[ ._/-]+[0-9]{1,4})?")
_TRIGGER = re.compile(r"[0-9]{3}|[\[(] ?(?:at|AT|@) ?[\])]| (?:at|AT) \S+ (?:dot|DOT) |[0-9][\[(]\.")


def _shape(s: str) -> str:
    s = re.sub(r"[A-Za-z]+", "a", s[:40])
    return re.sub(r"[0-9]+", lambda m: f"9{min(len(m.group()), 5)}", s)


@lru_cache(1 << 14)
def features(span: str, tokens: int) -> tuple[str, ...]:
    """Of a whole candidate span."""
    bare = span.strip(_EDGE + ".")
    digits = _digits(bare)
    letters = sum(c.isalpha() for c in bare)
    out = [f"shape={_shape(bare)}", f"tokens={tokens}", f"digits={min(len(digits), 20)}", f"letters={min(letters, 3)}", f"edge={span != bare}"]
    if _SPELT.fullmatch(bare):
        out.append("spelt")
    if _DOTTED.fullmatch(bare):
        out.append(f"dotted={all(int(x) <= 255 for x in re.findall('[0-9]+', bare))}")
    if _LOCAL_PHONE.fullmatch(bare):
        out.append("local")
    if _GROUPS.fullmatch(bare) or len(digits) == len(bare) >= 12:
        out.append(f"groups={12 <= len(digits) <= 19 and luhn(digits)}")
    return tuple(out)


@lru_cache(1 << 14)
def possible(span: str) -> frozenset[int]:
    """The kinds for which a span has evidence of its own: spelt-out signs, dotted octets, a check digit, a number's length."""
    bare = span.strip(_EDGE + ".")
    digits, out = _digits(bare), set()
    if _SPELT.fullmatch(bare):
        out.add(0)
    if _DOTTED.fullmatch(bare) and all(int(x) <= 255 for x in re.findall("[0-9]+", bare)):
        out.add(1)
    if 12 <= len(digits) <= 19 and _PARTS.fullmatch(bare) and luhn(digits):
        out.add(2)
    if 7 <= len(digits) <= 15 and _NUMBER.fullmatch(bare):
        out.add(3)
    return frozenset(out)


def _found(span: str, tokens: int, before: str) -> list[str]:
    """A span's features, those of the word before it, and that word with how many digits the span has."""
    cue = _CUES.get(before, -1)
    return [*features(span, tokens), f"cue={cue}", f"cue={cue}/{min(sum(map(str.isdigit, span)), 12)}"]


class SemiMarkov:
    """Weights by (label, feature); label 0 is outside, whose segments have one token, and 1.. are KINDS."""

    def __init__(self):
        self.w: dict[tuple[int, str], float] = {}

    def segment(self, text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[float]:
        """Scores of tokens i..j-1 as one segment, by label."""
        span = text[tokens[i][0] : tokens[j - 1][1]]
        before = text[slice(*tokens[i - 1])].strip(_EDGE + ".").lower() if i else ""
        found = _found(span, j - i, before)
        get = self.w.get
        may = possible(span)
        return [sum(get((y, f), 0.0) for f in found) if (y - 1 in may if y else j - i == 1) else -math.inf for y in range(len(KINDS) + 1)]

    def lattice(self, text, tokens):
        return {(i, j): self.segment(text, tokens, i, j) for i in range(len(tokens)) for j in range(i + 1, min(i + LONGEST, len(tokens)) + 1)}

    def learn(self, text: str, tokens: list[tuple[int, int]], gold: set[tuple[int, int, int]], rate: float) -> None:
        """One step along the gradient: observed minus expected features, by the forward and backward sums."""
        lattice, n = self.lattice(text, tokens), len(tokens)

        def total(xs):
            m = max(xs, default=-math.inf)
            return m if m == -math.inf else m + math.log(sum(math.exp(x - m) for x in xs))

        forward, backward = [0.0] + [0.0] * n, [0.0] * n + [0.0]
        for j in range(1, n + 1):
            forward[j] = total([forward[i] + v for i in range(max(0, j - LONGEST), j) for v in lattice[i, j]])
        for i in range(n - 1, -1, -1):
            backward[i] = total([backward[j] + v for j in range(i + 1, min(i + LONGEST, n) + 1) for v in lattice[i, j]])
        for (i, j), scores in lattice.items():
            span = text[tokens[i][0] : tokens[j - 1][1]]
            before = text[slice(*tokens[i - 1])].strip(_EDGE + ".").lower() if i else ""
            found = _found(span, j - i, before)
            for y, v in enumerate(scores):
                if v == -math.inf:
                    continue
                step = ((i, j, y) in gold) - math.exp(forward[i] + v + backward[j] - forward[n])
                if abs(step) > 1e-3:
                    for f in found:
                        self.w[y, f] = self.w.get((y, f), 0.0) + rate * step

    def decode(self, text: str, tokens: list[tuple[int, int]], margin: float = MARGIN) -> list[tuple[int, int, int]]:
        """Best segmentation's spans (start, kind's number, end), edges trimmed; each must beat its tokens as outside by `margin`."""
        n = len(tokens)
        lattice = self.lattice(text, tokens)
        best, back = [0.0] + [-math.inf] * n, [(0, 0)] * (n + 1)
        for j in range(1, n + 1):
            for i in range(max(0, j - LONGEST), j):
                for y, v in enumerate(lattice[i, j]):
                    if best[i] + v > best[j]:
                        best[j], back[j] = best[i] + v, (i, y)
        out, j = [], n
        while j:
            i, y = back[j]
            if y and lattice[i, j][y] - sum(lattice[k, k + 1][0] for k in range(i, j)) >= margin:
                s, e = tokens[i][0], tokens[j - 1][1]
                span = text[s:e]
                lead = len(span) - len(span.lstrip(_EDGE.replace("(", "") + "."))
                tail = len(span) - len(span.rstrip(_EDGE.replace(")", "") + "."))
                out.append((s + lead, y - 1, e - tail))
            j = i
        return out[::-1]


def _sentence(r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated sentence, and its spans as token numbers with label."""
    word = lambda: "".join(r.choice(("on", "th", "er", "la", "que", "mi", "ein", "ba")) for _ in range(r.randint(1, 3)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card(length=16):
        body = "4" + digits(length - 2)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def positive():
        kind = r.randrange(4)
        if kind == 0:
            name, host, end = word() + r.choice(("", "", f".{word()}", digits(2))), word(), r.choice(("com", "org", "net", "de", "info"))
            at, dot = r.choice((("at", "dot"), ("AT", "DOT")))
            return 0, r.choice((f"{name} {at} {host} {dot} {end}", f"{name} [{at}] {host} [{dot}] {end}", f"{name} ({at}) {host} ({dot}) {end}", f"{name}[{at}]{host}[{dot}]{end}", f"{name}({at}){host}({dot}){end}"))
        if kind == 1:
            octet = lambda: str(r.choice((r.randint(0, 9), r.randint(10, 99), r.randint(100, 255))))
            return 1, r.choice(("[.]", "(.)")).join(octet() for _ in range(4))
        if kind == 2:
            c = card()
            return 2, r.choice((".", "  ", "_", "/")).join(c[k : k + 4] for k in range(0, 16, 4))
        a, b, c = digits(3), digits(3), digits(4)
        return 3, r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{r.randint(30, 49)} {digits(3)} {digits(4)} {digits(2)}"))

    def negative():
        return r.choice((digits(4), f"{r.randint(1, 12)}:{digits(2)}", f"20{digits(2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", f"{r.randint(1, 9)}.{r.randint(0, 9)}", f"{digits(3)},{digits(3)}", f"password={digits(6)}ab{digits(4)}", f'"{digits(5)}fe{digits(9)}c{digits(3)}"', f"AKIA{digits(3)}QX{digits(4)}", f"{digits(r.randint(5, 24))}", f"{digits(4)} {digits(4)}", f"{digits(3)} {digits(3)}", f"{digits(1)}.{digits(2)}.{digits(1)}", f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}", f"{digits(4)}.{digits(4)}.{digits(4)}.{digits(4)}", f"{word()} at {word()} the", f"{digits(3)}-{digits(2)}", digits(3), f"20{digits(2)} {word()}", f"{digits(3)} {word()}", f"{digits(2)}[.]{digits(1)}", f"{word()}[at]{word()}", f"{word()} ({r.choice(('at', 'dot'))}) {digits(3)}", f"{digits(3)}.{digits(3)}", f"00{digits(2)}"))

    parts, gold, at = [], [], 0
    for _ in range(r.randint(1, 3)):
        lead = [word() for _ in range(r.randint(0, 3))]
        if r.random() < 0.5:
            kind, s = positive()
            if r.random() < 0.4:
                lead.append(r.choice([c for c, k in _CUES.items() if k == kind]) + r.choice(("", ":")))
            n = len(s.split())
            gold.append((at + len(lead), at + len(lead) + n, kind + 1))
        else:
            s = negative()
            if r.random() < 0.4:  # a word that often comes before personal data comes before other things too
                lead.append(r.choice(list(_CUES)) + r.choice(("", ":")))
            if len(_digits(s)) >= 12 and luhn(_digits(s)):  # a card by chance
                s = word()
        parts += [*lead, s + r.choice(("", "", ".", ","))]
        at += len(" ".join([*lead, s]).split())
    return " ".join(parts), gold


@lru_cache(4)
def trained(sentences: int = 1500, epochs: int = 4, seed: int = 11) -> SemiMarkov:
    """The field, learnt from generated sentences; the same for the same arguments."""
    r, model = random.Random(seed), SemiMarkov()
    made = [_sentence(r) for _ in range(sentences)]
    for epoch in range(epochs):
        for text, spans in made:
            tokens = [m.span() for m in _TOKEN.finditer(text)]
            covered = {k for i, j, _ in spans for k in range(i, j)}
            gold = set(spans) | {(k, k + 1, 0) for k in range(len(tokens)) if k not in covered}
            model.learn(text, tokens, gold, 0.3 / (1 + epoch))
    model.w = {k: v for k, v in model.w.items() if abs(v) > 1e-3}
    return model


_WIDEST = 200
_PART = re.compile(r"[0-9@]|^[\[(]?(?:at|AT|dot|DOT)[\])]?$|[\[(](?:at|AT|dot|DOT)[\])]")


def added_spans(text: str, base: list[tuple[int, int, int]], model: SemiMarkov) -> list[tuple[int, int, int]]:
    """The field's spans in the text between base spans: windows of up to LONGEST tokens around what might be personal data."""
    if not _TRIGGER.search(text):
        return []
    gaps, at = [], 0
    for s, e in sorted((s, e) for s, _, e in base):
        if s > at:
            gaps.append((at, s))
        at = max(at, e)
    gaps.append((at, len(text)))
    out = []
    for low, high in gaps:
        windows: list[list[int]] = []
        for m in _TRIGGER.finditer(text, low, high):
            if windows and m.start() <= windows[-1][1] + 80:
                windows[-1][1] = m.end()
            else:
                windows.append([m.start(), m.end()])
        for a, b in windows:
            near = [t.span() for t in _TOKEN.finditer(text, max(low, a - 80), min(high, b + 80))]
            near = [(s, e) for s, e in near if (s >= a - 60 or s == low) and (e <= b + 60 or e == high)]
            # runs of tokens that could belong to a span, with the word before each
            # a token of more than _WIDEST characters belongs to none, and parts what is on its two sides
            keep = [e - s <= _WIDEST and bool(_PART.search(text[s:e])) for s, e in near]
            i = 0
            while i < len(near):
                if not keep[i]:
                    i += 1
                    continue
                j = i
                while j < len(near) and near[j][1] - near[j][0] <= _WIDEST and (keep[j] or any(keep[j + 1 : j + 2])):
                    j += 1
                low_, high_ = max(0, i - 2), min(len(near), j + 1)
                wide = [k for k in range(low_, high_) if near[k][1] - near[k][0] > _WIDEST]
                run = near[max([low_, *(k + 1 for k in wide if k < i)]) : min([high_, *(k for k in wide if k >= j)])]
                out += model.decode(text, run)
                i = j
    taken, kept = [(s, e) for s, _, e in base], []
    for s, k, e in sorted(out):  # base spans and earlier ones win
        if s < e and all(e <= a or b <= s for a, b in taken):
            taken.append((s, e))
            kept.append((s, k, e))
    return kept


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


COUNTS = tuple(f"n_{k}" for k in KINDS)


def personal_data(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), redact: bool = False) -> DataFrame:
    """Columns `keep` with the counts of base spans by kind, base_sha256, spans (base and added), n_added.

    Offsets are code points, ends exclusive; spans are listed by start, then kind, then end. A null text is empty and
    has none. Texts of any length are read whole; a token of more than 200 characters belongs to no added span. Each row
    stands for itself: repeated rows and null ids come out as they are, an empty table gives an empty one, and a kept
    column that has an added column's name comes out with `_input` after it.
    redact: the column `redacted` comes too, the text with each span replaced by its kind in brackets.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained())
    kept = outputs(keep, [*COUNTS, "base_sha256", "spans", "n_added", *(["redacted"] if redact else [])])
    names = [*kept, *COUNTS, "base_sha256", "spans", "n_added", *(["redacted"] if redact else [])]
    schema = ", ".join([*([kept_fields(docs, keep, kept)] if keep else []), *(f"{c} long" for c in COUNTS), "base_sha256 string, spans string, n_added long", *(["redacted string"] if redact else [])])

    def run(batches):
        for b in batches:
            rows = []
            for value in b.column("_text").to_pylist():
                text = value or ""
                base = base_spans(text)
                more = added_spans(text, base, model.value)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
                row = [*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more)]
                rows.append([*row, redacted(value, base + more)] if redact else row)
            kinds = [*[pa.int64()] * len(COUNTS), pa.string(), pa.string(), pa.int64(), pa.string()]
            columns = [pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names) - len(keep))]
            yield pa.RecordBatch.from_arrays([*(b.column(f"_k{i}") for i in range(len(keep))), *columns], names)

    return beside(docs, keep, _text="text").mapInArrow(run, schema)


def redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """Overlapping spans become one placeholder, of the first's kind."""
    if not text or not spans:
        return text
    out, at, end = [], 0, -1
    for s, k, e in sorted(spans):
        if s < end:
            end = max(end, e)
        else:
            if end >= 0:
                at = end
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
            end = e
        at = end
    return "".join(out) + text[end:]


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """Base spans' counts and digest, and all spans, of every document: see `personal_data`."""
    return personal_data(table(spark, sf_dir, "documents"))
