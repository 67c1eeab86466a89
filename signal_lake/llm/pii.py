"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors in one pass over a text: at-signs, plus signs, digits, dots between
digits, URL schemes and identifier cues. At each anchor a deterministic parser expands to the left and right and
validates what it finds. The base kinds (email, ip, card, phone) follow the leftmost, non-overlapping reading of their
patterns; the method adds the kinds url (a scheme with what follows it) and account: a cue such as `api_key`, a separator,
and a value that holds a digit; behind `IBAN`, the longest run (in groups or not) whose check digits are right; behind
`password`, a separator and a value of 8 or more characters, not all letters; behind `account`, `passport` or `SSN`, also
without a separator or after `number is`, capitals and digits with five digits or more. Passwords of letters alone are not told from prose.

Defined cases: a null text is an empty text, with no spans; rows are taken one by one, so repeated rows give repeated
results; spans count code points of the text as it came, end exclusive. redact() keeps all columns that came in.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signal_lake.llm.common import table

#: Kinds in the order in which spans are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
#: Fixed values.
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "mailto:")
CUES = ("api_key", "apikey", "api-key", "access_key", "secret", "token", "password", "passwd", "iban", "account", "passport", "ssn")
MARK = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "url": "[URL]", "account": "[ACCOUNT]"}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'`|]*[A-Za-z0-9/_=&#%~+-]")
_VALUE = re.compile(r"[A-Za-z_]{0,8}[\"']?[\x20]*[:=#][\x20]*[\"']?([A-Za-z0-9][A-Za-z0-9+/_-]{7,}=*)")
_IBAN = re.compile(r"[^A-Za-z0-9\n]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_PASSWORD = re.compile(r"[\"']?\x20*[:=]\x20*[\"']?([^\s\"'<>,;]{8,})")
_NAMED = re.compile(r"(?:\x20(?i:number|no\.?|id))?(?:\x20?[:=#]\x20?|\x20(?:is\x20)?)([A-Z0-9][A-Z0-9-]{5,})(?![A-Za-z0-9])")

_automata: list = []


def _automaton():
    if not _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for d in "0123456789":
            a.add_word(d, ("digit", 1))
            for e in "0123456789":
                a.add_word(f"{d}.{e}", ("dot", 3))
        a.add_word("@", ("at", 1))
        a.add_word("+", ("plus", 1))
        for kind, words in (("scheme", SCHEMES), ("cue", CUES)):
            for w in words:
                for form in {w, w.upper(), w.title(), w.capitalize()}:
                    a.add_word(form, (kind, len(form)))
        a.make_automaton()
        _automata.append(a)
    return _automata[0]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _iban(text: str, at: int) -> tuple[int, int] | None:
    """The longest run from at on that ends at a boundary and leaves 1 when divided by 97."""
    if not (m := _IBAN.match(text, at)):
        return None
    for end in range(m.end(), m.start(1) + 14, -1):
        last, after = text[end - 1], text[end : end + 1]
        if last != " " and not (after.isascii() and after.isalnum()):
            run = text[m.start(1) : end].replace(" ", "")
            if len(run) >= 15 and int("".join(str(int(c, 36)) for c in run[4:] + run[:4])) % 97 == 1:
                return m.start(1), end
    return None


def _account(text: str, cue: str, at: int) -> tuple[int, int] | None:
    """The value that a cue, which ends before at, tells of."""
    if cue == "iban" and (span := _iban(text, at)):
        return span
    if cue in ("password", "passwd") and (m := _PASSWORD.match(text, at)):
        value = m[1].rstrip(".!?)")
        if len(value) >= 8 and not value.isalpha():
            return m.start(1), m.start(1) + len(value)
    if (m := _VALUE.match(text, at)) and any("0" <= c <= "9" for c in m[1]):
        return m.span(1)
    if cue in ("account", "passport", "ssn") and (m := _NAMED.match(text, at)) and sum("0" <= c <= "9" for c in m[1]) >= 5:
        return m.span(1)
    return None


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) sorted by kind as in KINDS, then start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = ip_end = card_end = phone_end = url_end = account_end = 0
    for last, (kind, size) in _automaton().iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= card_end and (m := _CARD.match(text, at)):
                card_end = m.end()
                digits = [c for c in m[0] if c not in " -"]
                if 13 <= len(digits) <= 19 and _luhn("".join(digits)):
                    found["card"].append(m.span())
        elif kind == "dot":
            if at >= ip_end:
                start = at
                while start > ip_end and "0" <= text[start - 1] <= "9":
                    start -= 1
                m = _CHAIN.match(text, start)
                ip_end, parts, p = m.end(), m[0].split("."), start
                ends = []
                for x in parts:
                    ends.append((p, p + len(x)))
                    p += len(x) + 1
                for i in range(0, len(parts) - 3, 4):
                    if all(int(x) <= 255 for x in (y.lstrip("0")[:4] or "0" for y in parts[i : i + 4])):
                        found["ip"].append((ends[i][0], ends[i + 3][1]))
        elif kind == "at":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                found["email"].append((start, email_end))
        elif kind == "plus":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif kind == "scheme":
            if at >= url_end and (m := _URL.match(text, last + 1)) and m.end() - last > 2:
                url_end = m.end()
                found["url"].append((at, url_end))
        elif at >= account_end and (span := _account(text, text[at : last + 1].lower(), last + 1)):
            account_end = span[1]
            found["account"].append(span)
    return [(k, s, e) for k in KINDS for s, e in found[k]]


def joined(found: list[tuple[str, int, int]], kinds=KINDS) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found if k in kinds)


def redacted(text: str, found: list[tuple[str, int, int]]) -> str:
    """text with each span, widest first where they overlap, replaced by its kind's mark."""
    out, at = [], 0
    for s, e, k in sorted(((s, e, k) for k, s, e in found), key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [text[at:s], MARK[k]]
            at = e
        elif e > at:  # the rest of a span that overlaps the one before
            at = e
    return "".join(out) + text[at:]


def _map(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(b.schema.get_field_index("text"))]
            found = [spans(t) if t else [] for t in texts]
            if digest:
                counts = [pa.array([sum(s[0] == k for s in f) for f in found], pa.int64()) for k in BASE]
                sha = [hashlib.sha256(joined(f, BASE).encode()).hexdigest() for f in found]
                yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(sha, pa.string()), pa.array(list(map(joined, found)), pa.string()), pa.array(list(map(len, found)), pa.int64())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"])
            else:
                new = pa.array([t if t is None else redacted(t, f) for t, f in zip(texts, found)], pa.string())
                yield b.set_column(b.schema.get_field_index("text"), "text", new)

    return run


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, the base spans' digest, all spans and their number."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_map(True), schema)


def redact(docs: DataFrame) -> DataFrame:
    """docs with the spans in text replaced by their kinds' marks; a null text stays null."""
    return docs.mapInArrow(_map(False), docs.schema)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
