"""Personal data by anchor expansion.

One Aho-Corasick pass over the whole text finds anchors: at-signs, plus signs, digits, schemes and
identifier cues. Each anchor hands over to a small deterministic parser that looks left and right of
it, fixes the boundaries and validates. The parsers of the four base kinds give exactly the
leftmost non-overlapping matches of the patterns in BASE (a test compares them), because each
pattern's match can only begin where its parser looks: an email at the start of the run of local
characters before an at-sign, an ip or card number at the first digit of a run, a phone number at a
plus sign. Two kinds come on top: `account` (a cue such as token, iban or account and the identifier
after it) and `url` (a scheme whose authority names a user).

Defined cases: null text counts as empty and has no spans. Spans are code points, end exclusive.
Kinds may overlap each other, spans of a kind never do. Repeated rows give repeated rows; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import slices, whole_text

#: The base kinds in the order of the output; a match counts if its check holds.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
EXTRA = ("account", "url")
KINDS = (*BASE, *EXTRA)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP, CARD, PHONE = (re.compile(BASE[k]) for k in ("ip", "card", "phone"))
CUES = ("account", "acct", "iban", "ssn", "token", "secret", "password", "api_key", "api key", "apikey")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
#: After a cue: up to a few separators, then an identifier of at least 8 characters.
IDENTIFIER = re.compile(r"(?:\s+(?:no|nr|number|id|is)\b\.?)?[\s:=#\"']{1,4}([A-Za-z0-9](?:[\x20-]?[A-Za-z0-9]){7,})")
AUTHORITY = re.compile(r"[A-Za-z0-9._%+~-]+(?::[^\s@/]*)?@[A-Za-z0-9.-]+(?::[0-9]+)?[^\s<>\"']*")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    """The check that a base match must hold; failing ones are dropped without a retry."""
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in found.split("."))
    if kind == "card":
        digits = found.replace(" ", "").replace("-", "")
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= sum("0" <= c <= "9" for c in found) <= 15
    return True


def iban(value: str) -> bool:
    """Country, check digits and mod 97 of an account number written without blanks."""
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", value):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _account(text: str, at: int) -> tuple[int, int] | None:
    """The identifier after a cue that ends before `at`: mixed or numeric, at least four digits."""
    m = IDENTIFIER.match(text, at)
    if not m:
        return None
    start, end = m.span(1)
    # Blanks join groups only where each group has a digit: words after the identifier stay out.
    groups, kept = re.finditer(r"[A-Za-z0-9-]+", text[start:end]), start
    for g in groups:
        if not any("0" <= c <= "9" for c in g.group()):
            break
        kept = start + g.end()
    value = text[start:kept]
    plain = value.replace(" ", "").replace("-", "")
    if len(plain) < 8 or sum("0" <= c <= "9" for c in plain) < 4:
        return None
    if re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", plain) and not iban(plain):
        return None
    return start, kept


def build() -> ahocorasick.Automaton:
    """Anchors with what they lead to: e, p, d, a (cue), u (scheme)."""
    anchors = ahocorasick.Automaton()
    anchors.add_word("@", ("e", 1))
    anchors.add_word("+", ("p", 1))
    for d in "0123456789":
        anchors.add_word(d, ("d", 1))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            anchors.add_word(form, ("a", len(form)))
    for scheme in SCHEMES:
        for form in {scheme, scheme.upper(), scheme.capitalize()}:
            anchors.add_word(form, ("u", len(form)))
    anchors.make_automaton()
    return anchors


def spans(text: str, anchors: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """All spans of a text by kind, each kind ordered by start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free = dict.fromkeys(KINDS, 0)  # where the last match of each kind ended, valid or not
    run = 0  # end of the run of digits seen last
    for at, (kind, length) in anchors.iter(text):
        if kind == "d":
            if at < run:
                continue
            run = at + 1
            while run < len(text) and "0" <= text[run] <= "9":
                run += 1
            if at >= free["card"] and (run > at + 1 or text[run : run + 1] in (" ", "-")) and (m := CARD.match(text, at)):
                free["card"] = m.end()
                if valid("card", m.group()):
                    out["card"].append(m.span())
            if text[run : run + 1] == "." and at >= free["ip"] and (m := IP.match(text, at)):
                free["ip"] = m.end()
                if valid("ip", m.group()):
                    out["ip"].append(m.span())
        elif kind == "e":
            start = at
            while start > free["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                free["email"] = m.end()
                out["email"].append((start, m.end()))
        elif kind == "p":
            if at >= free["phone"] and (m := PHONE.match(text, at)):
                free["phone"] = m.end()
                if valid("phone", m.group()):
                    out["phone"].append(m.span())
        elif kind == "a":
            start = at + 1 - length
            if start >= free["account"] and not text[start - 1 : start].isalnum() and (found := _account(text, at + 1)):
                free["account"] = found[1]
                out["account"].append(found)
        else:
            start = at + 1 - length
            if start >= free["url"] and (m := AUTHORITY.match(text, at + 1)):
                free["url"] = m.end()
                out["url"].append((start, m.end()))
    return out


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_account long, n_url long, n_found long"


def listed(found: dict[str, list[tuple[int, int]]], kinds) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found[k])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = build()
    for batch in slices(batches):
        rows = []
        for text in batch.column(1).to_pylist():
            found = spans(text, anchors)
            base = listed(found, BASE)
            rows.append((*(len(found[k]) for k in BASE), hashlib.sha256(base.encode()).hexdigest(), listed(found, KINDS), len(found["account"]), len(found["url"]), sum(map(len, found.values()))))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 9
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 3
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [f.split()[0] for f in FOUND.split(", ")])


def find_pii(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans of every row of docs; n_found counts spans of any kind."""
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(_find, FOUND)


def redacted(docs: DataFrame, mark: str = "<{}>") -> DataFrame:
    """doc_id, text with every span replaced by its kind; overlapping spans go as the first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = build()
        for batch in slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                cuts = sorted((s, -e, k) for k, v in spans(text, anchors).items() for s, e in v)
                parts, at = [], 0
                for s, e, k in cuts:
                    if s >= at:
                        parts += [text[at:s], mark.format(k)]
                        at = -e
                out.append("".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(work, "doc_id long, text string")
