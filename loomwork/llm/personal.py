"""Personal data in texts: patterns propose spans, checksums and value rules confirm them, nearby words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.words import Block, blocks

#: Kinds that a pattern and its rule settle: always reported.
BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that are reported from MIN_SCORE on.
SCORED_KINDS = ("iban", "ssn", "local_phone")
KINDS = BASE_KINDS + SCORED_KINDS
MIN_SCORE = 0.5

# The score of a confirmed span before its context is read.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "local_phone": 0.3}
#: What a word that speaks for the kind adds, and one that speaks against it takes away; each counts once.
CONTEXT_STEP = 0.3
#: Bytes before and after a span in which context words are looked for.
BEFORE, AFTER = 48, 24

# Context words of every kind, in four languages, lower case.
SPEAKS_FOR = {
    "email": ["mail", "e-mail", "email", "contact", "write", "correo", "courriel", "kontakt"],
    "ip": ["ip", "host", "server", "login", "address", "adresse", "servidor", "serveur"],
    "card": ["card", "visa", "mastercard", "amex", "credit", "debit", "karte", "kreditkarte", "carte", "tarjeta"],
    "phone": ["phone", "tel", "call", "mobile", "fax", "telefon", "anruf", "téléphone", "teléfono", "whatsapp"],
    "iban": ["iban", "account", "bank", "konto", "compte", "cuenta", "bic", "swift"],
    "ssn": ["ssn", "social", "security", "taxpayer"],
    "local_phone": ["phone", "tel", "call", "mobile", "fax", "telefon", "anruf", "téléphone", "teléfono", "whatsapp"],
}
SPEAKS_AGAINST = {
    "email": ["example", "noreply", "no-reply"],
    "ip": ["version", "release", "section", "chapter"],
    "card": ["order", "isbn", "tracking", "serial", "invoice"],
    "phone": ["isbn", "order", "part", "version"],
    "iban": ["serial", "part"],
    "ssn": ["order", "part", "isbn", "invoice"],
    "local_phone": ["isbn", "order", "part", "version", "page", "invoice"],
}

# Length of an account number by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22,
    "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15,
    "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}

_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_SSN = re.compile(rb"([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9A-Za-z-])")
_LOCAL_PHONE = re.compile(rb"\(?0?[0-9]{2,4}\)?[ /-][0-9]{3,4}[ -][0-9]{3,5}(?![0-9A-Za-z-])")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")

_LOCAL_PART = np.zeros(256, bool)
_LOCAL_PART[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"]] = True


def luhn(digits: bytes) -> bool:
    """Whether the last digit of an ASCII digit string checks the others: every second one doubled, digit sums added."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = (d - 48) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(account: bytes) -> bool:
    """Whether an account number without blanks checks: moved by four characters, letters as 10 to 35, remainder 1 by 97."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(chr(c), 36)) for c in moved)) % 97 == 1


class _Digits:
    """Runs of digits inside the rows of a block."""

    def __init__(self, block: Block):
        data, at = block.data, block.offsets
        digit = (data >= 0x30) & (data <= 0x39)
        before, after = np.append(False, digit[:-1]), np.append(digit[1:], False)
        before[at[:-1][at[:-1] < len(data)]] = False
        after[at[1:][at[1:] > 0] - 1] = False
        self.data = data
        self.start, self.end = np.flatnonzero(digit & ~before), np.flatnonzero(digit & ~after) + 1
        self.row = np.searchsorted(at, self.start, "right") - 1

    def chains(self, *separators: int) -> tuple[np.ndarray, np.ndarray]:
        """First run, and first run after, of the longest chains of runs with one separator between neighbours."""
        if not len(self.start):
            return self.start, self.start
        linked = (self.start[1:] == self.end[:-1] + 1) & (self.row[1:] == self.row[:-1])
        linked[linked] = np.isin(self.data[self.end[:-1][linked]], separators)
        first = np.flatnonzero(np.append(True, ~linked))
        return first, np.append(first[1:], len(self.start))


def _emails(block: Block, body: bytes) -> Iterator[tuple[int, int, int]]:
    signs = np.flatnonzero(block.data == 0x40)
    if not len(signs):
        return
    other = np.flatnonzero(~_LOCAL_PART[block.data])
    left = np.append(-1, other)[np.searchsorted(other, signs)] + 1
    rows = np.searchsorted(block.offsets, signs, "right") - 1
    left = np.maximum(left, block.offsets[rows])
    taken = 0
    for at, start, row in zip(signs.tolist(), left.tolist(), rows.tolist()):
        start = max(start, taken)
        domain = _DOMAIN.match(body, at + 1, int(block.offsets[row + 1])) if start < at else None
        if domain:
            taken = domain.end()
            yield row, start, taken


def _addresses(digits: _Digits, body: bytes) -> Iterator[tuple[int, int, int]]:
    """Four numbers joined by dots; a longer chain is read four by four."""
    first, last = digits.chains(0x2E)
    some = last - first >= 4
    for a, b in zip(first[some].tolist(), last[some].tolist()):
        for i in range(a, b - 3, 4):
            parts = [body[digits.start[k]:digits.end[k]].lstrip(b"0") for k in range(i, i + 4)]
            if all(len(p) <= 3 and int(p or b"0") <= 255 for p in parts):
                yield int(digits.row[i]), int(digits.start[i]), int(digits.end[i + 3])


def _cards(digits: _Digits, body: bytes) -> Iterator[tuple[int, int, int]]:
    first, last = digits.chains(0x20, 0x2D)
    n = np.append(0, np.cumsum(digits.end - digits.start))
    some = np.flatnonzero((n[last] - n[first] >= 13) & (n[last] - n[first] <= 19))
    for i in some.tolist():
        start, end = int(digits.start[first[i]]), int(digits.end[last[i] - 1])
        if luhn(body[start:end].replace(b" ", b"").replace(b"-", b"")):
            yield int(digits.row[first[i]]), start, end


def _phones(block: Block, body: bytes) -> Iterator[tuple[int, int, int]]:
    for at in np.flatnonzero(block.data == 0x2B).tolist():
        row = int(np.searchsorted(block.offsets, at, "right")) - 1
        found = _PHONE.match(body, at, int(block.offsets[row + 1]))
        if found and 9 <= sum(0x30 <= c <= 0x39 for c in found[0]) <= 15:
            yield row, at, found.end()


def _alone(body: bytes, at: int, first: int) -> bool:
    """Whether a span may begin here: no letter, digit or joining sign before it in its row."""
    return at == first or not (body[at - 1:at].isalnum() or body[at - 1] in b"+-./@_" or body[at - 1] >= 0x80)


def _accounts(block: Block, digits: _Digits, body: bytes) -> Iterator[tuple[int, int, int]]:
    at = digits.start - 2
    some = (digits.end - digits.start >= 2) & (at >= block.offsets[digits.row])
    some[some] = ((block.data[at[some]] & 0xDF) == block.data[at[some]]) & ((block.data[at[some] + 1] & 0xDF) == block.data[at[some] + 1])
    for row, start in zip(digits.row[some].tolist(), at[some].tolist()):
        first, end = int(block.offsets[row]), int(block.offsets[row + 1])
        size = IBAN_LENGTH.get(body[start:start + 2].decode("latin-1"), 0)
        if not size or not _alone(body, start, first):
            continue
        found = re.compile(rb"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){%d}(?![A-Za-z0-9])" % (size - 4)).match(body, start, end)
        if found and mod97(found[0].replace(b" ", b"")):
            yield row, start, found.end()


def _numbers(block: Block, digits: _Digits, body: bytes, pattern: re.Pattern, least: int, most: int) -> Iterator[tuple[int, int, int]]:
    """Matches that begin at a run of ``least`` to ``most`` digits, or at the bracket before it."""
    length = digits.end - digits.start
    for i in np.flatnonzero((length >= least) & (length <= most)).tolist():
        row, start = int(digits.row[i]), int(digits.start[i])
        first, end = int(block.offsets[row]), int(block.offsets[row + 1])
        start -= start > first and body[start - 1] == 0x28
        found = pattern.match(body, start, end) if _alone(body, start, first) else None
        if found:
            yield row, start, found.end()


def _socials(block: Block, digits: _Digits, body: bytes) -> Iterator[tuple[int, int, int]]:
    for row, start, end in _numbers(block, digits, body, _SSN, 3, 3):
        area, group, serial = body[start:start + 3], body[start + 4:start + 6], body[start + 7:start + 11]
        if area not in (b"000", b"666") and area < b"900" and group != b"00" and serial != b"0000":
            yield row, start, end


def _proposed(block: Block, body: bytes) -> Iterator[tuple[str, Iterator[tuple[int, int, int]]]]:
    """Confirmed spans (row, first byte, byte after) of each kind."""
    digits = _Digits(block)
    yield "email", _emails(block, body)
    yield "ip", _addresses(digits, body)
    yield "card", _cards(digits, body)
    yield "phone", _phones(block, body)
    yield "iban", _accounts(block, digits, body)
    yield "ssn", _socials(block, digits, body)
    yield "local_phone", _numbers(block, digits, body, _LOCAL_PHONE, 2, 5)


def score(kind: str, before: bytes, after: bytes) -> float:
    """Prior of the kind, moved by the words around a span."""
    near = set(_WORD.findall((before.decode(errors="ignore") + " \n " + after.decode(errors="ignore")).lower()))
    step = CONTEXT_STEP * (int(not near.isdisjoint(SPEAKS_FOR[kind])) - int(not near.isdisjoint(SPEAKS_AGAINST[kind])))
    return round(min(1.0, max(0.0, PRIOR[kind] + step)), 2)


def _found(block: Block) -> list[tuple[int, int, int, int, float]]:
    """(row, number of the kind, first byte, byte after, score) of the reported spans of a block, in this order."""
    body, out, taken = block.data.tobytes(), [], {}
    for k, (kind, spans) in enumerate(_proposed(block, body)):
        last: dict[int, int] = {}
        for row, start, end in spans:
            first, stop = int(block.offsets[row]), int(block.offsets[row + 1])
            value = score(kind, body[max(first, start - BEFORE):start], body[end:min(stop, end + AFTER)])
            if kind in SCORED_KINDS and (value < MIN_SCORE or last.get(row, 0) > start or any(a < end and start < b for a, b in taken.get(row, ()))):
                continue
            last[row] = end
            taken.setdefault(row, []).append((start, end))
            out.append((row, k, start, end, value))
    return sorted(out)


def _personal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(0)):
            found = _found(block)
            row, kind, start, end = (np.array([x[i] for x in found], np.int64) for i in range(4))
            if found:
                points = np.append(0, np.cumsum((block.data & 0xC0) != 0x80))
                start, end = points[start] - points[block.offsets[row]], points[end] - points[block.offsets[row]]
            spans = pa.StructArray.from_arrays([pa.array(KINDS).take(pa.array(kind)), pa.array(start), pa.array(end), pa.array([x[4] for x in found], pa.float64())],
                                               names=["kind", "start", "end", "score"])
            offsets = np.searchsorted(row, np.arange(len(block) + 1)).astype(np.int32)
            rows = batch.slice(block.first, len(block))
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.ListArray.from_arrays(pa.array(offsets), spans)], names=[*rows.schema.names[1:], "spans"])


def personal_data(docs: DataFrame, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or those named) with ``spans``: array of (kind, start, end, score) by kind and start.

    ``start`` and ``end`` (exclusive) count code points. Patterns propose, per kind leftmost and without overlaps:
    e-mail addresses; ``ip`` addresses, whose parts are at most 255; ``card`` numbers of 13 to 19 digits that pass Luhn;
    international ``phone`` numbers of 9 to 15 digits. A proposal that fails its rule is dropped. These are always
    reported. ``iban`` account numbers (length by country, mod-97), ``ssn`` numbers and national ``local_phone`` numbers
    are reported where they overlap no span before them and their score reaches ``MIN_SCORE``; the last two need a word nearby that speaks for them.
    The score is the kind's prior, raised by words within 48 bytes before or 24 bytes after that speak for the kind and
    lowered by those that speak against it.

    Null and empty texts have no spans. Texts are read whole, about 1 MB at a time; a longer one alone. Time grows with
    the length of a text, also for long runs of letters or digits. Rows are judged one by one, so repeated rows and ids all
    stay, and nothing is shuffled; columns that clash with the result name are replaced; an empty table gives an empty result.
    """
    kept = [c for c in (docs.columns if columns is None else columns) if c != "spans"]
    source = docs.select(F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)])
    schema = T.StructType([*source.schema.fields[1:], *T.StructType.fromDDL("spans array<struct<kind:string,start:bigint,end:bigint,score:double>>").fields])
    return source.mapInArrow(_personal, schema).toDF(*kept, "spans")


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` in which every span of ``personal_data`` is replaced by its kind in brackets."""
    found = personal_data(docs.withColumn("_whole", F.col(text_col)), text_col)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))
    built = F.aggregate(ordered, begin, lambda a, s: F.struct(
        F.when(s["end"] <= a["at"], a["done"]).otherwise(F.concat(
            a["done"], F.substr("_whole", (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int")), F.lit("["), s["kind"], F.lit("]"))).alias("done"),
        F.greatest(a["at"], s["end"]).alias("at")))
    text = F.concat(built["done"], F.substr("_whole", (built["at"] + 1).cast("int")))
    return found.withColumn(text_col, F.when(F.size("spans") > 0, text).otherwise(F.col("_whole"))).select(*docs.columns)
