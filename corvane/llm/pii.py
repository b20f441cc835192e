"""Format-preserving pseudonyms: validated numbers, dates, addresses and secrets, permuted by a keyed Feistel network."""

from __future__ import annotations

import datetime
import hmac
import ipaddress
import math
import re
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ASCII_LOWER, text_runs

ROUNDS = 10
#: The session's setting that holds the key.
KEY_SETTING = "spark.corvane.pii.key"
#: Bytes of text that a worker goes through at once.
RUN_BYTES = 4_000_000
#: The calling codes of one and of two digits; all others have three.
SHORT_CODES = {"1", "7"}
TWO_DIGIT_CODES = {
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
    "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
}
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: What may hold something private, tried in this order at each place; each is then validated.
FORMS = re.compile(
    r"""(?P<email>(?<![\w.+-])[\w.+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?!\w))
    |(?<!\w)(?:api[_-]?key|access[_-]?key|token|secret|passw(?:or)?d|key)\s{0,3}[:=]\s{0,3}["']?(?P<secret>[A-Za-z0-9_+/=-]{16,})
    |(?P<iban>(?<!\w)(?-i:[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?)(?!\w))
    |(?P<date>(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\w/-]|\.\d))
    |(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))
    |(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
    |(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ ]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-]))
    |(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))""",
    re.VERBOSE | re.IGNORECASE,
)
MAYBE = re.compile(r"\d|@|[:=]")
#: How many letters and digits an IBAN has, by country.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


class Feistel:
    """A keyed permutation of 0 to n - 1: rounds over two unequal halves, walked until the value lies inside."""

    def __init__(self, key: bytes):
        self.key = key

    def permuted(self, value: int, n: int, tweak: str) -> int:
        if n < 2:
            return value
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = value % a, value // a
            for k in range(ROUNDS):
                if k % 2:
                    right = (right + self.noise(left, k, n, tweak)) % b
                else:
                    left = (left + self.noise(right, k, n, tweak)) % a
            value = right * a + left
            if value < n:
                return value

    def noise(self, half: int, k: int, n: int, tweak: str) -> int:
        return int.from_bytes(hmac.digest(self.key, f"{tweak}|{n}|{k}|{half}".encode(), "sha256"), "big")

    def text(self, text: str, tweak: str) -> str:
        """``text`` with its ASCII letters and digits permuted together, each within its class; the rest stays."""
        places = [(i, c) for i, ch in enumerate(text) for c in CLASSES if ch in c]
        n = value = 0
        if places:
            n = math.prod(len(c) for _, c in places)
            for i, c in places:
                value = value * len(c) + c.index(text[i])
            value = self.permuted(value, n, tweak)
        out = list(text)
        for i, c in reversed(places):
            value, k = divmod(value, len(c))
            out[i] = c[k]
        return "".join(out)


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(int(d) * (2 - k % 2), 10)) for k, d in enumerate(reversed(body)))
    return str(-total % 10)


def refilled(form: str, digits: str) -> str:
    """``form`` with its letters and digits replaced in turn by ``digits``; separators stay."""
    rest = iter(digits)
    return "".join(next(rest) if c.isalnum() else c for c in form)


def iban_rest(compact: str) -> int:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


class Pseudonyms:
    """Validates what a form matched and gives its pseudonym, or None where it isn't what it looks like."""

    def __init__(self, key: bytes):
        self.feistel = Feistel(key)

    def card(self, found: str) -> str | None:
        digits = re.sub(r"\D", "", found)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        body = self.feistel.text(digits[:-1], "card")
        return refilled(found, body + luhn_digit(body))

    def iban(self, found: str) -> str | None:
        compact = found.replace(" ", "")
        if compact != compact.upper() or not 15 <= len(compact) <= 34 or iban_rest(compact) != 1:
            return None
        body = self.feistel.text(compact[4:], "iban" + compact[:2])
        check = 98 - iban_rest(compact[:2] + "00" + body)
        return refilled(found, f"{compact[:2]}{check:02d}{body}")

    def date(self, found: str) -> str | None:
        day = None
        for form in ["%Y-%m-%d"] if found[4] == "-" else [f"%d{found[2]}%m{found[5]}%Y", f"%m{found[2]}%d{found[5]}%Y"]:
            try:
                day = datetime.datetime.strptime(found, form).date().toordinal()
                break
            except ValueError:
                continue
        if day is None or not FIRST_DAY <= day <= LAST_DAY:
            return None
        day = FIRST_DAY + self.feistel.permuted(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date")
        moved = datetime.date.fromordinal(day)
        return form.replace("%Y", f"{moved.year:04d}").replace("%m", f"{moved.month:02d}").replace("%d", f"{moved.day:02d}")

    def ip(self, found: str) -> str | None:
        try:
            number = int(ipaddress.IPv4Address(found))
        except ValueError:
            return None
        return str(ipaddress.IPv4Address(self.feistel.permuted(number, 1 << 32, "ip")))

    def ssn(self, found: str) -> str | None:
        if found[:3] in ("000", "666") or found[0] == "9" or found[4:6] == "00" or found[7:] == "0000":
            return None
        while True:  # walked until the pseudonym is valid too
            found = self.feistel.text(found, "ssn")
            if not (found[:3] in ("000", "666") or found[0] == "9" or found[4:6] == "00" or found[7:] == "0000"):
                return found

    def phone(self, found: str) -> str | None:
        """The calling code stays, by the numbering plan; numbers in the layouts without one are of code 1. A trunk
        prefix in brackets, (0), stays too, so a number is the same value in every layout."""
        digits = re.sub(r"\D", "", found)
        if not 8 <= len(digits) <= 15:
            return None
        code, held = "1", ""
        if found[0] == "+":
            code = held = digits[: 1 if digits[0] in SHORT_CODES else 2 if digits[:2] in TWO_DIGIT_CODES else 3]
        national = digits[len(held) :]
        if "(0)" in found and national[0] == "0":
            held, national = held + "0", national[1:]
        return refilled(found, held + self.feistel.text(national, "phone" + code))

    def email(self, found: str) -> str | None:
        """Case makes no difference to the value, and each letter keeps its own."""
        local, _, domain = found.rpartition("@")
        new = self.feistel.text(local.translate(ASCII_LOWER), "email" + domain.lower())
        return "".join(b.upper() if "A" <= a <= "Z" else b for a, b in zip(local, new)) + "@" + domain

    def secret(self, found: str) -> str | None:
        if not any(c.isdigit() for c in found):
            return None  # a plain word isn't a secret
        hexes = next((a for a in ("0123456789abcdef", "0123456789ABCDEF") if set(found) <= set(a)), None)
        if not hexes:
            return self.feistel.text(found, "secret")
        value = self.feistel.permuted(int(found, 16), 16 ** len(found), "secret")
        out = f"{value:0{len(found)}x}"
        return out.upper() if hexes[-1] == "F" else out

    def ends(self, kind: str, found: str) -> list[int]:
        """Where what was matched may end, in the order to try: a card or an IBAN may have taken what follows it."""
        out = [len(found)]
        if kind == "card":
            # a hyphen ends only a number that has none itself; else it is part of a longer one
            out += [i for i in range(len(found) - 1, 12, -1) if found[i] == " " or found[i] == "-" and "-" not in found[:i]]
            out = [i for i in out if sum(map(str.isdigit, found[:i])) >= 13]
        elif kind == "iban":
            out += [i for i in range(len(found) - 1, 14, -1) if found[i] == " "]
            out.sort(key=lambda i: i - found.count(" ", 0, i) != IBAN_LENGTHS.get(found[:2]))
        return out

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of all that is private in ``text``, from left to right."""
        if not MAYBE.search(text):
            return []
        out, at = [], 0
        while m := FORMS.search(text, at):
            kind = m.lastgroup
            found = m[kind]
            start = m.start(kind)
            for end in self.ends(kind, found):
                if (new := getattr(self, kind)(found[:end])) is not None:
                    out.append((start, start + end, kind, new))
                    at = start + end
                    break
            else:
                at = start + 1
        return out


def session_key(spark: SparkSession) -> bytes:
    """The key in ``spark.corvane.pii.key``. Where that is unset, one drawn for this process alone and kept nowhere, so
    that no one can take the pseudonyms back; set the key for values to stay linked from run to run."""
    found = spark.conf.get(KEY_SETTING, None)
    if found:
        return found.encode()
    if not hasattr(session_key, "own"):
        session_key.own = os.urandom(32)
    return session_key.own


def pseudonymize(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with (text, spans) in a struct ``private`` beside a struct ``row`` of all its columns; one narrow pass.

    ``spans`` lists kind, start and end (in characters of the original). The same value under the same key has the
    same pseudonym in every document, whatever its separators (or an e-mail's case); an equal phone number written
    without its calling code is the same value where the layout is North American, else another one. A null text
    stays null and has no spans; repeated rows give repeated results, an empty table an empty one. Texts are whole,
    however long; further columns stay in ``row`` under whatever names.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            low = 0
            for part in text_runs(pc.struct_field(batch.column(0), text_col), RUN_BYTES):
                texts, spans = [], []
                for value in part:
                    text = value.as_py()
                    found = names.spans(text) if text else []
                    if found:
                        parts, last = [], 0
                        for start, end, _, new in found:
                            parts += [text[last:start], new]
                            last = end
                        text = "".join([*parts, text[last:]])
                    texts.append(text)
                    spans.append([{"kind": k, "start": s, "end": e} for s, e, k, _ in found])
                private = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(spans, kind)], ["text", "spans"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(part)), private], ["row", "private"])
                low += len(part)

    rows = docs.select(F.struct("*").alias("row"))
    private = StructType.fromDDL("private struct<text:string,spans:array<struct<kind:string,start:int,end:int>>>")
    return rows.mapInArrow(run, StructType([rows.schema["row"], *private]))
