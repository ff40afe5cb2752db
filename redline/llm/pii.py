"""Personal data by anchor expansion.

One Aho-Corasick pass finds the anchors: at-signs, digits, plus signs, URL schemes
and identifier cues. From each anchor a deterministic local parser expands to the
boundaries of the email, address or account and validates it (digit counts, Luhn,
octets, mod 97). A parser reads each stretch of text once per kind, so long runs of
digits or of address characters stay linear.

Base kinds: email, ip, card, phone. Added by the method: url, account (a cue such as
"iban" or "account" followed by an identifier), secret (a cue such as "api_key=" or
the prefix of an access key).

Defined results: a null text is empty; an empty text has no spans. Spans of one kind don't
overlap, the leftmost stays; those of different kinds may. Rows of the same id are rows of
their own. Only doc_id and text are read, so other columns may have any name; a stage keeps
them. An empty table gives an empty result."""

from __future__ import annotations

import hashlib
import re
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redline.llm.common import map_rows

KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE = KINDS[:4]

# What the parsers accept next to an anchor.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL = re.compile(r"[^\s<>\"'|]+")
SCHEMES = ("http://", "https://", "ftp://")
ACCOUNT_CUES = ("iban", "account", "acct", "ssn", "passport")
SECRET_CUES = ("api_key", "apikey", "api-key", "secret", "token", "password", "passwd")
LABEL = re.compile(r"(?:\s*(?:number|no\.?|nr\.?|id))?[\s:=#]{1,4}", re.I)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
ACCOUNT = re.compile(r"(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{0,2}[0-9]{6,17})(?![A-Za-z0-9])")
SECRET = re.compile(r"[\"']?\s{0,2}[:=]\s{0,2}[\"']?([A-Za-z0-9_\-/+]{12,})")
ACCESS_KEY = re.compile(r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")


@cache
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in [("@", "@"), ("+", "+"), ("AKIA", "key"), *((d, "0") for d in "0123456789"), *((s, "url") for s in SCHEMES),
                       *((c, "account") for w in ACCOUNT_CUES for c in (w, w.upper(), w.capitalize())),
                       *((c, "secret") for w in SECRET_CUES for c in (w, w.upper(), w.capitalize()))]:
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d)
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban(text: str, at: int) -> int:
    """Where an international account number that starts at `at` ends, 0 if none does:
    the longest reading that ends at a boundary, has 15 to 34 letters and passes modulo 97."""
    m = IBAN.match(text, at)
    end = m.end() if m else 0
    while end > at + 14:
        value = text[at:end].replace(" ", "")
        if not text[end:end + 1].isalnum() and 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1:
            return end
        end -= 1
    return 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by kind as in KINDS, then start."""
    text = text or ""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    past = dict.fromkeys(KINDS, 0)  # where the next match of a kind may start
    for last, (kind, size) in anchors().iter(text):
        at = last - size + 1
        if kind == "0":
            if at >= past["card"]:
                if m := CARD.match(text, at):
                    past["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(m.span())
            if at >= past["ip"]:
                if m := QUAD.match(text, at):
                    past["ip"] = m.end()
                    if all(map(octet, m[0].split("."))):
                        out["ip"].append(m.span())
                else:
                    past["ip"] = DIGITS.match(text, at).end()  # no digit of this run can start one
        elif kind == "@":
            start = at
            while start > past["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                out["email"].append((start, m.end()))
                past["email"] = m.end()
            else:
                past["email"] = max(past["email"], at)
        elif kind == "+":
            if at >= past["phone"] and (m := PHONE.match(text, at)):
                past["phone"] = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out["phone"].append(m.span())
        elif kind == "url":
            if at >= past["url"] and (m := URL.match(text, last + 1)):
                end = m.end()
                while end > last + 1 and text[end - 1] in ".,;:!?)":
                    end -= 1
                if end > last + 1:
                    out["url"].append((at, end))
                    past["url"] = end
        elif kind == "account":
            if at >= past["account"] and not (at and text[at - 1].isalnum()) and (m := LABEL.match(text, last + 1)):
                start = m.end()
                end = iban(text, start) or ((m := ACCOUNT.match(text, start)) and m.end()) or 0
                if end:
                    out["account"].append((start, end))
                    past["account"] = end
        elif kind == "secret":
            if at >= past["secret"] and (m := SECRET.match(text, last + 1)):
                out["secret"].append(m.span(1))
                past["secret"] = m.end(1)
        elif kind == "key":
            if at >= past["secret"] and not (at and text[at - 1].isalnum()) and (m := ACCESS_KEY.match(text, at)):
                out["secret"].append(m.span())
                past["secret"] = m.end()
    return [(k, a, b) for k in KINDS for a, b in out[k]]


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; where spans overlap
    the one that starts first, then the longest, names the whole stretch."""
    if not text:
        return text
    spans = sorted((a, -b, k) for k, a, b in find(text))
    out, done, at = [], 0, 0
    while at < len(spans):
        start, end, kind = spans[at][0], -spans[at][1], spans[at][2]
        at += 1
        while at < len(spans) and spans[at][0] < end:
            end = max(end, -spans[at][1])
            at += 1
        out += [text[done:start], f"[{kind.upper()}]"]
        done = end
    return "".join([*out, text[done:]])


SCHEMA = "doc_id long,n_email long,n_ip long,n_card long,n_phone long,base_sha256 string,spans string"


def digest(doc_id: int | None, text: str | None) -> tuple:
    spans = find(text)
    own = [[k for k, _, _ in spans].count(b) for b in BASE]
    said = [f"{k}:{a}:{b}" for k, a, b in spans]
    return (doc_id, *own, hashlib.sha256(",".join(said[: sum(own)]).encode()).hexdigest(), ",".join(said))


def query(docs: DataFrame) -> DataFrame:
    return map_rows(docs.select("doc_id", "text"), SCHEMA, lambda: digest)


def scrub(docs: DataFrame) -> DataFrame:
    """Stage: `docs` with redacted texts, same rows and columns; n_chars, if there, follows the text."""
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(redact, na_action="ignore")

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
