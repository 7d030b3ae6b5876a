"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, a plus before a digit, a digit before a dot,
two digits with at most a blank or hyphen between them, schemes, and cues of identifiers. At each anchor
a local parser expands to the boundaries and validates. No other part of a text is looked at, and each
parser starts behind its last match, so the work is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

DIGITS = "0123456789"
BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds; their spans follow those of the base kinds.
ADDED_KINDS = ("account", "login")
KINDS = BASE_KINDS + ADDED_KINDS
SECRET_CUES = ("api_key", "apikey", "password", "secret", "token")
ACCOUNT_CUES = ("account", "iban", "passport", "ssn")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBER = re.compile(r"[0-9]+")
DIGIT_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE_RUN = re.compile(r"[ ().0-9-]*")
SECRET_VALUE = re.compile(r"""[ ]?[=:][ ]?(["']?)([A-Za-z0-9_./+-]{16,})""")
ACCOUNT_START = re.compile(r"[ ]?(?:no\.?|number|#)?[ ]?[=:]?[ ]?(?=[A-Za-z]{0,2}[0-9])", re.I)
ACCOUNT_MOST = 34
#: A group of an identifier and what parts it from the next one; a longer group is none, so no more is read.
ACCOUNT_GROUP = re.compile(f"([A-Za-z0-9]{{1,{ACCOUNT_MOST + 1}}})([ -]?)")
#: Characters of an IBAN by its country.
IBAN_LENGTHS = {
    pair[:2]: int(pair[2:])
    for pair in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 "
        "FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 "
        "LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 "
        "SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
LOGIN = re.compile(r"[A-Za-z0-9._%+-]+:[^\s/@]+@[A-Za-z0-9.-]+")

Span = tuple[int, int]
Parser = Callable[[str, int, int, int], "tuple[Span | None, int]"]


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def email(text: str, start: int, end: int, done: int) -> tuple[Span | None, int]:
    """At an at-sign: local characters to the left, then labels with at least one dot between them."""
    left = start
    while left > done and text[left - 1] in LOCAL:
        left -= 1
    right = DOMAIN.match(text, end) if left < start else None
    return ((left, right.end()), right.end()) if right else (None, done)


def ip(text: str, start: int, end: int, done: int) -> tuple[Span | None, int]:
    """At a digit before a dot: four numbers; one above 255 discards the match, not what follows."""
    left = start
    while left > done and text[left - 1] in DIGITS:
        left -= 1
    at, valid = left, True
    for part in range(4):
        number = NUMBER.match(text, at)
        if not number or part < 3 and text[number.end() : number.end() + 1] != ".":
            return None, done
        value = number[0].lstrip("0")
        valid = valid and len(value) <= 3 and int(value or 0) <= 255
        at = number.end() + 1
    return (left, number.end()) if valid else None, number.end()


def card(text: str, start: int, end: int, done: int) -> tuple[Span | None, int]:
    """At the first two digits of a chain: the whole chain, by number of digits and check digit."""
    chain = DIGIT_CHAIN.match(text, start)
    digits = chain[0].replace(" ", "").replace("-", "")
    valid = 13 <= len(digits) <= 19 and luhn(digits)
    return chain.span() if valid else None, chain.end()


def phone(text: str, start: int, end: int, done: int) -> tuple[Span | None, int]:
    """At a plus and a digit: as far as the last digit among digits and separators."""
    right = PHONE_RUN.match(text, end).end()
    while right > end and text[right - 1] not in DIGITS:
        right -= 1
    if right < end + 2:
        return None, done
    digits = sum(c in DIGITS for c in text[start:right])
    return (start, right) if 9 <= digits <= 15 else None, right


def secret(text: str, start: int, end: int, done: int) -> tuple[Span | None, int]:
    """After a cue such as ``token``: an assigned value of 16 characters or more."""
    value = SECRET_VALUE.match(text, end)
    return (value.span(2), value.end()) if value else (None, done)


def iban(plain: str) -> bool:
    """By its country's length and its check digits."""
    plain = plain.upper()
    if len(plain) != IBAN_LENGTHS.get(plain[:2]):
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def account(text: str, start: int, end: int, done: int) -> tuple[Span | None, int]:
    """After a cue such as ``iban``: an identifier with 6 to 34 characters, most of them digits.

    It goes on from group to group as long as a group has a digit, or is a capital letter or two at most
    with a group of digits behind it; prose ends it. An IBAN ends where its country's length and its check
    digits say, its groups being of any letters; otherwise the longest run of groups that is valid counts.
    """
    opening = ACCOUNT_START.match(text, end)
    if not opening:
        return None, done
    first = at = opening.end()
    plain, stop, prose = "", None, False
    while group := ACCOUNT_GROUP.match(text, at):
        own = group[1]
        if len(plain) + len(own) > ACCOUNT_MOST:
            break
        plain += own
        digits = sum(c in DIGITS for c in own)
        if iban(plain):
            stop = group.end(1)
            break
        if not digits and first < at:
            # Letters alone part groups of digits only as a short mark.
            behind = ACCOUNT_GROUP.match(text, group.end())
            mark = len(own) <= 2 and own.isupper() and group[2] and behind and behind[1][0] in DIGITS
            prose = prose or not mark
        if not prose and digits and 6 <= len(plain) and 2 * sum(c in DIGITS for c in plain) > len(plain):
            stop = group.end(1)
        if not group[2] or prose and plain[:2].upper() not in IBAN_LENGTHS:
            break
        at = group.end()
    return ((first, stop), stop) if stop else (None, done)


def login(text: str, start: int, end: int, done: int) -> tuple[Span | None, int]:
    """After a scheme: user and password before a host."""
    value = LOGIN.match(text, end)
    return (value.span(), value.end()) if value else (None, done)


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    """Anchor strings to (kind, parser, length)."""
    found: list[tuple[str, int, Parser]] = [("@", 0, email), ("://", 5, login)]
    for a in DIGITS:
        found += [(f"{a}.", 1, ip), (f"+{a}", 3, phone)]
        found += [(a + between + b, 2, card) for b in DIGITS for between in ("", " ", "-")]
    for cues, parser in ((SECRET_CUES, secret), (ACCOUNT_CUES, account)):
        found += [(form, 4, parser) for cue in cues for form in {cue, cue.upper(), cue.capitalize()}]
    automaton = ahocorasick.Automaton()
    for string, kind, parser in found:
        automaton.add_word(string, (kind, parser, len(string)))
    automaton.make_automaton()
    return automaton


def find(text: str) -> list[list[Span]]:
    """The spans of each kind, ascending; code points, end exclusive."""
    spans: list[list[Span]] = [[] for _ in KINDS]
    done = [0] * len(KINDS)
    if text:
        for last, (kind, parser, length) in anchors().iter(text):
            start = last + 1 - length
            if start >= done[kind]:
                span, done[kind] = parser(text, start, last + 1, done[kind])
                if span:
                    spans[kind].append(span)
    return spans


def written(spans: list[list[Span]], kinds: int) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, found in zip(KINDS[:kinds], spans) for s, e in found)


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Personal data of every text: ``key``, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Spans are written kind:start:end, by kind, then start. A null or empty text has none; a null key
    stays null; equal rows each get their row; an empty table gives an empty result; other columns are
    ignored, whatever their names. Texts are read whole, in time linear in their length.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                spans = find(value.as_py() or "")
                base = hashlib.sha256(written(spans, len(BASE_KINDS)).encode()).hexdigest()
                rows.append((*map(len, spans[: len(BASE_KINDS)]), base, written(spans, len(KINDS))))
            counts, (digests, texts) = [[r[k] for r in rows] for k in range(4)], [[r[k] for r in rows] for k in (4, 5)]
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                names=[key, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"],
            )

    kind = docs.schema[key].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return docs.select(key, text).mapInArrow(scan, f"`{key}` {kind}, {counts}, base_sha256 string, spans string")


def mask(text: str) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first."""
    spans = sorted((s, -e, k) for k, found in zip(KINDS, find(text)) for s, e in found)
    parts, at, covered = [], 0, 0
    for start, end, kind in spans:
        if start >= covered:
            parts += [text[at:start], f"<{kind}>"]
            at = -end
        covered = max(covered, -end)
        at = max(at, covered)
    return "".join([*parts, text[at:]]) if parts else text


def mask_personal_data(docs: DataFrame, text: str = "text", n_chars: str | None = None) -> DataFrame:
    """The same rows and columns with personal data masked; ``n_chars`` names a column to recount.

    Null texts stay null and texts without personal data stay as they are.
    """
    place = docs.columns.index(text)
    count = docs.columns.index(n_chars) if n_chars else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if v is None else mask(v) for v in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            if count is not None:
                columns[count] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(count).type)
            yield pa.record_batch(columns, schema=batch.schema)

    return docs.mapInArrow(scan, docs.schema)
