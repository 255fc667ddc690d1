"""Personal data: Aho-Corasick finds anchors, local parsers expand each to the whole value and check it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import ID, TEXT, sha256_hex, slices

#: Base kinds, in the order of the result.
BASE = ("email", "ip", "card", "phone")
#: Kinds that cues and schemes add.
ADDED = ("account", "address", "secret")
KINDS = BASE + ADDED

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What may stand between a cue and its value.
LINK = re.compile(r"""(?:\s|number|no\.|nr\.|id|is|[:=#"'])*""", re.IGNORECASE)
#: Groups that hold digits, joined by single blanks or hyphens; the first may start with a country or series.
ACCOUNT = re.compile(
    r"[A-Za-z]{0,4}[0-9][A-Za-z0-9]{0,33}(?![A-Za-z0-9])(?:[ -](?=[A-Za-z]{0,33}[0-9])[A-Za-z0-9]{1,34}(?![A-Za-z0-9]))*"
)
#: Least digits, and least letters and digits, of an account number that is no IBAN.
ACCOUNT_DIGITS, ACCOUNT_SIZE = 3, 6
SECRET = re.compile(r"[A-Za-z0-9_+/=.~-]{16,}")
ACCESS_KEY = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
ADDRESS = re.compile(r"""[^\s/?#@"'<>]+@[^\s"'<>]+""")

#: Cue words for account numbers and for secrets.
ACCOUNT_CUES = ("account", "iban", "ssn", "passport", "konto", "compte", "cuenta")
SECRET_CUES = ("token", "secret", "api_key", "apikey", "password")

#: Letters and digits of each country's IBAN.
IBAN_SIZES = {
    m[:2]: int(m[2:])
    for m in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 "
        "FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 "
        "ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 "
        "ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}

SCHEMA = (
    f"{ID} bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, "
    "found array<struct<kind: string, start: int, end: int>>"
)


def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in (cue, cue.upper(), cue.capitalize()):
                found.add_word(form, (kind, len(cue)))
    for prefix in ("AKIA", "ASIA"):
        found.add_word(prefix, ("access", 4))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _plain(text: str, at: int) -> bool:
    return at < len(text) and text[at].isascii() and text[at].isalnum()


def iban_end(text: str, start: int) -> int | None:
    """End of the IBAN that starts here, by its country's length and its check digits; None if there is none."""
    size = IBAN_SIZES.get(text[start : start + 2].upper(), 0)
    chars, at = "", start
    while len(chars) < size:
        if chars and text[at : at + 1] in (" ", "-"):
            at += 1
        if not _plain(text, at):
            return None
        chars += text[at]
        at += 1
    if not size or _plain(text, at) or not chars[2:4].isdigit():
        return None
    return at if int("".join(str(int(c, 36)) for c in chars[4:] + chars[:4])) % 97 == 1 else None


def account_end(text: str, start: int) -> int | None:
    """End of the account number that starts here: an IBAN, or groups with enough digits."""
    if end := iban_end(text, start):
        return end
    m = ACCOUNT.match(text, start)
    enough = m and sum(c.isdigit() for c in m[0]) >= ACCOUNT_DIGITS and sum(c.isalnum() for c in m[0]) >= ACCOUNT_SIZE
    return m.end() if enough else None


def find(text: str, automaton: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in code points, end exclusive. Base kinds are the leftmost matches of their patterns."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    after = dict.fromkeys(KINDS, 0)
    tried = 0  # end of the last secret value looked at; a value that starts inside it ends there too

    def cue_value(kind: str, at: int) -> None:
        nonlocal tried
        start = LINK.match(text, at).end()
        if start == at or start < after[kind] or kind == "secret" and start < tried:
            return
        if kind == "account":
            end = account_end(text, start)
        else:
            m = SECRET.match(text, start)
            tried = m.end() if m else tried
            end = m.end() if m and any(c.isdigit() for c in m[0]) else None
        if end:
            found[kind].append((start, end))
            after[kind] = end

    for end, (anchor, width) in automaton.iter(text):
        at = end - width + 1
        if anchor == "digit":
            if at >= after["ip"]:
                m = DOTTED.match(text, at)
                after["ip"] = m.end()
                parts = m[0].split(".")
                for i in range(0, len(parts) - 3, 4):
                    start = at + sum(map(len, parts[:i])) + i
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts[i : i + 4]):
                        found["ip"].append((start, start + len(".".join(parts[i : i + 4]))))
            if at >= after["card"]:
                m = CARD.match(text, at)
                after["card"] = m.end() if m else at + 1
                if m:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
        elif anchor == "at":
            start = at
            while start > after["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                found["email"].append((start, m.end()))
                after["email"] = m.end()
        elif anchor == "plus":
            if at >= after["phone"] and (m := PHONE.match(text, at)):
                after["phone"] = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif anchor == "scheme":
            start = at
            while start > 0 and text[start - 1].isascii() and text[start - 1].isalnum():
                start -= 1
            m = ADDRESS.match(text, end + 1)
            if start < at and m and start >= after["address"]:
                found["address"].append((start, m.end()))
                after["address"] = m.end()
        elif anchor == "access":
            m = ACCESS_KEY.match(text, at)
            if m and at >= after["secret"] and not (at and text[at - 1].isalnum()):
                found["secret"].append(m.span())
                after["secret"] = m.end()
        else:
            cue_value(anchor, end + 1)
    return found


def listed(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind in kinds for start, end in found[kind])


def masked(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the first and longest names all."""
    spans = sorted((s, -e, kind) for kind in KINDS for s, e in found[kind])
    out, at = [], 0
    for start, minus_end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, -minus_end)
    return "".join(out) + text[at:] if out else text


def personal_data(docs: DataFrame, *, id_column: str = ID) -> DataFrame:
    """Per document the counts of the base kinds, their digest, and all spans.

    A null text, like an empty one, has no spans; a null id stays null; repeated rows
    give repeated rows; no documents give no rows. Texts of any length are read whole.
    Columns of ``docs`` beside the id and the text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for part in slices(batches, "_text"):
            rows = [find(text or "", automaton) for text in part.column(1).to_pylist()]
            counts = [pa.array([len(r[kind]) for r in rows], pa.int64()) for kind in BASE]
            base = pa.array([sha256_hex(listed(r, BASE).encode()) for r in rows], pa.string())
            spans = pa.array([listed(r, KINDS) for r in rows], pa.string())
            found = pa.array(
                [[{"kind": k, "start": s, "end": e} for k in KINDS for s, e in r[k]] for r in rows], pa.list_(span)
            )
            names = [ID, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found"]
            yield pa.record_batch([part.column(0), *counts, base, spans, found], names)

    picked = docs.select(F.col(id_column).cast("bigint").alias(ID), F.col(TEXT).alias("_text"))
    return picked.mapInArrow(run, SCHEMA)


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in the text replaced; all rows and other columns as they are, null texts null."""
    at = docs.columns.index(TEXT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for part in slices(batches, TEXT):
            texts = [None if t is None else masked(t, find(t, automaton)) for t in part.column(at).to_pylist()]
            yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
