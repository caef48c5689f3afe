"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
scheme marks and identifier cues.  From each anchor a local parser expands to
the left and right, and validates what it has found.  Base kinds (email, ip,
card, phone) give exactly the leftmost non-overlapping matches of their
patterns; the method adds web addresses that carry credentials, account numbers,
IBANs and secrets.

Rows: a null text is empty; texts are read whole, however long; equal rows get
equal results; an empty table gives no rows; extra columns pass through
``redact`` and are ignored by ``find``.
"""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account", "secret")

# The patterns that expand an anchor; base kinds as agreed.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+").match
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)").match
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+").match
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").match
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,30}\Z")
_LOGIN = re.compile(r"[^\s<>\"'`|\\^{}/?#]*@").match  # credentials before the host
_REST = re.compile(r"[^\s<>\"'`|\\^{}]+").match
_AFTER = re.compile(r"\s*(?:number|no\.?|nr\.?|#)?\s*[:=#]?\s*", re.IGNORECASE).match
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[ ]?[A-Za-z0-9]){11,30}(?![A-Za-z0-9])").match
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![0-9])").match
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])").match
_VALUE = re.compile(r"""\s*[:=]\s*(["']?)([^\s"',;]{6,})\1""").match
_SET = re.compile(r"""\s*[:=]\s*["']?""").match  # what stands between a cue and its value
_KEY_ID = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])").match

#: Cue -> parser that reads what follows it.
CUES = {
    "iban": "iban", "account": "account", "acct": "account", "konto": "account", "cuenta": "account", "compte": "account", "ssn": "ssn",
    "social security": "ssn", "password": "secret", "passwd": "secret", "passphrase": "secret", "secret": "secret", "token": "secret",
    "api_key": "secret", "apikey": "secret", "api-key": "secret", "access_key": "secret", "akia": "key"}


@functools.cache
def _anchors():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for ch in "0123456789":
        machine.add_word(ch, ("digit", 1))
    machine.add_word("@", ("at", 1))
    machine.add_word("+", ("plus", 1))
    machine.add_word("://", ("scheme", 3))
    for cue, parser in CUES.items():
        machine.add_word(cue, (parser, len(cue)))
    machine.make_automaton()
    return machine


def _luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = int(ch) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _iban(text: str) -> bool:
    plain = text.replace(" ", "").upper()
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data, in code points, by kind as in KINDS and then by start."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(BASE, 0)  # where the last match of each base kind ended
    past = dict.fromkeys(("url", "secret"), 0)  # these run to the next space: none that would end inside another is looked for, so a text is read once
    for last, (anchor, width) in _anchors().iter(low):
        at = last - width + 1
        if anchor == "digit":
            if at >= done["card"] and (m := _CARD(text, at)):
                done["card"] = m.end()
                if 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
                    found["card"].append(m.span())
            if at >= done["ip"] and (at == done["ip"] or not "0" <= text[at - 1] <= "9") and (m := _IP(text, at)):
                done["ip"] = m.end()
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                    found["ip"].append(m.span())
        elif anchor == "at":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN(text, at + 1)):
                done["email"] = m.end()
                found["email"].append((start, m.end()))
        elif anchor == "plus":
            if at >= done["phone"] and (m := _PHONE(text, at)):
                done["phone"] = m.end()
                if 8 <= len(_digits(m[0])) <= 15:
                    found["phone"].append(m.span())
        elif anchor == "scheme":
            if at >= past["url"] and _LOGIN(text, last + 1) and (m := _SCHEME.search(text, max(0, at - 32), at)):
                rest = _REST(text, last + 1)
                past["url"] = rest.end()
                found["url"].append((m.start(), last + 1 + len(rest[0].rstrip(".,;:!?)]"))))
        elif anchor == "key":
            if (at == 0 or not text[at - 1].isalnum()) and (m := _KEY_ID(text, at)):
                found["secret"].append(m.span())
        elif anchor == "secret":
            # a value that starts inside another ends with it; one that starts behind it is new, as in "secret: password = ..."
            inside = at < past["secret"] and not ((m := _SET(text, last + 1)) and m.end() >= past["secret"])
            if not inside and (m := _VALUE(text, last + 1)):
                past["secret"] = m.end()
                found["secret"].append(m.span(2))
        else:
            if (at and text[at - 1].isalpha()) or (last + 1 < len(text) and text[last + 1].isalpha()):
                continue
            start = _AFTER(text, last + 1).end()
            if anchor == "iban" and (m := _IBAN(text, start)):
                end = m.end()
                while end > start and not _iban(text[start:end]):  # words may follow the number after a space
                    end = text.rfind(" ", start, end)
                if end > start:
                    found["iban"].append((start, end))
            elif anchor == "account" and (m := _ACCOUNT(text, start)) or anchor == "ssn" and (m := _SSN(text, start)):
                found["account"].append(m.span())
    return [(k, a, b) for k in KINDS for a, b in sorted(set(found[k]))]


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """*text* with every span replaced by its kind in brackets; overlapping spans are replaced as one, named by the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the four base counts, base_sha256, spans per row."""
    def run(batches):
        for batch in batches:
            counts: list[list[int]] = [[] for _ in BASE]
            digests, all_spans = [], []
            for t in batch.column(1):
                spans = find_spans(t.as_py() or "")
                for column, kind in zip(counts, BASE):
                    column.append(sum(s[0] == kind for s in spans))
                digests.append(hashlib.sha256(spans_text([s for s in spans if s[0] in BASE]).encode()).hexdigest())
                all_spans.append(spans_text(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(all_spans, pa.string())],
                names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])
    counts = ", ".join(f"n_{k} long" for k in BASE)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """*docs* with personal data in ``text`` replaced by its kind, and ``n_chars``, if there is one, counted anew where text changed."""
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [t if t is None else redacted(t, find_spans(t)) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if count is not None:
                kept = batch.column(count).to_pylist()
                columns[count] = pa.array([n if t == u else len(u) for t, u, n in zip(old, new, kept)], batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
    return docs.mapInArrow(run, docs.schema)
