"""Licence recognition by sentences and rules.

A text is cut into sentences: at `.`, `!`, `?`, `;` and `:` (not inside a number or after `Identifier`), and at blank
lines; a sentence may run over lines, and any run of its whole lines counts as one too, so a
notice after a heading without a full stop is still seen.  Normalised sentences are looked
up in a table of known licence sentences; the identifiers found, in the order of the text,
are matched against ordered rules, each a sequence of identifiers that names a licence.  At a
place the first rule that fits takes its sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.common import slices, text_or_empty
from tidelog.llm.licences import CATEGORY, OWNER, owned, rules, sentence_table

#: Sentence ends become 0x01 (blank lines are so before), new lines stay, other bytes that are no ASCII letter or digit are spaces.
CLEAN = bytes(1 if chr(b) in ".!?;\x01" else 10 if b == 10 else b + 32 if 65 <= b <= 90 else b if chr(b).isascii() and chr(b).isalnum() else 32 for b in range(256))
INSIDE_NUMBER = re.compile(rb"(?<=[0-9vV])\.(?=[0-9 ])(?! *[A-Z])")
COLON = re.compile(rb"(?<![Ii]dentifier):(?=\s)")
BLANK = re.compile(rb"\n[ \r\t]*\n")
WORD = re.compile(rb"[0-9a-z]+")
ENDS = re.compile(rb" *+(?:[\n\x01]|\Z)")
HINT = re.compile(rb"licen[sc]e|copyright|spdx")
ADDED = ["licenses", "category", "n_sentences", "n_unknown"]


@cache
def known() -> tuple[dict[bytes, str], re.Pattern[bytes], re.Pattern[bytes]]:
    """The table, a pattern of the places where one of its sentences may begin, and one of as
    many words as the longest has (white space may be as wide as it likes)."""
    table = sentence_table()
    heads = sorted({b" ".join(s.split()[:2]) for s in table})
    start = re.compile(rb"(?:\A|[\n\x01])[ \n]*(" + b"|".join(h.replace(b" ", rb"[ \n]+") for h in heads) + rb")(?![0-9a-z])")
    most = max(len(s.split()) for s in table) + OWNER
    return table, start, re.compile(rb"(?:[0-9a-z]++[^0-9a-z]*+){1,%d}" % most)


def sentences(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, identifier) of the known sentences of a text, in order, apart."""
    table, start, window = known()
    named = owned()
    clean = cleaned(text)
    out, end, at = [], 0, 0
    while m := start.search(clean, at):
        lo = m.start(1)
        at = m.end(1)  # what ends a sentence stands there or later
        words = list(WORD.finditer(clean, lo, window.match(clean, lo).end()))
        for i in range(len(words), 0, -1):  # the longest first; a known one may hold a colon
            cut = words[i - 1].end()
            if not ENDS.match(clean, cut):
                continue
            body = b" ".join(w[0] for w in words[:i])
            if name := table.get(body) or next((k for k, p in named if p.fullmatch(body)), None):
                if lo >= end:
                    out.append((lo, cut, name))
                    end = at = cut
                break
    return out


def cleaned(text: bytes) -> bytes:
    text = COLON.sub(b".", INSIDE_NUMBER.sub(b" ", text.replace(b"\x01", b" ")))
    return BLANK.sub(lambda m: b"\x01" * len(m[0]), text).translate(CLEAN)


def recognise(names: list[str], joined: list[bool] | None = None) -> list[str]:
    """Licences of a sequence of identifiers; joined[i]: nothing stands between i and i + 1.

    A licence takes an `All rights reserved.` that is joined to it."""
    found, i, ordered = [], 0, rules()
    while i < len(names):
        for licence, ids in ordered:
            if tuple(names[i : i + len(ids)]) == ids:
                found.append((licence, i, i + len(ids)))
                i += len(ids)
                break
        else:
            i += 1
    reserved = {lo for _, lo, _ in found if names[lo] == "reserved"}
    ends = {x for _, lo, hi in found if lo not in reserved for x in (lo - 1, hi) if joined and x in reserved and joined[min(x, lo if x < lo else hi - 1)]}
    return [licence for licence, lo, _ in found if lo not in ends]


def joins(text: bytes, spans: list[tuple[int, int, str]]) -> list[bool]:
    """Whether no letter or digit stands between a known sentence and the next."""
    return [not any(c.isalnum() for c in text[a[1] : b[0]].decode("utf-8", "ignore")) for a, b in zip(spans, spans[1:])]


def unknown(text: bytes, spans: list[tuple[int, int, str]]) -> int:
    """Mentions of a licence outside of all known sentences."""
    return sum(1 for m in HINT.finditer(text.lower()) if not any(lo <= m.start() < hi for lo, hi, _ in spans))


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with licenses (distinct, sorted), category (the strictest of restricted, copyleft,
    permissive, public-domain; none without a licence), n_sentences (known ones) and n_unknown
    (mentions of a licence outside of these) added; columns of these names are replaced.

    Null and empty texts have none; repeated rows each give a row; an empty table none.
    """
    docs = docs.drop(*ADDED)
    at = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strict = ["restricted", "copyleft", "permissive", "public-domain"]
        for b in slices(batches, 2000):
            rows = []
            for text in text_or_empty(b.column(at)):
                spans = sentences(text)
                found = sorted(set(recognise([s[2] for s in spans], joins(text, spans))))
                kinds = {CATEGORY[x] for x in found}
                rows.append((found, next((k for k in strict if k in kinds), "none"), len(spans), unknown(text, spans)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (2, 3))], names=[*b.schema.names, *ADDED])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "licenses array<string>, category string, n_sentences long, n_unknown long"])
    return docs.mapInArrow(scan, schema)
