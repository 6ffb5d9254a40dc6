"""Personal data: base patterns, and a linear-chain CRF over word-shape features that adds what they miss.

The CRF reads lines that hold a digit, an ``@``, a bracketed or a spelled-out dot or at; labels begin and continue each
kind. An added span must hold 9 to 15 digits (phone), 13 to 19 that pass Luhn (card), four numbers (ip), or an at-sign and a dot in
some spelling (email); lines without a trigger cannot hold such a span.

Every base pattern runs in time linear in the text: an e-mail is looked for around each ``@``, numbers only from where
digits begin.

Defined results: null text is empty text; empty text has no spans; repeated rows each get their row; an empty table
gives an empty result; other columns play no part. Base spans of different kinds may overlap and all stay; an added
span that shares a character with a base span goes; spans with one start are ordered by kind as listed. Work is by line
and linear in a text's length.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read
from .crf import Crf, train
from .spans import WORDS, Span, apart, crf_spans, marked, ordered, sha256

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[({](?:at|arobase)[\])}]|\x20(?:dot|punkt|point)\x20", re.I)


#: What may stand before each kind.
CUES = [["mail", "e-mail", "write to", "contact", "reach me at", "courriel"], ["host", "server", "address", "from", "ping"], ["card", "Karte", "carte", "tarjeta", "paid with", "Visa", "Amex"], ["phone", "Tel.", "tel", "call", "fax", "mobile", "appelez le", "téléphone", "Telefon", "llame al", "dial", "cell"]]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append(("email", a, done := m.end()))
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    out = _emails(text)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


def file_features(text: str) -> list[float]:
    return [1.0]


def labelled_table() -> list[tuple[list[str], list[int], list[float]]]:
    """The small labelled table, from fixed templates with a fixed seed. Label 2k + 1 begins kind k, 2k + 2 continues it."""
    r = random.Random(11)
    syllables = "th an er on in ti ed ou nd ha re es at en be le la que ment eau ung keit sch ver aci doz".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    plain_word = lambda: r.choice(WORDS) if r.random() < 0.5 else word()
    prose = lambda a, b: " ".join(plain_word() for _ in range(r.randint(a, b)))
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    octet = lambda: str(r.randint(0, 255))
    make = {
        0: [lambda: f"{word()}.{d(2)}@mail{d(1)}.example.com", lambda: f"{word()}@{word()}.org", lambda: f"{word()} (at) {word()} (dot) com", lambda: f"{word()} [at] {word()} [dot] net", lambda: f"{word()}_{d(2)}@{word()}.de", lambda: f"{word()} @ {word()}.com",
            lambda: f"{word()} at {word()} dot {r.choice(['com', 'org', 'net', 'de', 'fr', 'edu'])}", lambda: f"{word()} dot {word()} at {word()} dot {r.choice(['com', 'org', 'net', 'io'])}", lambda: f"{word()}.{word()} at {word()} dot {r.choice(['com', 'org', 'uk'])}", lambda: f"{word()} AT {word()} DOT {r.choice(['COM', 'ORG'])}", lambda: f"{word()}{{at}}{word()}{{dot}}org", lambda: f"{word()}(at){word()}.com", lambda: f"{word()}.{word()}[at]{word()}.org"],
        1: [lambda: ".".join(octet() for _ in range(4)), lambda: "[.]".join(octet() for _ in range(4))],
        2: [lambda: d(16), lambda: " ".join(d(4) for _ in range(4)), lambda: "-".join(d(4) for _ in range(4)), lambda: d(15), lambda: f"{d(4)} {d(6)} {d(5)}", lambda: ".".join(d(4) for _ in range(4))],
        3: [lambda: f"+1 ({d(3)}) 555-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"+49 {d(3)} {d(7)}", lambda: f"0{d(3)} {d(3)} {d(4)}", lambda: f"0{d(3)}/{d(7)}",
            lambda: " ".join(["0" + d(1), *(d(2) for _ in range(4))]), lambda: ".".join(["0" + d(1), *(d(2) for _ in range(4))]), lambda: "-".join(["0" + d(1), *(d(2) for _ in range(4))]), lambda: f"0{d(4)} {d(6)}", lambda: f"0{d(2)} {d(4)} {d(4)}", lambda: f"0{d(2)}-{d(4)}-{d(4)}", lambda: f"00{d(2)} {d(2)} {d(3)} {d(4)}", lambda: f"1-{d(3)}-{d(3)}-{d(4)}", lambda: f"9{d(2)} {d(3)} {d(3)}", lambda: f"6{d(2)} {d(2)} {d(2)} {d(2)}"],
    }
    rows = []
    for kind, shapes in make.items():
        for shape in shapes:
            for _ in range(32):
                cue = r.choice(CUES[kind]) if r.random() < 0.4 else prose(0, 6)
                rows.append([(cue + r.choice([" ", ", ", ": "]), 0), (shape(), kind + 1), (r.choice(["", ".", ","]) + " " + prose(0, 6), 0)])
    plain = [lambda: f"{prose(2, 6)} {d(r.randint(1, 4))} {prose(1, 5)}.", lambda: f"{prose(1, 4)} 20{d(2)}-0{d(1)}-1{d(1)} {prose(1, 4)}", lambda: f"Apache License, Version {d(1)}.{d(1)}.", lambda: f"Licensed under CC BY-NC {d(1)}.0.", lambda: f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}" {prose(1, 5)}', lambda: f"{prose(1, 3)} {d(2)}:{d(2)} {prose(1, 3)}",
             lambda: f"{prose(1, 4)} ${d(2)}.{d(2)} {prose(1, 4)}", lambda: f"https://www.{word()}.example.com/{word()}/{d(3)}.html", lambda: f"{word()} {d(3)}, {d(3)}, {d(2)} {word()}", lambda: f"{prose(1, 3)} {d(1)},{d(3)},{d(3)} {prose(1, 3)}", lambda: f"{prose(1, 3)} {d(1)}.{d(1)}.{d(2)} {prose(1, 3)}", lambda: f"{prose(1, 4)} @ {prose(1, 4)}", lambda: f"{prose(1, 4)} {d(r.randint(5, 8))} {prose(1, 4)}", lambda: f"{prose(1, 4)} {d(2)}-{d(2)} {prose(1, 4)}",
             lambda: f"{prose(1, 4)} at {prose(1, 3)} dot {prose(1, 3)}", lambda: f"{prose(1, 3)} {d(3)}-{d(2)}-{d(4)} {prose(1, 3)}", lambda: " ".join(str(r.randint(1, 99)) for _ in range(r.randint(3, 9))), lambda: f"{prose(1, 3)} at {d(2)}:{d(2)} {prose(1, 4)}", lambda: f"{prose(0, 3)} {d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(1)} {prose(0, 3)}", lambda: f"{prose(1, 3)} {d(4)} {d(4)} {prose(1, 3)}", lambda: f"| {d(3)} | {d(2)} | {d(4)} | {d(3)} |", lambda: f"{prose(0, 3)} {d(1)} {d(3)} {d(3)} {prose(1, 3)}", lambda: f"20{d(2)}{d(4)} {prose(1, 3)} {d(10)}", lambda: f"ISBN 97{d(1)}-{d(1)}-{d(2)}-{d(6)}-{d(1)} {prose(1, 3)}", lambda: f"{prose(1, 3)} 1{d(3)} 1{d(3)} 19{d(2)} 20{d(2)} {prose(1, 3)}", lambda: f"{prose(0, 2)} {d(3)}-{d(2)}-{d(4)} {prose(0, 3)}", lambda: f"{prose(1, 3)} {d(1)}{d(2)} {d(3)} {d(3)} {r.choice(['in', 'and', 'pour', 'und'])} 20{d(2)}"]
    for _ in range(14):
        rows += [[(f(), 0)] for f in plain]
    return [(tokens, [0 if not k else 2 * k - 1 if first else 2 * k for k, first in zip(kinds, firsts, strict=True)], file_features(text)) for text, tokens, kinds, firsts in marked(rows, _TOKEN)]


@cache
def model() -> Crf:
    labels = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
    forbidden = [(a, 2 * k + 2) for k in range(len(KINDS)) for a in range(len(labels)) if a not in (2 * k + 1, 2 * k + 2)]
    return train(labels, labelled_table(), forbidden=forbidden, rounds=30)


_AT = re.compile(r"@|[\[({](?:at|arobase)[\])}]|\x20at\x20", re.I)
_DOT = re.compile(r"[A-Za-z0-9]\s*(?:\.|[\[({](?:dot|point|punkt)[\])}]|\x20(?:dot|point|punkt)\x20)\s*[A-Za-z]", re.I)


def _credible(kind: str, s: str) -> bool:
    digits = sum("0" <= c <= "9" for c in s)
    if kind == "email":
        m = _AT.search(s)
        return bool(m) and any(c.isalnum() for c in s[: m.start()]) and bool(_DOT.search(s[m.end() :]))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == "card":
        return 13 <= digits <= 19 and luhn("".join(c for c in s if "0" <= c <= "9"))
    return 9 <= digits <= 15


def scan(texts: list[str], crf: Crf) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text, in code points."""
    out = []
    for text, found in zip(texts, crf_spans(crf, texts, _TRIGGER, _TOKEN, file_features), strict=True):
        base = base_spans(text)
        extra = [(KINDS[(y - 1) // 2], a, b) for y, a, b in found if _credible(KINDS[(y - 1) // 2], text[a:b])]
        out.append((base, apart(extra, base)))
    return out


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]


def scan_pii(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text), as in ``SCHEMA``."""
    crf = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for i in range(0, len(ids), 512):
                for doc, (base, extra) in zip(ids[i : i + 512], scan(texts[i : i + 512], crf), strict=True):
                    n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                    rows.append((doc, *n, sha256(ordered(base, KINDS)), ordered(base + extra, KINDS), len(extra)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)] if rows else [pa.array([], t) for t in TYPES], names=NAMES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    return scan_pii(read(spark, sf_dir, "documents", "doc_id", "text"))
