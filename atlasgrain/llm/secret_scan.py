"""Secret scans: base patterns, and a linear-chain CRF that tags tokens as secret begin, inside or outside.

The CRF reads lines. An added span must have six or more characters with both a letter and a digit, or be 24 or more
letters (or dashes) of mixed case; that is checked after decoding, so lines without a digit or such a run are not read
and leaving them out changes nothing.

Defined results: null text is empty text; empty text has no spans; repeated rows each get their row; an empty table
gives an empty result; other columns play no part. Base spans of different kinds may overlap and all stay; an added
span that shares a character with a base span goes; spans with one start are ordered by kind as listed. Work is by line
and linear in a text's length.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read
from .crf import Crf, train
from .spans import WORDS, Span, apart, crf_spans, marked, ordered, sha256

KINDS = ["assign", "access", "hex", "crf"]
_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run of under 20 has no part of 20
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9_+/\-]+|[^\sA-Za-z0-9_+/\-]+?")
_TRIGGER = re.compile(r"[0-9]|[A-Za-z-]{24}")
_LETTERS = re.compile(r"[A-Za-z-]{24,}")


def base_spans(text: str) -> list[Span]:
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


def file_features(text: str) -> list[float]:
    """Of the whole file: does it look like code or settings."""
    return [1.0, float("=" in text), float("{" in text or "};" in text), float("-----BEGIN" in text)]


def labelled_table() -> list[tuple[list[str], list[int], list[float]]]:
    """The small labelled table: lines built from fixed templates with a fixed seed. 1 begins a secret, 2 continues it."""
    r = random.Random(7)
    alnum, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    many = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    syllables = "th an er on in ti ed ou nd ha re es at en be le la que ment eau ung keit sch ver aci doz".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    prose = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    plain_word = lambda: r.choice(WORDS) if r.random() < 0.5 else word()
    prose = lambda a, b: " ".join(plain_word() for _ in range(r.randint(a, b)))
    secret = lambda: r.choice([lambda: many(alnum, 20, 44), lambda: many(b64, 32, 60), lambda: "ghp_" + many(alnum, 36, 36), lambda: "sk-" + many(alnum, 32, 48), lambda: "xoxb-" + many(string.digits, 10, 12) + "-" + many(alnum, 20, 24), lambda: "eyJ" + many(alnum, 30, 50), lambda: many("0123456789abcdef", 32, 40), lambda: "AIza" + many(alnum, 35, 35)])()
    # what people choose: a word or two with digits or marks
    chosen = lambda: r.choice([lambda: word() + many(string.digits, 1, 4), lambda: word().capitalize() + many(string.digits, 2, 4), lambda: word() + "-" + word() + many(string.digits, 1, 3), lambda: many(alnum, 7, 14) + r.choice(string.digits), lambda: word().capitalize() + "_" + many(string.digits, 4, 4), lambda: many(string.digits, 1, 3) + word() + word().capitalize()])()
    lead = ["Authorization: Bearer ", "aws_secret_access_key = ", "client_secret: '", "key=", 'auth: "', "private_key = ", "credential: ", "pwd = ", "-u admin:", "access key ", "SECRET_KEY=", "bearer ", "", ""]
    cue = ["pwd: ", "pwd=", "PWD = ", "pass: ", "pass=", "passphrase: ", "passcode: ", "password is ", "the password is ", "passwd is ", "Passwort: ", "mot de passe : ", "contraseña: ", "credentials: ", "psw: ", 'pwd: "', "pass = '", "login pwd ", "root pwd: ", f"user {word()}, pwd: ", f"{word()} / pwd ", "wifi password is "]
    rows: list[list[tuple[str, int]]] = []
    for _ in range(160):
        rows.append([(prose(0, 6) + " ", 0), (r.choice(lead), 0), (secret(), 1), (r.choice(["", '"', "'", ";", "."]) + " " + prose(0, 6), 0)])
    for _ in range(12):
        for c in cue:
            rows.append([(prose(0, 5) + " " * r.randint(0, 1), 0), (c, 0), ((s := chosen()) if len(s := chosen()) >= 6 else s + many(string.digits, 4, 4), 1), (r.choice(["", '"', "'", ";", ".", ","]) + " " + prose(0, 6), 0)])
    plain = [lambda: prose(4, 14).capitalize() + ".", lambda: f"{word()}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com {prose(1, 6)}", lambda: f"{prose(1, 5)} {r.randint(1, 10**r.randint(1, 16))} {prose(1, 5)}", lambda: f"https://www.{word()}.example.com/{word()}/{word()}-{word()}/{r.randint(1, 999)}.html",
             lambda: f"{prose(1, 4)} {r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)} {prose(1, 4)}", lambda: f"{prose(1, 3)} +1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}", lambda: " | ".join(word() for _ in range(6)), lambda: f"Licensed under {word().upper()} {r.randint(1, 4)}.0, Version 2.0.",
             lambda: f"{word()}_{word()} = {r.randint(0, 9999)}", lambda: "".join(word() for _ in range(6)) + " " + prose(2, 5), lambda: f"{word()}### {word()}$$$ {word()}%%% {word()}&&&", lambda: f"{prose(1, 4)} 20{r.randint(10, 29)}-0{r.randint(1, 9)}-1{r.randint(0, 9)} {prose(1, 4)}", lambda: f"{word()}/{word()}_{word()}/{word()}{r.randint(1, 99)}.py", lambda: prose(3, 9).upper(),
             lambda: f"{prose(1, 5)} {chosen()} {prose(1, 5)}", lambda: f"{word()}: {word()}{r.randint(1, 999)} {prose(0, 4)}", lambda: f"{prose(1, 3)} version {word()}{r.randint(1, 99)}, model {word().upper()}-{r.randint(100, 9999)} {prose(0, 3)}", lambda: f"def {word()}_{word()}{r.randint(1, 9)}({word()}{r.randint(1, 9)}, {word()}={r.randint(1, 99)}):", lambda: f"{prose(0, 3)} pass {prose(1, 3)} {r.randint(1, 99)} {prose(0, 3)}", lambda: f"{prose(0, 3)} passed {r.randint(1, 99)} of {r.randint(1, 99)} {prose(1, 3)}", lambda: f"{prose(0, 4)} {chosen()}, {chosen()} {r.choice(['and', 'or', 'et', 'und'])} {chosen()} {prose(0, 3)}",
             lambda: f"{prose(0, 3)} the password is {plain_word()} {plain_word()} {r.randint(1, 99)}", lambda: f"key: {r.randint(1, 999)}, value: {r.randint(1, 999)}", lambda: f"https://{r.choice(['www.', ''])}{plain_word()}.{r.choice(['org', 'com', 'net'])}/{plain_word()}/20{r.randint(10, 29)}/0{r.randint(1, 9)}/{plain_word()}-{plain_word()}-{r.randint(1, 9999)}.html", lambda: f"{prose(1, 4)} {word().capitalize()}{r.randint(1, 99)}.", lambda: f"{word().capitalize()}{r.randint(1, 99)}, {word().capitalize()}{r.randint(1, 99)} {prose(1, 4)} {word().capitalize()}{r.randint(1, 9)}."]
    for _ in range(22):
        rows += [[(f(), 0)] for f in plain]
    return [(tokens, [0 if not k else 1 if first else 2 for k, first in zip(kinds, firsts, strict=True)], file_features(text)) for text, tokens, kinds, firsts in marked(rows, _TOKEN)]


@cache
def model() -> Crf:
    return train(["O", "B", "I"], labelled_table(), forbidden=[(0, 2)])


def _credible(s: str) -> bool:
    """Six or more characters with a letter and a digit, or 24 or more letters of mixed case."""
    digit, lower, upper = any("0" <= c <= "9" for c in s), any("a" <= c <= "z" for c in s), any("A" <= c <= "Z" for c in s)
    return (len(s) >= 6 and digit and (lower or upper)) or (bool(_LETTERS.fullmatch(s)) and lower and upper and not s.istitle())


def scan(texts: list[str], crf: Crf) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text, in code points."""
    out = []
    for text, found in zip(texts, crf_spans(crf, texts, _TRIGGER, _TOKEN, file_features), strict=True):
        base = base_spans(text)
        extra = [("crf", a, b) for _, a, b in found if _credible(text[a:b])]
        out.append((base, apart(extra, base)))
    return out


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text), as in ``SCHEMA``."""
    crf = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for i in range(0, len(ids), 512):
                for doc, (base, extra) in zip(ids[i : i + 512], scan(texts[i : i + 512], crf), strict=True):
                    n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
                    rows.append((doc, *n, sha256(ordered(base, KINDS)), ordered(base + extra, KINDS), len(extra)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)] if rows else [pa.array([], t) for t in TYPES], names=NAMES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents", "doc_id", "text"))
