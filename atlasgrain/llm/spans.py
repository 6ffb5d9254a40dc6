"""What the two span scanners share: lines that may hold a span, CRF spans with their places, and digests."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np

from .crf import Crf, runs

Span = tuple[str, int, int]


def ordered(spans: list[Span], kinds: list[str]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2])))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def suspect_lines(text: str, trigger: re.Pattern, token: re.Pattern) -> list[list[tuple[int, int]]]:
    """Token places of each line that holds what ``trigger`` finds; each line once."""
    out, at = [], 0
    while (m := trigger.search(text, at)) is not None:
        a = text.rfind("\n", 0, m.start()) + 1
        b = text.find("\n", m.end())
        b = len(text) if b < 0 else b
        out.append([x.span() for x in token.finditer(text, a, b)])
        at = b + 1
        if at > len(text):
            break
    return out


def crf_spans(model: Crf, texts: list[str], trigger: re.Pattern, token: re.Pattern, file_features) -> list[list[tuple[int, int, int]]]:
    """For each text the (label, start, end) that the model tags on its suspect lines."""
    lines, owner, places, files = [], [], [], []
    for k, text in enumerate(texts):
        found = suspect_lines(text, trigger, token)
        if found:
            f = file_features(text)
            for spots in found:
                lines.append([text[a:b] for a, b in spots])
                owner.append(k), places.append(spots), files.append(f)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if lines:
        for k, spots, labels in zip(owner, places, model.decode(lines, np.array(files, dtype=float)), strict=True):
            out[k] += [(y, spots[i][0], spots[j][1]) for y, i, j in runs(labels)]
    return out


def apart(extra: list[Span], base: list[Span]) -> list[Span]:
    """Those of ``extra`` that share no character with a base span; one walk along both sorted lists."""
    taken: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    out, i = [], 0
    for kind, a, b in sorted(extra, key=lambda s: s[1]):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i == len(taken) or taken[i][0] >= b:
            out.append((kind, a, b))
    return out


#: Plain words for the labelled tables, besides made-up ones.
WORDS = """the of and to in is was for with that from this are be on as by at it we you they will can not have please
contact call write reach office team support number account order invoice page version section table value result year
open report user server file line name date time address city street meeting call before after until about over under
le la les des une est dans pour avec vous nous sur par appelez bureau numéro adresse der die das und ist nicht mit auf
für von bitte Büro Nummer Anschrift el los las una es en por con para del llame oficina número""".split()


def marked(rows: list[list[tuple[str, int]]], token: re.Pattern) -> Iterator[tuple[str, list[str], list[int], list[bool]]]:
    """Of each line given as (text, kind) parts: the line, its tokens, their kinds, and whether each begins its part."""
    for parts in rows:
        text, marks, firsts = "", [], set()
        for s, kind in parts:
            firsts.add(len(text))
            marks += [kind] * len(s)
            text += s
        spots = [m.span() for m in token.finditer(text)]
        if spots:
            yield text, [text[a:b] for a, b in spots], [marks[a] for a, _ in spots], [a in firsts for a, _ in spots]
