"""License scans: phrases and tags by one Aho-Corasick pass, licence expressions by a shunting-yard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from pulseframe.llm import spans
from pulseframe.llm.tables import id_and_text

#: Fixed by the contract of the scan: phrase and label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases of the method, with the confidence that one place gives.
NOTICES = {
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "creative commons attribution": ("cc-by", 0.7),
    "this work is dedicated to the public domain": ("cc0", 0.8),
}
PHRASE_CONFIDENCE = 0.8
TAG = "spdx license identifier"
TAG_CONFIDENCE = 1.0
#: Identifier prefixes of the licence families, longest first.
FAMILIES = ("agpl", "lgpl", "gpl", "apache", "mit", "bsd", "mpl", "cc-by", "cc0", "isc", "unlicense")

PERMISSIVE = {"apache", "mit", "bsd", "cc-by", "cc0", "isc", "unlicense"}

_FOLD = spans.LOWER.copy()
_FOLD[[b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]] = ord(" ")
FOLD = bytes(_FOLD)
_TAG_TEXT = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(rb"[()]|[A-Za-z0-9.+:-]+|\S")
_IDENTIFIER = re.compile(r"[a-z0-9][a-z0-9.+:-]*")
_LEVEL = {"or": 1, "and": 2, "with": 3}


@dataclass(frozen=True)
class Value:
    """What a licence expression comes to: its licences, and whether it can be met by permissive ones alone."""

    licenses: frozenset[str]
    permissive: bool


def _identifier(token: str) -> Value:
    return Value(frozenset([token]), family(token) in PERMISSIVE)


def _apply(operator: str, left: Value, right: Value) -> Value:
    if operator == "with":  # an exception only loosens its licence
        return left
    free = left.permissive or right.permissive if operator == "or" else left.permissive and right.permissive
    return Value(left.licenses | right.licenses, free)


def expression_start(tokens: list[str]) -> int:
    """Length of the longest start of the tokens that is a whole expression, found in one pass."""
    depth, operand_next, whole = 0, True, 0
    for i, token in enumerate(tokens, 1):
        if token in _LEVEL:
            if operand_next:
                break
            operand_next = True
        elif token == "(":
            if not operand_next:
                break
            depth += 1
        elif token == ")":
            if operand_next or not depth:
                break
            depth -= 1
        elif operand_next and _IDENTIFIER.fullmatch(token):
            operand_next = False
        else:
            break
        if not depth and not operand_next:
            whole = i
    return whole


def evaluate(tokens: list[str]) -> Value:
    """Value of ``( a or b ) and c with e``; raises ValueError where it is no expression.

    Shunting yard: operands go to one stack, operators to another, and an operator is applied as soon as the next one
    binds no tighter. ``with`` binds tightest, then ``and``, then ``or``; all group to the left.
    """
    if not tokens or expression_start(tokens) != len(tokens):
        raise ValueError("not a licence expression")
    values: list[Value] = []
    waiting: list[str] = []

    def reduce_until(stop: int) -> None:
        while waiting and waiting[-1] != "(" and _LEVEL[waiting[-1]] >= stop:
            right, left = values.pop(), values.pop()
            values.append(_apply(waiting.pop(), left, right))

    for token in tokens:
        if token in _LEVEL:
            reduce_until(_LEVEL[token])
            waiting.append(token)
        elif token == "(":
            waiting.append(token)
        elif token == ")":
            reduce_until(0)
            waiting.pop()
        else:
            values.append(_identifier(token))
    reduce_until(0)
    return values[0]


def tokens_of(line: bytes) -> list[str]:
    return [t.decode("utf-8", "replace").lower() for t in _TOKEN.findall(line)]


def family(identifier: str) -> str:
    return next((f for f in FAMILIES if identifier.startswith(f)), identifier)


def _tag_labels(text: bytes) -> set[str]:
    """Labels of the expressions behind identifier tags; of a line, the longest start that is an expression counts."""
    found: set[str] = set()
    for line in _TAG_TEXT.findall(text):
        tokens = tokens_of(line)
        if whole := expression_start(tokens):
            found |= {family(x) for x in evaluate(tokens[:whole]).licenses}
    return found


class Scanner:
    """The automaton of all phrases over words joined by single spaces. Built once per task."""

    def __init__(self, phrases: Mapping[str, str] = PHRASES, notices: Mapping[str, tuple[str, float]] = NOTICES) -> None:
        self.automaton = ahocorasick.Automaton()
        entries = {p: (True, label, PHRASE_CONFIDENCE) for p, label in phrases.items()}
        entries |= {p: (False, label, c) for p, (label, c) in notices.items()}
        entries[TAG] = (False, None, TAG_CONFIDENCE)
        for phrase, (base, label, confidence) in entries.items():
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, base, label, confidence))
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = text.translate(FOLD).split()
        # One character per byte, so that offsets are those of the bytes.
        joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
        starts, base_labels, labels, doubt = [], set(), set(), 1.0
        tagged: set[str] | None = None
        for end, (length, base, label, confidence) in self.automaton.iter(joined):
            if label is None:
                if tagged is None:  # all tags of the text at once
                    tagged = _tag_labels(text)
                    labels |= tagged
                doubt *= 1.0 - confidence if tagged else 1.0
                continue
            if base:
                starts.append(end - length + 1)
                base_labels.add(label)
            labels.add(label)
            doubt *= 1.0 - confidence
        first = last = None
        if starts:
            first = joined.count(" ", 0, min(starts))
            last = joined.count(" ", 0, max(starts))
        return (
            len(words), len(starts), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels | base_labels)), 1.0 - doubt,
        )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the confidence that the text states a licence: 1 - the product of the doubts that its phrases and tags
    leave (0 without any). Null and empty texts have no words, labels or score; repeated rows repeat their result.
    Columns besides doc_id and text are not read. Each row is read alone, so no key or group can be too large.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for chunk in spans.chunks(batches):
            data, bounds = spans.text_bytes(chunk.column(1))
            whole = data.tobytes()
            found = [scanner.scan(whole[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([chunk.column(0), *columns], names=["doc_id", *names])

    return id_and_text(docs).mapInArrow(
        scan,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )
