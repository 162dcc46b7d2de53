"""License scans: phrases and identifier tags by Aho-Corasick, expressions by shunting-yard.

Texts are lower-cased (A-Z) and cut into words of digits, a-z and anything beyond ASCII.
One automaton finds every phrase as a run of whole words. Where it meets the identifier
tag, the expression behind the tag is parsed and evaluated.

A name that is no registered identifier is listed as unknown and gives no label.

Defined results: a null text counts as empty, without words, places or labels; repeated
rows each give their result; other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notice phrases, by which the method adds labels.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by 4 0": "cc-by",
    "cc0 1 0": "cc0",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG_PHRASE = "spdx license identifier"
_TAG = re.compile(rb"spdx-license-identifier[\x20\t]*:[\x20\t]*([^\r\n]*)")
_TOKEN = re.compile(r"[()]|[a-z0-9.+:_-]+")
#: Identifiers that share a label with a phrase.
SAME_LABEL = {"apache-2.0": "apache-2"}
PERMISSIVE = frozenset("mit apache-2 apache-2.0 bsd bsd-2-clause bsd-3-clause isc zlib cc0 cc0-1.0 unlicense cc-by-4.0".split())
#: Registered licence identifiers by family, and exceptions, in lower case.
KNOWN = re.compile(
    r"(?:[al]?gpl|gfdl)-\d\.\d(?:\.\d)?(?:-only|-or-later)?|gfdl-\d\.\d(?:-no)?-invariants-(?:only|or-later)|"
    r"(?:apache|afl|artistic|apsl|cpal|cpl|cddl|ecl|epl|eupl|mpl|lppl|ms-pl|osl|qpl|zpl)-\d\.\d[a-z]?(?:\.\d)?(?:-[a-z0-9-]+)?|"
    r"bsd-[1-4]-clause(?:-[a-z0-9-]+)?|0bsd|bsl-1\.0|busl-1\.1|cc0-1\.0|cc-pddc|"
    r"cc-by(?:-nc)?(?:-sa|-nd)?-\d\.\d(?:-[a-z]+)?|cecill-(?:\d\.\d|b|c)|odbl-1\.0|odc-by-1\.0|pddl-1\.0|"
    r"mit(?:-0|-cmu|-advertising|-feh|-modern-variant)?|mulanpsl-\d\.\d|ofl-1\.[01](?:-(?:no-)?rfn)?|openssl|sspl-1\.0|"
    r"beerware|blueoak-1\.0\.0|curl|ftl|hpnd|icu|ijg|isc|libpng(?:-2\.0)?|ms-pl|ms-rl|ncsa|ntp|php-3\.0?1?|postgresql|"
    r"psf-2\.0|python-2\.0(?:\.1)?|ruby|sleepycat|tcl|unicode-(?:3\.0|dfs-2016)|unlicense|upl-1\.0|vim|w3c|wtfpl|x11|"
    r"zlib(?:-acknowledgement)?|(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+"
)
KNOWN_EXCEPTION = re.compile(r"[a-z0-9.+-]*-exception(?:-[a-z0-9.-]+)?|linux-syscall-note|(?:documentref-[a-z0-9.-]+:)?additionref-[a-z0-9.-]+")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_WORD_BYTES = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


@dataclass
class Expression:
    text: str
    valid: bool
    permissive: bool
    #: registered licences, and other names that stand as licences or exceptions
    identifiers: list[str]
    unknown: list[str] = field(default_factory=list)


@dataclass
class Scan:
    n_words: int
    #: (label, first word, words, whether the phrase is one of the base)
    places: list[tuple[str, int, int, bool]] = field(default_factory=list)
    expressions: list[Expression] = field(default_factory=list)

    @property
    def base(self) -> list[tuple[str, int, int, bool]]:
        return [p for p in self.places if p[3]]

    @property
    def labels(self) -> list[str]:
        tagged = (SAME_LABEL.get(i, i) for e in self.expressions if e.valid for i in e.identifiers)
        return sorted({p[0] for p in self.places} | set(tagged))

    @property
    def score(self) -> float:
        if any(e.valid and not e.unknown for e in self.expressions) or self.base:
            return 1.0
        return 0.7 if self.places else 0.3 if self.expressions else 0.0


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard over ``and``, ``or``, ``with`` and brackets; None if not an expression.

    Reading ends before the first token that cannot continue the expression, so a comment
    end or a sentence after it does no harm.
    """
    output: list[str] = []
    stack: list[str] = []
    operand = True
    for token in tokens:
        if token == "(":
            if not operand:
                break
            stack.append(token)
        elif token == ")":
            if operand or "(" not in stack:
                break
            while stack[-1] != "(":
                output.append(stack.pop())
            stack.pop()
        elif token in _PRECEDENCE:
            if operand:
                return None
            while stack and _PRECEDENCE.get(stack[-1], 0) >= _PRECEDENCE[token]:
                output.append(stack.pop())
            stack.append(token)
            operand = True
        else:
            if not operand:
                break
            output.append(token)
            operand = False
    if operand or "(" in stack:
        return None
    return output + stack[::-1]


def evaluate(text: str) -> Expression:
    """Whether an expression is well formed, its licences, and whether it permits free reuse.
    A name that is not registered permits nothing.

    ``or`` leaves the choice, ``and`` needs both sides, ``with`` adds an exception, which
    only relaxes the licence to its left.
    """
    tokens = [t.rstrip(".") or t for t in _TOKEN.findall(text.lower())]
    postfix = to_postfix(tokens)
    if postfix is None:
        return Expression(text.strip(), False, False, [])
    stack: list[tuple[bool, list[str]]] = []
    for token in postfix:
        if token in _PRECEDENCE:
            (right, right_names), (left, left_names) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left, left_names + [f"with {name}" for name in right_names]))
            else:
                stack.append((left or right if token == "or" else left and right, left_names + right_names))
        else:
            stack.append((token.removesuffix("+") in PERMISSIVE, [token]))
    permissive, names = stack[0]
    identifiers = [x for x in names if KNOWN.fullmatch(x.removesuffix("+"))]
    exceptions = [x for x in names if x.startswith("with ") and KNOWN_EXCEPTION.fullmatch(x[5:])]
    unknown = [x.removeprefix("with ") for x in names if x not in identifiers and x not in exceptions]
    return Expression(text.strip(), True, permissive, identifiers, unknown)


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrases, base in ((NOTICE_PHRASES, False), (BASE_PHRASES, True)):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (label, phrase.count(" ") + 1, base))
    found.add_word(f" {TAG_PHRASE} ", None)
    found.make_automaton()
    return found


def scan(text: bytes) -> Scan:
    """Every phrase and tagged expression of one UTF-8 text."""
    lowered = text.lower()
    words = lowered.translate(_WORD_BYTES).split()
    result = Scan(len(words))
    joined = f" {b' '.join(words).decode('utf-8', 'replace')} "
    tagged = False
    word, read = -1, 0
    for end, value in _automaton().iter(joined):
        if value is None:
            tagged = True
            continue
        word += joined.count(" ", read, end + 1)
        read = end + 1
        label, length, base = value
        result.places.append((label, word - length, length, base))
    if tagged:
        result.expressions = [evaluate(m[1].decode("utf-8", "replace")) for m in _TAG.finditer(lowered)]
    return result


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the places, the expressions, all labels and a score for every row."""
    place = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("base", pa.bool_())])
    expression = pa.struct(
        [("text", pa.string()), ("valid", pa.bool_()), ("permissive", pa.bool_()), ("identifiers", pa.list_(pa.string())),
         ("unknown", pa.list_(pa.string()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(x or b"") for x in batch.column(1).to_pylist()]
            places = [
                [dict(zip(("label", "first_word", "words", "base"), p, strict=True)) for p in f.places] for f in found
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f.n_words for f in found], pa.int64()),
                    pa.array(places, pa.list_(place)),
                    pa.array([[vars(e) for e in f.expressions] for f in found], pa.list_(expression)),
                    pa.array([f.labels for f in found], pa.list_(pa.string())),
                    pa.array([f.score for f in found], pa.float64()),
                ],
                ["doc_id", "n_words", "places", "expressions", "labels", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        run,
        "doc_id long, n_words long, "
        "places array<struct<label string, first_word long, words long, base boolean>>, "
        "expressions array<struct<text string, valid boolean, permissive boolean, identifiers array<string>, unknown array<string>>>, "
        "labels array<string>, score double",
    )
