"""Licence scan: Aho-Corasick over words, and a shunting-yard parser for expressions.

Notice phrases and the identifier tag are found together in one pass over a
text's words; expressions behind tags are parsed and evaluated: ``a or b`` allows
what either allows, ``a and b`` what both allow, ``a with x`` what ``a`` allows.

Distribution: one pass, no shuffle; slices of bounded bytes.

Defined results: a null or empty text has no words, no labels and score 0; a very long
text is scanned as a whole; of phrases that begin or end together all count; repeated
rows are scanned each for itself; an empty table gives an empty result; a malformed
expression gives the label ``unparsed``; without a label, ``permissive`` is null; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squall.llm.common import columns, map_texts, table

# Phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "creative commons": "creative-commons",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: Identifiers (lower case, without version) whose use is free of conditions on derived work.
PERMISSIVE = ("mit", "apache", "bsd", "isc", "cc0", "cc-by", "unlicense", "zlib", "bsl", "public-domain", "0bsd")

_EXPRESSION = re.compile(r"spdx-license-identifier\s*:[ \t]*([^\r\n\"'`<>{}*,;]*)", re.I)
_TOKENS = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_RANK = {"or": 1, "and": 2, "with": 3}


class ExpressionError(ValueError):
    pass


#: Identifiers without a version or a hyphen, in lower case: fixed values.
PLAIN_IDENTIFIERS = frozenset("mit isc zlib unlicense x11 ncsa curl libpng wtfpl beerware ruby vim gpl lgpl agpl apache bsd mpl epl cddl artistic openssl psf icu json ijg".split())


def is_identifier(word: str) -> bool:
    """A plain identifier, or one with a version or in parts; other words are prose."""
    low = word.lower()
    return low in PLAIN_IDENTIFIERS or bool(re.search(r"[a-z]", low) and re.search(r"[0-9]|[a-z]-[a-z0-9]", low))


def to_postfix(text: str, known=lambda word: True) -> list[str]:
    """Shunting-yard: operators ``or`` < ``and`` < ``with``, all left associative.

    The expression ends before an operator whose right side is a word that isn't known, and before a word that follows an operand.
    """
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    tokens = _TOKENS.findall(text)
    for token, after in zip(tokens, [*tokens[1:], None], strict=False):
        low = token.lower()
        if low in _RANK:
            if operand_next:
                raise ExpressionError(text)
            if after is not None and after not in "()" and after.lower() not in _RANK and not known(after):
                break  # prose goes on: "MIT and not ..."
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand_next = True
        elif token == "(":
            if not operand_next:
                raise ExpressionError(text)
            stack.append(token)
        elif token == ")":
            if operand_next:
                raise ExpressionError(text)
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ExpressionError(text)
            stack.pop()
        else:
            if not operand_next:
                break  # prose goes on behind the expression
            out.append(low)
            operand_next = False
    if operand_next or "(" in stack:
        raise ExpressionError(text)
    return out + stack[::-1]


def is_permissive(identifier: str) -> bool:
    return any(identifier == p or re.fullmatch(re.escape(p) + r"-[0-9].*", identifier) for p in PERMISSIVE)


def evaluate(text: str, allows=is_permissive) -> tuple[list[str], bool]:
    """The identifiers named by an expression, and whether it allows."""
    values: list[bool] = []
    names: list[str] = []
    postfix = to_postfix(text, is_identifier)
    for k, token in enumerate(postfix):
        if token in _RANK:
            right, left = values.pop(), values.pop()
            values.append(left or right if token == "or" else left and right if token == "and" else left)
        else:
            # the operand right before "with" names an exception, no licence
            if not (k + 1 < len(postfix) and postfix[k + 1] == "with"):
                names.append(token)
            values.append(allows(token))
    return sorted(set(names)), values[0]


def _automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for phrase, label in {**BASE_PHRASES, **MORE_PHRASES, TAG: TAG}.items():
        machine.add_word(f" {phrase} ", (phrase in BASE_PHRASES, label, len(phrase) + 2))
    machine.make_automaton()
    return machine


_MACHINE: list = []

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "permissive boolean, expressions array<string>"
)


def scan_batch(batch):
    import pyarrow as pa

    from squall.llm.textcore import TABLES, text_buffers

    if not _MACHINE:
        _MACHINE.append(_automaton())
    machine = _MACHINE[0]
    ids, texts = columns(batch, "doc_id", "text")
    data, offsets = text_buffers(texts)
    rows = []
    for i in range(len(ids)):
        raw = bytes(data[offsets[i] : offsets[i + 1]])
        words = raw.translate(TABLES["alnum"]).split()
        line = f" {b' '.join(words).decode('latin-1')} "
        starts, base, found, tagged = [], set(), set(), False
        for end, (is_base, label, size) in machine.iter(line):
            if label == TAG:
                tagged = True
            else:
                found.add(label)
                if is_base:
                    base.add(label)
                    starts.append(end + 1 - size)
        expressions, permissive = [], None
        if tagged:
            for m in _EXPRESSION.finditer(raw.decode("utf-8", "replace")):
                try:
                    names, good = evaluate(m[1])
                    found.update(names)
                    permissive = good if permissive is None else permissive and good
                    expressions.append(m[1].strip())
                except ExpressionError:
                    found.add("unparsed")
        if permissive is None and found:
            permissive = all(is_permissive(x) for x in found)
        score = 1.0 if expressions else 0.9 if found - {"all-rights-reserved", "unparsed"} else 0.5 if found else 0.0
        first, last = (line.count(" ", 0, min(starts)), line.count(" ", 0, max(starts))) if starts else (None, None)
        rows.append((len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(found)), score, permissive, expressions))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.list_(pa.string()))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "permissive", "expressions"]
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True))], names)


def scan_licenses(docs: DataFrame) -> DataFrame:
    return map_texts(docs.select("doc_id", "text"), scan_batch, SCHEMA)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).withColumn("expressions", F.array_join("expressions", " | "))
