"""Language identification of whole texts with labelled spans.

Scripts narrow the candidates: a word may only be of languages that use its
script (any language, if none does), and languages that no word of a slice may be of
are left out of its decoding.  Each word gets a score per candidate from its character
trigrams; a Viterbi pass with a penalty for switching labels every word, so that runs
of words in one language become spans.  The text's language is the one with most
words.

Training counts trigrams and scripts per language over all labelled rows given;
its result has a fixed number of buckets per language.

Distribution: two passes without a shuffle of texts; counts are summed per
(language, bucket) on the map side first.

Defined results: null texts and texts without a letter are ``und`` with score 0;
so is everything when no row is labelled; ties go to the language first by code
point; a text whose letters are all of a script without a range gets the first language
with score 0; a very long text is decoded as a whole; repeated rows are labelled each for
itself; an empty table gives an empty result; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squall.llm.common import columns, crc, map_texts, ready, table

BUCKETS = 1 << 14
SWITCH = 8.0  # log penalty
SMOOTH = 0.5
#: A language is a candidate for a script that holds this share of its words.
SCRIPT_SHARE = 0.01
#: Most that a single trigram may say for or against a language.
CLIP = 4.0

# Scripts by ranges of code points.
_RANGES = (
    (0x41, 0x5A, "latin"), (0x61, 0x7A, "latin"), (0xAA, 0xAA, "latin"), (0xBA, 0xBA, "latin"), (0xC0, 0xD6, "latin"), (0xD8, 0xF6, "latin"), (0xF8, 0x2AF, "latin"),
    (0x370, 0x3FF, "greek"), (0x400, 0x52F, "cyrillic"), (0x531, 0x58F, "armenian"), (0x5D0, 0x5F2, "hebrew"), (0x620, 0x6FF, "arabic"), (0x700, 0x74F, "syriac"),
    (0x750, 0x77F, "arabic"), (0x780, 0x7BF, "thaana"), (0x7C0, 0x7FF, "nko"), (0x8A0, 0x8FF, "arabic"), (0x900, 0x97F, "devanagari"), (0x980, 0x9FF, "bengali"),
    (0xA00, 0xA7F, "gurmukhi"), (0xA80, 0xAFF, "gujarati"), (0xB00, 0xB7F, "oriya"), (0xB80, 0xBFF, "tamil"), (0xC00, 0xC7F, "telugu"), (0xC80, 0xCFF, "kannada"),
    (0xD00, 0xD7F, "malayalam"), (0xD80, 0xDFF, "sinhala"), (0xE00, 0xE7F, "thai"), (0xE80, 0xEFF, "lao"), (0xF00, 0xFFF, "tibetan"), (0x1000, 0x109F, "myanmar"),
    (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"), (0x1200, 0x139F, "ethiopic"), (0x13A0, 0x13FF, "cherokee"), (0x1400, 0x177F, "other"), (0x1780, 0x17FF, "khmer"),
    (0x1800, 0x18AF, "mongolian"), (0x18B0, 0x1C7F, "other"), (0x1C80, 0x1C8F, "cyrillic"), (0x1C90, 0x1CBF, "georgian"), (0x1D00, 0x1DBF, "latin"), (0x1E00, 0x1EFF, "latin"),
    (0x1F00, 0x1FFF, "greek"), (0x2C60, 0x2C7F, "latin"), (0x2D00, 0x2D2F, "georgian"), (0x2D80, 0x2DDF, "ethiopic"), (0x2E80, 0x2FDF, "han"), (0x3005, 0x3007, "han"),
    (0x3041, 0x30FF, "kana"), (0x3100, 0x312F, "han"), (0x3131, 0x318F, "hangul"), (0x31F0, 0x31FF, "kana"), (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"),
    (0xA000, 0xA63F, "other"), (0xA640, 0xA69F, "cyrillic"), (0xA6A0, 0xA71F, "other"), (0xA720, 0xA7FF, "latin"), (0xA800, 0xABFF, "other"), (0xAC00, 0xD7FF, "hangul"),
    (0xF900, 0xFAFF, "han"), (0xFB00, 0xFB06, "latin"), (0xFB1D, 0xFB4F, "hebrew"), (0xFB50, 0xFDFF, "arabic"), (0xFE70, 0xFEFC, "arabic"), (0xFF21, 0xFF5A, "latin"),
    (0xFF66, 0xFF9F, "kana"), (0x10000, 0x1BFFF, "other"), (0x1D400, 0x1D7FF, "latin"), (0x1E000, 0x1EFFF, "other"), (0x20000, 0x3FFFF, "han"),
)
SCRIPTS = ("none", *sorted({name for _, _, name in _RANGES}))
_FIRST = np.array([x[0] for x in _RANGES])
_LAST = np.array([x[1] for x in _RANGES])
_NUMBER = np.array([SCRIPTS.index(x[2]) for x in _RANGES], dtype=np.int8)
#: Score of a word in a language that doesn't use its script: below that of any path that avoids it.
FORBIDDEN = -1e6


def script_of(points: np.ndarray) -> np.ndarray:
    """Number of each code point's script, 0 for none."""
    place = np.maximum(np.searchsorted(_FIRST, points, "right") - 1, 0)
    return np.where((points >= _FIRST[place]) & (points <= _LAST[place]), _NUMBER[place], 0).astype(np.int8)


_ASCII_SCRIPT = script_of(np.arange(256) * (np.arange(256) < 128))


_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def _trigrams(words) -> np.ndarray:
    """Bucket of the trigram around each byte."""
    b = words.bytes.astype(np.uint32)
    padded = np.full(len(b) + 2, 32, dtype=np.uint32)
    padded[1:-1] = b
    h = padded[:-2] * np.uint32(0x9E3779B1) ^ padded[1:-1] * np.uint32(0x85EBCA77) ^ padded[2:] * np.uint32(0xC2B2AE3D)
    return (h >> np.uint32(32 - 14)).astype(np.int64)


def _scripts(words) -> np.ndarray:
    """Script of each word: that of its first letter."""
    if not len(words.start):
        return np.zeros(0, np.int64)
    of = _ASCII_SCRIPT[words.bytes]
    leads = np.flatnonzero(words.bytes >= 0xC2)
    if len(leads):
        b = np.concatenate([words.bytes, np.zeros(3, np.uint8)]).astype(np.int64)
        lead, tail = b[leads], [b[leads + k] & 0x3F for k in (1, 2, 3)]
        two, three = (lead & 0x1F) << 6 | tail[0], (lead & 0x0F) << 12 | tail[0] << 6 | tail[1]
        four = (lead & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]
        of[leads] = script_of(np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four)))
    lettered = np.flatnonzero(of)
    place = np.searchsorted(lettered, words.start)
    first = np.where(place < len(lettered), lettered[np.minimum(place, max(len(lettered) - 1, 0))] if len(lettered) else 0, len(of))
    return np.where(first < words.end, of[np.minimum(first, len(of) - 1)], 0).astype(np.int64)


def _count(batch):
    from squall.llm.textcore import Words

    lang, texts = columns(batch, "lang", "text")
    words = Words(texts, "alnum")
    trigrams, scripts = _trigrams(words), _scripts(words)
    names, of = np.unique(np.array(lang.to_pylist(), dtype=object), return_inverse=True)
    size = BUCKETS + len(SCRIPTS)
    total = np.zeros((len(names), size), dtype=np.int64)
    is_word = words.bytes != 32
    by_byte = np.repeat(of, np.diff(words.offsets))
    total[:, :BUCKETS] = np.bincount(by_byte[is_word] * BUCKETS + trigrams[is_word], minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
    by_word = np.repeat(of, np.diff(words.at))
    total[:, BUCKETS:] = np.bincount(by_word * len(SCRIPTS) + scripts, minlength=len(names) * len(SCRIPTS)).reshape(len(names), -1)
    row, bucket = np.nonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(names[row].tolist(), pa.string()), pa.array(bucket, pa.int64()), pa.array(total[row, bucket], pa.int64())], ["lang", "bucket", "n"])


def _has_letter(raw: bytes) -> bool:
    return bool(_ASCII_LETTER.search(raw)) or (not raw.isascii() and any(c.isalpha() for c in raw.decode("utf-8", "replace")))


class Model:
    """Log scores per language and trigram bucket, and candidates per script."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        n = max(1, len(self.languages))
        table_ = np.array([counts[x] for x in self.languages], dtype=np.float64).reshape(len(self.languages), BUCKETS + len(SCRIPTS))
        grams = table_[:, :BUCKETS] + SMOOTH
        logs = np.log(grams / grams.sum(axis=1, keepdims=True)) if len(self.languages) else np.zeros((0, BUCKETS))
        if len(self.languages):
            logs = np.clip(logs - logs.mean(axis=0), -CLIP, CLIP)
        self.scores = np.ascontiguousarray(logs.T, dtype=np.float32)
        scripts = table_[:, BUCKETS:]
        share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
        self.allowed = (share >= SCRIPT_SHARE).T
        self.allowed[~self.allowed.any(axis=1)] = True  # no evidence: any

    def labels(self, words) -> tuple[np.ndarray, np.ndarray]:
        """(language of each word, whether the word has a letter)"""
        from squall.llm.viterbi import decode_switching

        scripts = _scripts(words)
        lettered = scripts > 0
        candidates = np.flatnonzero(self.allowed[np.unique(scripts[lettered])].any(axis=0)) if lettered.any() else np.zeros(1, np.int64)
        return candidates[decode_switching(self.emissions(words, scripts, candidates), words.at, SWITCH)], lettered

    def emissions(self, words, scripts: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Score of each word in each candidate language."""
        trigrams = _trigrams(words)
        emit = np.zeros((len(words.start), len(candidates)), dtype=np.float32)
        lettered = scripts > 0
        total = np.zeros(len(trigrams) + 1)
        for k, language in enumerate(candidates):
            np.cumsum(self.scores[trigrams, language], out=total[1:])
            emit[:, k] = np.where(self.allowed[scripts, language], total[words.end] - total[words.start], FORBIDDEN)
        emit[~lettered] = 0
        return emit


def train(labelled: DataFrame) -> Model:
    """labelled(text, lang): counts over all rows whose lang is not null."""
    rows = labelled.where(F.col("lang").isNotNull()).select("lang", "text")
    counts = map_texts(rows, _count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # One row per language: as many numbers as there are buckets.
    packed = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells"))
    out: dict[str, np.ndarray] = {}
    for row in packed.toLocalIterator():
        cells = np.array([(c["bucket"], c["n"]) for c in row["cells"]], dtype=np.int64)
        one = np.zeros(BUCKETS + len(SCRIPTS))
        one[cells[:, 0]] = cells[:, 1]
        out[row["lang"]] = one
    return Model(out)


def judge(texts: pa.Array, m: Model, with_spans: bool = False):
    """Language, score and spans of each text."""
    from squall.llm.textcore import Words

    words = Words(texts, "alnum")
    n, n_languages = len(texts), max(1, len(m.languages))
    if not n:
        return [], np.zeros(0), []
    share = np.zeros((n, n_languages))
    spans: list = [[] for _ in range(n)]
    if m.languages and len(words.start):
        labels, lettered = m.labels(words)
        row = np.repeat(np.arange(n), np.diff(words.at))
        share = np.bincount((row * n_languages + labels)[lettered], minlength=n * n_languages).reshape(n, n_languages).astype(float)
        if with_spans:
            change = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (row[1:] != row[:-1])]))
            for a, b in zip(change, np.append(change[1:], len(labels)), strict=True):
                base = int(words.at[row[a]])
                spans[row[a]].append({"first": int(a) - base, "last": int(b) - base, "lang": m.languages[labels[a]]})
    total = share.sum(axis=1)
    best = share.argmax(axis=1)
    score = np.where(total > 0, share[np.arange(n), best] / np.maximum(total, 1), 0.0)
    letters = [_has_letter(words.raw[a:b]) for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True)]
    score[~np.array(letters, dtype=bool)] = 0.0
    found = [m.languages[b] if seen and m.languages else "und" for b, seen in zip(best, letters, strict=True)]
    return found, score, spans


SCHEMA = "doc_id long, lang_pred string, score double, spans array<struct<first:long,last:long,lang:string>>"


def identify(docs: DataFrame, model: Model, with_spans: bool = True) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, spans (word ranges, end exclusive, with a language)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # buckets x languages

    def work(batch):
        ids, texts = columns(batch, "doc_id", "text")
        found, score, spans = judge(texts, shared.value, with_spans)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())]))
        return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(found, pa.string()), pa.array(score), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])

    return map_texts(docs.select("doc_id", "text"), work, SCHEMA)


def predictor(spark: SparkSession, model: Model):
    """A column function: text -> struct(lang, score), row by row, for filters that keep all columns."""
    ready(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        from squall.llm.textcore import slices

        parts = [judge(texts.slice(i, j - i), shared.value)[:2] for i, j in slices(texts)]
        lang = [x for found, _ in parts for x in found]
        score = [float(x) for _, scores in parts for x in scores]
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    return predict


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(crc("doc_id"), F.lit(4)) == 2
    model = train(docs.where(~held_out))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["first"], s["last"], s["lang"])), ",")
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"), spans.alias("spans"))
