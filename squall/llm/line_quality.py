"""Line-first quality rules (DataFrame operations only).

Every line is judged by itself: punctuation (hardly a word between symbols, or
a short fragment without a closing mark), navigation (a row of menu separators)
and boilerplate (notices and calls to action).  Lines that fail are removed; a
document that loses too much of its text is rejected.

Distribution: one pass, no shuffle.  Repeats are looked for with 64-bit hashes
of 8-word windows inside a row, made by doubling (hashes of 1, 2, 4, 8 words); the
sort is made only for texts that have some.

Defined results: a null text has no words and no lines, fails the base rule and
is not kept; a very long text or line is judged whole; repeated rows are judged each
for itself, ties don't arise; an empty table gives an empty result; the caller's columns
come back as one struct, so that no name of theirs clashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squall.llm.common import table

_WS = " \t\n\x0b\x0c\r"
_WS_CLASS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
#: Share of a document's word characters that removed lines may hold.
MOST_LOST = 0.5

CLOSING = r"[.!?:;…。！？\"'”’»)\]]\s*$"
NAVIGATION = r"^[^|»>]{0,40}([|»>]\s*[^|»>]{0,40}){2,}$"
#: In lower case; grouped by first letters, so that few ways are tried at a place.
BOILERPLATE = (
    r"(^|[^a-z])(a(ll rights reserved|ccept (all )?cookies)|back to top|c(ookie policy|lick here|opyright)|enable javascript|"
    r"l(og ?in|icensed under)|p(rivacy policy|owered by)|re(ad more|leased under)|s(ign (in|up)|ubscribe (now|to)|hare (this|on))|"
    r"terms of (use|service))([^a-z]|$)"
)
#: Share of words that may equal the word before them.
MOST_STUTTER = 0.3


def _blanks(text):
    return F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))


def _windows(words):
    """Hash of the eight words from each word on; words: hashes of words."""
    out = words
    for k in (1, 2, 4):
        out = _doubled(out, k)
    return F.slice(out, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))


def _doubled(hashes, k: int):
    # The array is bound once, as the single element of an outer array.
    return F.element_at(F.transform(F.array(hashes), lambda v: F.zip_with(v, F.slice(v, 1 + k, F.greatest(F.size(v) - k, F.lit(0))), lambda a, b: F.xxhash64(a, b))), 1)


def base_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """whole (the given columns), _words (hashes), _lines, and the base counts."""
    out = docs.select(F.struct(*docs.columns).alias("whole"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    t = F.col("_text")
    trimmed = F.btrim(t, F.lit(_WS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _WS_CLASS))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(_WS)) != "")
    out = out.withColumn("_words", F.transform(words, lambda w: F.xxhash64(w))).withColumn("_lines", lines)
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    out = out.withColumn("word_chars", (F.length(t) - _blanks(t)).cast("long"))
    out = out.withColumn("n_symbols", F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    out = out.withColumn("_windows", F.when(F.size("_words") >= WINDOW, _windows(F.col("_words"))).otherwise(F.array().cast("array<bigint>")))
    return out.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0)).otherwise(_covered("_windows")).cast("long"))


def _covered(windows: str):
    """Words inside windows whose hash stands twice or more."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    # The sorted array is bound once, as the single element of an outer array.
    def starts(p):
        def again(x, k):
            after = F.when(k + 1 < F.size(p), F.get(p, k + 1)["h"] == x["h"]).otherwise(F.lit(False))
            before = F.when(k > 0, F.get(p, k - 1)["h"] == x["h"]).otherwise(F.lit(False))
            return after | before

        return F.sort_array(F.transform(F.filter(p, again), lambda x: x["i"]))

    def length(s):
        steps = F.transform(s, lambda x, k: F.when(k + 1 < F.size(s), F.least(F.lit(WINDOW), F.get(s, k + 1) - x)).otherwise(F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    found = F.transform(F.array(placed), starts)
    return F.element_at(F.transform(found, length), 1)


def line_fails(line):
    """Whether one line is to be removed.  Cheap tests stand before patterns."""
    t = F.btrim(line, F.lit(_WS))
    dense = F.length(t) - _blanks(t)
    marks = F.regexp_count(t, F.lit(r"[#*$%&|<>{}\\^~=_]"))
    punctuation = (marks * 5 > dense) | ((dense < 12) & ~t.rlike(CLOSING))
    return punctuation | (((marks > 0) | t.contains("»")) & t.rlike(NAVIGATION)) | ((dense < 120) & F.lower(t).rlike(BOILERPLATE))


def clean_lines(docs: DataFrame, text: str = "text", most_lost: float = MOST_LOST) -> DataFrame:
    """whole (the given columns), the base counts, cleaned_text, lost (share of word characters in removed lines), base_failed and kept."""
    out = base_columns(docs, text)
    out = out.withColumn("_bad", F.transform("_lines", line_fails))
    gone = F.aggregate(F.zip_with("_lines", "_bad", lambda x, bad: F.when(bad, F.length(x) - _blanks(x)).otherwise(F.lit(0))), F.lit(0), lambda a, n: a + n)
    out = out.withColumn("lost", F.when(F.col("word_chars") > 0, gone / F.col("word_chars")).otherwise(F.lit(0.0)))
    out = out.withColumn("cleaned_text", F.array_join(F.filter("_lines", lambda x, i: ~F.get("_bad", i)), "\n"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    stutter = F.size(F.filter("_words", lambda w, i: F.get("_words", i + 1) == w))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= most_lost) & (stutter <= MOST_STUTTER * F.col("n_words")))
    return out.drop("_text", "_words", "_lines", "_windows", "_bad")


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean_lines(docs).select("whole.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
