"""Toxicity scores behind a noisy-channel deobfuscation.

A character language model (trigrams over all documents) and a channel of
look-alike characters, separators and repetitions span a lattice of what an odd
token may stand for; Viterbi finds the likeliest letters.  Odd are tokens that
mix letters with look-alikes, repeat a letter three times, or are spelt out with
blanks.  In all other tokens the lattice has a single way besides the written one,
that of leaving separators and repeated letters out, so those are looked up without
decoding.  A lexicon and a logistic model over restored words, learned from labelled
rows, give the score.

Distribution: a pass for the language model (counts of fixed size per task), one
for the labelled rows, one for scores; no shuffle of texts.  At most
``MAX_LABELLED`` labelled rows, least hash first, fit the classifier; the
language model counts every document.

Defined results: a null or empty text gets the score of a text without any
lexicon word; without labelled rows of both kinds every score is the share of
toxic rows (0 if there is none); a document labelled both ways counts as toxic; of equally
likely readings the one with the later letters in the alphabet stands, and of equally
telling words the first by code point is kept; a very long text is scored as a whole;
repeated rows are scored each for itself; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squall.llm.common import columns, crc, map_texts, shared_dir, table

#: Labelled rows that fit the classifier, at most.
MAX_LABELLED = 20_000
#: Words of the lexicon, at most: those that tell toxic rows best.
LEXICON = 500
THRESHOLD = 0.7

# Letters that a character may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "abcdefghijklmnopqrstuvwxyz", "#": "h",
}
SEPARATORS = " .-_~'*/\\,"

SUBSTITUTE = -0.7  # channel scores: look-alike for a letter,
DROP = -0.2  # a separator or further repetition left out

# ---- language model ------------------------------------------------------------

_CODE = np.zeros(256, dtype=np.int64)  # 0: outside of a word
_CODE[97:123] = np.arange(1, 27)


class LanguageModel:
    def __init__(self, counts: np.ndarray):
        three = counts.reshape(27, 27, 27).astype(float)
        two = three.sum(axis=2, keepdims=True)
        one = three.sum(axis=(0, 1))
        one = (one + 1) / (one + 1).sum()
        pairs = three.sum(axis=0)
        back = (pairs + 20 * one) / (pairs.sum(axis=1, keepdims=True) + 20)
        self.log = np.log((three + 5 * back[None]) / (two + 5))


def language_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all texts."""

    def count(batches):
        from squall.llm.textcore import Words, slices

        total = np.zeros(27**3, dtype=np.int64)
        for batch in batches:
            texts = columns(batch, "text")[0]
            for i, j in slices(texts):
                words = Words(texts.slice(i, j - i), "alnum")
                c = np.concatenate([[0, 0], _CODE[words.bytes], [0]])
                total += np.bincount((c[:-2] * 27 + c[1:-1]) * 27 + c[2:], minlength=27**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])

    found = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # 19,683 rows at most
    out = np.zeros(27**3)
    for r in found:
        out[r["gram"]] = r["n"]
    return out


# ---- lattice -------------------------------------------------------------------


def restore(token: str, log: np.ndarray) -> str:
    """The likeliest letters behind a token: Viterbi over (last two letters), one step per character."""
    # state: (letter before, last letter, run of equal input) -> (score, letters)
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    last_char = ""
    for ch in token:
        new: dict[tuple[int, int], tuple[float, str]] = {}

        def put(key, score, letters, new=new):
            if key not in new or new[key][0] < score:
                new[key] = (score, letters)

        plain = "a" <= ch <= "z"
        options = ch if plain else LOOKALIKES.get(ch, "")
        cost = 0.0 if plain else SUBSTITUTE
        for (a, b), (score, letters) in states.items():
            for option in options:
                c = ord(option) - 96
                put((b, c), score + cost + log[a, b, c], letters + option)
            if ch in SEPARATORS or not options or ch == last_char:
                put((a, b), score + DROP, letters)
        states = new or states
        last_char = ch
    return max(((s + log[a, b, 0], w) for (a, b), (s, w) in states.items()))[1]


_LETTER = np.zeros(256, dtype=np.int32)
_LETTER[97:123] = 1
_ODD = np.zeros(256, dtype=np.int32)
_SPLIT = np.zeros(256, dtype=np.int32)
for _ch in LOOKALIKES:
    _ODD[ord(_ch) if _ch.isascii() else _ch.encode()[-1]] = 1  # a sign of several bytes by its last
for _ch in SEPARATORS.strip():
    _SPLIT[ord(_ch)] = 1
_TAIL = np.zeros(256, dtype=bool)
for _ch in ".,!?;:\"')]|*#$%&<>":
    _TAIL[ord(_ch)] = True


def _inside_letters(b: np.ndarray) -> np.ndarray:
    """1 for last bytes of look-alikes of several bytes that are part of other characters."""
    out = np.zeros(len(b), dtype=np.int32)
    for ch in (c.encode() for c in LOOKALIKES if not c.isascii()):
        at = np.flatnonzero(b == ch[-1])
        other = np.zeros(len(at), dtype=bool)
        for k, byte in enumerate(ch[-2::-1], 1):
            other |= (at < k) | (b[at - k] != byte)
        out[at[other]] = 1
    return out


def squeezed_tokens(words):
    """Blank-separated tokens without separators and marks, repeated letters once: (bytes, first, last) of each."""
    b = words.bytes
    keep = (_SPLIT[b] == 0) & ~_TAIL[b]
    kept = np.flatnonzero(keep)
    # a letter goes if it equals the one kept before it in the same token
    token = np.searchsorted(words.start, kept, "right")
    same = np.zeros(len(kept), dtype=bool)
    same[1:] = (b[kept[1:]] == b[kept[:-1]]) & (token[1:] == token[:-1]) & (_LETTER[b[kept[1:]]] > 0)
    kept = kept[~same]
    return b[kept], np.searchsorted(kept, words.start), np.searchsorted(kept, words.end)


def odd_tokens(words) -> list[tuple[int, int]]:
    """(first, last) ranges of tokens that may be obfuscated: single ones, or runs of single characters."""
    n = len(words.start)
    if not n:
        return []
    start, end = words.start, words.end.copy()
    for _ in range(3):
        last = words.bytes[end - 1]
        end = np.where(_TAIL[last] & (end - start > 1), end - 1, end)

    def within(table_):
        total = np.zeros(len(words.bytes) + 1, dtype=np.int32)
        np.cumsum(table_, out=total[1:])
        return total[end] - total[start]

    b = words.bytes
    letters = within(_LETTER[b])
    odd = within(_ODD[b] & ~_inside_letters(b))
    splits = within(_SPLIT[b])
    thrice = np.zeros(len(b), dtype=np.int32)
    thrice[2:] = (b[2:] == b[1:-1]) & (b[1:-1] == b[:-2]) & (_LETTER[b[2:]] > 0)
    repeats = within(thrice)
    single = (letters >= 2) & ((odd > 0) & (odd <= letters + 2) | (repeats > 0) | ((splits >= 2) & (letters >= SHORTEST)))
    short = ((end - start) == 1) & ((letters + odd) == 1)
    row = np.repeat(np.arange(len(words.at) - 1), np.diff(words.at))
    out = [(int(i), int(i) + 1) for i in np.flatnonzero(single)]
    edges = np.flatnonzero(np.concatenate([[True], (short[1:] != short[:-1]) | (row[1:] != row[:-1])]))
    for a, z in zip(edges, np.append(edges[1:], n), strict=True):
        if short[a] and z - a >= 3:
            out.append((int(a), int(z)))
    return out


class Restorer:
    """restore with a cache of bounded size."""

    def __init__(self, log: np.ndarray):
        self.log, self.seen = log, {}

    def __call__(self, token: str) -> str:
        if token not in self.seen:
            if len(self.seen) > 50_000:
                self.seen.clear()
            self.seen[token] = restore(token, self.log)
        return self.seen[token]


def restored(words, restorer: Restorer):
    """(text's place, restored letters) of each odd token or run."""
    for a, z in odd_tokens(words):
        token = b" ".join(words.seen[words.start[i] : words.end[i]] for i in range(a, z)).decode("utf-8", "ignore")
        row = int(np.searchsorted(words.at, a, "right")) - 1
        yield row, restorer(token.strip(".,!?;:\"')]|#%&<>"))


# ---- classifier ----------------------------------------------------------------

#: Stems are the first so many bytes of longer words; one counts where it stands twice or more.
STEMS = (5, 6)
#: Letters that a word has at least to be looked up without its separators and repeated letters.
SHORTEST = 4
_AGAIN = re.compile(r"(.)\1+")


def squeezed(word: str) -> str:
    """Repeated letters once: restored words may lack a doubled letter, or have one too many."""
    return _AGAIN.sub(r"\1", word)


def text_features(words: list[bytes]) -> set[str]:
    """Words of a text, and stems (with a star) that stand in it twice or more."""
    out = {w.decode("latin-1") for w in words if len(w) > 1 and not w.isdigit()}
    for n in STEMS:
        stems = Counter(w[:n] for w in words if len(w) > n)
        out.update(f"{x.decode('latin-1')}*" for x, k in stems.items() if k > 1)
    return out


def _features(words_found: Counter, weights: dict[str, float], n_words: int) -> list[float]:
    hits = [(weights[w], n) for w, n in words_found.items() if w in weights]
    if not hits:
        return [0.0, 0.0, 0.0, 0.0]
    total = sum(n for _, n in hits)
    return [1.0, max(w for w, _ in hits), float(np.log1p(len(hits))), float(total / np.sqrt(max(n_words, 1)))]


class Classifier:
    def __init__(self, weights: dict[str, float], beta: np.ndarray, prior: float):
        self.weights, self.beta, self.prior = weights, beta, prior

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.beta[0] + features @ self.beta[1:])))


def _lexicon(sample: DataFrame, log: np.ndarray, limit: int) -> dict[str, float]:
    n1, n0 = (sample.where(F.col("toxic") == k).count() for k in (1, 0))
    if not n1 or not n0:
        return {}

    def count(batches):
        from squall.llm.textcore import Words, slices

        restorer = Restorer(log)
        seen = {0: Counter(), 1: Counter()}
        for batch in batches:
            labels, texts = columns(batch, "toxic", "text")
            for i, j in slices(texts):
                part = texts.slice(i, j - i)
                more: dict[int, list] = {}
                for row, w in restored(Words(part, "space_lower"), restorer):
                    more.setdefault(row, []).extend(x.encode() for x in w.split())
                words = Words(part, "alnum")
                for k in range(j - i):
                    own = words.seen[words.offsets[k] : words.offsets[k + 1]].split()
                    seen[labels[i + k].as_py()].update(text_features(own + more.get(k, [])))
        for label, counter in seen.items():
            if counter:
                yield pa.RecordBatch.from_arrays([pa.array(list(counter)), pa.array([label] * len(counter), pa.int64()), pa.array(list(counter.values()), pa.int64())], ["word", "toxic", "n"])

    per = sample.select("toxic", "text").mapInArrow(count, "word string, toxic long, n long").groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b")
    )
    per = per.checkpoint()
    # A log-likelihood ratio that about one of the many words tested would reach by chance.
    least = 2 * float(np.log(max(per.count(), 2))) - 6
    a, b = F.col("a"), F.col("b")
    odds = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
    share = (a + b) / float(n1 + n0)
    ratio = 2 * (a * F.log(a / (share * n1)) + F.when(b > 0, b * F.log(b / (share * n0))).otherwise(0.0))
    best = per.where("a >= 3").withColumns({"w": odds, "g": ratio}).where((F.col("g") > least) & (F.col("w") > 1)).orderBy(F.desc("g"), "word").limit(limit)
    found = {r["word"]: float(r["w"]) for r in best.collect()}
    # words that say less than their stem add nothing
    return {w: x for w, x in found.items() if w.endswith("*") or not any(len(w) > n and found.get(f"{w[:n]}*", x) > x for n in STEMS)}


def _work(log, weights):
    """A batch's features per document."""
    whole = {w.encode("latin-1"): w for w in weights if not w.endswith("*")}
    stems = {n: {w[:-1].encode("latin-1"): w for w in weights if w.endswith("*") and len(w) == n + 1} for n in STEMS}
    short = {squeezed(w): w for w in sorted(weights) if not w.endswith("*")}

    def keys_of(names):
        from squall.llm.textcore import span_hashes

        data = np.frombuffer(b"".join(names), dtype=np.uint8)
        ends = np.cumsum([len(x) for x in names])
        return np.sort(span_hashes(data, ends - np.array([len(x) for x in names]), ends)) if names else np.zeros(0, np.uint64)

    def features(texts, state={}):  # noqa: B006  one restorer per worker
        from squall.llm.textcore import Words, span_hashes

        if "restorer" not in state:
            state["restorer"] = Restorer(log)
            state["squeezed"] = keys_of([w.encode("latin-1") for w in short if len(w) >= SHORTEST])
            state["keys"] = {0: keys_of(list(whole)), **{n: keys_of(list(stems[n])) for n in STEMS}}
        plain = Words(texts, "alnum")
        found: dict[int, Counter] = {}
        for n, keys in state["keys"].items():
            if not len(keys) or not len(plain.start):
                continue
            longer = np.flatnonzero(plain.end - plain.start > n)
            start = plain.start[longer]
            hashes = span_hashes(plain.bytes, start, start + n if n else plain.end[longer])
            place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            counts: dict[int, Counter] = {}
            for p in longer[keys[place] == hashes]:
                w = stems[n].get(plain.word(p)[:n]) if n else whole.get(plain.word(p))
                if w:
                    counts.setdefault(int(np.searchsorted(plain.at, p, "right")) - 1, Counter())[w] += 1
            for row, own in counts.items():
                for w, k in own.items():
                    if k > 1 or not n:
                        found.setdefault(row, Counter())[w] += k
        odd = Words(texts, "space_lower")
        known = state["squeezed"]
        if len(known) and len(odd.start):
            data, first, last = squeezed_tokens(odd)
            hashes = span_hashes(data, first, last)
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            for p in np.flatnonzero(known[place] == hashes):
                w, written = bytes(data[first[p] : last[p]]).decode("latin-1"), odd.word(p).decode("latin-1")
                full = short.get(w)
                if full and full not in re.findall("[a-z]+", written):  # as written it has been counted
                    found.setdefault(int(np.searchsorted(odd.at, p, "right")) - 1, Counter())[full] += 1
        for row, w in restored(odd, state["restorer"]):
            w = squeezed(w)
            hits = [short[w]] if w in short else []
            if not hits:  # spelt out between other single letters
                hits = [full for x, full in short.items() if len(x) >= SHORTEST and x in w and (len(w) <= len(x) + 3 or len(w) > 8)]
            if hits:
                found.setdefault(row, Counter()).update(hits)
        sizes = np.diff(plain.at)
        return np.array([_features(found[k], weights, int(sizes[k])) if k in found else [0.0] * 4 for k in range(len(texts))]).reshape(len(texts), 4)

    return features


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ beta)))
        penalty = ridge * np.concatenate([[0.0], beta[1:]])
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(beta)), x.T @ (y - p) - penalty)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, lexicon: int = LEXICON) -> tuple[np.ndarray, Classifier]:
    """docs(doc_id, text); labels(doc_id, toxic): returns the language model's logs and the classifier."""
    log = LanguageModel(language_counts(docs)).log
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("long")).alias("toxic"))
    rows = rows.orderBy(crc("doc_id"), "doc_id").limit(most)
    shared_dir(spark)
    # At most MAX_LABELLED ids of two numbers each are broadcast; their texts are written once.
    sample = docs.join(F.broadcast(rows.withColumnRenamed("doc_id", "labelled_id")), F.col("doc_id") == F.col("labelled_id")).select("toxic", "text").checkpoint()
    weights = _lexicon(sample, log, lexicon)
    features = _work(log, weights)

    def work(batch):
        toxic, texts = columns(batch, "toxic", "text")
        x = features(texts)
        return pa.RecordBatch.from_arrays([toxic.cast(pa.int64()), *(pa.array(x[:, k]) for k in range(4))], ["toxic", "a", "b", "c", "d"])

    # One row of numbers per labelled row: MAX_LABELLED at most.
    data = map_texts(sample, work, "toxic long, a double, b double, c double, d double").collect()
    y = np.array([r["toxic"] for r in data], dtype=float)
    x = np.array([[r["a"], r["b"], r["c"], r["d"]] for r in data], dtype=float).reshape(len(data), 4)
    prior = float(y.mean()) if len(y) else 0.0
    if not weights or not 0 < prior < 1:
        beta = np.array([np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)), 0, 0, 0, 0]) if len(y) else np.array([-50.0, 0, 0, 0, 0])
    else:
        beta = _fit(x, y)
    return log, Classifier(weights, beta, prior)


def score_documents(docs: DataFrame, log: np.ndarray, model: Classifier) -> DataFrame:
    features = _work(log, model.weights)

    def work(batch):
        ids, texts = columns(batch, "doc_id", "text")
        return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(model.score(features(texts)))], ["doc_id", "score"])

    return map_texts(docs.select("doc_id", "text"), work, "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(crc("doc_id"), F.lit(3)) == 1
    log, model = train(spark, docs, table(spark, sf_dir, "labels").where(~held_out))
    return score_documents(docs, log, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
