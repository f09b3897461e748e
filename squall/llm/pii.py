"""Personal data: exact patterns, and a linear-chain conditional random field.

The field labels blank-separated tokens from word shapes (digits, letters,
marks, length) and from cue words nearby.  It is trained by gradient ascent from
the small labelled table below and decoded by Viterbi in numpy batches over
whole texts.  Tokens for which no label can catch up with O, whatever the
neighbours' labels are, are fixed at once (``active_tokens``, a bound from scores and
transitions), so only the runs between them are decoded: the labels are those of
decoding the whole text.

Patterns are the base spans; the field adds spans that overlap none of them:
further emails, phones and cards in other spellings, ``id`` (personal numbers)
and ``secret`` (keys, tokens, passwords).

Distribution: one pass, no shuffle; slices of bounded bytes; the weights are a
few thousand numbers.

Defined results: a null or empty text has no spans (redacted, null stays null); a very
long text or token is decoded like any other, cut nowhere; of overlapping spans the base
ones win, and among equally good labels the first as listed; repeated rows are scanned
each for itself; an empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squall.llm.common import columns, map_texts, ready, table

KINDS = ("email", "ip", "card", "phone", "id", "secret")
LABELS = ("O", "email", "card", "phone", "id", "secret")

# ---- base patterns -------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits: what fails at its start fails further on.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str):
    """Leftmost matches, found from each @: its local part is the run before it."""
    least = 0
    place = text.find("@")
    while place >= 0:
        begin = place
        while begin > least and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < place and (m := _DOMAIN.match(text, place + 1)):
            yield begin, m.end()
            least = m.end()
            place = text.find("@", least)
        else:
            place = text.find("@", place + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _at_most_255(digits: str) -> bool:
    digits = digits.lstrip("0")  # a run of digits may be of any length
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if any(c in text for c in "0123456789"):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(_at_most_255(x) for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# ---- labelled table ------------------------------------------------------------

#: [label text] marks spans; everything else is O.
LABELLED = (
    "please write to [email anna.meier@example.org] before friday",
    "contact: [email j.smith (at) example (dot) com] or ask at the desk",
    "reach me under [email paul [at] mail [dot] example [dot] net] thanks",
    "my address is [email lee@localhost] for now",
    "send it to [email maria at example dot com] and wait",
    "mail [email x.y@intranet] for help",
    "call [phone (415) 555-0132] after noon",
    "phone: [phone 415-555-0132] any day",
    "her number is [phone 020 7946 0123] in town",
    "tel. [phone 030 / 1234567] in the office",
    "fax [phone 555.014.7788] is closed",
    "mobile [phone 0171-5550199] or the front desk",
    "ring [phone (030) 5550-1234] for a table",
    "call [phone (212) - 555 - 0187] at noon",
    "her phone is [phone 020 - 7946 - 0123] now",
    "office [phone 030 / 12345 67] in town",
    "or ring [phone 0171 / 555 01 99] today",
    "the card [card 5105 - 1051 - 0510 - 5102] was declined",
    "visa [card 4012 / 8888 / 8888 / 1883] on file",
    "card number [card 4111 1111 1111 1112] was charged",
    "the card [card 5500-0000-0000-0005] has expired",
    "paid with visa [card 4929348385146307] today",
    "credit card: [card 378282246310006] on file",
    "ssn [id 078-05-1120] on the form",
    "social security number [id 219-09-9999] please",
    "passport [id X1234567] was lost",
    "iban [id DE89370400440532013000] for the rent",
    "tax id [id 12/345/67890] is needed",
    "her ssn is [id 457-55-5462] as stated",
    'the server said token = [secret "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"] and closed',
    'set token = [secret "cb1a9fee807a05366fcb8b6c95c7c565ede51a72"] in the file',
    "password: [secret hunter2xyz] is weak",
    "api_key = [secret sk-4f9aB77cQ1zzT08x] never share",
    "secret [secret AKIA4EXAMPLE7XYZQ12] was found",
    "the key [secret ghp_16C7e42F292c6912E7710c838347Ae178B4a] leaked",
    "access token [secret eyJhbGciOi9.J1c2VyIjo4.x7Qk2] expired",
    "password: [secret correcthorsebatterystaple] was changed",
    'token = [secret "deadbeefcafebabefeedface"] in the file',
    "secret: [secret thequickbrownfoxjumps] is weak",
    "api_key = [secret AbCdEfGhIjKlMnOpQrStUvWx] never share",
    "the password: remember it, and the key: understanding",
    "a secret: friendship of the two is shared",
    "internationalization and responsibilities are long words",
    "password = [secret trustnooneatallever] for the box",
    "my password is [secret openthegatesquickly] now",
    "the key is communication and the token is understanding",
    "der schlüssel: donaudampfschifffahrtsgesellschaft liegt am ufer",
    "in 2019 about 3,000 people came to the fair",
    "the price rose by 4.5 % to 1,250.00 in march 2021",
    "see section 12.3.4 and table 7 on page 128",
    "version 2.0 of the program was built on 2020-05-14 at 12:30",
    "the ratio 3/4 is less than 10/12 in most years",
    "a token of thanks, and the key to the house",
    "he forgot the password and the card at home",
    "they phone each other and send an email now and then",
    "at noon the dot on the map is at the river",
    "room 415 is on floor 4, seats 100-120 are free",
    "between 1914 and 1918, and again 1939-1945, they left",
    "the score was 3-2 after 90 minutes, 45-30 at the half",
    "thntblere of then edtioner | inea | ononedth | edshhe | worthless",
    "achach$$$ schgech%%% ench*** nicht### eneina of the",
    "pages 12 - 15 and 100 - 120 of 300 - 400 are missing",
    "the 1990 - 1995 and 2001 - 2005 seasons, 12 / 20 and 3 / 4",
    "on 2020 - 05 - 14 the score was 3 - 2 , then 110 - 98",
    "thewn at the nd athar. at. inea ond at ononedth thenre",
    "we met at school and at work, then sat at home. at last",
    "order 100200300 was shipped in 12 boxes of 24",
    "isbn 978-3-16-148410-0 is the third edition",
    "the sum of 1234567 and 7654321 is 8888888",
    "http://example.org/a/b?c=1 is the page and #42 the issue",
    "la población de 2010 era de 1.234.567 personas",
    "im jahr 1871 wurden 25 000 mark gezahlt",
)
_MARK = re.compile(r"\[(" + "|".join(LABELS[1:]) + r") ((?:[^\[\]]|\[(?:at|dot)\])*)\]")

# Cue words by group, in lower case.
CUES = (
    ("email", "mail", "e-mail", "contact", "reach", "write", "send"),
    ("phone", "tel", "telephone", "call", "ring", "fax", "mobile", "number"),
    ("card", "visa", "mastercard", "credit", "amex"),
    ("ssn", "social", "security", "passport", "iban", "tax"),
    ("token", "password", "passwd", "secret", "key", "api_key", "apikey", "access"),
    ("at", "(at)", "[at]"),
    ("dot", "(dot)", "[dot]"),
    ("=", ":", "is"),
)
AT, DOT = 5, 6  # groups


# ---- features ------------------------------------------------------------------

_CLASSES = np.zeros((9, 256), dtype=np.int32)
for _c in range(256):
    _ch = chr(_c)
    _CLASSES[0, _c] = 48 <= _c <= 57
    _CLASSES[1, _c] = 97 <= _c <= 122 or _c >= 128
    _CLASSES[2, _c] = 65 <= _c <= 90
    _CLASSES[3, _c] = _ch in "-./"
    _CLASSES[4, _c] = _ch in "()+"
    _CLASSES[5, _c] = _ch == "@"
    _CLASSES[6, _c] = _ch in "\"'"
    _CLASSES[7, _c] = _ch in "%$#&*|<>,"
    _CLASSES[8, _c] = _ch in "=:_"

_N_SHAPES = 10 * 4 * 3 * 3 * 3 * 2 * 2 * 2 * 2


def shapes(words) -> np.ndarray:
    """A small number per token that stands for its shape."""
    n = len(words.bytes)
    counts = []
    total = np.zeros(n + 1, dtype=np.int32)
    for one in _CLASSES:
        np.cumsum(one[words.bytes], out=total[1:])
        counts.append(total[words.end] - total[words.start])
    digits, lower, upper, joins, rounds, ats, quotes, marks, signs = counts
    # number of digits in ten bands
    band = np.searchsorted(np.array([1, 2, 3, 4, 5, 7, 9, 13, 20]), digits, side="right")
    code = band
    code = code * 4 + np.searchsorted(np.array([1, 9, 16]), lower, side="right")
    code = code * 3 + np.minimum(upper, 2)
    code = code * 3 + np.minimum(joins, 2)
    code = code * 3 + np.minimum(rounds, 2)
    code = code * 2 + (ats > 0)
    code = code * 2 + (quotes > 0)
    code = code * 2 + (marks > 0)
    return code * 2 + (signs > 0)


@functools.cache
def _cue_hashes() -> tuple[np.ndarray, np.ndarray]:
    from squall.llm.textcore import Words

    flat = [(w, g) for g, group in enumerate(CUES) for w in group]
    w = Words(pa.array([x for x, _ in flat], pa.string()), "space_lower")
    h = w.hashes()
    order = np.argsort(h)
    return h[order], np.array([g for _, g in flat])[order]


def cues(words) -> np.ndarray:
    """Cue group of each token (lower-cased, one trailing ``:``, ``.`` or ``,`` aside), or -1."""
    from squall.llm.textcore import TABLES, span_hashes

    if not len(words.start):
        return np.zeros(0, np.int64)
    lowered = np.frombuffer(words.seen.translate(TABLES["space_lower"]), dtype=np.uint8)
    last = lowered[words.end - 1]
    end = words.end - ((last == 58) | (last == 46) | (last == 44)) * (words.end - words.start > 1)
    h = span_hashes(lowered, words.start, end)
    keys, groups = _cue_hashes()
    place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[place] == h, groups[place], -1)


class Field:
    """Weights: per shape parts and label, per cue group nearby and label, and transitions."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, begin: np.ndarray):
        self.weights, self.trans, self.begin = weights, trans, begin
        self.by_shape = shape_parts(np.arange(_N_SHAPES)) @ weights[:_SHAPE_PARTS]
        # What a label can win over O by transitions: a step between labels counts half for
        # each of its tokens, a step from or to O for the token that isn't O.
        step = trans - trans[0, 0]
        inner = step[1:, 1:] / 2
        left, right = np.maximum(step[0, 1:], inner.max(axis=0)), np.maximum(step[1:, 0], inner.max(axis=1))
        self.gain = left + right
        self.edge_gain = np.maximum(left, begin[1:] - begin[0]) + np.maximum(right, 0.0)
        # By shape alone, for tokens inside a text without a cue or a digit near.
        first = np.cumsum([_SHAPE_PARTS] + [len(CUES) + 1] * 5 + [11])
        quiet = self.by_shape + weights[first[:5]].sum(axis=0) + weights[first[5:] + 1].sum(axis=0)
        self.quiet = self.most(quiet, self.gain)

    @staticmethod
    def most(scores: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """The most that each token can add to a path by not being O."""
        return (scores[:, 1:] - scores[:, :1] + gain).max(axis=1)

    def scores(self, shape: np.ndarray, cue: np.ndarray, at: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Scores of the tokens numbered by places, by lookups instead of one-hot products."""
        out = self.by_shape[shape[places]]
        first = _SHAPE_PARTS
        for values, size in context_values(shape, cue, at, places):
            out += self.weights[first + values]
            first += size
        return out


def shape_parts(code: np.ndarray) -> np.ndarray:
    """One-hot parts of shapes: each part, and the digit band with each other part."""
    parts, rest = [], code
    for size in (2, 2, 2, 2, 3, 3, 3, 4, 10):
        parts.append((rest % size, size))
        rest = rest // size
    band = parts[-1][0]
    out = [np.eye(size)[v] for v, size in parts]
    for v, size in parts[:-1]:
        out.append(np.eye(10 * size)[band * size + v])
    return np.concatenate(out, axis=1)


_SHAPE_PARTS = shape_parts(np.zeros(1, dtype=np.int64)).shape[1]


def context_values(shape: np.ndarray, cue: np.ndarray, at: np.ndarray, places: np.ndarray):
    """(value, number of values) of own cue, cues one to three before and one after, and the digit bands beside; 0: none."""
    n = len(shape)
    row = np.searchsorted(at, places, "right") - 1
    low, high = at[row], at[row + 1]
    band = shape // (_N_SHAPES // 10)
    for by, values, size in [(b, cue, len(CUES) + 1) for b in (0, 1, 2, 3, -1)] + [(b, band, 11) for b in (1, -1)]:
        p = places - by
        yield np.where((p >= low) & (p < high), values[np.clip(p, 0, n - 1)] + 1, 0), size


def context_parts(shape: np.ndarray, cue: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.concatenate([np.eye(size)[v] for v, size in context_values(shape, cue, at, np.arange(len(shape)))], axis=1)


def _parse(line: str) -> tuple[str, list[int]]:
    text, labels, place = "", [], 0
    for m in _MARK.finditer(line):
        before = line[place : m.start()]
        labels += [0] * len(before.split())
        labels += [LABELS.index(m[1])] * len(m[2].split())
        text += before + m[2]
        place = m.end()
    labels += [0] * len(line[place:].split())
    return text + line[place:], labels


@functools.cache
def train(rounds: int = 300, ridge: float = 0.02) -> Field:
    """Maximum likelihood over the labelled table, by gradient ascent with exact marginals."""
    from squall.llm.textcore import Words

    pairs = [_parse(x) for x in LABELLED]
    words = Words(pa.array([t for t, _ in pairs], pa.string()), "space")
    gold = np.array([x for _, l in pairs for x in l])
    assert len(gold) == len(words.start)
    shape = shapes(words)
    cue = cues(words)
    x = np.concatenate([shape_parts(shape), context_parts(shape, cue, words.at)], axis=1)
    n_labels = len(LABELS)
    weights, trans, begin = np.zeros((x.shape[1], n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)
    moments = [np.zeros_like(p) for p in (weights, trans, begin)]
    for _ in range(rounds):
        emit = x @ weights
        g_emit, g_trans, g_begin = np.eye(n_labels)[gold], np.zeros_like(trans), np.zeros_like(begin)
        for a, b in zip(words.at[:-1], words.at[1:], strict=True):
            e, y = emit[a:b], gold[a:b]
            m = b - a
            forward, backward = np.zeros((m, n_labels)), np.zeros((m, n_labels))
            forward[0] = begin + e[0]
            for t in range(1, m):
                forward[t] = np.logaddexp.reduce(forward[t - 1][:, None] + trans, axis=0) + e[t]
            for t in range(m - 2, -1, -1):
                backward[t] = np.logaddexp.reduce(trans + (e[t + 1] + backward[t + 1])[None], axis=1)
            z = np.logaddexp.reduce(forward[-1])
            g_emit[a:b] -= np.exp(forward + backward - z)
            g_begin += np.eye(n_labels)[y[0]] - np.exp(forward[0] + backward[0] - z)
            for t in range(1, m):
                g_trans[y[t - 1], y[t]] += 1
                g_trans -= np.exp(forward[t - 1][:, None] + trans + (e[t] + backward[t])[None] - z)
        for p, g, s in zip((weights, trans, begin), (x.T @ g_emit, g_trans, g_begin), moments, strict=True):
            g -= ridge * p
            s += g * g
            p += 0.3 * g / np.sqrt(s + 1e-8)
    return Field(weights, trans, begin)


def active_tokens(shape: np.ndarray, cue: np.ndarray, at: np.ndarray, field: Field) -> np.ndarray:
    """The tokens that the bound leaves open; all others are O on every best path.

    A run of labels other than O beats O only if what its tokens can add at most
    sums to 0 or more: a token stays open if any run around it does.
    """
    n = len(shape)
    edge, loud = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    starts = at[:-1][np.diff(at) > 0]
    edge[starts] = edge[np.append(starts[1:], n) - 1] = True
    digits = np.flatnonzero(shape // (_N_SHAPES // 10) > 0)
    cued = np.flatnonzero(cue >= 0)
    for places, steps in ((digits, (-1, 1)), (cued, (-1, 0, 1, 2, 3))):
        for by in steps:
            near = places + by
            loud[near[(near >= 0) & (near < n)]] = True
    most = field.quiet[shape]
    for places, gain in ((np.flatnonzero(loud & ~edge), field.gain), (np.flatnonzero(edge), field.edge_gain)):
        if len(places):
            most[places] = field.most(field.scores(shape, cue, at, places), gain)
    total = np.concatenate([[0.0], np.cumsum(most + 1e-9)])
    best = np.maximum.accumulate(total[:0:-1])[::-1] - np.minimum.accumulate(total[:-1])
    return np.flatnonzero(best >= -1e-6)


def label_tokens(words, field: Field) -> tuple[np.ndarray, np.ndarray]:
    """(token numbers, labels) of all tokens that are not O."""
    from squall.llm.viterbi import decode

    none = np.zeros(0, np.int64)
    shape = shapes(words)
    if not len(shape):
        return none, none
    cue = cues(words)
    places = active_tokens(shape, cue, words.at, field)
    if not len(places):
        return none, none
    emit = field.scores(shape, cue, words.at, places)
    row = np.searchsorted(words.at, places, "right")
    new = np.concatenate([[True], (np.diff(places) > 1) | (np.diff(row) > 0)])
    at = np.append(np.flatnonzero(new), len(places))
    # Runs lie between tokens that are O, or at a text's ends.
    first, last = at[:-1], at[1:] - 1
    opens = places[first] == words.at[row[first] - 1]
    closes = places[last] + 1 == words.at[row[last]]
    emit[first] += np.where(opens[:, None], field.begin, field.trans[0])
    emit[last] += np.where(closes[:, None], 0.0, field.trans[:, 0])
    labels = decode(emit, at, field.trans, block=8)
    found = labels > 0
    return places[found], labels[found]


#: With a spelt-out at there must be a dot of the domain, spelt out or not.
_SPELT = re.compile(r"(?is)^[^\s@]+\s*(@\s*\S|([(\[]at[)\]]|\bat\b)\s*.*(\bdot\b|\w\.\w))")
_NUMBER = re.compile(r"[0-9 ().+/-]+")
#: A number whose check digit is wrong is a card only behind such a word.
_CARD_CUE = re.compile(r"(?i)\b(" + "|".join(CUES[2]) + r")\b")
#: So is a secret without a digit.
_SECRET_CUE = re.compile(r"(?i)\b(" + "|".join(CUES[4]) + r")\b")
_TRIM = " \t\r\n.,;:!?\"'"


def field_spans(text: str, raw: bytes, spans: list[tuple[int, int, int]], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Labelled byte spans (in order) as code-point spans, without those that overlap base spans or lack what they need."""
    out = []
    taken = sorted((x, y) for _, x, y in taken)
    starts, reach = [x for x, _ in taken], list(accumulate((y for _, y in taken), max))
    at = place = 0  # so many bytes are so many code points
    for label, a, b in spans:
        start = place + len(raw[at:a].decode("utf-8", "replace"))
        end = start + len(raw[a:b].decode("utf-8", "replace"))
        at, place = b, end
        while start < end and text[start] in _TRIM:
            start += 1
        while end > start and text[end - 1] in _TRIM:
            end -= 1
        kind, inner = LABELS[label], text[start:end]
        digits = len(_NOT_DIGIT.sub("", inner))
        sane = {"email": bool(_SPELT.match(inner)) and len(inner) > 5, "phone": 7 <= digits <= 15 and bool(_NUMBER.fullmatch(inner)), "card": 13 <= digits <= 19 and bool(_NUMBER.fullmatch(inner)) and (luhn(_NOT_DIGIT.sub("", inner)) or bool(_CARD_CUE.search(text, max(0, start - 40), start))), "id": digits >= 6, "secret": len(inner) >= 8 if digits else len(inner) >= 16 and bool(_SECRET_CUE.search(text, max(0, start - 40), start))}[kind]
        before = bisect_left(starts, end)
        if start < end and sane and not (before and reach[before - 1] > start):
            out.append((kind, start, end))
    return out


def spans_of(texts: pa.Array, field: Field) -> list[tuple[str, list, list]]:
    """(text, base spans, the field's further spans) of each text."""
    from squall.llm.textcore import Words

    words = Words(texts, "space")
    places, labels = label_tokens(words, field)
    rows = np.searchsorted(words.at, places, "right") - 1
    own: dict[int, list] = {}
    for p, label, row in zip(places.tolist(), labels.tolist(), rows.tolist(), strict=True):
        spans = own.setdefault(row, [])
        a, b = int(words.start[p] - words.offsets[row]), int(words.end[p] - words.offsets[row])
        if spans and spans[-1][0] == label and spans[-1][3] == p - 1:
            spans[-1] = (label, spans[-1][1], b, p)
        else:
            spans.append((label, a, b, p))
    out = []
    for i in range(len(texts)):
        raw = words.raw[words.offsets[i] : words.offsets[i + 1]]
        text = raw.decode("utf-8", "replace")
        base = base_spans(text)
        out.append((text, base, field_spans(text, raw, [s[:3] for s in own[i]], base) if i in own else []))
    return out


SCHEMA = "doc_id long, base array<struct<kind:string,start:int,stop:int>>, more array<struct<kind:string,start:int,stop:int>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base spans and the field's further spans, in code points."""
    field = train()

    def work(batch):
        ids, texts = columns(batch, "doc_id", "text")
        found = spans_of(texts, field)
        as_rows = [[[{"kind": k, "start": a, "stop": b} for k, a, b in x[n]] for x in found] for n in (1, 2)]
        return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(x, _SPAN) for x in as_rows)], ["doc_id", "base", "more"])

    return map_texts(docs.select("doc_id", "text"), work, SCHEMA)


def _joined(spans):
    """kind:start:end by kind as listed, then start."""
    place = F.transform(spans, lambda s: F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("p"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(place), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def digest(found: DataFrame) -> DataFrame:
    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def more(kind):
        return F.size(F.filter("more", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("email"), count("ip"), count("card"), count("phone"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "more")).alias("spans"),
        more("id"), more("secret"), F.size("more").cast("long").alias("n_more"), (F.size("base") + F.size("more")).cast("long").alias("n_spans"),
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(table(spark, sf_dir, "documents")))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by <KIND>; other columns as they are.

    Done row by row with the operator's own functions, so that equal ids or
    further columns need no join.
    """
    field = train()
    ready(docs.sparkSession)

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        from squall.llm.textcore import slices

        out: list = []
        for i, j in slices(texts):
            part = texts.slice(i, j - i)
            for k, (text, base, more) in enumerate(spans_of(part, field)):
                if not part[k].is_valid:
                    out.append(None)
                    continue
                pieces, place = [], 0
                for kind, a, b in sorted(base + more, key=lambda s: (s[1], -s[2])):
                    if b > place:
                        pieces += [text[place : max(a, place)], f"<{kind.upper()}>"]
                        place = b
                out.append("".join(pieces) + text[place:])
        return pa.array(out, pa.string())

    return docs.withColumn("text", cleaned("text"))
