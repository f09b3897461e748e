"""Each operator against plain Python, on odd rows and on the small tables."""

import hashlib
import json
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from squall.llm import bloom, chat_format, decontaminate, graph, language, licenses, line_quality, mixing, near_dedup, pii, shingles, substring_dedup, textcore, toxicity, viterbi
from squall.llm.common import table

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


BASE = " ".join(f"w{k}" for k in range(60))
ROWS = [
    (1, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (3, BASE + " end", "en", None, 1), (4, None, None, None, None), (5, "", "en", "b", 0), (6, "   \n\t ", "en", "b", 5),
    (7, "one", "en", "b", 3), (8, "one two", "en", "b", 7), (9, "Ünïcödé ß 東京 текст " * 30, "de", "c", 1), (10, "x" * 5000, "en", "c", 1), (11, BASE[:100] + " " + BASE, "fr", "a", 1),
    (12, " ".join(str(k % 7) for k in range(3000)), "en", "a", 1), (12, " ".join(str(k % 7) for k in range(3000)), "en", "a", 1), (None, BASE, "en", "a", 1), (None, None, None, "z", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(spark, odd):
    """Further columns with names that operators use themselves."""
    return odd.withColumns({n: F.lit(1) for n in ("size", "words", "label", "cluster", "chunk", "kept", "score", "hits", "rep", "member", "start", "slot", "row", "key")})


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DATA, "documents")


def text_rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# ---- shared parts ----


def test_words_and_grams():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab 1.\n\tÄß東") for _ in range(rng.randrange(30))) for _ in range(200)]
    for kind, pattern, change in (("space", WORD, lambda t: t), ("alnum", ALNUM, lower), ("space_lower", WORD, lower)):
        w = textcore.Words(pa.array(texts), kind)
        want = [pattern.findall(change(t)) for t in texts]
        assert [[w.word(i).decode() for i in range(a, b)] for a, b in zip(w.at[:-1], w.at[1:], strict=True)] == want
        h = w.hashes()
        flat = [x for ws in want for x in ws]
        assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))
        g, first = textcore.grams(h, w.at, 3)
        triples = [tuple(ws[k : k + 3]) for ws in want for k in range(len(ws) - 2)]
        assert len(g) == len(triples) and len(set(zip(triples, g.tolist(), strict=True))) == len(set(triples))


def test_slices_cover_all_rows():
    column = pa.array(["a" * 10, "", None, "b" * 100, "c"])
    got = list(textcore.slices(column, 12))
    assert got[0][0] == 0 and got[-1][1] == 5 and all(x[1] == y[0] for x, y in zip(got[:-1], got[1:], strict=True))


def test_slices_bound_what_a_worker_takes():
    texts = pa.array([f"call +1 555 010 {k:04} now; " + f"the quick brown Fox jumps over {k} lazy dogs, " * 80 for k in range(1200)], pa.string())
    field, model = pii.train(), language.Model({"en": np.ones(language.BUCKETS + len(language.SCRIPTS))})
    works = {
        "sets": lambda x: [k.tolist() for k in shingles.Sets(x).keys()],
        "spans": lambda x: [[base, more] for _, base, more in pii.spans_of(x, field)],
        "language": lambda x: language.judge(x, model)[0],
    }
    for name, work in works.items():
        work(texts[:1])  # what is kept for good isn't counted
        tracemalloc.start()
        for i, j in textcore.slices(texts):
            work(texts.slice(i, j - i))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40 << 20, (name, peak)
        # and the cuts don't show in the results
        made, large = ([work(texts.slice(i, j - i)) for i, j in textcore.slices(texts, most)] for most in (textcore.SLICE_BYTES, 2 << 20))
        if name == "sets":
            made, large = ([[k for part in x for k in part[n]] for n in (0, 1)] for x in (made, large))
            assert made == large
        else:
            assert [x for part in made for x in part] == [x for part in large for x in part]


def test_viterbi_matches_plain():
    rng = np.random.default_rng(0)

    def plain(e, tr, b, en):
        s, back = e[0] + b, []
        for t in range(1, len(e)):
            step = s[:, None] + tr
            back.append(step.argmax(0))
            s = step.max(0) + e[t]
        k = int((s + en).argmax())
        path = [k]
        for x in back[::-1]:
            k = x[k]
            path.append(k)
        return path[::-1]

    for _ in range(60):
        n = int(rng.integers(1, 5))
        sizes = rng.integers(0, 40, size=int(rng.integers(1, 7)))
        at = np.concatenate([[0], np.cumsum(sizes)])
        e, tr, b, en = rng.normal(size=(at[-1], n)), rng.normal(size=(n, n)), rng.normal(size=n), rng.normal(size=n)
        got = viterbi.decode(e, at, tr, b, en, block=int(rng.integers(1, 9)))
        for i, m in enumerate(sizes):
            if m:
                assert got[at[i] : at[i + 1]].tolist() == plain(e[at[i] : at[i + 1]], tr, b, en)


# ---- 1: language ----


def test_language_accuracy(spark):
    d = "/root/testdata/sf0.01"
    found = language.op1_language_id(spark, d).join(table(spark, d, "documents").select(F.col("doc_id"), "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert len(found) == 1000 and (held.lang == held.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all()
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(found.doc_id, found.held_out, strict=True))


def plain_script(c):
    """Script by the character's Unicode name, for some."""
    import unicodedata

    name = unicodedata.name(c, "").split(" ")[0].lower()
    return {"cjk": "han", "hiragana": "kana", "katakana": "kana"}.get(name, name)


def test_scripts_by_code_points():
    texts = ["Ünï", "ελλ", "тек", "ქართ", "ไทย", "東京", "ひら", "カナ", "한글", "עבר", "عرب", "हिन", "አማር", "ភាស", "😀", "12", "😀a", "ߒߞߏ", "ދިވެ", "ﬁ"]
    words = textcore.Words(pa.array(texts), "alnum")
    got = [language.SCRIPTS[k] for k in language._scripts(words)]
    assert got[:14] == [plain_script(t[0]) for t in texts[:14]] and got[14:] == ["none", "none", "latin", "nko", "thaana", "latin"]


def test_language_matches_plain(docs):
    """Every word's emissions, the path of a plain Viterbi over them, and the share of words."""
    model = language.train(docs)
    rows = [t or "" for _, t in text_rows(docs)] + ["Ünïcödé ß 東京 текст " * 9, "the 12 of 東京", "12 13", "東京"]
    found, score, spans = language.judge(pa.array(rows), model, True)
    n = len(model.languages)
    for i, text in enumerate(rows):
        words = [w.encode() for w in ALNUM.findall(lower(text))]
        line = b" " + lower(text).encode().translate(textcore.TABLES["alnum"]) + b" "
        emit, lettered, place = [], [], 0
        for w in words:
            place = line.index(w, place)
            total = np.zeros(n)
            for k in range(place, place + len(w)):
                a, b, c = (np.uint32(line[k + d]) for d in (-1, 0, 1))
                h = a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77) ^ c * np.uint32(0xC2B2AE3D)
                total += model.scores[int(h >> np.uint32(18))]
            place += len(w)
            letters = [c for c in w.decode() if language.script_of(np.array([ord(c)]))[0]]
            lettered.append(bool(letters))
            emit.append(np.where(model.allowed[language.script_of(np.array([ord(letters[0])]))[0]], total, -1e6) if letters else np.zeros(n))
        path = []
        if words:
            s, back = emit[0], []
            for e in emit[1:]:
                step = s[:, None] - language.SWITCH * (1 - np.eye(n))
                back.append(step.argmax(0))
                s = step.max(0) + e
            path = [int(s.argmax())]
            for b in back[::-1]:
                path.append(int(b[path[-1]]))
            path = path[::-1]
        own = Counter(k for k, x in zip(path, lettered, strict=True) if x)
        best = max(range(n), key=lambda k: (own[k], -k))
        assert found[i] == (model.languages[best] if any(c.isalpha() for c in text) else "und"), text[:80]
        assert abs(score[i] - (own[best] / max(1, sum(own.values())))) < 1e-9
        assert sum(x["last"] - x["first"] for x in spans[i]) == len(words)


def test_switching_viterbi_matches_the_general_one():
    rng = np.random.default_rng(1)
    for _ in range(80):
        n, sizes = int(rng.integers(1, 12)), rng.integers(0, 60, size=int(rng.integers(1, 9)))
        at = np.concatenate([[0], np.cumsum(sizes)])
        e, tr = rng.normal(size=(at[-1], n)), np.full((n, n), -1.3)
        np.fill_diagonal(tr, 0)
        block = int(rng.integers(1, 9))
        assert (viterbi.decode(e, at, tr, block=block) == viterbi.decode_switching(e, at, 1.3, block=block)).all()


def test_language_odd_rows(spark, odd, empty, clashing, docs):
    model = language.train(docs)
    got = {r.doc_id: r for r in language.identify(clashing, model).collect()}
    assert got[4].lang_pred == got[5].lang_pred == got[6].lang_pred == got[12].lang_pred == "und" and got[4].score == 0.0
    assert got[9].lang_pred in model.languages
    assert language.identify(empty, model).count() == 0
    nothing = language.train(empty)
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {"und"}
    mixed = spark.createDataFrame([(1, "the of and to in is on that by for the and of " * 3 + "der die und das ist ein nicht von mit der die " * 3)], "doc_id long, text string")
    spans = language.identify(mixed, model).first().spans
    assert [s.lang for s in spans] == ["en", "de"] and spans[0].first == 0 and spans[0].last == spans[1].first


# ---- 2: chat ----


def call(**x):
    return "<tool_call>" + json.dumps(x) + "</tool_call>"


def test_chat(spark):
    rows = [
        (1, 0, "user", 'hi "q" é'), (1, 1, "assistant", "a " + call(id="b", name="calculate", arguments={"expression": {"$result": "a"}}) + call(name="search", id="a", arguments={"query": "z", "limit": 2})),
        (1, 2, "tool", '{"tool_call_id": "a", "content": {"z": 1, "a": [1]}}'), (1, 3, "assistant", call(id="c", name="search", arguments={"q": 1}) + "<tool_call>nope</tool_call>"),
        (1, 4, "assistant", call(id="x", name="calculate", arguments={"expression": {"$result": "y"}}) + call(id="y", name="calculate", arguments={"expression": {"$result": "x"}})),
        (2, 0, "tool", '{"tool_call_id": "a", "content": 1}'), (None, None, None, None), (2, 0, "tool", '{"tool_call_id": "a", "content": 1}'),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit(9))
    got = {(r.conv_id, r.turn): r for r in chat_format.format_chat(spark, df).collect()}
    assert chat_format.format_chat(spark, df).count() == 8
    assert (got[1, 1].n_calls, got[1, 1].n_linked, got[1, 1].n_invalid, got[1, 1].top_level) == (2, 1, 0, 1)
    message = json.loads(got[1, 1].message)
    assert [c["id"] for c in message["tool_calls"]] == ["a", "b"] and message["tool_calls"][0]["arguments"] == '{"limit":2,"query":"z"}'
    assert got[1, 3].n_invalid == 2 and got[1, 4].top_level is None and got[1, 4].n_calls == 2
    assert list(json.loads(got[1, 0].message)) == ["content", "conv_id", "role", "turn"]
    assert got[None, None].n_calls == 0
    assert chat_format.format_chat(spark, df.limit(0)).count() == 0


def plain_chat(rows):
    """{(conv_id, turn): (n_calls, n_linked, n_invalid, top_level, ids in order)} by plain dictionaries and recursion."""
    calls, answered = {}, set()
    for conv, turn, role, text in rows:
        for at, raw in enumerate(re.findall(r"(?s)<tool_call>(.*?)</tool_call>", text)):
            try:
                calls[conv, turn, at] = json.loads(raw)
            except ValueError:
                calls[conv, turn, at] = {}
        if role == "tool":
            answered.add((conv, json.loads(text)["tool_call_id"]))
    uses, ids = {}, {}
    for (conv, turn, at), c in sorted(calls.items()):
        if "id" in c and (conv, c["id"]) not in uses:
            uses[conv, c["id"]] = {v["$result"] for v in c.get("arguments", {}).values() if isinstance(v, dict)}
    known = set(uses)

    def level(key, seen=()):
        if key in seen:
            return None
        if key not in ids:
            below = [level((key[0], u), (*seen, key)) for u in uses[key] if (key[0], u) in known]
            ids[key] = None if None in below else 1 + max(below, default=-1)
        return ids[key]

    def bad(c):
        schema = chat_format.SCHEMAS.get(c.get("name"))
        arguments = c.get("arguments")
        if schema is None or not isinstance(arguments, dict) or set(arguments) - set(schema):
            return True
        kinds = {"STRING": str, "BIGINT": int}
        return any((k not in arguments and need) or (k in arguments and not isinstance(arguments[k], dict | kinds[kind])) for k, (kind, need) in schema.items())

    out = {}
    for conv, turn, _, _ in rows:
        own = [(at, c) for (x, y, at), c in sorted(calls.items()) if (x, y) == (conv, turn)]
        levels = {at: level((conv, c["id"])) if "id" in c else None for at, c in own}
        order = sorted(own, key=lambda x: (levels[x[0]] is not None, levels[x[0]] or 0, x[0]))
        some = [k for k in levels.values() if k is not None]
        out[conv, turn] = (len(own), sum((conv, c.get("id")) in answered for _, c in own), sum(bad(c) for _, c in own), max(some, default=None), [c.get("id") for _, c in order])
    return out


def test_chat_matches_plain(spark):
    rng = random.Random(6)
    rows = []
    for conv in range(25):
        names = [f"c{k}" for k in range(rng.randrange(1, 9))]
        turn = 0
        for name in names:
            tool = rng.choice([*chat_format.SCHEMAS, "unknown"])
            arguments = {k: rng.choice(["x", 3, {"$result": rng.choice(names)}]) for k in (*chat_format.SCHEMAS.get(tool, ()), "more") if rng.random() < (0.15 if k == "more" else 0.8)}
            text = "say " + call(id=name, name=tool, arguments=arguments) + (call(name="search", arguments={"query": "q"}) if rng.random() < 0.2 else "") + ("<tool_call>{</tool_call>" if rng.random() < 0.1 else "")
            rows.append((conv, turn, "assistant", text))
            turn += 1
            if rng.random() < 0.7:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": name, "content": "done"})))
                turn += 1
    want = plain_chat(rows)
    got = {}
    for r in chat_format.format_chat(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got[r.conv_id, r.turn] = (r.n_calls, r.n_linked, r.n_invalid, r.top_level, [c.get("id") for c in json.loads(r.message).get("tool_calls", [])])
    assert {x[3] for x in want.values()} >= {None, 0, 1, 2} and got == want


# ---- 3: licences ----


def test_licence_expressions():
    assert licenses.to_postfix("a or b and c") == ["a", "b", "c", "and", "or"]
    assert licenses.evaluate("(MIT OR GPL-2.0-only) AND Apache-2.0") == (["apache-2.0", "gpl-2.0-only", "mit"], True)
    assert licenses.evaluate("GPL-2.0-only WITH Classpath-exception-2.0") == (["gpl-2.0-only"], False)
    for bad in ("", "MIT OR", "(MIT", "MIT )", "AND MIT"):
        with pytest.raises(licenses.ExpressionError):
            licenses.evaluate(bad)


def test_licences(spark, empty, clashing, docs):
    extra = spark.createDataFrame([(900100, "SPDX-License-Identifier: MIT OR Apache-2.0\nx", "en", "a", 1), (900101, "the MIT  License, mit\nlicense and cc-by", "en", "a", 1), (900102, "SPDX-License-Identifier: (MIT", "en", "a", 1)], SCHEMA)
    both = clashing.select(*extra.columns).unionByName(extra).unionByName(docs)
    got = licenses.scan_licenses(both).collect()
    want = []
    for i, t in text_rows(both):
        w = ALNUM.findall(lower(t))
        at = sorted((k, label) for p, label in licenses.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        want.append((i, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=key) == sorted(want, key=key)
    by = {r.doc_id: r for r in got}
    assert by[900100].labels == "apache-2.0,mit" and by[900100].permissive and by[900102].labels == "unparsed" and by[900101].n_base == 3
    assert licenses.scan_licenses(empty).count() == 0


# ---- 4: quality ----


def test_quality(spark, empty, clashing, docs):
    more = {n: F.lit(1) for n in ("n_words", "lost", "kept", "cleaned_text", "_words", "_lines", "_bad", "_text", "base_failed", "whole")}
    both = clashing.select(*docs.columns).unionByName(docs).withColumns(more)
    got = line_quality.clean_lines(both).collect()
    assert len(got) == both.count() and all(r.whole.n_words == r.whole.kept == 1 for r in got)
    for r in got:
        t = r.whole.text or ""
        w = WORD.findall(t)
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        n = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert line_quality.clean_lines(empty).count() == 0
    page = "home | news | about | login\nThis is a sentence that says something about the world and goes on for long enough.\nAll rights reserved\nIt is followed by another one, which is no worse and has as many words."
    one = line_quality.clean_lines(spark.createDataFrame([(1, page)], "doc_id long, text string")).first()
    assert one.kept and one.cleaned_text.split("\n") == [page.split("\n")[1], page.split("\n")[3]]


# ---- 5: toxicity ----


def test_restores_what_is_hidden(spark, docs):
    log = toxicity.LanguageModel(toxicity.language_counts(table(spark, "/root/testdata/sf0.01", "documents"))).log
    for hidden, plain in {"1d10t": "idiot", "i d i o t": "idiot", "s.t.u.p.i.d": "stupid", "stuuuupid": "stupid", "m0r0n": "moron", "tr@sh": "trash"}.items():
        assert toxicity.squeezed(toxicity.restore(hidden, log)) == plain


def test_restore_matches_every_reading(spark):
    """Viterbi over the lattice against all of its readings."""
    rng = np.random.default_rng(5)
    log = np.log(rng.dirichlet(np.ones(27), size=(27, 27)))
    for token in ("1d1", "a-b", "aab", "b00", "@|1", "s.s5", "zz", "4!a", "x"):
        readings = {("", 0.0)}
        for k, ch in enumerate(token):
            plain = "a" <= ch <= "z"
            options = ch if plain else toxicity.LOOKALIKES.get(ch, "")
            cost = 0.0 if plain else toxicity.SUBSTITUTE
            new = set()
            for letters, score in readings:
                a, b = ([0, 0] + [ord(c) - 96 for c in letters])[-2:]
                for option in options:
                    new.add((letters + option, score + cost + log[a, b, ord(option) - 96]))
                if ch in toxicity.SEPARATORS or not options or (k and ch == token[k - 1]):
                    new.add((letters, score + toxicity.DROP))
            readings = new
        ends = {}
        for letters, score in readings:
            a, b = ([0, 0] + [ord(c) - 96 for c in letters])[-2:]
            ends[letters] = max(ends.get(letters, -1e9), score + log[a, b, 0])
        assert toxicity.restore(token, log) == max(ends, key=ends.get)


@pytest.fixture(scope="module")
def trained(spark):
    d = "/root/testdata/sf0.01"
    return toxicity.train(spark, table(spark, d, "documents"), table(spark, d, "labels"))


def test_every_hidden_form_counts(spark, trained):
    log, model = trained
    clean = "the of and to in is on that by for with " * 4
    forms = ["mo-ron", "id.iot", "idioot", "1d1ot", "i.d.i.o.t", "id10t", "tr@sh", "l'idiot", "i d i o t", "£oser", "m,oron", "i\\diot"]
    rows = [(k, clean + x) for k, x in enumerate(forms)] + [(100, clean + "the id-card, a self-made l'ami"), (101, clean)]
    got = {r.doc_id: r.score for r in toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), log, model).collect()}
    assert [forms[k] for k in range(len(forms)) if got[k] < 0.7] == [] and got[100] == got[101] < 0.3


def test_toxicity(spark, odd, empty, clashing):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    log, model = toxicity.train(spark, docs, labels)
    assert {"idiot", "trash", "scum"} <= set(model.weights)
    clean = "the of and to in is on that by for with " * 4
    rows = [(1, clean), (2, clean + "you idiot and moron, stupid loser"), (3, clean + "you 1d10t and m0r0n, s t u p i d l0ser"), (4, None), (5, "")]
    got = {r.doc_id: r.score for r in toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), log, model).collect()}
    assert got[2] >= 0.7 and got[3] >= 0.7 and got[1] < 0.5 and got[4] == got[5] == got[1]
    assert toxicity.score_documents(clashing, log, model).count() == len(ROWS) and toxicity.score_documents(empty, log, model).count() == 0
    _, nothing = toxicity.train(spark, empty, labels.limit(0))
    assert all(r.score < 0.5 for r in toxicity.score_documents(odd, log, nothing).collect())


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    if not table(spark, d, "labels").count():
        pytest.skip("no labels")
    found = toxicity.op5_toxicity(spark, d).join(table(spark, d, "labels"), "doc_id").where("held_out").toPandas()
    assert (found.predicted[found.toxic == 1]).mean() > 0.8 and (found.predicted[found.toxic == 0]).mean() < 0.01


# ---- 6: personal data ----


def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        n = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(n) <= 19 and pii.luhn(n):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]


def test_base_patterns_match_plain():
    rng = random.Random(5)
    for _ in range(3000):
        t = "".join(rng.choice("ab.@_-%+1234567890 ()\né") for _ in range(rng.randrange(60)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_pii(spark, odd, empty, clashing, docs):
    both = clashing.select(*docs.columns).unionByName(docs)
    rows = pii.digest(pii.find(both)).collect()
    want = {}
    for i, t in text_rows(both):
        want.setdefault(i, set()).add(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(t or "")).encode()).hexdigest())
    assert len(rows) == both.count() and all(r.base_sha256 in want[r.doc_id] for r in rows)
    assert pii.find(empty).count() == 0
    more = [(1, "call me at 415-555-2671 or write to bob at corp dot org today"), (2, "in 2019 about 25 people came, 3,000 in all"), (3, 'set token = "cb1a9fee807a05366fcb8b6c95c7c565ede51a72" é x')]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(more, "doc_id long, text string")).collect()}
    assert {s.kind for s in got[1].more} == {"phone", "email"} and not got[2].more and [more[2][1][s.start : s.stop] for s in got[3].more] == ["cb1a9fee807a05366fcb8b6c95c7c565ede51a72"]
    hidden = pii.redact(spark.createDataFrame([(1, "mail a.b@c.de now"), (2, None), (3, "é +1 (415) 555-2671.")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.text for r in hidden] == ["mail <EMAIL> now", None, "é <PHONE>."]


def test_field_labels_are_those_of_whole_texts(docs):
    """Fixing tokens by the bound changes no label, text ends included."""
    field = pii.train()
    more = ["030 / 1234567", "(415) - 555 - 0132", "call 415", "bob at corp dot org", "a - b / c", "", "my card: 4111 1111 1111 1112"]
    words = textcore.Words(pa.array([t for _, t in text_rows(docs)] + more, pa.string()), "space")
    shape, cue = pii.shapes(words), pii.cues(words)
    want = viterbi.decode(field.scores(shape, cue, words.at, np.arange(len(shape))), words.at, field.trans, begin=field.begin)
    places, labels = pii.label_tokens(words, field)
    got = np.zeros(len(shape), dtype=int)
    got[places] = labels
    assert (got == want).all() and (want > 0).any()


def test_long_digit_runs_and_secrets():
    assert pii.base_spans("1" * 5000 + ".1.1.1") == [] and pii.base_spans("0" * 5000 + "7.1.1.255") == [("ip", 0, 5009)] and pii.base_spans("1.2.3.256") == []
    texts = ["password: correcthorsebatterystaple", 'token = "deadbeefcafebabefeedface"', "the key: understanding of the matter", "number 4111111111111112 of them", "visa 4111111111111112 of them"]
    found = [[(k, t[a:b]) for k, a, b in more] for t, _, more in pii.spans_of(pa.array(texts), pii.train())]
    assert found == [[("secret", "correcthorsebatterystaple")], [("secret", "deadbeefcafebabefeedface")], [], [], [("card", "4111111111111112")]]


def test_nothing_found_in_prose(spark):
    """Of the field's spans in the test documents none is prose: each has a digit, or stands behind a cue."""
    texts = [t for _, t in text_rows(table(spark, "/root/testdata/sf0.01", "documents"))]
    more = [(k, t[a:b], t[max(0, a - 40) : a]) for t, _, own in pii.spans_of(pa.array(texts, pa.string()), pii.train()) for k, a, b in own]
    assert len(more) > 5 and all(re.search("[0-9]", x) or pii._SECRET_CUE.search(before) for _, x, before in more) and not any(k == "email" for k, _, _ in more)


def test_numbers_with_lone_connectors():
    texts = ["call (415) - 555 - 0132 now", "card 4111 - 1111 - 1111 - 1112 was charged", "phone 030 / 12345 67 here", "pages 112 - 115 and 200 - 220 of 500 - 600", "they stood at the gate. At. Once"]
    found = [[(k, t[a:b]) for k, a, b in more] for t, _, more in pii.spans_of(pa.array(texts), pii.train())]
    assert found == [[("phone", "(415) - 555 - 0132")], [("card", "4111 - 1111 - 1111 - 1112")], [("phone", "030 / 12345 67")], [], []]


# ---- 7: mix ----


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    total, stopped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        left, w = total - sum(stopped.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 2 * sizes[s]]
        if not over:
            return stopped | {s: left * weight[s] / w for s in free}
        stopped |= {s: 2 * sizes[s] for s in over}


def plain_mix(spark, rows):
    """{(doc_id, size): sorted words taken} by the schedule: slots by golden-ratio points, blocks of each source's shuffled sequence."""
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    targets = plain_targets(sizes)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    some = [s for s in order if targets[s] > 0]
    all_targets = sum(targets.values())
    wanted = {s: max(min(mixing.SLOTS, all_targets) * targets[s] / all_targets, mixing.FEWEST) for s in some}
    total = sum(wanted.values())
    upper, sofar = [], 0.0
    for s in some:
        sofar += wanted[s]
        upper.append(sofar / total)
    points = (np.arange(1, int(-(-total // 1)) + 1) * mixing.GOLDEN) % 1.0
    owner = np.minimum(np.searchsorted(upper, points, "right"), len(some) - 1)
    slots = {s: int((owner == k).sum()) for k, s in enumerate(some)}
    keys = spark.createDataFrame([(i, n) for i, _, n in rows], "d long, n long").select(F.xxhash64(F.lit(7), "d", "n").alias("h")).collect()
    out = []
    for s in order:
        quota = round(targets[s]) if slots.get(s) else 0
        own = sorted(((k.h & (2**64 - 1), i is not None, i or 0, n, i) for k, (i, x, n) in zip(keys, rows, strict=True) if x == s))
        # all slots of a source together are the first ``quota`` words of its sequence, gone through twice
        at = 0
        for *_, n, i in own:
            taken = sum(max(0, min(at + r * sizes[s] + n, quota) - (at + r * sizes[s])) for r in (0, 1))
            out.append((i, n, taken))
            at += n
    return sorted(out, key=str), targets, sizes


@pytest.mark.parametrize("which", ["odd", "small"])
def test_mix(spark, odd, docs, clashing, which):
    data = clashing if which == "odd" else docs
    rows = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in data.collect()]
    want, targets, sizes = plain_mix(spark, rows)
    got = mixing.mix(spark, data).collect()
    assert sorted(((r.doc_id, r["size"], r.taken) for r in got), key=str) == want
    by = {sizes[s]: t for s, t in targets.items()}
    assert len(by) == len(sizes) or which == "odd"
    assert all(abs(r.target - by[r.source_size]) < 1e-6 for r in got) or which == "odd"
    again = sorted(((r.doc_id, r["size"], r.taken) for r in mixing.mix(spark, data.repartition(3), few_sources=1).collect()), key=str)
    assert again == want


def test_mix_of_many_sources(spark):
    """Sources of one word to many: each within a word of its target."""
    words = F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 7 + 1).cast("int")), " ")
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), words.alias("text"), F.concat(F.lit("s"), F.floor(F.sqrt("id") * 8).cast("string")).alias("source"))
    found = mixing.mix(spark, docs).join(docs.select(F.col("doc_id").alias("i"), "source"), F.col("doc_id") == F.col("i"))
    per = found.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") > 2 * F.col("size")).alias("over")).collect()
    assert len(per) > 300 and all(abs(r.taken - r.target) <= 0.5 and not r.over for r in per)
    assert mixing.bucket_bits(0) == 10 and mixing.bucket_bits(10**9) == 18 and mixing.bucket_bits(10**13) == 26


def test_mix_of_nothing(spark, empty):
    assert mixing.mix(spark, empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, "a", 1), (2, "", None, None, 1)], SCHEMA)
    assert [r.taken for r in mixing.mix(spark, blank).collect()] == [0, 0]


def test_mix_takes_small_sources_in_full(spark):
    """A small source beside a large one takes its target, not a multiple of the large one's block."""
    text = lambda n: F.array_join(F.array_repeat(F.lit("w"), n), " ")
    big = spark.range(2000).select(F.col("id").alias("doc_id"), text(5000).alias("text"), F.lit("b").alias("source"))
    small = spark.range(9).select((F.col("id") + 10_000).alias("doc_id"), text(4).alias("text"), F.when(F.col("id") < 8, "a").alias("source"))
    docs = big.unionByName(small)
    rows = mixing.mix(spark, docs).join(docs.select(F.col("doc_id").alias("i"), "source"), F.col("doc_id") == F.col("i")).collect()
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"] and (r.first_slot is None) == (r.taken == 0)
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert set(target) == {"a", "b", None} and all(abs(taken[s] - target[s]) <= 0.5 for s in target), (taken, target)


# ---- 8: repeated passages ----


def plain_repeats(spark, rows):
    """rows in the order that counts: null ids first, then id, then the text's hash."""
    seen, out = set(), []
    order = {t or "": r.h for t, r in zip([t for _, t in rows], spark.createDataFrame([(t or "",) for _, t in rows], "t string").select(F.shiftrightunsigned(F.xxhash64("t"), 1).alias("h")).collect(), strict=True)}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, order[r[1] or ""])):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(g)
        out.append((str(i), len(w), sum(gone), " ".join(x for x, y in zip(w, gone, strict=True) if not y)))
    return sorted(out)


@pytest.mark.parametrize("chars", [1500, 10_000_000])
def test_repeats(spark, empty, clashing, docs, chars):
    both = clashing.select("doc_id", "text", F.lit(1).alias("bucket")).unionByName(docs.select("doc_id", "text", F.lit(1).alias("bucket")))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(both, chars).collect())
    assert got == plain_repeats(spark, text_rows(both))
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_repeats_in_random_texts(spark):
    rng = random.Random(2)
    passages = [[rng.choice("abcd") for _ in range(rng.randrange(5, 60))] for _ in range(8)]
    rows = [(i, " ".join(x for _ in range(rng.randrange(6)) for x in rng.choice(passages) + [rng.choice("efgh")] * rng.randrange(3))) for i in range(120)]
    rows += [(7, t) for _, t in rows[:60]] + [(None, t) for _, t in rows[60:90]]  # an id of many rows, and many null ids
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(df, 1000, 4).collect())
    assert got == plain_repeats(spark, rows)


def test_chunks_at_any_size(spark):
    """What is sent stays in proportion to the input: hashes per row of (chunk, bucket)."""
    for total in (10**7, 10**10, 10**12, 10**13, 10**14):
        n = substring_dedup.n_chunks_of(total)
        buckets = min(substring_dedup.MOST_BUCKETS, max(1, n // 2))
        assert n <= substring_dedup.MOST_CHUNKS and total / n <= 25_000_000 and total / 6.5 / n / buckets > 10
        assert n / buckets * total / 6.5 / n * 5 < 7e8  # bytes of a bucket
    ids = spark.range(5000).select((F.col("id") * F.col("id")).alias("doc_id"), F.lit("x" * 100).alias("text"))
    bounds, nulls, n = substring_dedup.chunk_bounds(ids, 5000, at_once=7)
    rows = np.bincount(np.searchsorted(bounds, np.arange(5000) ** 2), minlength=n)
    assert nulls == 0 and 90 <= n <= 120 and rows.max() < 110


# ---- 9: near duplicates ----


def plain_components(rows, width=3, percent=85):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_family(seed=4, n=140):
    """Copies of a few texts with some words changed: similarities on both sides of the threshold."""
    rng = random.Random(seed)
    bases = [[f"t{b}w{k}" for k in range(150)] for b in range(3)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("block,hubs,percent,width", [(256, 32, 85, 3), (8, 3, 85, 3), (16, 1, 80, 5), (2, 1, 85, 3)])
def test_near_duplicates(spark, docs, block, hubs, percent, width):
    rows = near_family() + [(1000 + i, t) for i, t in text_rows(docs)] + [(5000, None), (5001, ""), (5002, "one"), (5003, "ONE"), (5004, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit(1))
    want = plain_components(rows, width, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, percent, width, block, hubs).collect()}
    assert got == want


def test_loose_clusters(spark):
    """Hundreds of texts that share bands but mostly aren't linked, worked off in blocks by cluster and by band key."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(160)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randrange(2, 16)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components(rows)
    assert 20 < len({c for _, c in want.values()}) < 250
    for block, hubs in ((8, 2), (64, 8)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, 85, 3, block, hubs).collect()}
        assert got == want


def test_near_duplicates_odd_rows(spark, empty, clashing):
    rows = near_dedup.near_duplicates(clashing, 85, 3).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[2].component_id == 1 and not by[2].kept and by[3].component_id == 1 and by[4].kept and by[4].n_shingles == 0
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.drop_near_duplicates(clashing, 85, 3)
    assert kept.columns == clashing.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == sorted({1, 4, 5, 6, 7, 8, 9, 10, 12} | ({11} if by[11].kept else set()))
    assert sum(r.doc_id is None for r in kept.collect()) == 2


def test_unlike_texts_of_one_id(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (1, a), (4, a + " x"), (4, "p q r s t u"), (4, "p q r s t u v w x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for shuffled in (df.repartition(3), df.orderBy(F.desc("text"))):
        got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(shuffled, 85, 3).collect())
        assert got == [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (4, 1, False), (4, 4, True), (4, 4, True)]
        assert sorted(tuple(r) for r in near_dedup.drop_near_duplicates(shuffled, 85, 3).collect()) == [(1, a), (1, b), (4, "p q r s t u"), (4, "p q r s t u v w x y z")]


def test_components_either_way(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(200)] + [(5000, 5001 + k) for k in range(100)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long")
    for few in (0, 10_000):
        assert {r.node: r.label for r in graph.components(df, few).collect()} == want
    assert graph.components(df.limit(0)).count() == 0


def test_bounds_never_prune_what_is_likely():
    need = near_dedup.least_matches(0.85, 1e-6)
    assert near_dedup.banding(85) == (5, 25) and near_dedup.banding(80) == (4, 32)
    assert all(a < b for a, b in zip(need[:-1], need[1:], strict=True)) and need[-1] < 0.85 * 128


# ---- 10: benchmark ----


@pytest.mark.parametrize("limits", [{}, {"hot": 3, "least": 2, "few": 1}])
def test_decontamination(spark, odd, docs, empty, clashing, limits):
    bench = table(spark, DATA, "benchmark").unionByName(spark.createDataFrame([(900, "One, two"), (901, None), (902, "..."), (903, BASE)], "item_id long, text string"))
    items = [(r.item_id, ALNUM.findall(lower(r.text))) for r in bench.collect()]
    windows = {}
    for i, w in items:
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    names = ("items", "row", "hits", "key", "text_", "whole", "matches", "n_words", "shift")
    both = docs.unionByName(clashing.select(*docs.columns)).withColumns({n: F.lit(1) for n in names})
    got = sorted(str((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in decontaminate.digest(decontaminate.contamination(both, bench, **limits)).collect())
    want, clean = [], []
    for i, t in text_rows(both):
        w = ALNUM.findall(lower(t))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        want.append(str((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))))
        if not hit:
            clean.append(str((i, t)))
    assert got == sorted(want) and 0 < len(clean) < len(want)
    left = decontaminate.clean_only(both, bench, **limits)
    assert left.columns == both.columns and sorted(str((r.doc_id, r.text)) for r in left.collect()) == sorted(clean)
    assert decontaminate.contamination(empty, bench).count() == 0 and decontaminate.clean_only(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.digest(decontaminate.contamination(odd, bench.limit(0))).collect())
    assert decontaminate.clean_only(odd, bench.limit(0)).count() == len(ROWS)


def test_bloom(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    f = bloom.build(keys, 5000)
    assert (f.bits == bloom.build(keys, 5000, few=10).bits).all()
    have = np.array([r.k for r in keys.collect()], dtype=np.int64).view(np.uint64)
    other = np.array([r.k for r in spark.range(10_000, 30_000).select(F.xxhash64("id").alias("k")).collect()], dtype=np.int64).view(np.uint64)
    assert f.has(have).all() and f.has(other).mean() < 0.02
    full = bloom.build(keys, 5000, most_bits=1 << 16)
    assert full.has(have).all() and not bloom.build(keys.limit(0), 0).has(have).any()


@pytest.mark.parametrize("limits", [{}, {"hot": 1, "least": 1, "few": 1}])
def test_rows_of_equal_ids_are_judged_alone(spark, limits):
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta eps"), (3, "zeta eta theta iota")], "item_id long, text string")
    rows = [(None, "alpha beta gamma x y"), (None, "a clean text of five"), (None, "now delta eps is here"), (7, "alpha beta gamma delta eps"), (7, "all of this is clean"), (7, "all of this is clean")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontaminate.digest(decontaminate.contamination(df, bench, **limits)).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted([(None, 5, 3, 1), (None, 5, 0, 0), (None, 5, 2, 1), (7, 5, 5, 2), (7, 5, 0, 0), (7, 5, 0, 0)], key=key)
    assert sorted(r.text for r in decontaminate.clean_only(df, bench, **limits).collect()) == sorted(rows[k][1] for k in (1, 4, 5))
