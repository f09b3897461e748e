"""Many spans in one long text."""

import time

import pyarrow as pa

from squall.llm import pii


def overlapping(spans, taken):
    return [s for s in spans if not any(s[1] < y and x < s[2] for _, x, y in taken)]


def test_long_text_with_many_spans():
    """Spans stand where their pieces do, and the time grows with the text, not with its square."""
    field = pii.train()
    piece = 'Ünï mail me at a{k}@example.org now. token = "Zx9Q8w7E6r5T4y3U2i1O{k:06d}" — fin.\n'
    took = {}
    for n in (300, 3000):
        text = "".join(piece.format(k=k) for k in range(n))
        began = time.process_time()
        (_, base, more), = pii.spans_of(pa.array([text]), field)
        took[n] = time.process_time() - began
        assert [text[a:b] for kind, a, b in base if kind == "email"] == [f"a{k}@example.org" for k in range(n)]
        secrets = [text[a:b] for kind, a, b in more if kind == "secret"]
        assert len(secrets) == n and all(f"Zx9Q8w7E6r5T4y3U2i1O{k:06d}" in s for k, s in enumerate(secrets))
        assert overlapping(more, base) == more
    assert took[3000] < 40 * took[300] + 1


def test_spans_that_touch_base_spans():
    text = "write ab@cd.ef and 1.2.3.4 — ünï +49 170 1234567 end"
    raw = text.encode()
    taken = [("email", 6, 14), ("ip", 19, 26), ("phone", 33, 48)]
    at = lambda a, b: (len(text[:a].encode()), len(text[:b].encode()))
    for a in range(len(text)):
        for b in range(a + 9, min(len(text), a + 22)):
            spans = [(pii.LABELS.index("secret"), *at(a, b))]
            got = pii.field_spans(text, raw, spans, taken)
            assert got == overlapping(pii.field_spans(text, raw, spans, []), taken)
