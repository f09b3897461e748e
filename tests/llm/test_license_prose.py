"""Expressions that prose goes on behind."""

import pytest

from squall.llm import licenses


@pytest.mark.parametrize("text,names,free", [
    ("MIT and not allowed", ["mit"], True), ("MIT or later we saw", ["mit"], True), ("GPL-2.0-only or else", ["gpl-2.0-only"], False), ("MIT AND Apache-2.0 and so on", ["apache-2.0", "mit"], True),
    ("(MIT OR GPL-3.0-only) and the rest", ["gpl-3.0-only", "mit"], True), ("GPL-2.0-only WITH Classpath-exception-2.0 with thanks", ["gpl-2.0-only"], False), ("MIT or ISC", ["isc", "mit"], True),
    ("MIT or (BSD-3-Clause and LGPL-2.1)", ["bsd-3-clause", "lgpl-2.1", "mit"], True), ("MIT or LicenseRef-own", ["licenseref-own", "mit"], True), ("MIT see below", ["mit"], True),
])
def test_prose_is_no_licence(text, names, free):
    assert licenses.evaluate(text) == (names, free)


@pytest.mark.parametrize("text", ["", " ", "MIT OR", "MIT and or ISC", "(MIT and more", "AND MIT", "MIT or )"])
def test_broken_expressions(text):
    with pytest.raises(licenses.ExpressionError):
        licenses.evaluate(text)
