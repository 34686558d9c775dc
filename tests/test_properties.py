"""Properties that hold for any input."""

import numpy as np
from hypothesis import example, given, settings
from hypothesis import strategies as st

from orderweave.operators import dictionary, scoring
from orderweave.sources import export, sheet

WORDS = st.text(alphabet="абв xyz-", max_size=12)
CELL = st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cc", "Cs"]), max_size=20)


@settings(deadline=None, max_examples=200)
@given(WORDS, st.lists(st.text(alphabet="абxy", min_size=1, max_size=4), max_size=6))
def test_terms_do_not_overlap(text, terms):
    terms = sorted(set(terms), key=lambda t: (-len(t), t))
    found = dictionary.find_terms(text, terms)
    assert sum(map(len, found)) <= len(text) and all(t in text for t in found)
    at = 0
    for t in found:  # in text order, one after another
        at = text.index(t, at) + len(t)
    longest = next((t for t in terms if t in text), None)
    assert longest is None or longest in found


@settings(deadline=None, max_examples=100)
@given(st.text(max_size=40), st.integers(1, 128))
def test_vectors_have_unit_length(text, size):
    v = scoring.trigram_vector(text, size)
    assert len(v) == size and abs(np.linalg.norm(v) - 1) < 1e-9


@settings(deadline=None, max_examples=60)
@example([("=1+1", "", 1), ("<&>'\"", "0", 2)])
@given(st.lists(st.tuples(CELL, st.text(alphabet="0123456789", max_size=13), st.integers(1, 999)), max_size=5))
def test_workbooks_give_back_what_went_in(rows):
    book = export.workbook([(i + 1, name, code, n, "c") for i, (name, code, n) in enumerate(rows)], [("rows", len(rows))])
    got = {(r, c): t for r, c, t, _ in sheet.xlsx_cells(book)}
    for i, (name, code, n) in enumerate(rows):
        assert got.get((i + 2, 2), "") == name.strip() and got.get((i + 2, 3), "") == code and got[i + 2, 4] == str(n)
