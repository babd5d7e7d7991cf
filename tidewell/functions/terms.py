"""Which of many terms a text holds, by one automaton over all of them and one pass over the text."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_automata: dict[tuple[str, ...], object] = {}


def _automaton(terms: tuple[str, ...]):
    """This process's automaton: a term leads to its length and the numbers of all terms that are spelled so."""
    if terms not in _automata:
        import ahocorasick

        a, numbers = ahocorasick.Automaton(), {}
        for i, t in enumerate(terms):
            numbers.setdefault(t, []).append(i)
        for t, own in numbers.items():
            if t:
                a.add_word(t, (len(t), own))
        if len(a):
            a.make_automaton()
        _automata[terms] = a
    return _automata[terms]


def numbers_in(text: str | None, terms: tuple[str, ...], whole_word: bool = False) -> list[int]:
    """The numbers of the terms in a text, ascending; an empty term is in any text but a null."""
    a = _automaton(terms)
    if text is None:
        return []
    found = {i for i, t in enumerate(terms) if not t}
    if len(a):
        for end, (n, own) in a.iter(text):
            if not whole_word or not (text[end - n : end - n + 1].isalnum() and end >= n) and not text[end + 1 : end + 2].isalnum():
                found.update(own)
    return sorted(found)


def numbers_of(texts: pa.Array, terms: tuple[str, ...], whole_word: bool = False) -> pa.Array:
    """The numbers of the terms in each text of a batch.

    One text at a time becomes a Python string, which has four bytes a
    character if it has an emoji; equal texts are read once.
    """
    coded = texts.dictionary_encode(null_encoding="encode")
    return pa.array([numbers_in(t.as_py(), terms, whole_word) for t in coded.dictionary], pa.list_(pa.int32())).take(coded.indices)


def term_numbers(text: Column, terms: Iterable[str], whole_word: bool = False) -> Column:
    """The numbers, from 0 and ascending, of the lower-case terms that a text holds, ignoring case; none for a null."""
    listed = tuple(terms)

    @F.arrow_udf("array<int>")
    def hits(texts: pa.Array) -> pa.Array:
        return numbers_of(texts, listed, whole_word)

    return hits(F.lower(text))


def term_names(numbers: Column, terms: Iterable[str]) -> Column:
    """The terms of these numbers."""
    named = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    return F.transform(numbers, lambda i: F.get(named, i))
