"""A worker that turns to another operator keeps nothing of the vocabulary."""

import weakref

from fotolith.llm import bpe, queries


def test_a_vocabulary_is_forgotten():
    kept = weakref.ref(bpe.loaded(queries.vocabulary()))
    bpe.forget()
    assert kept() is None and not bpe._loaded
    assert len(bpe.loaded(queries.vocabulary()).ids) > 40_000
