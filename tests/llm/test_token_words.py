"""Operator 3: each distinct word is encoded once, whatever its case and the marks after it, and texts
are encoded many at a time, with the library's result."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest

from fotolith.llm import queries, token_files


@pytest.fixture(scope="module")
def encoder():
    return token_files.Encoder(queries.vocabulary())


def same(encoder, texts):
    half = len(texts) // 2
    columns = list(encoder.columns([pa.array(t, pa.string()) for t in (texts[:half], texts[half:])], 2))
    ids, sizes = (np.concatenate(x) for x in zip(*columns))
    assert [len(n) for _, n in columns] == [half, len(texts) - half]
    want = [[*e.ids, 2] for e in encoder.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_words_are_shared_and_simple_pieces_not_taken_apart_by_the_library(monkeypatch):
    encoder = token_files.Encoder(queries.vocabulary())
    asked, encoded = [], []
    monkeypatch.setattr(encoder, "words", lambda p: asked.append(p) or token_files.Encoder.words(encoder, p))
    monkeypatch.setattr(encoder.kept, "encode", lambda words: encoded.extend(words) or encoder.encode_all(words))
    same(encoder, ["Zebra### ZEBRA. zebra*** (Zebra) it's", "Été!### été"])
    assert asked == ["(Zebra)", "it's"]
    assert sorted(encoded) == sorted(["zebra", "###", ".", "***", "(", ")", "it", "'s", *encoder.in_symbols(pa.array(["été"], pa.large_string())).to_pylist(), "!###"])


def test_any_text_is_encoded_as_by_the_library(encoder):
    rs = random.Random(5)
    some = ["a", "B", "É", "ß", "ÿ", "×", "ª", "µ", "İ", "Σ", "한", "1", "½", "'", "'s", "’", ".", "#", "-", "<", "<|endoftext|>", "<|ENDOFTEXT|>", "endoftext", "́", "̸", " ", "\u0085", "​", "　", " ", "\n", "\x1c", "\x00", "\x7f", "😀", "ſ", "K", "ﬁ", "Ǆ"]
    same(encoder, [None, "", " \n", " ", *("".join(rs.choices(some, k=rs.randrange(12))) for _ in range(5000))])
    same(encoder, ["".join(rs.choices(encoder.LETTERS + encoder.MARKS * 2 + "'  ", k=rs.randrange(20))) for _ in range(5000)])
    same(encoder, [])


def test_a_special_token_of_letters_or_marks_stays_whole(tmp_path):
    spec = json.load(open(queries.vocabulary(), encoding="utf-8"))
    spec["added_tokens"].append({**spec["added_tokens"][0], "content": "zebra"})
    path = tmp_path / "more.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    encoder = token_files.Encoder(str(path))
    same(encoder, ["zebra Zebra zebras! ok", "a zebra."])
    assert [ids.tolist() for ids, _ in encoder.columns([pa.array(["zebra"])], None)][0] == [encoder.library.token_to_id("zebra")]


def test_batches_are_encoded_together(encoder, monkeypatch):
    rows = [pa.RecordBatch.from_pydict({"key": [k], "text": pa.array([t], pa.string())}) for k, t in enumerate(["abc", None, "", "defgh", "i" * 30, "j", "k"])]
    got = [[b.column("key")[0].as_py() for b in some] for some in token_files.gathered(iter(rows), "text", 8)]
    assert got == [[0, 1, 2, 3], [4], [5, 6]] and list(token_files.gathered(iter([]), "text", 8)) == []
    asked = []
    monkeypatch.setattr(encoder, "encode_pieces", lambda p: asked.append(p.to_pylist()) or token_files.Encoder.encode_pieces(encoder, p))
    list(encoder.columns([pa.array(["a b", "c a"]), pa.array(["b d"])], 2))
    monkeypatch.setattr(token_files, "PIECE_BYTES", 3)
    same(encoder, ["a b", "cd a", "e fgh"])
    assert asked == [["a", "b", "c", "d"], ["a", "b"], ["cd", "e"], ["fgh"]]


@pytest.mark.parametrize("size", [0, 1, 65_535, 65_536, 200_001])
def test_dealing_keeps_the_order(size):
    one = np.random.default_rng(size).random(size) < 0.3
    zeros = size - int(one.sum())
    out = np.full(size, -1)
    for at, low, high in token_files.dealing(one, zeros):
        out[low.to], out[high.to] = at + low.places, at + high.places
    assert out.tolist() == [*np.flatnonzero(~one), *np.flatnonzero(one)]
