"""Token counts against the library, over signs of all Unicode and over texts that merge badly."""

import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from deskloom.llm import token_counts

from .conftest import prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    return lambda text: len(made.encode(text, add_special_tokens=False).ids)


def test_every_sign_in_every_surrounding(library):
    count = token_counts.counter(PATH).count
    signs = [*range(0x3000), *range(0x3000, 0x110000, 61), 0x1C89, 0xA7CB, 0x105C0, 0x558, 0x10EC5]
    signs = [chr(code) for code in signs if not 0xD800 <= code < 0xE000]
    for at in range(0, len(signs), 40):
        text = "".join(f"a{s}1{s}!{s} {s}{s}'{s}" for s in signs[at : at + 40])
        assert count(text) == library(text), text


def test_random_texts(library):
    count = token_counts.counter(PATH).count
    pick = random.Random(5)
    parts = ["'s", "'re", "'LL", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "a", "the", "Z9", "é", "中", "<|endoftext|>", "<|endof", "aaaa", "...", "​"]
    for _ in range(3000):
        text = "".join(pick.choice(parts) for _ in range(pick.randrange(40)))
        assert count(text) == library(text), repr(text)


def test_windows_cut_no_piece(library, monkeypatch):
    counter = token_counts.counter(PATH)
    text = prose(1, 3000) + "  \n  " + prose(2, 50).replace(" ", "  ") + "x" * 500
    monkeypatch.setattr(token_counts, "WINDOW", 37)
    assert "".join(token_counts.windows(text, 37)) == text
    assert counter.count(text) == library(text)


def test_long_piece_is_not_quadratic(library):
    started = time.process_time()
    assert token_counts.counter(PATH).count("ab" * 100_000) == library("ab" * 100_000)
    assert time.process_time() - started < 30


def test_remembered_counts_are_dropped(monkeypatch, library):
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    counter = token_counts.Counter(PATH)
    assert [counter.count(prose(i, 30)) for i in range(5)] == [library(prose(i, 30)) for i in range(5)]


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="no plain byte-level"):
        token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))


def test_query(docs, query, library):
    rows = [(0, None), (1, ""), (2, "Grüße, 中文! <|endoftext|> it's"), (3, prose(4, 5000)), (3, "x"), (None, " \n ")]
    found = query("op11_token_counts", documents=docs(rows))
    told = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found)
    counted = [(str(i), len((text or "").encode()), library(text or "")) for i, text in rows]
    assert told == sorted((*row, row[2] > 512) for row in counted)
