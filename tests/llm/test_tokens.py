import base64

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import tokens

DATA = open(tokens.VOCABULARY, "rb").read()
MINE = tokens.Encoder(DATA)
THEIRS = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())}, special_tokens={})
TEXTS = ["", " ", "Hello world", "<|endoftext|>", "aaaaaaaaaaa", "  \n\n x\t", "没有空格的一长串文字", "😀👩‍🔬", "it's we'll I'D", "x" * 3000, "ab" * 2000, "0123456789" * 300, "\x00\x01"]


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_public_library(text):
    assert MINE.encode(text) == THEIRS.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert MINE.encode(text) == THEIRS.encode_ordinary(text)
    assert b"".join(MINE.tokens[t] for t in MINE.encode(text)) == text.encode()


def test_queue_gives_ranks_in_order():
    q = tokens.RankQueue(50_256)
    for rank, at in [(70, 1), (3, 2), (50_000, 3), (70, 0), (4_096, 5)]:
        q.push(rank, at)
    out = []
    while q.top:
        out.append(q.pop())
    assert out == [(3, [2]), (70, [1, 0]), (4_096, [5]), (50_000, [3])]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    small = tokens.Encoder(DATA)
    for t in TEXTS:
        assert small.encode(t) == THEIRS.encode_ordinary(t)
    assert len(small.known) <= 3 and len(small.pairs) <= 3


def test_table(spark):
    rows = [(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "word", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids)) for r in tokens.encoded(docs).collect()), key=str)
    assert got == sorted([(1, THEIRS.encode_ordinary("a b")), (2, []), (3, []), (3, []), (None, THEIRS.encode_ordinary("word"))], key=str)
    assert tokens.encoded(docs).schema["ids"].dataType.simpleString() == "array<int>"
    assert tokens.encoded(docs.limit(0)).count() == 0
    assert sorted((r.doc_id, r.n_tokens) for r in tokens.token_counts(docs.where("doc_id = 1")).collect()) == [(1, 2)]
