import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from redline.llm import bpe

PATH, PATTERN = bpe.public_vocabulary()


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Tokenizer(f.read(), PATTERN)


def ids(runs):
    return [int(i) for i in b",".join(runs).split(b",") if i]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list(" \t\n'sdmthe.,!1é"))), max_size=40), max_size=5))
def test_equals_the_library(library, own, texts):
    got = own.encode(texts)
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [ids(g) for g in got] == [w.ids for w in want]
    assert [own.decode(g) for g in got] == [library.decode(w.ids, skip_special_tokens=False) for w in want]


def test_special_long_and_empty(library, own):
    texts = ["", "<|endoftext|>", "a <|endoftext|><|endoftext|> b", "z" * 3000, "né" * 900, "the " * 2000, " " * 999, "ab" * 40]
    for text, runs in zip(texts, own.encode(texts), strict=True):
        assert ids(runs) == library.encode(text, add_special_tokens=False).ids
        assert own.decode(runs) == library.decode(ids(runs), skip_special_tokens=False)


def test_table(spark, awkward, empty, small, library):
    for docs in (awkward, small):
        rows = bpe.query(docs).collect()
        texts = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.collect()), key=str)
        want = []
        for _, doc_id, text in texts:
            e = library.encode(text, add_special_tokens=False).ids
            back = library.decode(e, skip_special_tokens=False)
            want.append((doc_id, len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want)
    assert bpe.query(empty).collect() == []
    got = bpe.encode_documents(awkward, PATH, PATTERN, with_ids=True).collect()
    assert all(len(r.ids) == r.n_tokens for r in got)
