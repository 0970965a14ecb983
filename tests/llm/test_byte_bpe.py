import random

import edge
import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import byte_bpe as b

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def vocabulary():
    with open(b.vocabulary_path(), "rb") as f:
        return b.Vocabulary(f.read())


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def check(vocabulary, reference, texts):
    counts, ids, offsets = vocabulary.encode_batch(texts)
    at = 0
    for text, n in zip(texts, counts.tolist()):
        assert ids[at : at + n].tolist() == reference.encode_ordinary(text), text
        at += n
    sizes, data = vocabulary.decode_batch(counts, ids, offsets)
    at = 0
    for text, n in zip(texts, sizes.tolist()):
        assert data[at : at + n].tobytes() == text.encode()
        at += n


def test_awkward_texts(vocabulary, reference):
    random.seed(1)
    letters = list("abstmdrevlSTA'' \n\t  ''12²½é中🙂!?. 　\u0085 ​́_٣Ⅷ\x1c\x00")
    texts = ["".join(random.choices(letters, k=random.choice([0, 1, 2, 3, 5, 9, 30, 200]))) for _ in range(3000)]
    check(vocabulary, reference, [*texts, "a" * 5000, "ab" * 3000, " " * 3000 + "x", "'" * 1000, "é" * 700, "x'll've's", "", "\0", "it's 'tis ''re '' s"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_text(vocabulary, reference, texts):
    check(vocabulary, reference, texts)


def test_blocks_do_not_matter(vocabulary, reference, monkeypatch):
    monkeypatch.setattr(b, "BLOCK", 7)
    monkeypatch.setattr(b, "WIDTH", 3)
    check(vocabulary, reference, ["it's  a\n\n test of 'll  blocks   ", "", "   ", "x're"])


def test_small_cache(reference, monkeypatch):
    monkeypatch.setattr(b, "CACHE_PIECES", 6)
    with open(b.vocabulary_path(), "rb") as f:
        check(b.Vocabulary(f.read()), reference, ["the the of the and of the cat sat on the mat of the cat " * 3])


def test_functions_compose():
    t = b.COMPOSE.astype(int)
    n = len(t)
    x, y, z = np.meshgrid(*[np.arange(n)] * 3, indexing="ij")
    assert (t[t[x, y], z] == t[x, t[y, z]]).all()


def test_long_pieces_merge_alike(vocabulary):
    piece = b"abracadabra" * 12
    assert b._merge_long(piece, vocabulary.ranks) == b.merge(piece, vocabulary.ranks)


def test_edge_rows(spark, reference):
    docs = edge.documents(spark)
    tokens = b.encode(docs, b.vocabulary_path())
    assert tokens.columns == [*docs.columns, "_ids", "_offsets"]
    got = b.decode(tokens, b.vocabulary_path(), "_ids", "_offsets").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["_ids"] == reference.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
        assert len(r["_ids"]) == len(r["_offsets"]) and r.ids == "x"


def test_query(spark, sf, reference):
    import hashlib

    sha = lambda x: hashlib.sha256(x).hexdigest()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = b.op1_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(texts[r.doc_id].encode()))
