"""One document of each component stays, with ids null or repeated."""

from collections import Counter

from test_text_operators import rows

from rasterfold.llm import simhash

A, B, C = ("".join(f"{w}{i} " for i in range(30)) for w in ("river", "stone", "cloud"))


def texts(docs):
    return Counter((r["doc_id"], r["text"]) for r in rows(simhash.one_of_each(docs)))


def test_unlike_texts_without_ids_stay(make_docs):
    assert texts(make_docs([(None, A), (None, B), (None, C), (None, C), (None, None), (None, "")])).keys() >= {(None, A), (None, B), (None, C)}
    assert texts(make_docs([(None, A), (None, B), (None, C), (None, C)])) == {(None, A): 1, (None, B): 1, (None, C): 1}


def test_copies_without_ids_go(make_docs):
    assert texts(make_docs([(1, A), (None, A.upper()), (None, B)])) == {(1, A): 1, (None, B): 1}


def test_unlike_texts_that_share_an_id_stay(make_docs):
    assert texts(make_docs([(1, A), (1, B), (2, B), (1, A.upper() + " "), (3, C), (3, C)])) == {(1, A.upper() + " "): 1, (1, B): 1, (3, C): 1}
