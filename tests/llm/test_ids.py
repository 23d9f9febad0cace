"""Ids that doubles can't hold stay as they are beside nulls."""

from test_text_operators import rows

from rasterfold.llm import packing, secrets
from rasterfold.llm.registry import TOKENIZER

LARGE = (2**60 + 1, 2**60 + 3)


def test_large_ids_beside_null(spark, make_docs):
    docs = make_docs([(i, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"') for i in (*LARGE, None)])
    assert {r["doc_id"] for r in rows(packing.pack(docs, TOKENIZER))} == {*LARGE, None}
    assert {r["doc_id"] for r in rows(packing.pack(docs, TOKENIZER, with_ids=True))} == {*LARGE, None}
    assert {r["doc_id"] for r in rows(secrets.scan_secrets(docs, secrets.train_forest(spark)))} == {*LARGE, None}


def plain_fit(lengths, capacity, most_open):
    """The packer again, over a plain list of open bins."""
    bins, made, out = [], 0, []
    for n in lengths:
        fitting = [b for b in bins if b[0] >= n]
        if fitting:
            least = min(b[0] for b in fitting)
            chosen = [b for b in fitting if b[0] == least][-1]
            bins.remove(chosen)
        else:
            if len(bins) == most_open:
                least = min(b[0] for b in bins)
                bins.remove([b for b in bins if b[0] == least][-1])
            chosen, made = (capacity, made), made + 1
        out.append((chosen[1], capacity - chosen[0]))
        if chosen[0] > n:
            bins.append((chosen[0] - n, chosen[1]))
    return out


def test_packer_against_a_plain_one():
    import random

    draw = random.Random(1)
    for _ in range(60):
        capacity, most_open = draw.randint(4, 60), draw.randint(1, 6)
        lengths = [draw.randint(1, capacity) for _ in range(draw.randint(0, 300))]
        assert packing.fit(lengths, capacity, most_open) == plain_fit(lengths, capacity, most_open)


def test_ids_of_odd_texts():
    """Word by word the ids are those of whole texts, whatever letters and marks these have."""
    import random
    from array import array

    from tokenizers import Tokenizer

    draw, whole = random.Random(1), Tokenizer.from_file(TOKENIZER)
    texts = ["".join(draw.choice("aAbB éÉßÀµÿŸŒœ .,!?'-12\n\t<|>ΣσςİıK漢😀_") for _ in range(200)) for _ in range(200)]
    texts += ["ÀÉ ÎÖ", "µ Å", "ẞ", "a.B.C", "<|endoftext|> X", "", " ", "\n\n", "ABC!!!", "!!!", "É.", "Hello, WORLD."]
    for text, ids in zip(texts, packing.token_ids(texts, TOKENIZER), strict=True):
        assert ids == array("I", [*whole.encode(text, add_special_tokens=False).ids, packing.END_ID]).tobytes(), text
