import random

import pytest
from tests.llm.conftest import ODD

from blockloom.llm.token_count import count_texts, pieces, token_counts

public = pytest.importorskip("public_tokenizers")
MODEL = public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=MODEL)


def test_equals_the_library_on_random_texts(library):
    rng = random.Random(1)
    vocabulary = list(pieces(MODEL).ids)
    alphabet = "   abehin tT==--..__\n\t▁éñ執①日本😀aaaa0123<s>\x00 "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(800)]
    texts += ["".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25))) for _ in range(800)]
    texts += ["".join(rng.choice("abn= ") * rng.randint(1, 40) for _ in range(rng.randint(0, 6))) for _ in range(400)]
    texts += [" " * n for n in range(300)] + ["a" + " " * n + "the" for n in range(300)]
    assert count_texts(texts, MODEL, {}) == [len(x) for x in library.encode(texts)]


def test_frame(spark, docs_of, library):
    got = {(r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(docs_of(ODD), MODEL).collect()}
    assert got == {(d, len((t or "").encode()), len(library.encode(t or ""))) for d, t, _ in ODD}
    assert token_counts(docs_of([]), MODEL).collect() == []
