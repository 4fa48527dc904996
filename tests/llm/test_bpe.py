import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from quietlake.llm import bpe

from .helpers import awkward, empty


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.rank_path()), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(bpe.rank_path())


def encoded(codec, texts):
    """ids and decoded bytes of each text."""
    values, sizes = codec.encode(pa.array(texts))
    data, lengths = codec.decode(values, sizes)
    split = lambda x, n: np.split(x, np.cumsum(n)[:-1])
    return [(i.tolist(), d.tobytes()) for i, d in zip(split(values, sizes), split(data, lengths))]


def test_perfect_hash(codec):
    assert len(codec.whole.keys) == len(codec.ranks) and None not in codec.whole.keys
    assert all(codec.whole.get(k) == v for k, v in codec.ranks.items())
    assert codec.whole.get(b"no such token at all") == -1


def test_small_perfect_hashes():
    for n in range(0, 40):
        keys = [f"k{i}".encode() for i in range(n)]
        h = bpe.PerfectHash(keys, list(range(n)))
        assert [h.get(k) for k in keys] == list(range(n)) and h.get(b"other") == -1


def test_random_texts(codec, reference):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdeéß 'ts\n\t \x1c\x1f.-9日🙂S") for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "\n\nx", "it's I'LL 's", "x" * 5000, "<|endoftext|> a"]
    texts += ["Ende. Été, naïve.\nx. ", "a.b c., d,\n.e", "a\r b", "it. 's I,'ll", *("".join(rng.choice("aZé., \n'") for _ in range(20)) for _ in range(1500))]
    for t, (ids, back) in zip(texts, encoded(codec, texts)):
        assert ids == reference.encode_ordinary(t)
        assert back == t.encode()


def test_every_character_as_a_separator(codec, reference):
    texts = [f"a{chr(c)}b {chr(c)} c" for c in [*range(0x300), *range(0x1680, 0x1690), *range(0x2000, 0x2070), 0x3000, 0xFEFF]]
    for t, (ids, _) in zip(texts, encoded(codec, texts)):
        assert ids == reference.encode_ordinary(t)


def test_whole_table(spark, data, reference):
    import hashlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = bpe.op6_two_tier_bpe(spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = reference.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_awkward_rows(spark):
    both = bpe.encode(awkward(spark), decoded=True).collect()
    assert len(both) == 9 and {bytes(r.ids) for r in both if r.doc_id in (1, 2)} == {b""}
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(awkward(spark))).collect()}
    assert back[7].decode() == "ÄÖ ß 日本語 🙂 é"
    assert bpe.encode(empty(spark)).count() == 0


def test_memo_forgets_but_stays_right(reference):
    c = bpe.Codec(bpe.rank_path())
    c.memo.capacity = 3
    for i in range(30):
        t = [f"alpha beta{i} gamma{i % 4} delta"]
        assert encoded(c, t)[0][0] == reference.encode_ordinary(t[0])
    assert len(c.memo) <= 8
