import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from quietlake.llm import sentence_bpe

from .helpers import awkward, documents, empty


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentence_bpe.model_path())


@pytest.fixture(scope="module")
def codec():
    return sentence_bpe.codec(sentence_bpe.model_path())


def encoded(codec, texts):
    """ids and decoded bytes of each text."""
    values, sizes = codec.encode(pa.array(texts, pa.string()))
    data, lengths = codec.decode(values, sizes)
    split = lambda x, n: np.split(x, np.cumsum(n)[:-1])
    return [(i.tolist(), d.tobytes()) for i, d in zip(split(values, sizes), split(data, lengths))]


def same(codec, library, texts):
    for t, (ids, back) in zip(texts, encoded(codec, texts)):
        expected = library.encode(t, add_bos=True, add_eos=True)
        assert ids == expected, repr(t)
        assert back == library.decode(expected).encode(), repr(t)


def test_random_texts(codec, library):
    rng = random.Random(3)
    for letters in ("abcdeéß 'ts\n\t \x1c.-9日🙂S▁", "aeinrst ", "ab", "  \n▁x", "日本語的一是 中。", "01289.,", "<0x41>s/unk "):
        same(codec, library, ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(800)])


def test_edges(codec, library):
    texts = ["", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "\n\nx", "▁", "▁▁a▁", "<s> a</s><unk><0x41>", "\x00a\x00", "é é", "x" * 5000, "ab" * 3000, "日本" * 2000]
    same(codec, library, texts)
    same(codec, library, [" " * n + w for n in [*range(1, 70), 500, 4000] for w in ("", "a", "\nb", "▁", "日", "\t", "the")])


def test_long_word_of_random_letters(codec, library):
    rng = random.Random(5)
    same(codec, library, ["".join(rng.choice("etaoinshrdlu") for _ in range(20_000)), "".join(rng.choice("etaoinshrdlu        ") for _ in range(60_000))])


def test_rounds_without_cuts(library, monkeypatch):
    """The rounds alone, without the cuts inside words, give the library's ids too."""
    c = sentence_bpe.Codec(sentence_bpe.model_path())
    monkeypatch.setattr(c, "_cut", lambda points, sizes: sizes)
    rng = random.Random(7)
    same(c, library, ["".join(rng.choice("aeinrstl \n.") for _ in range(rng.randint(0, 200))) for _ in range(300)] + [" " * 90, "x" + " " * 77 + "y"])


def test_decode_of_any_ids(codec, library):
    rng = random.Random(9)
    lists = [[rng.choice([0, 1, 2, 28705, 264, 3, rng.randint(3, 258), rng.randint(259, 31999)]) for _ in range(rng.randint(0, 12))] for _ in range(3000)]
    counts = np.array([len(x) for x in lists])
    data, sizes = codec.decode(np.array([i for x in lists for i in x], "<u4"), counts)
    for x, d in zip(lists, np.split(data, np.cumsum(sizes)[:-1])):
        assert d.tobytes() == library.decode(x).encode(), x


def test_memo_forgets_but_stays_right(library):
    c = sentence_bpe.Codec(sentence_bpe.model_path())
    c.memo.capacity = 3
    for i in range(30):
        same(c, library, [f"alpha beta{i} gamma{i % 4}  delta"])
    assert len(c.memo) <= 8


def test_whole_table(spark, data, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = sentence_bpe.op11_piece_rounds(spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_awkward_rows(spark):
    both = sentence_bpe.encode(awkward(spark), decoded=True).collect()
    assert len(both) == 9 and {np.frombuffer(r.ids, "<u4").tolist().__repr__() for r in both if r.doc_id in (1, 2)} == {"[1, 2]"}
    back = {r.doc_id: bytes(r.decoded) for r in sentence_bpe.decode(sentence_bpe.encode(awkward(spark))).collect()}
    assert all(back[r.doc_id].decode() == (r.text or "") for r in awkward(spark).collect())
    assert sentence_bpe.encode(empty(spark)).count() == 0
    clash = documents(spark, [(1, "a b")]).withColumnsRenamed({"fp": "ids", "key": "decoded"})
    assert sentence_bpe.encode(clash, decoded=True).columns == ["doc_id", "ids", "decoded"]
