import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from quietlake.llm import packing

from .helpers import PROSE, awkward, documents, empty


def check(rows, docs, length):
    """Every id in exactly one piece; sequences gapless and full but for the last."""
    t = Tokenizer.from_file(packing.tokenizer_path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[d], key=lambda r: r.start)
        assert [i for r in pieces for i in r.ids] == ids
        at = 0
        for r in pieces:
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
    last = max(by_seq)
    for s in range(last + 1):
        at = 0
        for r in sorted(by_seq[s], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length if s < last else at <= length


def test_pieces(spark):
    docs = [(i, f"{PROSE} Number {i}, it's ÉCOLE's “quote” 日本 {'word ' * (i * 13 % 90)}") for i in range(60)] + [(99, None), (98, "")]
    for length in (64, 2048):
        check(packing.pack(documents(spark, docs), length=length).collect(), docs, length)


def test_whole_table_against_the_library(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    check(packing.pack(spark.read.parquet(f"{data}/documents.parquet")).collect(), docs, 2048)


def test_awkward_rows(spark):
    rows = packing.pack(awkward(spark)).collect()
    assert sum(r.length for r in rows if r.doc_id == 6) == 2 * rows[[r.doc_id for r in rows].index(6)].doc_tokens
    assert {r.doc_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert packing.pack(empty(spark)).count() == 0
    assert "ids" not in packing.pack(empty(spark), ids=False).columns


def test_words_equal_whole_texts():
    e, t = packing.Encoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    texts = ["a\x01b c \x01", "<|endoftext|> x", "\tq w e\x1cz", "é ́x", "ΣΑΣ ΣΣ", "", " ", "\n\n a  b \n", "I'LL don't", "１２３ ½ Ⅷ", None]
    texts += ["Ångström's ÉCOLE, naïve. Größe\nfür. ªb ºc µm ÿ Ÿ ß ẞ İ ı", "b. c, d.e ,f .g. h.. i., j", "x" * 31 + " " + "y" * 32 + " " + "ñ" * 70]
    rng = random.Random(8)
    texts += ["".join(rng.choice("abzÀÉßñÿªº.,'’ \n09-\u0301İſK中") for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    values, sizes = e.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(values, np.cumsum(sizes)[:-1])] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
