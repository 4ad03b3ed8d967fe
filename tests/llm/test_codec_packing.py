import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from scorelens.llm.packing import Pool, best_fill, encoding, pack, token_ids
from scorelens.llm.piece_codec import PieceEncoder, encode_texts
from scorelens.llm.queries import op3_piece_codec, op7_packing

from conftest import SF

MODEL = P.path("piece_bpe_32k.model")
RANKS = P.path("byte_bpe_50k.tiktoken")
TEXTS = ["", " ", "a", "a  b", "▁▁x ▁", "tab\tnew\nline\n", "x" * 5000, "日本語のテキスト", "é ﬁ ① 　 \xa0",
         "\U0001F600 grin", "<s> </s> <unk> <0x41>", "a\x00b", " trailing ", "\n\n  \n", "ab" * 900 + " c"]


def test_agenda_equals_library():
    enc, lib = PieceEncoder(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("abceinrst ▁\n.é") for _ in range(rng.randrange(60))) for _ in range(400)]
    for t, (ids, back, agrees) in zip(texts, enc.batch(texts), strict=True):
        want = lib.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert agrees, t
        assert back == lib.decode(want)


def test_agenda_alone_equals_library_on_words():
    enc, lib = PieceEncoder(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(4)
    for _ in range(500):
        w = "".join(rng.choice("theaniorsé1.") for _ in range(rng.randrange(1, 30)))
        assert np.frombuffer(enc.segment("▁" + w), "<u4").tolist() == lib.encode(w)


def test_codec_query_equals_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op3_piece_codec(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = lib.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.agrees) == (len(ids), True)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_codec_odd_rows(spark, odd_docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted((str(r.doc_id), bytes(r.ids), r.decoded) for r in encode_texts(odd_docs, MODEL).collect())
    want = sorted((str(r.doc_id), np.array(lib.encode(r.text or "", add_bos=True, add_eos=True), "<u4").tobytes(),
                   lib.decode(lib.encode(r.text or "", add_bos=True, add_eos=True))) for r in odd_docs.collect())
    assert got == want
    assert encode_texts(odd_docs.limit(0), MODEL).count() == 0


def test_token_ids_equal_the_tokenizers_library():
    tk, enc = Tokenizer.from_file(P.path("byte_bpe_50k.json")), encoding(RANKS)
    for t in [*TEXTS, "a<|endoftext|> b", "don't we'll  1234 ...!!", "\r\n\t x"]:
        assert token_ids(enc, t, 1).tolist() == [*tk.encode(t, add_special_tokens=False).ids, 1], t


def test_best_fill_is_closest_to_capacity():
    rng = random.Random(5)
    for _ in range(300):
        room = rng.randrange(1, 40)
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(0, 6))}
        sums = {0}
        for size, c in counts.items():
            sums = {s + k * size for s in sums for k in range(c + 1) if s + k * size <= room}
        got = best_fill(sorted(counts, reverse=True), counts, room)
        assert sum(s * k for s, k in got) == max(sums)
        assert all(0 < k <= counts[s] for s, k in got)


def check_packed(rows, tokens, capacity):
    """Every token once, gapless sequences of at most ``capacity``, padded to it unless a power of two."""
    per_doc, per_seq = {}, {}
    for r in rows:
        per_doc.setdefault(r["doc_id"], []).append(r)
        per_seq.setdefault(r["sequence_id"], []).append(r)
    for seq in per_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == capacity or at & (at - 1) == 0
    for doc, ids in tokens.items():
        at = 0
        for r in sorted(per_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert set(per_doc) == set(tokens)


def test_packing_query(spark):
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    tokens = {r.doc_id: [*tk.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs}
    check_packed([r.asDict() for r in op7_packing(spark, SF).collect()], tokens, 2048)


def test_packing_odd_rows(spark, odd_docs):
    rows = pack(odd_docs, RANKS).collect()
    enc = encoding(RANKS)
    assert sum(r.length for r in rows) == sum(len(token_ids(enc, r.text or "", 1)) for r in odd_docs.collect())
    assert {r.length for r in rows if r.doc_id == 3} == {1}
    assert sum(r.length for r in rows if r.doc_id == 7) == len(token_ids(enc, "word " * 30000, 1))
    assert pack(odd_docs.limit(0), RANKS).count() == 0


@pytest.mark.parametrize("capacity", [8, 64])
def test_pool_keeps_every_token(capacity):
    rng = random.Random(6)
    pool, total = Pool(capacity), 0
    for d in range(300):
        n = rng.randrange(0, capacity)
        total += n
        pool.add(((d, n), 0, np.arange(n)))
    windows = list(pool.windows(0))
    assert all(sum(len(p[2]) for p in w) == capacity for w in windows)
    rest = [sum(len(p[2]) for p in w) for w in pool.rest()]
    assert all(n & (n - 1) == 0 for n in rest)
    assert sum(rest) + capacity * len(windows) == total
