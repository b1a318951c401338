import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import op01_bpe as op

SF = "/root/testdata/sf0.001"
FILE = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, FILE.splitlines())}
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OWN = op.codec(FILE, P.PATTERN)


def ids(text):
    return next(iter(OWN.encode([text.encode()])))[0].tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeinst  \n'0é")), max_size=80))
def test_like_tiktoken(text):
    assert ids(text) == TIKTOKEN.encode_ordinary(text)
    assert OWN.decode(np.array(ids(text))) == text.encode()


def test_long_pieces_and_forgetting(monkeypatch):
    for text in ("a" * 3000, "antidisestablishment" * 40, " " * 999 + "x", "é" * 400, "=" * 257, "<|endoftext|>"):
        assert ids(text) == TIKTOKEN.encode_ordinary(text)
        assert OWN.merge_long(text.encode()).tolist() == op.np.concatenate(OWN.merge([text.encode()], len(text.encode()))).tolist()
    monkeypatch.setattr(op, "REMEMBERED", 1)
    assert ids("again and again") == TIKTOKEN.encode_ordinary("again and again")


def test_whole_table(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in op.op1_bpe(spark, SF).collect():
        want = TIKTOKEN.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), sha(" ".join(map(str, want)).encode()), sha(texts[r.doc_id].encode()))


def test_nulls_and_round_trip(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (2, "", 6), (None, "hé llo", 7)], "doc_id long, text string, ids int")
    back = op.decode(op.encode(docs)).orderBy("doc_id").collect()
    assert [bytes(r.decoded).decode() for r in back] == ["hé llo", "", "", ""]
    assert op.digests(docs.limit(0)).count() == 0
    assert op.digests(docs).where("n_tokens = 0").count() == 3
