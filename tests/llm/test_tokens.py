import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from slotwise.llm.packing import Packer, pack
from slotwise.llm.token_files import read_token_files, token_digests, write_token_files
from slotwise.llm.tokens import Encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  a", "a  b ", "a \n b", "x.\ny", "It's, we'll. 'Tis", "!!, .. a_, b", "ÀÉ é , J̌ İx Σας",
    "​foo bar", "tab\tx\n\n\ny z", "don't.' \"q\", 3.14, 5,\nnew", "a\0b \0 c", "<|endoftext|> x", "Word <|endoftext|>, <|pad|> [UNK] <unk>x", "<|ENDOFTEXT|> b", "日本語 テスト. 한글, ok",
    "a b c", "\x1cq \x1d.", "word́ x", "SHOUT!! IT!!",
]


def plain(path, text, end):
    t = Tokenizer.from_file(path)
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_the_tokenizer(path):
    random.seed(5)
    signs = list("abcDÉ ß.,!'_ \n\t123日é​\0")
    texts = ODD + ["".join(random.choice(signs) for _ in range(random.randint(1, 60))) for _ in range(1500)]
    reference = Tokenizer.from_file(path)
    small = Encoder(path, cache=40)
    for text, ids in zip(texts, small.ids(texts), strict=True):
        assert list(np.frombuffer(ids, "<u4")) == reference.encode(text, add_special_tokens=False).ids, ascii(text)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_texts_encoded_together_look_each_piece_up_once(path):
    random.seed(6)
    signs = list("abcDÉ ß.,!'_ \n\t123日é\u200b\0")
    texts = [*ODD, *["".join(random.choice(signs) for _ in range(random.randint(0, 60))) for _ in range(600)], *["some words here"] * 300]
    encoder = Encoder(path, cache=40)
    want = [encoder.encode(t) for t in texts]
    for a, b in [(0, len(texts)), (len(texts) - 300, len(texts)), (0, 1), (0, 0)]:
        ids, counts = encoder.joined(texts[a:b])
        assert [x.tobytes() for x in np.split(ids, np.cumsum(counts))[:-1]] == want[a:b]
    looked = []

    class Watched(type(encoder.known)):
        def __getitem__(self, piece):
            looked.append(piece)
            return super().__getitem__(piece)

    encoder.known = Watched(encoder.tokenizer, encoder.spaced, 40)
    encoder.joined(["some words here"] * 300)
    assert len(looked) == 3


def test_token_files(spark, parquet_of, edges, tmp_path):
    docs = parquet_of([*edges, *ODD], first=5)
    path = str(tmp_path / "tokens")
    write_token_files(docs, path, WORD, parts=3)
    rows = sorted(token_digests(read_token_files(spark, path)).collect())
    start = 0
    for row, (i, text) in zip(rows, enumerate([*edges, *ODD]), strict=True):
        ids = plain(WORD, text, 2)
        assert tuple(row) == (5 + i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    plan = read_token_files(spark, path).where("doc_id = 7").select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,7)" in plan and "ids" not in plan.split("ReadSchema")[-1]


def test_token_files_repeated_and_null_ids(spark, tmp_path):
    docs = spark.createDataFrame([(None, "b"), (2, "x y"), (2, "x y"), (1, None)], "doc_id long, text string")
    path = str(tmp_path / "tokens")
    write_token_files(docs, path, WORD, parts=2)
    rows = read_token_files(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 2]
    assert [r["start"] for r in rows] == list(np.cumsum([0, *[len(r["ids"]) for r in rows]])[:-1])
    empty = str(tmp_path / "empty")
    write_token_files(docs.limit(0), empty, WORD)
    assert read_token_files(spark, empty).count() == 0


def check_packing(rows, want, size):
    seen = {}
    for r in rows:
        ids = list(np.frombuffer(r["ids"], "<u4"))
        assert len(ids) == r["length"] > 0
        seen.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
    for doc_id, ids in want.items():
        pieces = sorted(seen.pop(doc_id))
        assert [x for _, own, _ in pieces for x in own] == ids
        assert {n for _, _, n in pieces} == {len(ids)}
        assert [s for s, _, _ in pieces] == list(np.cumsum([0, *[len(own) for _, own, _ in pieces]])[:-1])
    assert not seen
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    sizes = []
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        sizes.append(at)
    assert max(sizes) <= size and sum(s < size for s in sizes) <= 1


def test_packing(spark, docs_of, edges, monkeypatch):
    import slotwise.llm.packing as p

    monkeypatch.setattr(p, "FAN", 2)  # several rounds of merging
    texts = [*edges, *ODD, *["few words here " * k for k in range(60)]]
    docs = docs_of(texts).repartition(7)
    rows = pack(docs, BYTE, size=64, windows=3).collect()
    check_packing(rows, {i: plain(BYTE, t, 1) for i, t in enumerate(texts)}, 64)
    assert pack(docs.limit(0), BYTE).count() == 0


def test_packer_keeps_a_fixed_number_of_windows_open():
    done = []
    packer = Packer(10, 2, done.append)
    for i, n in enumerate([6, 7, 3, 5, 9, 1, 1, 8]):
        packer.add(i, 0, n, np.arange(n, dtype="<u4").tobytes())
        assert len(packer.open) <= 2
    assert [p[0] for p in done[0]] == [1, 2]  # the piece of three goes where it fits best
    packer.drain()
    assert sum(len(p[3]) // 4 for window in done for p in window) == 40
