"""Byte-level BPE against the library that defines it and against merging step by step."""
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lexloom.llm import byte_bpe
from lexloom.llm.byte_bpe import ByteBpe, PerfectHash, read_ranks


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe()


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(read_ranks()),
                             special_tokens={})


def ids_of(bpe, text):
    data = b"".join(bpe.encode(text))
    return [int.from_bytes(data[i:i + 4], "little") for i in range(0, len(data), 4)]


ODD = ["", " ", "\n", "it's we'll I'M", "a  b   c ", "\t\n x", "x\x1cy\x85z\xa0w q", "été Đặng 日本語 👩‍👩‍👧", "é",
       "123 4567", "<|endoftext|>", "!!!???", "a" * 5000, " " * 5000, "ab" * 3000 + "  " * 3000 + "z", "\0\x01",
       "\U0010fffd", "don't'll've", "'S 's"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(bpe, library, text):
    ids = ids_of(bpe, text)
    assert ids == library.encode_ordinary(text)
    assert bpe.decode(b"".join(bpe.encode(text))) == text.encode()


def test_code_points(bpe, library):
    for c in [*range(0x3100), *range(0x3100, 0x110000, 257)]:
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}b {chr(c)}"
            assert ids_of(bpe, text) == library.encode_ordinary(text), hex(c)


def test_stretches_do_not_show(bpe, library, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab1 \n\t'é!", [5, 5, 2, 6, 2, 1, 1, 2, 2], k=400)) for _ in range(200)]
    for stretch in (1, 7, 64):
        monkeypatch.setattr(byte_bpe, "STRETCH", stretch)
        for text in texts:
            assert "".join(text[a:b] for a, b in bpe.stretches(text)) == text
            assert ids_of(bpe, text) == library.encode_ordinary(text)


def plain_merge(piece, ranks):
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 60:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_merging_step_by_step(bpe):
    rng, ranks = random.Random(6), dict(read_ranks())
    for _ in range(500):
        piece = bytes(rng.choices(b"abetn\xc3\xa9 \n", k=rng.randint(1, 40)))
        assert bpe.merge(piece) == plain_merge(piece, ranks)


def test_perfect_hash():
    rng = random.Random(7)
    for n in (0, 1, 2, 3, 10, 1000):
        keys = list({rng.randbytes(rng.randint(0, 6)) for _ in range(n)})
        table = PerfectHash(keys)
        assert sorted(table.numbers) == list(range(len(keys)))            # minimal: every slot is taken
        assert [table.find(k) for k in keys] == list(range(len(keys)))
        assert all(table.find(rng.randbytes(9)) == -1 for _ in range(100))
    with pytest.raises(ValueError):
        PerfectHash([b"a", b"a"])


def rows(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select(
        "*", *[F.lit(1).alias(c) for c in ("id", "ids", "n_tokens")])


def test_tables(spark, library):
    texts = [None, "", "one two", "one two", "Zwei  Wörter\n", "x" * 3000]
    df = rows(spark, *texts).unionByName(rows(spark, "no id").withColumn("doc_id", F.lit(None).cast("long")))
    got = {(r[0], r[1], r[2], r[3]) for r in byte_bpe.round_trip(df).collect()}
    want = set()
    for i, t in [*enumerate(texts), (None, "no id")]:
        ids = library.encode_ordinary(t or "")
        data = b"".join(x.to_bytes(4, "little") for x in ids)
        want.add((i, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    encoded = byte_bpe.encode_texts(df)
    assert encoded.columns == ["doc_id", "ids"]
    back = {r[0]: bytes(r[1]).decode() for r in byte_bpe.decode_ids(encoded).collect()}
    assert back == {**{i: t or "" for i, t in enumerate(texts)}, None: "no id"}


def test_no_rows(spark):
    df = rows(spark, "a").limit(0)
    assert byte_bpe.round_trip(df).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert byte_bpe.round_trip(df).count() == byte_bpe.encode_texts(df).count() == 0
