"""Files of planes: exact round trips, positions, and ids equal to whole-text encoding."""

import io
import random
import zlib

import numpy as np
import pytest
from corpus_audit.llm import token_planes as P

import public_tokenizers

FILE = public_tokenizers.path("byte_bpe_50k.json")


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("block_ids", [1, 7, 64, 1000])
def test_round_trip(bits, block_ids):
    rng = random.Random(block_ids)
    docs = [(k if k % 5 else None, np.array([rng.choice([0, 2, 255, 50256, 2**32 - 1]) for _ in range(rng.randrange(0, 60))], "<u4").tobytes()) for k in range(40)]
    stream = io.BytesIO()
    writer = P.PlaneWriter(stream, block_ids, bits)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    n = writer.close()
    found = list(P.read_planes(Source(stream.getvalue())))
    assert [(d, ids) for d, _, ids in found] == docs
    starts = np.cumsum([0, *(len(i) // 4 for _, i in docs)])
    assert [s for _, s, _ in found] == starts[:-1].tolist() and n == starts[-1]


def test_empty_file_and_foreign_file():
    stream = io.BytesIO()
    P.PlaneWriter(stream).close()
    assert list(P.read_planes(Source(stream.getvalue()))) == []
    with pytest.raises(ValueError):
        list(P.read_planes(Source(b"x" * 100)))


def test_pieces_equal_whole_texts():
    from tokenizers import Tokenizer

    whole, rng = Tokenizer.from_file(FILE), random.Random(1)
    bits = [" ", " ", "  ", "\n", " \n", "\t", " ", "\u2003", "a", "Word", "don't", "'s", "12", "é", "日本", "🎉", "...", "<|endoftext|>", "x" * 80, "\x1c", "\x85"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(0, 30))) for _ in range(3000)] + ["", " ", "  ", "a ", " a", "a b"]
    encoder = P.WordwiseEncoder(FILE, cached=50)
    for start in range(0, len(texts), 100):
        part = texts[start : start + 100]
        for t, ids in zip(part, encoder.encode(part)):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_awkward_rows(spark, awkward):
    from tokenizers import Tokenizer

    whole, df = Tokenizer.from_file(FILE), awkward()
    want, start = [], 0
    rows = sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for doc_id, text in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    for bits in (False, True):
        got = P.read_ids(P.write_ids(df, FILE, 2, block_ids=100, bits=bits)).selectExpr("doc_id", "start", "n_tokens", "crc32(ids) AS c")
        assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    assert P.read_ids(P.write_ids(df.limit(0), FILE, 2)).count() == 0


def test_pieces_move_between_caches_and_keep_their_ids():
    encoder, rng = P.WordwiseEncoder(FILE, cached=40), random.Random(9)
    words = [f"w{k}" for k in range(60)] + ["é😀", "naïve,", "a\nb", "漢字", "x.", "Straße\nund", "don't"]
    for _ in range(30):
        texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(5)]
        assert encoder.encode(texts) == encoder._ids(texts)
    pieces = ["é", "漢字", "b", "😀x"]
    for lead in " \n":
        assert encoder._ids_of_pieces(pieces, lead) == encoder._ids([lead + p for p in pieces])


class Counted:
    """Counts the characters that a tokenizer gets."""

    def __init__(self, tokenizer):
        self.tokenizer, self.n = tokenizer, 0

    def encode_batch_fast(self, texts, **more):
        self.n += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **more)


LETTERS, MARKS = "abcXYZ\u00e0\u00d6\u00df\u0161\u024f", list(",.;:!?#$%&*()[]{}<>|-_/@~`^=+\"\\") + ["", "...", "?!", "***", ".$$$"]


def plain_words(rng, n):
    return ["".join(rng.choices(LETTERS, k=rng.randrange(1, 12))) + (rng.choice(MARKS) if rng.random() < 0.4 else "") for _ in range(n)]


def test_plain_words_are_encoded_without_the_pattern():
    encoder, rng = P.WordwiseEncoder(FILE, cached=100), random.Random(3)
    texts = ["a" + rng.choice(" \n") + "".join(w + rng.choice("   \n") for w in plain_words(rng, 200)) + "z" for _ in range(40)] + ["a", ""]
    want = encoder._ids(texts)
    encoder.tokenizer = counted = Counted(encoder.tokenizer)
    for start in range(0, len(texts), 6):
        assert encoder.encode(texts[start : start + 6]) == want[start : start + 6]
    assert counted.n == len(texts) - 1  # the first letter of each, which no blank is before


def test_special_tokens_in_plain_words(tmp_path):
    from tokenizers import AddedToken, Tokenizer

    for token in ("###", "abc", "X.", "<|x|>"):
        whole, rng = Tokenizer.from_file(FILE), random.Random(4)
        whole.add_special_tokens([AddedToken(token, normalized=False)])
        whole.save(str(file := tmp_path / "special.json"))
        texts = [" ".join(plain_words(rng, 20) + rng.choices([token, f"a{token}", f"ab{token},"], k=rng.randrange(2)) + ["end"]) for _ in range(60)]
        encoder = P.WordwiseEncoder(str(file))
        assert encoder.encode(texts) == encoder._ids(texts)


def test_known_pieces_are_bounded():
    encoder, rng = P.WordwiseEncoder(FILE, cached=50), random.Random(6)
    for k in range(20):
        texts = [" ".join([f"w{rng.randrange(10**6)}" for _ in range(30)] + ["always", "x" * 500])]
        assert encoder.encode(texts) == encoder._ids(texts)
        assert len(encoder.pieces) == len(encoder.ids) == len(encoder.last) <= 2 * 50 + 32
    assert "always" in encoder.pieces.to_pylist()
    encoder.encode(["end"])
    assert max(map(len, encoder.pieces.to_pylist())) <= P.LONG_PIECE
