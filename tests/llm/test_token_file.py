"""The token file's random access and its checksums."""

import io

import numpy as np
import pyarrow as pa
import pytest

from termloom.llm import token_output
from termloom.llm.token_output import _PLAIN, FOOTER, Reader, Writer, encoder, gathered, plain_pieces


@pytest.fixture
def documents():
    return [np.arange(i * i % 37 + (i == 5) * 5000, dtype="<u4") + i for i in range(50)]


@pytest.fixture
def data(documents):
    sink = io.BytesIO()
    out = Writer(sink, frame_tokens=100)
    for ids in documents:
        out.add(ids.tobytes())
    out.close()
    return sink.getvalue()


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        self.taken += n
        return super().read(n)


def test_chosen_documents_alone_are_unpacked(data, documents):
    source = Counting(data)
    reader = Reader(source, len(data))
    assert len(reader.frames) > 5
    asked = []
    whole = reader.frame
    reader.frame = lambda k: asked.append(k) or whole(k)
    before = source.taken
    found = dict(reader.documents([49, 20, 20, 0]))
    assert set(found) == {0, 20, 49} and all((found[k] == documents[k]).all() for k in found)
    assert len(asked) == len(set(asked)) <= 3
    assert source.taken - before == sum(int(reader.frames[k]["size"]) for k in asked)
    assert all((ids == documents[k]).all() for k, ids in Reader(io.BytesIO(data), len(data)).documents())


def test_damage_is_found(data):
    reader = Reader(io.BytesIO(data), len(data))
    at = int(reader.frames[3]["offset"]) + 5
    torn = bytearray(data)
    torn[at] ^= 1
    bad = Reader(io.BytesIO(bytes(torn)), len(torn))
    assert len(bad.frame(2)) and len(bad.frame(4))
    with pytest.raises(ValueError, match="frame 3"):
        bad.frame(3)
    torn = bytearray(data)
    torn[-FOOTER.size - 2] ^= 1
    with pytest.raises(ValueError, match="seek table"):
        Reader(io.BytesIO(bytes(torn)), len(torn))
    with pytest.raises(ValueError, match="not a token file"):
        Reader(io.BytesIO(data[:-1]), len(data) - 1)
    empty = io.BytesIO()
    Writer(empty).close()
    assert list(Reader(empty, len(empty.getvalue())).documents()) == []


def test_pieces_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(token_output.default_tokenizer()), encoder(token_output.default_tokenizer())
    texts = ["", " ", "a b", " a  b\n", "x\n\ny", "été\x85日本 語　z", "it's 5kg,\tno", "word " * 500, "a\r\nb", "\x1cq", "one\ntwo three\nfour"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_of_rare_words_are_learned_together(monkeypatch):
    """Rare words cost a call for many of them, not for each, and a full memory keeps what is in use."""
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(token_output.default_tokenizer()), token_output.PieceEncoder(token_output.default_tokenizer())
    calls = []

    class Counted:
        def encode_batch_fast(self, texts, **more):
            calls.extend(texts)
            return tokenizer.encode_batch_fast(texts, **more)

    monkeypatch.setattr(own, "tokenizer", Counted())
    monkeypatch.setattr(own, "LIMIT", 3000)
    random = np.random.default_rng(7)
    words = ["".join(map(chr, random.choice([*range(97, 123), 233, 0x4E2D, 39, 46], 7))) for _ in range(5000)]
    odd = ["é\u3000中 x", "“a” b", "a\u0085 b", "a\u2003 b c", "a <|endoftext|> b<|endoftext|>\nc", "\n", "x\u1680 y", "a \x1fb"]
    for texts in ([" ".join(words[i : i + 50]) for i in range(0, 5000, 50)], odd, [" ".join(words[:2500]), "\n".join(words[:9]), *odd]):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) < 400


def test_known_pieces_are_arrays_and_those_used_last_stay(monkeypatch):
    """A known piece costs no call and no object, and a full memory loses what has not been used for longest."""
    own = token_output.PieceEncoder(token_output.default_tokenizer())
    random = np.random.default_rng(3)
    words = sorted({"".join(map(chr, random.integers(97, 123, 7))) for _ in range(20_000)})
    first = own.encode(["x", " ".join(["x", *words])])
    assert len(own.known) == len(own.known_ids) == len(words) + 1
    assert own.known.nbytes + own.known_ids.nbytes < 60 * len(words)
    learned = []
    monkeypatch.setattr(own, "learn", lambda new, learn=own.learn: learned.extend(new.to_pylist()) or learn(new))
    assert own.encode(["x", " ".join(["x", *words])]) == first and not learned
    monkeypatch.setattr(own, "LIMIT", 3000)
    own.encode([" ".join(["x", *words[:2000]])])
    own.encode([" ".join(["x", *words[-500:]])])
    learned.clear()
    own.encode([" ".join(["x", *words[:2000], *words[-500:]])])
    assert not learned
    own.encode([" ".join(["x", *words[5000:8000]]), " ".join(words[:2])])
    assert len(own.known) == 3000 and len(learned) == 3001


def test_plain_pieces_are_those_of_the_pattern():
    pieces = ["", " ", " a", "a", " a b", "\n", " é", " “a”", " a\u0085", " \u3000", " a\u2003b", " 日本", " \x1f", "  a", " \u1680", " à"]
    for some in (pieces, pieces[:0], pieces[2:3]):
        array = pa.array(some, pa.large_string())
        assert plain_pieces(array).tolist() == [bool(_PLAIN(x)) for x in some]
    assert plain_pieces(pa.array(pieces, pa.large_string())[3:9]).tolist() == [bool(_PLAIN(x)) for x in pieces[3:9]]


def test_batches_are_gathered_whole_and_in_order():
    batches = [pa.RecordBatch.from_pydict({"text": [str(i)] * i}) for i in range(1, 40)]
    out = list(gathered(batches, 300))
    assert [x for b in out for x in b["text"].to_pylist()] == [str(i) for i in range(40) for _ in range(i)]
    assert 1 < len(out) < 40 and list(gathered([], 300)) == []


def test_rows_without_id_come_first(spark, sf_of):
    rows = [(2, "b b"), (None, "n"), (1, None), (1, "a"), (None, "")]
    out = token_output.op4_token_output(spark, sf_of(documents=spark.createDataFrame(rows, "doc_id bigint, text string"))).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [None, None, 1, 1, 2]
    assert [r["start"] for r in out] == [0, *np.cumsum([r["n_tokens"] for r in out])[:-1]]
