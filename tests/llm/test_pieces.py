import hashlib
import random

import pytest

from condeval.llm import pieces
from condeval.llm.queries import piece_file

PATH = piece_file()
DDL = "doc_id bigint, text string, n_tokens string, key string"
TEXTS = [
    None, "", " ", "  \n", "Hello, WORLD  don't 123", "<s>a</s><unk> <0x0A>", "▁▁ a▁b", "é́ ñß t². x²,　",
    "汉字 한국 😀👍🏽 \x00\x1c\x85\xa0 �", "x" * 3000, " " * 999, "word, " * 20_000, "汉字" * 4000,
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def segmenter(model):
    return pieces.Segmenter(model)


def test_random_texts(library, segmenter):
    pick = random.Random(4)
    pool = "abcde theing éñß▁  \t\n\x85\xa0汉字！!?.,'́😀0129<0x0A></s>\r﻿"
    names = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.get_piece_size())]
    texts = ["".join(pick.choice(pool) for _ in range(pick.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(pick.choice(names) for _ in range(pick.randint(0, 25))) for _ in range(8000)]
    texts += ["".join(chr(pick.choice([pick.randrange(1, 0xD800), pick.randrange(32, 300)])) for _ in range(30)) for _ in range(3000)]
    for text, chunks in zip(texts, segmenter.chunked(texts), strict=True):
        found, decoded = segmenter.joined(chunks)
        ids = library.encode(text, add_eos=True)
        assert found == " ".join(map(str, ids)), repr(text)
        assert decoded == segmenter.decode(ids) == library.decode(ids), repr(text)


def test_chunks_concatenate_to_the_marked_text(segmenter):
    for text in filter(None, TEXTS):
        assert "".join(segmenter.marked_chunks(text)) == "▁" + text.replace(" ", "▁")


def test_columns_and_queue_agree(library, segmenter):
    """Short chunks are segmented as columns, long ones by a queue: the same ids at any length."""
    pick = random.Random(5)
    chunks = ["▁" * pick.randint(0, 3) + "".join(pick.choice("abceinstérlou'-") for _ in range(pick.randint(1, 60))) for _ in range(2000)]
    segmenter.add(chunks)
    assert [segmenter.table[c][0] for c in chunks] == [" ".join(map(str, segmenter.long_chunk_ids(c))) for c in chunks]


def test_the_table_is_bounded(model, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_CHARS", 50)
    fresh = pieces.Segmenter(model)
    texts = [f"word{i} again" for i in range(40)]
    first = [fresh.encode(t) for t in texts]
    assert first == [fresh.encode(t) for t in texts] and len(fresh.table) < 20


def test_each_distinct_chunk_is_segmented_once(model, monkeypatch):
    fresh, seen = pieces.Segmenter(model), []
    whole = fresh.segmented
    monkeypatch.setattr(fresh, "segmented", lambda chunks: seen.extend(chunks) or whole(chunks))
    list(fresh.chunked(["a b, a b", "b a\nb"] * 50))
    assert sorted(seen) == sorted(["▁a", "▁b", ",", "\n", "b"])


def _message(*fields):
    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    out = b""
    for number, value in fields:
        out += varint(number << 3 | (0 if isinstance(value, int) else 2)) + (varint(value) if isinstance(value, int) else varint(len(value)) + value)
    return out


@pytest.mark.parametrize(
    "names, trainer, normalizer, says",
    [
        (["a▁"], [(3, 2)], [(4, 0)], "cross"),
        (["a"], [(3, 1)], [(4, 0)], "BPE"),
        (["a"], [(3, 2)], [(2, b"table"), (4, 0)], "leave texts"),
        (["a"], [(3, 2)], [(4, 1)], "leave texts"),
        (["a"], [(3, 2)], [(4, 0)], "byte"),
    ],
)
def test_models_it_refuses(names, trainer, normalizer, says):
    listed = [(1, _message((1, n.encode()))) for n in names]
    with pytest.raises(ValueError, match=says):
        pieces.Segmenter(_message(*listed, (2, _message(*trainer)), (3, _message(*normalizer))))


def test_operators(spark, library):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", "y"), (None, "a b", "x", "y")]
    table = spark.createDataFrame(rows, DDL)
    encoded = pieces.encoded(table, PATH)
    decoded = {(r.doc_id, r.text) for r in pieces.decoded(encoded, PATH).collect()}
    got = sorted(map(str, pieces.round_trip_digests(table, PATH).collect()))
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want, texts = [], set()
    for key, text, *_ in rows:
        ids = library.encode(text or "", add_eos=True)
        texts.add((key, library.decode(ids)))
        want.append(
            f"Row(doc_id={key}, n_tokens={len(ids)}, ids_sha256='{sha(' '.join(map(str, ids)))}', decoded_sha256='{sha(library.decode(ids))}')"
        )
    assert got == sorted(want) and decoded == texts
    assert pieces.round_trip_digests(table.limit(0), PATH).count() == 0
