"""Encoding, token counts and packing against the vocabularies' own libraries."""

import hashlib
import random
import struct
import zlib

import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from codestrata.llm import bpe, packing, pretok, token_counts, vocab
from tests.llm import util


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("plain", pat_str=pretok.PATTERN, mergeable_ranks=vocab.load_ranks(vocab.default_path("byte_bpe_50k.tiktoken")), special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocab.default_path("byte_bpe_50k.json"))


def test_split_is_the_pattern():
    random.seed(1)
    rx = regex.compile(pretok.PATTERN)
    alphabet = " \n\t'strevlmdSab1２.,é 中\u0378👍\u0085\x1c"
    for _ in range(200):
        texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 40))) for _ in range(10)]
        w = pretok.split(texts)
        assert [[w.big[w.starts[k] : w.ends[k]] for k in range(a, b)] for a, b in zip(w.offsets, w.offsets[1:], strict=False)] == [rx.findall(t) for t in texts]


def test_cut_keeps_the_matches():
    random.seed(2)
    rx = regex.compile(pretok.PATTERN)
    for _ in range(100):
        text = "".join(random.choice("ab's  \n.1") for _ in range(random.randint(0, 200)))
        pieces = list(pretok.cut(text, 10))
        assert "".join(pieces) == text
        assert [m for p in pieces for m in rx.findall(p)] == rx.findall(text)


def test_json_and_ranks_are_the_same_vocabulary():
    assert vocab.load_json_ranks(vocab.default_path("byte_bpe_50k.json")) == vocab.load_ranks(vocab.default_path("byte_bpe_50k.tiktoken"))


def test_encode_decode_round_trip(spark, sf, plain):
    texts = util.texts(spark, sf)
    rows = bpe.digests(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_encode_awkward_rows_in_small_chunks(spark, plain):
    for chunk in (10, 10_000_000):
        got = bpe.decode(bpe.encode(util.awkward(spark), chunk_chars=chunk)).collect()
        expected = [(i, plain.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in util.AWKWARD]
        assert sorted((str(r.id), list(r.ids), bytes(r.decoded)) for r in got) == sorted((str(a), b, c) for a, b, c in expected)
    assert bpe.decode(bpe.encode(util.empty(spark))).count() == 0


def test_unknown_id_is_an_error(spark):
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [60000])], "id long, ids array<int>")).collect()


@pytest.mark.parametrize("chunk, overlap", [(1 << 16, 1 << 10), (64, 4), (50, 1)])
def test_token_counts(spark, sf, library, chunk, overlap):
    texts = util.texts(spark, sf)
    texts = dict(list(texts.items())[:60]) if chunk < 100 else texts
    rows = [(i, t) for i, t in texts.items()] + [(r[0], r[1]) for r in util.AWKWARD]
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), chunk_chars=chunk, overlap=overlap).collect()
    expected = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert token_counts.count_tokens(util.empty(spark)).count() == 0


def test_spliced_where_no_boundary_is_in_the_overlap(library):
    store = pretok.WordIds(vocab.word_encoder(vocab.load_json_ranks(vocab.default_path("byte_bpe_50k.json"))))

    def encode(piece):
        words = pretok.split([piece])
        at = store.look_up(words)
        return words.starts, store.sizes[at]

    random.seed(3)
    for _ in range(200):
        text = "".join(random.choice(["a" * random.randint(1, 90), " " * random.randint(1, 60), "'re", "'", "\n", "1", ".", "é"]) for _ in range(random.randint(1, 60)))
        assert token_counts.spliced(text, encode, 40, 3) == len(library.encode(text, add_special_tokens=False).ids)


def check_pieces(rows, ids_of, limits=packing.Limits()):
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, own in by.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            ids = ids_of[doc]
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids_of[doc])
    padding = total = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= limits.tokens and len(own) <= limits.segments
        total += at
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    return padding / max(total, 1)


def test_packing(spark, sf, library):
    texts = util.texts(spark, sf)
    rows = packing.pieces(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert check_pieces(rows, {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}) < 0.001


def test_packing_awkward_rows(spark, library):
    rows = [(i if i is not None else -1, t) for i, t, _ in util.AWKWARD]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    got = packing.pieces(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {k for k, _ in rows}
    check_pieces(got, {k: [*library.encode(t or "", add_special_tokens=False).ids, 1] for k, t in rows})
    assert packing.pieces(util.empty(spark)).count() == 0


def test_vector_limits_hold_and_examples_stay_whole(spark):
    random.seed(4)
    rows = [(k, n := random.randint(0, 300), random.randint(0, n)) for k in range(500)]
    limits = packing.Limits(512, 5, 300)
    got = packing.pack_examples(spark.createDataFrame(rows, "id long, tokens long, loss long"), "id", "tokens", "loss", limits).collect()
    of = {r[0]: r for r in rows}
    assert sorted(r.id for r in got) == sorted(r[0] for r in rows if r[1])
    sequences = {}
    for r in got:
        assert r.length == of[r.id][1]
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= 512 and len(own) <= 5 and sum(min(of[r.id][2], r.length) for r in own) <= 300
    least = max(sum(r[1] for r in rows) / 512, sum(r[2] for r in rows) / 300, sum(r[1] > 0 for r in rows) / 5)
    assert len(sequences) < 1.35 * least


def test_an_example_that_fits_nowhere_is_an_error(spark):
    with pytest.raises(Exception, match="fits no sequence"):
        packing.pack_examples(spark.createDataFrame([(1, 5000, 1)], "id long, t long, l long"), "id", "t", "l").collect()


def _changing(frames):
    for frame in frames:
        yield frame.assign(text=[f"{t} w{random.SystemRandom().random()}" for t in frame.text])


def test_rows_that_change_between_readings_are_an_error(spark):
    rows = spark.createDataFrame([(k, "a b") for k in range(50)], "doc_id long, text string")
    with pytest.raises(Exception, match="write it before encoding"):
        bpe.encode(rows.mapInPandas(_changing, rows.schema)).collect()


def test_examples_that_fit_nowhere_have_rows_with_a_reason(spark):
    rows = [(1, 5000, 1), (2, 0, 0), (3, None, 7), (4, 100, 90), (5, 100, None), (6, 100, 10), (None, 20, 5), (7, 20, 900)]
    got = packing.place_examples(spark.createDataFrame(rows, "id long, t long, l long"), "id", "t", "l", packing.Limits(512, 5, 50)).collect()
    assert sorted((r.id or 0, r.reason) for r in got if r.reason) == [(1, "tokens"), (2, "empty"), (3, "empty"), (4, "loss")]
    assert all((r.sequence_id is None) == (r.offset is None) == (r.reason is not None) for r in got)
    assert sorted(r.id or 0 for r in got if r.reason is None) == [0, 5, 6, 7]


def test_conversations_are_packed_by_three_limits(spark, sf, library):
    table = spark.read.parquet(f"{sf.replace("sf0.001", "sf0.01")}/conversations.parquet")
    turns = [(r.conv_id, r.role, r.text) for r in table.collect()] + [(-1, None, "no one says this"), (-1, "assistant", None), (-2, "assistant", "word " * 4000)]
    rows = spark.createDataFrame([(c, r, t, "x") for c, r, t in turns], "conv_id long, role string, text string, n_tokens string")
    expected = {}
    for conv, role, text in turns:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        tokens, loss = expected.get(conv, (0, 0))
        expected[conv] = tokens + n, loss + n * (role == "assistant")
    examples = packing.conversation_examples(rows)
    assert {r.conv_id: (r.tokens, r.loss) for r in examples.collect()} == expected
    limits = packing.Limits(4096, 8, 1500)
    placed = packing.place_examples(examples, "conv_id", "tokens", "loss", limits).collect()
    assert sorted(r.id for r in placed) == sorted(expected) and [r.reason for r in placed if r.id == -2] == ["loss"]
    sequences = {}
    for r in placed:
        if r.reason is None:
            assert r.length == expected[r.id][0]
            sequences.setdefault(r.sequence_id, []).append(r)
    sums = [(sum(r.length for r in own), len(own), sum(expected[r.id][1] for r in own)) for own in sequences.values()]
    assert all(a <= 4096 and b <= 8 and c <= 1500 for a, b, c in sums)
    assert any(own[0] != own[1] for own in expected.values())
    assert any(c > 1200 and a < 3500 and b < 8 for a, b, c in sums)  # the loss limit alone fills some


def test_a_shared_folder_is_asked_for(spark, monkeypatch):
    from codestrata.llm import common

    class Cluster:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})

    class Session:
        conf = {}
        sparkContext = Cluster()

    with pytest.raises(ValueError, match="shares"):
        common.shared_dir(Session())
