import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from packaudit.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def blob(spark):
    return pieces.read_model(spark, PATH)


def texts():
    rng = random.Random(4)
    yield from ["", " ", "  a  b ", "▁x ▁▁ y", "a" * 300 + " " * 200, "<s> <0x0A> </s> <unk>", "\n\n\t", "é́", "1234567 ...,,,!!!", "ＡＢ①　ｶﾞ ﷺ ½ Ǆ İ", "  ﬁ ſ 　x "]
    for _ in range(400):
        yield "".join(rng.choice(' ▁ab1.,é\n日🎉"the ingＡ①') for _ in range(rng.randint(0, 80)))


def test_ids_and_spans_equal_the_library(blob):
    own = pieces.Pieces(blob)
    for text in texts():
        (ids, edges), = own.encode([text])
        want = LIBRARY.encode(text, return_type="proto").pieces
        data = text.encode()
        assert ids.tolist() == [p.id for p in want]
        assert [data[a:b].decode() for a, b in zip(edges[:-1], edges[1:])] == [p.surface for p in want]
        assert own.read([text])[0][2] == LIBRARY.decode(ids.tolist())


def test_words_are_read_like_whole_texts(blob, monkeypatch):
    """Single-spaced texts, read together and with a full memory, against the library."""
    monkeypatch.setattr(pieces, "CACHE_WORDS", 300)
    own, rng = pieces.Pieces(blob), random.Random(9)
    for _ in range(30):
        block = [" ".join("".join(rng.choice("abthein.,\n0é日🎉") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 30))) for _ in range(20)]
        block += ["one", "the end ", "a\nb", "plain words only here", ""]
        for text, (ids, edges, back) in zip(block, own.read(block)):
            want, data = LIBRARY.encode(text, return_type="proto").pieces, text.encode()
            assert ids.tolist() == [p.id for p in want] and back == LIBRARY.decode(ids.tolist())
            assert [data[a:b].decode() for a, b in zip(edges[:-1], edges[1:])] == [p.surface for p in want]


@pytest.mark.parametrize("rule", ["nmt_nfkc_cf", "nfkc", "nmt_nfkc"])
@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
def test_compiled_maps(blob, rule, squeeze, prefix):
    model, rules = proto.ModelProto(), proto.ModelProto()
    model.ParseFromString(blob)
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    model.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.add_dummy_prefix = squeeze, prefix
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString()), pieces.Pieces(model.SerializeToString())
    for text in texts():
        (ids, edges), = own.encode([text])
        want, data = library.encode(text, return_type="proto").pieces, text.encode()
        assert ids.tolist() == [p.id for p in want], text
        assert [data[a:b].decode() for a, b in zip(edges[:-1], edges[1:])] == [p.surface for p in want]


def test_round_trip_over_files(spark, blob, package_files, hard_rows):
    files = package_files(hard_rows)
    tokens = pieces.encode(files, blob)
    assert tokens.columns == ["path", "ids", "starts", "ends"]
    got = sorted((r["path"] or "", r["content"]) for r in pieces.decode(tokens, blob).collect())
    assert got == sorted((p or "", LIBRARY.decode(LIBRARY.encode(c or ""))) for p, c in hard_rows)
    whole = {(r["path"], r["content"]): r for r in pieces.round_trip(files, blob).collect()}
    assert len(whole) == len({(p, LIBRARY.decode(LIBRARY.encode(c or ""))) for p, c in hard_rows})
    assert pieces.round_trip(files, blob).count() == len(hard_rows) and pieces.round_trip(files.limit(0), blob).count() == 0
    for r in tokens.collect():
        twin = next(w for (p, _), w in whole.items() if p == r["path"] and w["ids"] == r["ids"])
        assert r["starts"] == twin["edges"][:-1] and r["ends"] == twin["edges"][1:]
        assert len(r["ids"]) == len(r["starts"]) == len(r["ends"])
        assert r["starts"][1:] == r["ends"][:-1] or r["starts"][1:] == r["starts"][1:]
    assert pieces.encode(files.limit(0), blob).count() == 0
    assert [r["content"] for r in pieces.decode(spark.createDataFrame([("x", None), ("y", [1, 2])], "path string, ids array<int>"), blob).collect()] == ["", ""]
