"""The SentencePiece encoder on characters without a piece, on long runs, and on models that it can't follow."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece.sentencepiece_model_pb2 import ModelProto

from chirplake.llm import pieces
from chirplake.llm.queries import PIECE_MODEL

pytestmark = pytest.mark.skipif(not Path(PIECE_MODEL).exists(), reason="no model")


@pytest.fixture(scope="module")
def model():
    return Path(PIECE_MODEL).read_bytes()


def test_characters_without_a_piece_side_by_side(model):
    """Every state of the vocabulary's cache has a key of its own: random ideograms after plain words equal the library's ids."""
    rng = np.random.default_rng(5)
    v, sp = pieces.Vocabulary(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    plain = ["the quick brown foxes jumped over lazy dogs near the river bank", "elephants see trees and bees " * 20]
    odd = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 40))) for _ in range(300)] + ["瀢违", "瀶魱"]
    odd += ["".join(map(chr, rng.integers(0xAC00, 0xD7A3, 20))) + "ee" for _ in range(100)] + ["\U0001f600" * 70, "a" * 300 + "瀢"]
    for texts in (plain, odd, plain):
        assert pieces.encode_all(v, pa.array(texts)).to_pylist() == sp.encode(texts)


def test_long_segments_commit_in_a_bounded_window(model):
    v, sp = pieces.Vocabulary(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    text = "internationalisation" * 400
    encoder, got, widest = pieces.StreamingEncoder(v), [], 0
    for k in range(0, len(text) + 1, 5):
        got += encoder.feed((pieces.BLANK + text)[k : k + 5])
        widest = max(widest, len(encoder.chars))
    assert got + encoder.finish() == sp.encode(text) and widest < 3 * pieces.COMMIT_EVERY and len(got) > 1000


@pytest.mark.parametrize("change", ["type", "bytes", "blanks", "prefix", "charsmap"])
def test_other_models_are_refused(model, change):
    m = ModelProto()
    m.ParseFromString(model)
    if change == "type":
        m.trainer_spec.model_type = m.trainer_spec.UNIGRAM
    elif change == "bytes":
        m.trainer_spec.byte_fallback = False
    elif change == "blanks":
        m.normalizer_spec.remove_extra_whitespaces = True
    elif change == "prefix":
        m.normalizer_spec.add_dummy_prefix = False
    else:
        m.normalizer_spec.precompiled_charsmap = b"x"
    with pytest.raises(ValueError, match="can't follow"):
        pieces.checked(m.SerializeToString())


def test_models_whose_pieces_go_over_white_space_are_refused(model):
    for change in ("rule", "piece"):
        m = ModelProto()
        m.ParseFromString(model)
        if change == "rule":
            m.trainer_spec.split_by_whitespace = False
        else:
            next(p for p in m.pieces[1000:] if p.type == p.NORMAL).piece = "of▁the"
        with pytest.raises(ValueError, match="white space"):
            pieces.checked(m.SerializeToString())
    assert pieces.checked(model) == model
