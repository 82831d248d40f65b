"""Machines composed by hand, and piece models against the library."""

import random

import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from pairloom.llm import pieces
from pairloom.llm.transducers import EPSILON, REST, Composed, Lexicon, Table, shortest_path


def test_tiny_machines():
    upper = Table()
    upper.arc(0, "a", ("A",), 1.0, 0)
    upper.arc(0, "a", ("B", "B"), 0.25, 1)
    upper.arc(0, REST, (REST,), 0.0, 0)
    upper.arc(1, EPSILON, ("!",), 0.0, 0)
    upper.end(0)
    cost = Table()
    cost.arc(0, "A", ("x",), 1.0, 0)
    cost.arc(0, "B", ("y",), 0.5, 0)
    cost.arc(0, REST, (REST,), 0.125, 0)
    cost.end(0, 0.5)
    both = Composed(upper, cost)
    # a: by A 1 + 1, by BB! 0.25 + 0.5 + 0.5 + 0.125; c: 0.125; the end 0.5
    assert shortest_path(both, "ac") == (("y", "y", "!", "c"), 2.0)
    cost.arc(0, "A", ("z",), 0.25, 0)
    assert shortest_path(both, "ac") == (("z", "c"), 1.875)
    never = Table()
    assert shortest_path(Composed(upper, never), "a") is None


def brute(piece_weights, strange, text):
    """All segmentations of a text, the lightest one's weight."""
    best = {0: 0.0}
    for i in range(len(text)):
        options = [(j, piece_weights[text[i:j]]) for j in range(i + 1, len(text) + 1) if text[i:j] in piece_weights]
        options += [] if text[i] in piece_weights else [(i + 1, strange)]
        for j, w in options:
            if i in best:
                best[j] = min(best.get(j, 1e9), best[i] + w)
    return best[len(text)]


def test_lexicon_against_all_segmentations():
    r = random.Random(3)
    weights = {"".join(r.choice("abc") for _ in range(r.randint(1, 4))): r.random() * 5 for _ in range(25)}
    lexicon = Lexicon({t: (k, w) for k, (t, w) in enumerate(weights.items())}, lambda c: ((-1,), 7.0))
    for _ in range(300):
        text = "".join(r.choice("abcd") for _ in range(r.randint(0, 9)))
        assert shortest_path(lexicon, text, 0)[1] == pytest.approx(brute(weights, 7.0, text))


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """A unigram model written by hand, with byte fallback or without: its folder."""
    r = random.Random(4)
    found = {"▁": 2.5}
    while len(found) < 60:
        found["".join(r.choice("▁abcd") if k == 0 else r.choice("abcd") for k in range(r.randint(1, 4)))] = 1 + r.random() * 8
    for c in "abcd":
        found.setdefault(c, 6 + r.random())
    folder = tmp_path_factory.mktemp("models")
    for name, fallback in (("bytes", True), ("none", False)):
        m = pb.ModelProto()
        m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, fallback
        m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = True, False, True
        m.normalizer_spec.name = "identity"
        rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256) if fallback] + [(t, -w, 1) for t, w in found.items()]
        for t, w, kind in rows:
            m.pieces.add(piece=t, score=w, type=kind)
        (folder / name).write_bytes(m.SerializeToString())
    return folder


@pytest.mark.parametrize("name", ["bytes", "none"])
def test_unigram_equals_the_library(unigram, name):
    m, sp, r = pieces.PieceMachine(str(unigram / name)), sentencepiece.SentencePieceProcessor(model_file=str(unigram / name)), random.Random(5)
    same = 0
    for _ in range(1500):
        text = "".join(r.choice("aabbccdd  ▁éz\n日") for _ in range(r.randint(0, 30)))
        got, want = [i for w in m.encode(text) for i in w], sp.encode(text)
        same += got == want
        # of equally likely segmentations, rounding picks one
        assert sum(map(sp.get_score, got)) == pytest.approx(sum(map(sp.get_score, want)), abs=1e-3) and sp.decode(got) == sp.decode(want), repr(text)
    assert same >= 1485


def test_merge_order_is_what_merging_gives():
    r = random.Random(6)
    texts = ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "aa", "aab", "bca"]
    order = pieces.MergeOrder(dict(enumerate(texts)), {t: r.random() for t in texts if len(t) > 1})
    machine = Composed(Lexicon({t: (k, 0.0) for k, t in enumerate(texts)}, lambda c: ((-1,), 0.0)), order)
    for _ in range(400):
        text = "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
        ids, weight = shortest_path(machine, text, (0, order.start))
        assert [texts[i] for i in ids] == order.merged(text) and weight == 0


def test_clashing_names(spark, docs):
    df = docs.withColumns({"__text": F.lit(1), "__ids": F.lit("x"), "_text": F.lit(2), "decoded": F.lit("y")})
    back = pieces.decode_pieces(pieces.encode_pieces(df))
    assert back.columns == [c for c in df.columns if c not in ("ids", "decoded")] + ["ids", "decoded"]
    assert all((r.text or "") == r.decoded and r["__text"] == 1 for r in back.collect())
