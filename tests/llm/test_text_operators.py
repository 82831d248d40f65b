"""Operators that score or rewrite one text at a time."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairloom.llm import pieces, token_counts
from pairloom.llm.common import tokenizer_path
from pairloom.llm.personal import KINDS, base_spans, find_personal, luhn, mask_personal, personal_spans, trained
from pairloom.llm.quality import quality_rules
from pairloom.llm.toxicity import fit_toxicity, keep_clean, score_toxicity

from .conftest import TEXTS

ALPHABET = [*"ab'sretlvmd   ..,,!!\t\n\x00\x0b\x0c\x1c\x85\xa0 éàÀÉßΣσİıǅ१²½日本語한글ᄀ가🙂👩‍💻̀ﬁ▁▁##((12))+@-_", "<|endoftext|>", "<s>", "'re", "hello", "world", "    ", "...."]


def strings(n, seed, most=25):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, most))) for _ in range(n)]


# --- toxicity -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic_data(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("aeiounrst") for _ in range(r.randint(2, 8)))
    rows = []
    for i in range(600):
        words, bad = [word() for _ in range(r.randint(5, 60))], int(r.random() < 0.4)
        if bad:
            words.insert(r.randrange(len(words)), r.choice(("blighter", "dunderhead")))
        rows.append((i, " ".join(words), bad))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows] + [(3, None), (None, 1), (10**9, 1)], "doc_id long, toxic int")
    return docs, labels, {i: b for i, _, b in rows}


def test_toxicity_held_out(toxic_data):
    docs, labels, truth = toxic_data
    got = score_toxicity(docs, fit_toxicity(docs, labels)).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_toxicity_edges(spark, toxic_data, docs, empty):
    train, labels, _ = toxic_data
    model = fit_toxicity(train, labels)
    got = score_toxicity(docs, model).collect()
    assert len(got) == len(TEXTS) and all(r.score is not None for r in got)
    assert score_toxicity(empty, model).count() == 0
    none = fit_toxicity(train, labels.filter("false"))
    assert max(r.score for r in score_toxicity(docs, none).collect()) < 0.5
    kept = keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert score_toxicity(docs.select("doc_id", F.lit("you DUNDERHEAD").alias("text")), model).filter("predicted = 1").count() == len(TEXTS)


# --- token counts and pieces ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def test_counts_equal_the_library(library):
    c = token_counts.counter("word_bpe_49k.json")
    for s in [*strings(3000, 5), "", "a" * 5000, "é" * 300]:
        assert c.count(s) == len(library.encode(s, add_special_tokens=False).ids), repr(s)


def test_other_steps_raise(tmp_path):
    with open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"added_tokens": [{**spec["added_tokens"][0], "lstrip": True}]}, {"model": {**spec["model"], "ignore_merges": True}}):
        (tmp_path / "other.json").write_text(json.dumps({**spec, **change}))
        with pytest.raises(ValueError, match="are read"):
            token_counts.PrefixCounter(str(tmp_path / "other.json"))


def test_every_prefix(library):
    c = token_counts.counter("word_bpe_49k.json")
    for s in strings(120, 6, 30):
        s = c.normal(s.replace("<|endoftext|>", ""))
        want = [len(library.encode(s[:i], add_special_tokens=False).ids) for i in range(len(s) + 1)]
        assert c.prefix_counts(s) == want
        for budget in (0, 1, 5):
            assert c.cut(s, budget) == (len(s) if want[-1] <= budget else max(i for i, n in enumerate(want) if n <= budget and c.cut(s, budget) == i))


def test_count_tokens(docs, empty, library):
    got = token_counts.count_tokens(docs, limit=100).collect()
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_counts.count_tokens(empty).count() == 0


def test_pieces_equal_the_library():
    m, sp = pieces.machine("piece_bpe_32k.model"), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for s in [*strings(3000, 7), "", " " * 50, "▁" * 9, "a" * 3000]:
        ids = [i for w in m.encode(s) for i in w]
        assert ids == sp.encode(s), repr(s)
        assert m.decode(ids) == sp.decode(ids)


def test_encode_and_decode(docs, empty):
    back = pieces.decode_pieces(pieces.encode_pieces(docs))
    assert back.columns[:-2] == [c for c in docs.columns if c != "ids"] and back.columns[-2:] == ["ids", "decoded"]
    assert all((r.text or "") == r.decoded for r in back.collect())
    got = pieces.piece_digests(docs).collect()
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in got)
    assert pieces.piece_digests(empty).count() == pieces.encode_pieces(empty).count() == 0


# --- personal data --------------------------------------------------------------------------------------------------

PATTERNS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s, d: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s, d: all(int(x) <= 255 for x in s.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda s, d: 16 <= len(d) <= 19 and luhn(d)),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s, d: 8 <= len(d) <= 15),
)


def brute_spans(text):
    return [(k, *m.span()) for k, (p, ok) in enumerate(PATTERNS) for m in re.finditer(p, text) if ok(m.group(), re.sub(r"\D", "", m.group()))]


def test_base_spans():
    r = random.Random(2)
    for _ in range(5000):
        s = "".join(r.choice("ab@.+-_ 0112345(6)%/é٣") for _ in range(r.randint(0, 60)))
        assert base_spans(s)[0] == brute_spans(s), repr(s)
    assert len(base_spans("4111 1111 1111 1111, 4111-1111-1111-1112")[0]) == 1


def test_added_spans():
    w = trained()
    for s, kind in (("call (415) 555-1234 now", 3), ("tel 415-555-1234.", 3), ("card 4111.1111.1111.1111 x", 2), ("mail joe (at) example.com ok", 0)):
        assert [k for k, _, _ in personal_spans(s, w)[1]] == [kind], s
    for s in ("on 2024-05-06 10:11:12 it", "version 1.2.3.4.5.6 of 7", "ISBN 978-3-16-148410-0", "meet (at) noon", "1990 2000 2010 2020", "sum 12 + 34 - 56 (78) 90", "0cab398dc11d1a2a11dc6572c8df8bd228c864f3"):
        assert personal_spans(s, w)[1] == [], s


def test_find_personal(spark, docs, empty):
    got = find_personal(docs).collect()
    assert len(got) == len(TEXTS) and {r.spans for r in got} == {""}
    assert find_personal(empty).count() == 0
    text = "write a.b@c.de or +1 (415) 555-1234 from 10.0.0.1 é"
    r = find_personal(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    joined = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in brute_spans(text))
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 0, 1)
    assert r.spans == joined and r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    masked = mask_personal(docs.withColumn("text", F.lit(text))).first()
    assert masked.text == "write [email] or [phone] from [ip] é"


# --- quality --------------------------------------------------------------------------------------------------------


def brute_quality(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality_counts(spark, docs, empty):
    r = random.Random(4)
    texts = ["".join(r.choice(["a", "b", "c ", " ", "\n", "\t", "#", "|", "\x0b", "\x85", "é", "word ", "the same line again\n"]) for _ in range(r.randint(0, 90))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality_rules(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(texts[r.doc_id]), repr(texts[r.doc_id])
    assert quality_rules(docs).count() == len(TEXTS) and quality_rules(empty).count() == 0
    assert quality_rules(docs).filter("text is null").count() == 0 if "text" in quality_rules(docs).columns else True


def test_line_rules(spark):
    good = "This is a first sentence of some length, with words. And a second one follows it here."
    cases = {
        f"{good}\nHome | About | Contact | News | Login\nAll rights reserved.": True,
        "Home | About | Contact | News | Login\nOne | Two | Three | Four | Five": False,
        "THIS!! IS!! A!! LINE!! THAT!! SHOUTS!! ALL!! THE!! TIME!! AND!! MORE!!": False,
        "a### b$$$ c*** d%%% e&&& f### g$$$ h*** i%%% j&&& k### l$$$": False,
        good: True,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules(df).collect()}
    assert [got[i].kept for i in range(len(cases))] == list(cases.values())
    assert got[0].clean_text == good and got[0].n_lines_removed == 2
