"""Token counts of a word-end BPE by prefix dynamic programming.

A tokenizers file with the steps NFC, white space to one space, lower case, a split into pieces, bytes and merges
with a word-end mark is read here and run by the prefix automaton of merges.py: for each distinct piece of text it
yields the exact number of tokens of every prefix at once. Kept by piece and summed over a text, these answer how many
tokens any prefix of the normalised text has and where a token budget ends, without encoding anything again.

Special strings in a text are single tokens, as the library has them by default. Nulls count as empty texts; empty
texts have no tokens; an empty table gives an empty result; repeated rows are counted alike; columns beside id and text are ignored. The caches of a
worker are bounded; texts of any length are counted whole.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, text_of, tokenizer_path
from .merges import END, Kept, Merges

SPACE = regex.compile(r"\s+")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes: visible Latin-1 characters for themselves, the others from 256 upwards."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


#: The steps that are done here, as a file names them.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def _check(spec: dict) -> None:
    """Raises for a file with other steps than those of this module."""
    model, steps = spec["model"], spec["pre_tokenizer"].get("pretokenizers", [])
    split = [(s["type"], s.get("behavior"), s.get("invert")) for s in steps if s["type"] == "Split"]
    plain = [s for s in steps if s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"]]
    free = [t["content"] for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    odd = model["type"] != "BPE" or not model["end_of_word_suffix"] or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if (spec["normalizer"] or {}).get("normalizers") != NORMAL or split != [("Split", "Removed", True)] or len(plain) != 1 or len(steps) != 2 or free or odd:
        raise ValueError("only byte-level BPE files with word ends, NFC, single spaces and lower case are read")


class PrefixCounter:
    def __init__(self, path: str, most_pieces: int = 1_000_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec)
        byte, mark = byte_letters(), spec["model"]["end_of_word_suffix"]

        def plain(token: str) -> str:
            end = token.endswith(mark)
            return "".join(chr(byte[c]) for c in token.removesuffix(mark)) + END * end

        added = {t["content"] for t in spec["added_tokens"]}
        vocab = {plain(t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        rank = {(plain(a), plain(b)): k for k, (a, b) in enumerate(merges)}
        self.merges = Merges(vocab, lambda a, b: rank.get((a, b)))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.split = regex.compile(" ?(?:" + split + ")")
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        # what all special strings begin with: texts without it have none
        self.begin = commonprefix(sorted(added))
        # the counts of a piece's prefixes, and the last of them
        self.prefixes = Kept(self._prefixes, most_pieces)
        self.pieces = Kept(lambda piece: self.prefixes[piece][-1], most_pieces)

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = SPACE.sub(" ", text)
        if not text.isascii() and "Σ" in text:  # its lower case doesn't depend on what follows
            text = text.replace("Σ", "σ")
        return text.lower()

    def _prefixes(self, piece: str) -> bytes | list[int]:
        counts = self.walk(piece)
        return bytes(counts) if max(counts) < 256 else counts

    def walk(self, piece: str) -> list[int]:
        """The number of tokens of each prefix of a piece, by characters, the empty one included."""
        word = piece.removeprefix(" ")
        counts = [0] * (len(piece) - len(word) + 1)
        if word[0] == "'" and len(word) > 1:  # cut short, a contraction is a mark and letters
            inner = [0, *(sum(self._whole(p) for p in self.split.findall(word[:k])) for k in range(1, len(word)))]
            return counts + inner[1:] + [self._whole(word)]
        data = word.encode("utf-8", "surrogatepass")
        whole = self.merges.walk(data.decode("latin-1"))[2]
        if len(data) == len(word):
            return counts + whole[1:]
        at = 0
        for c in word:
            at += len(c.encode("utf-8", "surrogatepass"))
            counts.append(whole[at])
        return counts

    def _whole(self, word: str) -> int:
        return self.merges.walk(word.encode("utf-8", "surrogatepass").decode("latin-1"))[2][-1]

    def _parts(self, text: str) -> list[str]:
        """Stretches between special strings; each gap between two is one token."""
        return self.special.split(text) if self.special and self.begin in text else [text]

    def count(self, text: str) -> int:
        get, total, parts = self.pieces.__getitem__, 0, self._parts(text)
        for part in parts:
            total += sum(map(get, self.split.findall(self.normal(part))))
        return total + len(parts) - 1

    def prefix_counts(self, text: str) -> list[int]:
        """The number of tokens of every prefix of a normalised text without special strings."""
        out, base = [0], 0
        for piece in self.split.findall(text):
            base, n = out[-1], self.pieces[piece]
            out += [base + k for k in self.prefixes[piece][1:]]
            assert out[-1] == base + n
        return out + [out[-1]] * (len(text) + 1 - len(out))

    def cut(self, text: str, budget: int) -> int:
        """How many characters the longest prefix of the normalised text within a budget of tokens has.

        Special strings count as one token and keep their length.
        """
        chars, used = 0, 0
        parts = self._parts(text)
        marks = [m.end() - m.start() for m in self.special.finditer(text)] if len(parts) > 1 else []
        for k, part in enumerate(parts):
            if k:
                if used + 1 > budget:
                    return chars
                chars, used = chars + marks[k - 1], used + 1
            normal = self.normal(part)
            at = 0
            for piece in self.split.findall(normal):
                n = self.pieces[piece]
                if used + n > budget:
                    prefixes = self.prefixes[piece]
                    return chars + at + max(i for i, c in enumerate(prefixes) if used + c <= budget)
                used, at = used + n, at + len(piece)
            chars += len(normal)
        return chars


@lru_cache(maxsize=2)
def counter(name: str) -> PrefixCounter:
    """One for each worker process, whatever the number of tasks it runs."""
    return PrefixCounter(tokenizer_path(name))


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and cut_chars (of the normalised text, within limit) of every document."""
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("cut_chars", pa.int64())])

    def start():
        c = counter(tokenizer)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, cuts = [], []
            for s in batch.column("text"):
                s = s.as_py()
                n = c.count(s)
                counts.append(n)
                cuts.append(c.cut(s, limit) if n > limit else None)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts]), pa.array(cuts, pa.int64())], schema=out)

        return step

    whole = text_of(text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("text"))
    return map_arrow(rows, start, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
