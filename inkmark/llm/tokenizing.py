"""BPE encoding and decoding by forced-boundary splitting."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

#: How the word-level vocabulary cuts lower-case text into words, for text of the Latin letters below.
_LETTERS = "a-z\\u00df-\\u00f6\\u00f8-\\u017f"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
_OTHER = re.compile("[^\\t-\\r\\x20-\\x7e\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u012f\\u0131-\\u017f]")

#: The parts of a tokenizer file that this module's way of cutting words is made for.
_PARTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
}
_MODEL_OFF = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")


def _check(spec: dict, path: str) -> None:
    """Refuses files whose words would be cut, merged or joined otherwise than here."""
    wrong = [part for part, value in _PARTS.items() if spec.get(part) != value]
    if spec["model"].get("type") != "BPE" or any(spec["model"].get(x) for x in _MODEL_OFF):
        wrong.append("model")
    if any(x.get(flag) for x in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        wrong.append("added_tokens")
    if wrong:
        raise ValueError(f"{path}: ids would be wrong, as these parts aren't the ones this encoder knows: {', '.join(wrong)}")


class Encoder:
    """Encodes and decodes as the tokenizer of a file does, special tokens in texts included.

    The file is one of lower-case words with marked ends, as _PARTS says; any other is refused by a ValueError.

    A text is cut into words. In a word, a pair of neighbouring bytes that stands in no token of the vocabulary
    can't be merged over: the word is cut there, the fragments are encoded independently (only the last one has the
    mark of the word's end) and their ids joined.
    """

    def __init__(self, path: str, remembered: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec, path)
        self.tokenizer = Tokenizer.from_file(path)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.last, self.inner = BPE(vocab, merges, end_of_word_suffix=end), BPE(vocab, merges)
        self.within = {t[i : i + 2] for x in vocab for t in [x.removesuffix(end) if end else x] for i in range(len(t) - 1)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.lead = "<" if all(x.startswith("<") for x in self.special) else ""  # without it a text has no special token
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        top = max(names) + 1
        self.names = [names.get(i, "") for i in range(top)]
        self.digits = [b"%d" % i for i in range(top)]
        self.remembered, self.young, self.old = remembered, {}, {}
        letters = self.tokenizer.pre_tokenizer.pre_tokenize_str  # a letter's bytes as the vocabulary writes them
        self.written = {c: "".join(w for w, _ in letters(chr(c))) for c in range(0x21, 0x180) if chr(c).isprintable()}

    def fragments(self, word: str) -> list[str]:
        within = self.within
        cuts = [i for i, pair in enumerate(map(str.__add__, word, word[1:]), 1) if pair not in within]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)] if cuts else [word]

    def _word(self, word: str) -> bytes:
        """Ids, as 32-bit numbers, of a word of the vocabulary's characters."""
        *inner, last = self.fragments(word)
        ids = [t.id for f in inner for t in self.inner.tokenize(f)]
        return array("I", ids + [t.id for t in self.last.tokenize(last)]).tobytes()

    def _new(self, word: str) -> bytes:
        """A word's ids; remembered if short. Two generations: what is in use outlives a full memory."""
        if (found := self.old.get(word)) is None:
            if word[0] == "\0":
                found = self._word(word[1:])
            else:
                found = self._word(word if word.isascii() else word.translate(self.written))
        if len(word) <= 40:
            if len(self.young) >= self.remembered:
                self.young, self.old = {}, self.young
            self.young[word] = found
        return found

    def _plain(self, text: str) -> bytes:
        if not _OTHER.search(text):
            words = _WORDS.findall(text.lower())
        else:  # the vocabulary's own characters, marked as such
            words = ["\0" + w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]
        miss = self._new
        return b"".join([x if (x := self.young.get(w)) is not None else miss(w) for w in words])

    def encode(self, text: str | None) -> array:
        ids = array("I")
        if self.marks and text and self.lead in text and self.marks.search(text):
            for k, part in enumerate(self.marks.split(text)):
                ids.frombytes(array("I", [self.special[part]]).tobytes() if k % 2 else self._plain(part))
        elif text:
            ids.frombytes(self._plain(text))
        return ids

    def decode(self, ids) -> str:
        """The file has no decoder: tokens stand with a blank between them."""
        names = self.names
        return " ".join([names[i] for i in ids])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, which Spark reuses for its next tasks."""
    return Encoder(path)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row of docs: digests of the ids and of the text decoded from them.

    Null and empty texts have no ids and decode to the empty text. Repeated rows give repeated rows, an empty table
    none, null ids stay; other columns of docs, of any name, are left alone. Very long texts are encoded whole. A file
    that the encoder doesn't know is an error before anything runs. Texts are encoded where they lie: no shuffle, one text in memory at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for x in b.column(1):
                ids = e.encode(x.as_py()).tolist()
                n.append(len(ids))
                digits = e.digits
                ids_sha.append(hashlib.sha256(b" ".join([digits[i] for i in ids])).hexdigest())
                text_sha.append(hashlib.sha256(e.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    with open(path, encoding="utf-8") as f:
        _check(json.load(f), path)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
