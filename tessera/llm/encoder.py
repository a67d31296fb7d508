"""Token ids of texts, word by word, exactly as the tokenizers library gives them.

Where the tokenizer drops ASCII white space between tokens (its pre-tokenizer
keeps only matches without white space), no token and no normalisation crosses
a space, so a text's ids are its words' ids in a row. Words repeat, so each
worker keeps the ids of the words it met, in two generations of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import sys

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Words kept in each of the two generations.
KEEP = 350_000
#: The simple words are of printable ASCII and Latin-1 letters: one code point
#: folds to one, and they are in NFC. The split pattern and steps for which the word-wise way is proven.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN = "a-zß-öø-ÿ"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^{_LATIN}0-9]+")


class _Words(dict):
    """Ids of words, in two generations: a full one becomes the old one, which is asked before a word is encoded anew."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: bytes) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = self.encode(word)
        self[word] = got
        return got

    def age(self) -> None:
        if len(self) > KEEP:
            self.old = dict(self)
            self.clear()


class Encoder:
    """ids(text) for one tokenizer file; ids are little-endian unsigned numbers of ``width`` bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec["truncation"] = spec["padding"] = None
        self.tk = Tokenizer.from_str(json.dumps(spec))
        self.dtype = np.dtype("<u2" if self.tk.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        special = spec.get("added_tokens", [])
        self.by_word = (
            steps == ["NFC", "Replace", "Lowercase"]
            and len(pre) == 2
            and pre[0].get("pattern", {}).get("Regex") == _SPLIT
            and pre[0].get("behavior") == "Removed"
            and pre[0].get("invert") is True
            and not pre[1].get("add_prefix_space")
            and not pre[1].get("use_regex")
            and not any(re.search(r"\s", x["content"]) or x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in special)
        )
        #: The text is split by a pattern that looks ahead alone: where a split begins, all later ones follow from the text behind it.
        whole = spec.get("pre_tokenizer") or {}
        parts = whole.get("pretokenizers", [whole])
        patterns = [x.get("pattern", {}).get("Regex") for x in parts if x.get("type") == "Split"]
        self.looks_ahead = (
            (spec.get("normalizer") or {"type": "NFC"}).get("type") in ("NFC", "NFD")
            and {x.get("type") for x in parts} <= {"Split", "ByteLevel"}
            and (len(patterns) == 1 or (not patterns and parts[0].get("use_regex", True)))
            and not parts[0].get("add_prefix_space")
            and all(x and not re.search(r"\(\?<[=!]|\\[bBAGZ]|\^", re.sub(r"\[\^", "[", x)) for x in patterns)
        )
        #: Words that hold a special string's first two characters go to the library.
        self.simple = re.compile(r"(?:(?!" + "|".join(sorted({re.escape(x["content"][:2]) for x in special}) or [r"(?!)"]) + r")[!-~À-ÖØ-öø-ÿ])+")
        self.cache = _Words(self._word)
        self.pieces: dict[str, bytes] = {}
        self.pack = struct.Struct(f"<{'H' if self.dtype.itemsize == 2 else 'I'}").pack
        if self.by_word:
            alphabet = self.tk.pre_tokenizer.pre_tokenize_str
            letters = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
            self.byte_chars = str.maketrans({c: alphabet(c)[0][0] for c in letters})
            for probe in ("Tést'S <b>12!? ÀÈß's--", "straße ïÿ Ø|'LL."):
                if b"".join(map(self._word, probe.encode().split())) != self._library(probe):
                    self.by_word = False

    def _library(self, text: str) -> bytes:
        return np.array(self.tk.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if not self.simple.fullmatch(text):
            return self._library(text)
        text = text.lower()
        got = self.pieces.get(text)
        if got is not None:
            return got
        found, pieces = _PIECE.findall(text), self.pieces
        if len(found) == 1:
            return self._piece(text)
        return b"".join([pieces.get(p) or self._piece(p) for p in found])

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token, by the library's own merges."""
        got = b"".join([self.pack(t.id) for t in self.tk.model.tokenize(piece if piece.isascii() else piece.translate(self.byte_chars))])
        if len(self.pieces) >= KEEP:
            self.pieces.clear()
        self.pieces[piece] = got
        return got

    def words(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word (no ASCII white space inside)."""
        out = list(map(self.cache.__getitem__, words))
        self.cache.age()
        return out

    #: Words looked up at once, so that a very long text needs no list of all of its words' ids.
    STEP = 1 << 16

    def packed(self, text: bytes) -> bytes:
        """The ids of a text, packed."""
        if not self.by_word:
            return self._library(text.decode())
        words = text.split()
        if len(words) <= self.STEP:
            out = b"".join(map(self.cache.__getitem__, words))
            self.cache.age()
            return out
        return b"".join(b"".join(self.words(words[i : i + self.STEP])) for i in range(0, len(words), self.STEP))

    def ids(self, text: bytes) -> np.ndarray:
        return np.frombuffer(self.packed(text), self.dtype)


def encoder(path: str) -> Encoder:
    """One encoder for each file and process, with the words it met before."""
    kept = sys.modules[__name__].__dict__.setdefault("_kept", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def fingerprint(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
