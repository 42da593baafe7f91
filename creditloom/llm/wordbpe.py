"""Pre-tokens of texts exactly as a word-level BPE file of the tokenizers library splits them."""

from __future__ import annotations

import functools
import json
import re
import unicodedata

from tokenizers import Tokenizer
from tokenizers.models import BPE

#: The alphabet for which splitting is done here. All other texts
#: go through the library's own normaliser and splitter. Printable ASCII and
#: Latin letters compose and lower-case alike everywhere, but for the dotted I.
_ALPHABET = [
    c
    for c in map(chr, [*range(0x20, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2028), 0x20AC])
    if c != "İ" and unicodedata.is_normalized("NFC", c)
]
_SPACE = "\t\n\r "


def _class(chars: list[str]) -> str:
    return "".join(map(re.escape, chars))


_LOWERED = sorted({x for c in _ALPHABET for x in c.lower()})
_LETTERS = _class([c for c in _LOWERED if unicodedata.category(c)[0] == "L"])
_NUMBERS = _class([c for c in _LOWERED if unicodedata.category(c)[0] == "N"])
_PLAIN = re.compile(f"[\t\n\r{_class(_ALPHABET)}]*")
_SPLIT = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+"
)
#: The splitting pattern that the fast way stands for.
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class WordBpe:
    """One tokenizer file: its splitting, its merges and its special strings."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        names = sorted(self.special, key=len, reverse=True)
        self._parts = re.compile(f"({'|'.join(map(re.escape, names))})") if names else None
        self.suffix = model.get("end_of_word_suffix") or ""
        self._usual = _PATTERN in json.dumps(spec["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\")
        self._bytes = next(p for p in _steps(self.library.pre_tokenizer, spec) if p is not None)
        self.outer = self.library.model
        # The same merges for text that goes on behind it: without the mark of a word's end.
        self.inner = BPE(vocab=model["vocab"], merges=[tuple(m) for m in model["merges"]])
        self.names = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}

    def spelled(self, word: str) -> str:
        """A pre-token in the byte alphabet of the vocabulary."""
        return "".join(piece for piece, _ in self._bytes.pre_tokenize_str(word))

    def sections(self, text: str | None) -> list[tuple[str, bool]]:
        """The text cut at special strings; those are marked."""
        if not text:
            return []
        if self._parts is None or not any(s in text for s in self.special):
            return [(text, False)]
        return [(part, part in self.special) for part in self._parts.split(text) if part]

    def words(self, text: str) -> tuple[list[str], bool]:
        """The pre-tokens of a section, and whether they are spelled in bytes already."""
        if self._usual and _PLAIN.fullmatch(text):
            return _SPLIT.findall(text.lower()), False
        normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return [piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)], True


def _steps(pre_tokenizer, spec: dict) -> list:
    """The byte spelling step of a pre-tokenizer, made anew from its settings."""
    from tokenizers.pre_tokenizers import ByteLevel

    steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
    found = [ByteLevel(add_prefix_space=False, use_regex=False) for s in steps if s["type"] == "ByteLevel"]
    if not found:
        raise ValueError("the tokenizer does not spell its words in bytes")
    return found


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """The tokenizer of a file, loaded once in every process."""
    return WordBpe(path)
