"""Word-level encoding with the tokenizers library.

The word BPE vocabulary drops white space and never joins across it, so each white-space word is
encoded once by the library and its ids are reused; a batch is then one ragged gather in numpy.
New words of a slice are encoded together: their pre-tokens, a line of them at a time, go through
the library's model, and each ends at the only id that closes a word.
"""

from __future__ import annotations

import json
import re

import numpy as np

from siltline.llm.common import ragged

#: Signs whose NFC form is themselves and whose lower case is one sign, the same everywhere.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ\n]*")
#: Fixed value: the vocabulary's own pattern of pre-tokens, for PLAIN signs in lower case, and the end of a word.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\n]+|\n")
#: Pre-tokens in one call of the library.
LINE = 4000
_OPEN: dict[str, "WordEncoder"] = {}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_signs() -> dict[int, str]:
    """The byte-level alphabet: visible bytes stand for themselves, the rest for signs from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class WordEncoder(dict):
    """bytes of a word -> its number; the ids of word i are flat[start[i] : start[i] + length[i]].

    Of more than ``most`` words only those met again are kept, so memory is bounded and common words stay.
    """

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.lines = Tokenizer(self.tokenizer.model)
        self.lines.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(self.tokenizer.get_vocab_size())])
        self.signs = byte_signs() | {ord(" "): " "}
        self.new: list[bytes] = []
        self.flat, self.length, self.uses = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.length) + len(self.new)
        self.new.append(word)
        return number

    def settle(self) -> None:
        """Encodes the words met since the last time."""
        whole = b"\n".join(self.new).decode("utf-8", "replace")
        other: dict[int, list[int]] = {}
        if not PLAIN.fullmatch(whole) or "<|" in whole:  # other signs go through the whole tokenizer
            texts = whole.split("\n")
            for i, text in enumerate(texts):
                if not PLAIN.fullmatch(text) or "<|" in text:
                    other[i], texts[i] = self.tokenizer.encode(text, add_special_tokens=False).ids, ""
            whole = "\n".join(texts)
        code = {"\n": 0}
        number = np.array([code.setdefault(piece, len(code)) for piece in PIECE.findall(whole.lower() + "\n")], np.int64)
        flat, length = self._pieces(list(code)[1:])
        length = np.concatenate(([0], length))
        edge = np.concatenate(([0], np.cumsum(length[number])[number == 0]))
        flat, held = flat[ragged((np.cumsum(length) - length)[number], length[number])], np.diff(edge)
        if other:
            at = [0, *sorted(other), len(held)]
            parts = [(flat[edge[a] : edge[b]], np.array(other.get(b, []), np.uint32)) for a, b in zip(at, at[1:], strict=False)]
            flat = np.concatenate([x for pair in parts for x in pair])
            held[list(other)] = [len(ids) for ids in other.values()]
        self.flat, self.length = np.concatenate([self.flat, flat]), np.concatenate([self.length, held])
        self.new = []

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens one after the other, and how many each has."""
        found = [np.zeros(0, np.uint32)]
        for a in range(0, len(pieces), LINE):
            line = " ".join(pieces[a : a + LINE]).encode().decode("latin-1").translate(self.signs)
            found.append(np.array(self.lines.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint32))
        ids = np.concatenate(found)
        return ids, np.diff(np.flatnonzero(self.closes[ids]), prepend=-1)

    def forget(self) -> None:
        """Drops the words met least since the last time; half of ``most`` are kept at most."""
        least = 2
        while (self.uses >= least).sum() > self.most // 2:
            least *= 2
        keep = np.flatnonzero(self.uses >= least)
        number = np.full(len(self.length), -1, np.int64)
        number[keep] = np.arange(len(keep))
        start = np.cumsum(self.length) - self.length
        self.flat, self.length, self.uses = self.flat[ragged(start[keep], self.length[keep])], self.length[keep], np.zeros(len(keep), np.int64)
        kept = [(w, i) for w, i in zip(self, number[list(self.values())].tolist(), strict=True) if i >= 0]
        self.clear()
        self.update(kept)

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each closed by ``end``, and each text's number of ids."""
        if len(self.length) > self.most:
            self.forget()
        numbers, counts = [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = text.split()
            counts[i] = len(words)
            numbers.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
        if self.new:
            self.settle()
        word = np.concatenate(numbers)
        self.uses = np.bincount(word, minlength=len(self.length)) + np.pad(self.uses, (0, len(self.length) - len(self.uses)))
        start, lengths = np.cumsum(self.length) - self.length, self.length[word]
        before = np.concatenate(([0], np.cumsum(lengths)))
        edge = np.concatenate(([0], np.cumsum(counts)))
        sizes = before[edge[1:]] - before[edge[:-1]] + 1
        ids = np.full(int(sizes.sum()), end, np.uint32)
        inner = np.ones(len(ids), bool)
        inner[np.cumsum(sizes) - 1] = False
        ids[inner] = self.flat[ragged(start[word], lengths)]
        return ids, sizes


def encoder(path: str) -> WordEncoder:
    """One for each worker process; its words stay between tasks."""
    if path not in _OPEN:
        _OPEN[path] = WordEncoder(path)
    return _OPEN[path]
