"""Encoding with the tokenizers library, each distinct word once.

It fits files whose pre-tokenizer never joins characters across white space and
drops white space, with byte-level BPE inside each pre-token. For those, the ids
of a text are the ids of its white-space separated words, one after another,
and the ids of a word are those of its pre-tokens.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

#: Bytes that byte-level BPE shows as themselves; the others follow from code point 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]


#: Marks that may end a word and are one pre-token together.
_MARKS = ".,;:!?|-#%&*$()"
#: Marks at the end of a word after a plain letter, where every pre-token ends: a space before them leaves the pre-tokens as they are, and
#: words are learned once and not once for each mark.
_ENDING = re.compile(rb"(?<=[A-Za-z])[.,;:!?]+(?=\s|\Z)")
#: Letters whose lower case depends on the word or has several characters.
_CASE_ODD = frozenset("\u03a3\u0130")


def _byte_alphabet() -> dict[int, str]:
    hidden = [b for b in range(256) if b not in set(_SHOWN)]
    return {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """Call it with an Arrow array of texts: a list of ids as little-endian bytes, two for each
    id where the vocabulary allows it and else four (`dtype`).

    Words seen are kept, up to `limit`. Then a new store is begun, and the full one serves until that is full too, so words that
    come often are learned once, memory is bounded, and results don't depend on it.
    """

    _made: dict[tuple[str, int], WordEncoder] = {}

    @classmethod
    def shared(cls, path: str, limit: int) -> WordEncoder:
        """One encoder for each Python worker, kept from task to task."""
        if (path, limit) not in cls._made:
            cls._made[path, limit] = cls(path, limit)
        return cls._made[path, limit]

    def __init__(self, path: str, limit: int = 500_000):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        spec = json.load(open(path, encoding="utf-8"))
        pieces = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if pieces != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or level["type"] != "ByteLevel":
            raise ValueError("this file doesn't work word by word")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.whole = Tokenizer.from_file(path)
        self.words_only = Tokenizer(self.whole.model)
        self.words_only.pre_tokenizer = WhitespaceSplit()
        self.suffix = spec["model"]["end_of_word_suffix"]
        vocab = self.whole.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(self.suffix)]] = True
        self.dtype = np.dtype("<u2" if max(self.whole.get_vocab().values()) < 1 << 16 else "<u4")
        self.special = [x["content"].encode() for x in spec["added_tokens"]]
        self.alphabet = _byte_alphabet()
        self.limit = limit
        self.words: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _pretokens(self, word: bytes) -> tuple[str, ...] | list[str] | None:
        """A word's pre-tokens after normalization, or None where the library takes the whole word: special tokens, odd spaces and controls.

        Letters with marks after them are the plain case; the file's own pattern cuts all others.
        """
        text = word.decode("utf-8", "replace")
        if text.isascii() or (unicodedata.is_normalized("NFC", text) and not _CASE_ODD.intersection(text)):
            lower = text.lower()
            if lower.isalpha():
                return (lower,)
            head = lower.rstrip(_MARKS)
            if head.isalpha():
                return head, lower[len(head) :]
        if not text.isprintable() or any(s in word for s in self.special):
            return None
        return self.find("".join(c.lower() for c in unicodedata.normalize("NFC", text)))

    def _learn(self, new: set[bytes]) -> None:
        plain = [w for w in new if w.isalpha()]  # ASCII letters only, as it is bytes that are asked
        cut = {w: self._pretokens(w) for w in new.difference(plain)}
        fresh = list({p for x in cut.values() if x for p in x}.difference(self.parts))
        shown = [w.lower().decode() for w in plain]
        shown += [p if p.isascii() else p.encode().decode("latin-1").translate(self.alphabet) for p in fresh]
        lines = [" ".join(shown[i : i + 400]) for i in range(0, len(shown), 400)]
        fast = getattr(self.words_only, "encode_batch_fast", self.words_only.encode_batch)
        found = [e.ids for e in fast(lines, add_special_tokens=False)]
        ids = np.array([i for x in found for i in x], "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else np.zeros(0, np.int64)
        if len(stops) != len(shown):
            raise ValueError("word ends don't match the words")
        raw = ids.astype(self.dtype).tobytes()
        ends = (stops * self.dtype.itemsize).tolist()
        pieces = [raw[a:z] for a, z in zip([0, *ends], ends)]
        self.words.update(zip(plain, pieces))
        self.parts.update(zip(fresh, pieces[len(plain) :]))
        get = self.parts.__getitem__
        for w, x in cut.items():
            if x is None:
                self.words[w] = np.array(self.whole.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids, self.dtype).tobytes()
            else:
                self.words[w] = b"".join(map(get, x))

    def __call__(self, texts, at_once: int = 1024, most_bytes: int = 1 << 22) -> list[bytes]:
        """at_once: texts that are cut before their words are looked up; fewer where they have more than most_bytes."""
        out, start = [], 0
        while start < len(texts):
            n = min(at_once, max(1, at_once * most_bytes // max(1, texts.slice(start, at_once).nbytes)))
            part, start = texts.slice(start, n), start + n
            cut = []
            for t in part.to_pylist():
                cut.append(_ENDING.sub(rb" \g<0>", t.encode().lower() if t.isascii() else t.encode()).split() if t else [])
            seen = set().union(*cut)
            new = seen.difference(self.words)
            if len(self.words) + len(new) > self.limit:
                self.before, self.words = self.words, {}
                self.parts.clear()
                new = seen
            if new:
                back = new.intersection(self.before)
                self.words.update(zip(back, map(self.before.__getitem__, back)))
                new = new.difference(back)
            if new:
                self._learn(new)
            get = self.words.__getitem__
            out += [b"".join(map(get, words)) for words in cut]
        return out
