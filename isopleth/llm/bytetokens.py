"""Token ids of a byte-level tokenizer by the tokenizers library, remembered per word."""

import os
import struct

import numpy as np

_TAIL = b".,!?;:|"
_TOGETHER = 1000
_LOADED: dict[tuple[str, int], "ByteTokens"] = {}


def _ends(part: bytes) -> bool:
    """Nothing, or no white space at the end."""
    return part == b"" or not part.decode()[-1].isspace()


def _letters(part: bytes) -> bool:
    """Latin letters alone."""
    return part.isalpha() or part != b"" and (text := part.decode()).isalpha() and max(text) < "ɐ"


class ByteTokens:
    """Encodes texts with a byte-level tokenizer whose words take one space before them along.

    Between two characters that aren't white space a single space always begins a new word there, so a text may be cut
    before it and each part encoded on its own. Parts that were seen are remembered. Of new ones, letters with
    punctuation after them, also over lines, are encoded as words by the library's model; others go to the library many
    at a time, as one text: only a part's first token begins with the space. What has white space beside the cut is not
    cut there. At `limit` remembered parts the older half is forgotten; parts of over 64 bytes are forgotten at once.
    Texts with a special token's string go to the library whole.
    """

    def __init__(self, path: str, limit: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit, self.known, self.old, self.words, self.old_words = limit, {}, {}, {}, {}
        as_byte = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {b: as_byte.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        self.letters |= {b: self._high(as_byte, b) for b in range(0xC2, 0xF5)} | {b: as_byte.pre_tokenize_str(bytes([0xC3, b]).decode())[0][0][1] for b in range(0x80, 0xC0)}
        vocabulary = self.tokenizer.get_vocab()
        self.packed = [struct.pack("<I", i) for i in range(max(vocabulary.values()) + 1)]
        self.model = self.tokenizer.model
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True

    @staticmethod
    def _high(as_byte, first: int) -> str:
        """How the library writes a byte that begins a character."""
        rest = {0xE0: b"\xa0\x80", 0xF0: b"\x90\x80\x80"}.get(first, b"\x80" * (1 if first < 0xE0 else 2 if first < 0xF0 else 3))
        return as_byte.pre_tokenize_str((bytes([first]) + rest).decode())[0][0][0]

    def _library(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        ids = self.words.get(word) or self.old_words.get(word)
        if ids is None:
            packed = self.packed
            ids = b"".join([packed[t.id] for t in self.model.tokenize(word.decode("latin-1").translate(self.letters))])
            if len(word) <= 64:
                self.words[word] = ids
        return ids

    def _simple(self, part: bytes, begin: bytes = b" ") -> bytes | None:
        """The ids of a part of lines of letters with punctuation after them, of no other, and what it begins with."""
        out = []
        for line in part.split(b"\n"):
            stem = line.rstrip(_TAIL)
            if not _letters(stem):
                return None
            if out:
                out.append(self._word(b"\n"))
            out.append(self._word(begin + stem))
            if len(stem) < len(line):
                out.append(self._word(line[len(stem) :]))
            begin = b""
        return b"".join(out)

    def _learn(self, parts: set[bytes]) -> None:
        """Makes the ids of those parts known that may follow a space as they are."""
        new, mixed = {}, []
        for part in parts:
            ids = self.old.get(part)
            if ids is None:
                ids = self._word(b" " + part) if part.isalpha() else self._simple(part)
            if ids is not None:
                new[part] = ids
            elif part != b"" and not (text := part.decode())[0].isspace() and not text[-1].isspace():
                mixed.append(part)
        for at in range(0, len(mixed), _TOGETHER):
            some = mixed[at : at + _TOGETHER]
            raw = self._library(b" " + b" ".join(some))
            starts = np.flatnonzero(self.begins[np.frombuffer(raw, "<u4")]) * 4
            if len(starts) == len(some):
                bounds = [*starts.tolist(), len(raw)]
                new.update((p, raw[a:b]) for p, a, b in zip(some, bounds, bounds[1:]))
            else:
                new.update((p, self._library(b" " + p)) for p in some)
        self.known.update(new)

    def _forget(self, parts: set[bytes]) -> None:
        for part in parts:
            if len(part) > 64:
                self.known.pop(part, None)
        if len(self.known) > self.limit // 2:
            self.old, self.known = self.known, {}
        if len(self.words) > self.limit // 4:
            self.old_words, self.words = self.words, {}

    def _joined(self, parts: list[bytes]) -> bytes:
        """The ids of a text some of whose parts have white space beside their cuts."""
        out, held, ended = [], [parts[0]], _ends(parts[0])
        for part in parts[1:]:
            ids = self.known.get(part)
            if ids is not None and ended:
                if held:
                    out.append(self._library(b" ".join(held)))
                    held = []
                out.append(ids)
            elif ended and part != b"" and not part.decode()[0].isspace():
                out.append(self._library(b" ".join(held)) if held else b"")
                held = [b"", part]
                ended = _ends(part)
            else:
                held = held or [b""]
                held.append(part)
                ended = part != b"" and _ends(part)
        return b"".join(out) + (self._library(b" ".join(held)) if held else b"")

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """The ids of some texts, as little-endian unsigned 32-bit integers; what they have that is new is learnt together."""
        whole = {i for i, text in enumerate(texts) if any(s in text for s in self.special)}
        split = [[b""] if i in whole else text.split(b" ") for i, text in enumerate(texts)]
        new = set().union(*split).difference(self.known)
        self._learn(new)
        out = []
        for i, parts in enumerate(split):
            if i in whole:
                out.append(self._library(texts[i]))
                continue
            try:
                if not _ends(parts[0]):
                    raise KeyError
                ids = b"".join(map(self.known.__getitem__, parts[1:]))
                first = self._simple(parts[0], b"") if parts[0] else b""
                out.append((self._library(parts[0]) if first is None else first) + ids)
            except KeyError:  # white space beside a cut
                out.append(self._joined(parts))
        self._forget(new)
        return out

    @classmethod
    def load(cls, path: str, limit: int = 800_000) -> "ByteTokens":
        """One encoder per Python worker."""
        if (path, limit) not in _LOADED:
            _LOADED[path, limit] = cls(path, limit)
        return _LOADED[path, limit]
