"""Token ids of texts by the tokenizers library, remembered per word."""

import os
import re

import numpy as np

#: Bytes with A-Z in lower case, as the tokenizer's own normalizer makes them.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_TAIL = ".,!?;:|"
_TOGETHER = 500
_LOADED: dict[tuple[str, int], "WordTokens"] = {}


class WordTokens:
    """Encodes texts with a tokenizer that lowers case, drops white space and never merges across it.

    A text is cut at ASCII white space, which only splits where the tokenizer splits too. Each different run is encoded
    once by the library and remembered; a run of letters with punctuation after it is remembered as those two. Runs
    of letters go to the library many at a time, as one text: each ends with a token that ends a word, and where the
    number of those isn't the number of runs, they go one by one. At `limit` remembered runs the older half is
    forgotten, so memory stays bounded. Runs of over 64 bytes are not remembered. Texts with a special token's string go
    to the library whole, which finds those strings before it does anything else; with special_as_text they are
    ordinary text.
    """

    def __init__(self, path: str, limit: int = 800_000, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        strings = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        pattern, first = re.compile("|".join(map(re.escape, strings)), re.IGNORECASE), os.path.commonprefix(strings)
        first = first if first.lower() == first.upper() else ""  # a beginning without letters is looked for first
        self.special = lambda text: bool(strings) and first in text and pattern.search(text) is not None
        self.limit, self.known, self.old = limit, {}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, runs: list[str]) -> list[bytes]:
        """The ids of runs of letters."""
        out = []
        for at in range(0, len(runs), _TOGETHER):
            some = runs[at : at + _TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                raw, at_id = ids.tobytes(), 0
                for end in ends.tolist():
                    out.append(raw[4 * at_id : 4 * end])
                    at_id = end
            else:
                out += self._library(some)
        return out

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of words not in `known`."""
        own, letters, mixed, joined = {}, {}, {}, {}
        for word in words:
            ids = self.old.get(word)
            if ids is not None:
                own[word] = ids
                continue
            text = word.decode()
            stem = text.rstrip(_TAIL)
            if text.isalpha():
                letters[word] = text
            elif len(stem) < len(text) and stem.isalpha():
                joined[word] = (stem.encode(), text[len(stem) :].encode())
            else:
                mixed[word] = text
        for stem, tail in joined.values():
            for part, group in ((stem, letters), (tail, mixed)):
                if part not in own and part not in group:
                    ids = self.known.get(part) or self.old.get(part)
                    if ids is None:
                        group[part] = part.decode()
                    else:
                        own[part] = ids
        own.update(zip(letters, self._letters(list(letters.values()))))
        own.update(zip(mixed, self._library(list(mixed.values())) if mixed else ()))
        own.update((word, own[stem] + own[tail]) for word, (stem, tail) in joined.items())
        if len(self.known) + len(own) > self.limit // 2:
            self.old, self.known = self.known, {}
        self.known.update((w, ids) for w, ids in own.items() if len(w) <= 64)
        return own

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of some texts; what they have that is new is learnt together."""
        whole = {i: self._library([text])[0] for i, text in enumerate(texts) if self.special(text)}
        split = [[] if i in whole else text.encode().translate(_LOWER).split() for i, text in enumerate(texts)]
        found = [list(map(self.known.get, words)) for words in split]
        new = {w for words, parts in zip(split, found) if None in parts for w, ids in zip(words, parts) if ids is None}
        if new:
            own = self._learn(new)
            found = [[own[w] if ids is None else ids for w, ids in zip(words, parts)] if None in parts else parts for words, parts in zip(split, found)]
        return [whole[i] if i in whole else b"".join(parts) for i, parts in enumerate(found)]

    @classmethod
    def load(cls, path: str, limit: int = 800_000) -> "WordTokens":
        """One encoder per Python worker."""
        if (path, limit) not in _LOADED:
            _LOADED[path, limit] = cls(path, limit)
        return _LOADED[path, limit]


def by_size(texts: list, most_chars: int = 1_000_000):
    """Runs of list places whose texts have about `most_chars` characters together."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most_chars:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
