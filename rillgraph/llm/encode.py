"""Token ids of many texts at once through the tokenizers library.

The vocabulary splits at white space, so a text's ids are those of its words one after another. Words repeat: each distinct one is
encoded once and looked up after that. Only words that are wholly ASCII are lower-cased before: the vocabulary composes
characters first and folds case last, and some compose only in lower case. Texts in which a special token's string may stand are
encoded whole.

New words are learned by the library's merges alone where the vocabulary normalises and splits as FORM says and the word has
printable Latin-1 characters only: those are composed already, fold one by one, and are split here. All other words go through
the whole of the library.
"""

from __future__ import annotations

import gc
import json
import re
from collections import defaultdict
from collections.abc import Callable
from functools import cache, cached_property
from itertools import chain, compress, count, islice

import numpy as np

from rillgraph.llm.common import trim

#: Distinct words, and pieces of them, that an encoder remembers; beyond that it keeps the half that it met most often.
REMEMBERED = 200_000
#: Of these, how many it keeps from one task to the next, as one text: idle workers should hold little.
KEPT = 60_000
#: Pieces of words that the library gets as one text.
TOGETHER = 1000
#: Characters of text that a task encodes at once, about.
AT_ONCE = 1 << 20

# How the vocabulary word_bpe_49k normalises and splits texts.
FORM = (
    ["NFC", "Replace", "Lowercase"],
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
)
# End of the fixed values.

#: The same split for printable Latin-1 characters in lower case, and words that have no others.
_LETTER, _DIGIT = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_LETTER}{_DIGIT}]+")
_LATIN, _LATIN_TEXT = re.compile(r"[!-~¡-¬®-ÿ]+").fullmatch, re.compile(r"[\t-\r -~¡-¬®-ÿ]*").fullmatch
#: Byte-level vocabularies spell bytes that don't print by characters from 256 on.
_PRINT = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SPELLED = {chr(b): chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _PRINT) if b > 0x7F}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _spelled(pieces: str) -> str:
    """Printable Latin-1 text as a byte-level vocabulary spells its UTF-8 bytes, spaces unchanged."""
    if not pieces.isascii():
        pieces = pieces.encode().decode("latin-1")
        for byte, spelled in _SPELLED.items():
            pieces = pieces.replace(byte, spelled)
    return pieces


def _words(text: str) -> list[str]:
    """The words as they are looked up."""
    if _LATIN_TEXT(text):
        return text.lower().split()
    words = text.encode("utf-8", "surrogatepass").split()  # str.split() splits at other characters too
    return [w.lower().decode() if w.isascii() else w.decode("utf-8", "surrogatepass") for w in words]


def gathered(ids: np.ndarray, first: np.ndarray, many: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ids of the entries `at` one after another; entry k has many[k] ids from first[k] on."""
    own = many[at]
    ends = np.cumsum(own)
    return ids[np.repeat(first[at] - (ends - own), own) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Grown:
    """An array that grows at its end, with room for as much again."""

    def __init__(self, given: np.ndarray) -> None:
        self.held, self.n = given, len(given)

    def add(self, more: np.ndarray) -> None:
        """Put more behind the rest."""
        end = self.n + len(more)
        if end > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(max(end, 2 * self.n) - self.n, self.held.dtype)])
        self.held[self.n : end] = more
        self.n = end

    def all(self) -> np.ndarray:
        """What is there, not a copy."""
        return self.held[: self.n]


class Memo:
    """The ids of keys met before; keys not met are learned together."""

    def __init__(self, learn: Callable[[list], tuple[np.ndarray, np.ndarray]]) -> None:
        """learn gives the ids of a list of keys one after another, and how many each has."""
        self.learn = learn
        self.known: dict = defaultdict(count().__next__)
        self.held: str | None = None
        self.ids, self.first, self.many, self.met = (Grown(np.zeros(0, t)) for t in (np.uint32, np.int64, np.int64, np.int64))

    def of(self, groups: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all groups of keys one after another, and how many each group has."""
        if self.held is not None:
            self._chosen(self.held.split("\n"))
            self.held = None
        elif len(self.known) > REMEMBERED:
            self._chosen(self._shrink(REMEMBERED // 2))
        before = len(self.known)
        counts = np.fromiter(map(len, groups), np.int64, len(groups))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(groups)), np.int64, int(counts.sum()))
        if len(self.known) > before:
            ids, lens = self.learn(list(islice(reversed(self.known), len(self.known) - before))[::-1])
            self.first.add(self.ids.n + np.cumsum(lens) - lens)
            self.ids.add(ids)
            self.many.add(lens)
            self.met.add(np.zeros_like(lens))
        self.met.all()[:] += np.bincount(at, minlength=self.met.n)
        many = self.many.all()
        ends = np.append(0, np.cumsum(many[at]))
        return gathered(self.ids.all(), self.first.all(), many, at), np.diff(ends[np.append(0, np.cumsum(counts))])

    def rest(self) -> None:
        """Keep the KEPT keys met most often, as one text until they are needed."""
        if self.held is None and self.known:
            self.held = "\n".join(self._shrink(KEPT))
            self.known = {}

    def _chosen(self, keys: list) -> None:
        self.known = defaultdict(count(len(keys)).__next__, zip(keys, range(len(keys)), strict=True))

    def _shrink(self, n: int) -> list:
        """The n keys met most often, in their order; all else about the others goes."""
        met, many = self.met.all(), self.many.all()
        keep = np.sort(np.argpartition(-met, n)[:n]) if n < len(met) else np.arange(len(met))
        chosen = np.zeros(len(met), bool)
        chosen[keep] = True
        keys = list(compress(self.known, chosen.tolist()))
        self.ids = Grown(gathered(self.ids.all(), self.first.all(), many, keep))
        self.many, self.met = Grown(many[keep]), Grown(met[keep] // 2)  # what was met long ago weighs less
        self.first = Grown(np.cumsum(many[keep]) - many[keep])
        return keys


class Encoder:
    """Encodes lists of texts; null counts as empty."""

    def __init__(self, path: str, split: bool = True) -> None:
        """split: the vocabulary's tokens never cross or hold white space, and case is folded."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.split = path, split
        self.size = len({*spec["model"]["vocab"], *(t["content"] for t in spec.get("added_tokens") or ())})
        self.merges = self._merges(spec) if split else None
        self.words, self.pieces = Memo(self._learn), Memo(self._merged)
        del spec
        trim()

    @cached_property
    def tokenizer(self):
        """The whole of the library, loaded when it is needed."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _merges(self, spec: dict):
        """The vocabulary without normalising, splitting at spaces only; None if it is of another form."""
        from tokenizers import Tokenizer

        try:
            steps, cuts = spec["normalizer"]["normalizers"], spec["pre_tokenizer"]["pretokenizers"]
            form = [x["type"] for x in steps], cuts[0]["pattern"]["Regex"]
            if form != FORM or cuts[1]["type"] != "ByteLevel" or cuts[1]["add_prefix_space"] or cuts[1]["use_regex"] or not spec["model"]["end_of_word_suffix"]:
                return None
        except (KeyError, TypeError, IndexError):
            return None
        spec = spec | {"normalizer": None, "added_tokens": [], "post_processor": None, "pre_tokenizer": {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}}
        ending = spec["model"]["end_of_word_suffix"]
        self.last = np.zeros(self.size, bool)
        for token, k in spec["model"]["vocab"].items():
            self.last[k] = token.endswith(ending)
        return Tokenizer.from_str(json.dumps(spec))

    def rest(self) -> None:
        """At a task's end: keep little."""
        self.words.rest()
        self.pieces.rest()
        trim()

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]  # without places in the text
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum())), lens

    def _merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _whole(), for pieces of printable Latin-1 words in lower case."""
        texts = [" ".join(pieces[k : k + TOGETHER]) for k in range(0, len(pieces), TOGETHER)]
        found = [np.array(x.ids, np.uint32) for x in self.merges.encode_batch_fast([_spelled(t) for t in texts], add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint32), *found])
        lens = np.diff(np.nonzero(self.last[ids])[0], prepend=-1)  # each piece has its end in its last token
        return (ids, lens) if len(lens) == len(pieces) else self._whole(pieces)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.fromiter((self.merges is not None and _LATIN(w) is not None for w in words), bool, len(words))
        n = int(plain.sum())
        if n == len(words):
            return self.pieces.of([_PIECE.findall(w.lower()) for w in words])
        order = np.argsort(~plain, kind="stable")
        ids, lens = self.pieces.of([_PIECE.findall(words[k].lower()) for k in order[:n].tolist()])
        others, more = self._whole([words[k] for k in order[n:].tolist()])
        ids, lens, back = np.append(ids, others), np.append(lens, more), np.argsort(order)
        return gathered(ids, np.cumsum(lens) - lens, lens, back), lens[back]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        texts = [t or "" for t in texts]
        if not self.split or any("<|" in t for t in texts):
            return self._whole(texts)
        collecting = gc.isenabled()
        gc.disable()  # millions of strings and no cycles: looking for those takes a fifth of the time
        try:
            return self.words.of([_words(t) for t in texts])
        finally:
            if collecting:
                gc.enable()


@cache
def encoder(path: str, split: bool = True) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path, split)


def ended(ids: np.ndarray, lens: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text's ids."""
    return np.insert(ids, np.cumsum(lens), end_id), lens + 1
