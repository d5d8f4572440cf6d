"""Byte-pair encoding by backtracking over the longest Aho-Corasick matches; decoding through an offset table."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Fixed values of the vocabulary's format: the end-of-word mark and the split into words. White space is
#: spelt out, because libraries differ over a few control characters.
END = "</w>"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
#: Longest chunk between white space that a worker remembers.
MEMO_CHUNK = 48
#: Entries of a memo: some 30 MB of short strings and their tokens.
MEMO_CHUNKS = 120_000
#: Pairs of tokens whose compatibility a worker remembers, some 20 MB.
MEMO_PAIRS = 200_000
#: Characters that Python's split takes for white space and the vocabulary's split does not.
SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, the others
    shifted past 255 in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


@dataclass
class Vocabulary:
    """Token strings by id and the merges that built them.

    In matching, a byte is one letter and the last byte of a word is another, 256 further on, so that the
    end mark is part of a letter and tokens are plain strings.
    """

    tokens: list[str]
    special: dict[str, int]
    #: A row per merge: the numbers of its two tokens and of the token made.
    merges: np.ndarray

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        tokens = [""] * (max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, number in model["vocab"].items():
            tokens[number] = token
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, number in special.items():
            tokens[number] = content
        number = model["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        return cls(tokens, special, np.array([(number[a], number[b], number[a + b]) for a, b in pairs], np.int32).reshape(-1, 3))

    @cached_property
    def rank_of_pair(self) -> dict[int, int]:
        """Rank of the merge of two tokens, by ``pair``; ids and ranks run in the same order."""
        return {left * len(self.tokens) + right: made for left, right, made in self.merges.tolist()}

    @cached_property
    def halves(self) -> tuple[list[int], list[int]]:
        """The two tokens each merged token was made of; -1 for a token that is whole."""
        left, right = ([-1] * len(self.tokens) for _ in range(2))
        for a, b, made in self.merges.tolist():
            left[made], right[made] = a, b
        return left, right

    @cached_property
    def spelling(self) -> dict[str, int]:
        """Tokens in matching letters. A token that its own merges never produce cannot be used."""
        place = {letter: i for i, letter in enumerate(byte_letters())}
        found = {}
        for number, token in enumerate(self.tokens):
            if number not in self.special.values():
                letters = [chr(place[c]) for c in token.removesuffix(END)]
                if token.endswith(END):
                    letters[-1] = chr(ord(letters[-1]) + 256)
                found["".join(letters)] = number
        return found


class Decoder:
    """All token strings in one text, and where each begins."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.text = "".join(vocabulary.tokens)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in vocabulary.tokens])]).tolist()

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by blanks, end marks included, as the vocabulary (which has no decoder) gives them."""
        text, offsets = self.text, self.offsets
        return " ".join([text[offsets[i] : offsets[i + 1]] for i in ids])


class Memo:
    """The values of short strings seen lately: two generations of ``MEMO_CHUNKS`` entries together."""

    def __init__(self) -> None:
        self.young: dict = {}
        self.old: dict = {}

    def recall(self, key: str):
        """The value of a key that is not ``young``."""
        found = self.old.get(key)
        if found is not None:
            self.add(key, found)
        return found

    def add(self, key: str, value) -> None:
        if len(key) <= MEMO_CHUNK:
            if len(self.young) >= MEMO_CHUNKS // 2:
                self.old, kept = self.young.copy(), self.young
                kept.clear()  # emptied in place: readers hold on to it
            self.young[key] = value


class Encoder:
    """Encodes texts as the vocabulary's merges do, in time linear in a word's length."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        (self.left_half, self.right_half), self.rank = vocabulary.halves, vocabulary.rank_of_pair
        self.decoder = Decoder(vocabulary)
        self.size = len(vocabulary.tokens)
        self.names = [str(i) for i in range(self.size)]
        self.pairs: dict[int, bool] = {}
        self.spelling, self.lengths = vocabulary.spelling, [0] * self.size
        #: The longest shorter token that a token begins with; -1 where there is none.
        self.shorter = [-1] * self.size
        self.matcher = ahocorasick.Automaton()
        for letters, number in self.spelling.items():
            self.lengths[number] = len(letters)
            self.shorter[number] = next((t for n in range(len(letters) - 1, 0, -1) if (t := self.spelling.get(letters[:n])) is not None), -1)
            self.matcher.add_word(letters, number)
        for letter in map(chr, range(512)):  # a match begins at every place, if with no token
            if letter not in self.spelling:
                self.matcher.add_word(letter, -1)
        self.matcher.make_automaton()
        self.memo: Memo = Memo()
        self.word_memo: Memo = Memo()
        self.marks = regex.compile("|".join(map(regex.escape, vocabulary.special))) if vocabulary.special else None

    def fits(self, left: int, right: int) -> bool:
        """Whether merging would leave ``left`` and ``right`` side by side.

        Walks both tokens apart along their seam, latest merge first. If a pair of parts that touch at the
        seam would have merged before the parts themselves were used up, the seam does not survive.
        """
        pair = left * self.size + right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        used = self.size  # rank at which the current parts were merged away
        while True:
            if self.rank.get(left * self.size + right, used) < used:
                return False
            whole_left, whole_right = self.left_half[left] < 0, self.left_half[right] < 0
            if whole_left and whole_right:
                return True
            # undo the later of the two merges; on the left side a merge of equal rank comes first
            if whole_right or not whole_left and left > right:
                used, left = left, self.right_half[left]
            else:
                used, right = right + 1, self.left_half[right]

    def word(self, data: bytes) -> list[int]:
        """Ids of one word given as its UTF-8 bytes.

        The leftmost longest match from a place on begins there. Tokens are tried longest first, shorter ones along
        ``shorter``; places from which no way leads on are not tried again.
        """
        letters = data[:-1].decode("latin-1") + chr(data[-1] + 256)
        whole = self.spelling.get(letters)
        if whole is not None:
            return [whole]
        matches, lengths, shorter = self.matcher.iter_long, self.lengths, self.shorter
        pairs, width, size = self.pairs, self.size, len(letters)
        ids, at, dead = [], 0, set()
        _, token = next(matches(letters))
        while True:
            while token >= 0:
                after = at + lengths[token]
                if after not in dead:
                    if not ids:
                        break
                    holds = pairs.get(ids[-1] * width + token)
                    if holds or holds is None and self.fits(ids[-1], token):
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                if after == size:
                    return ids
                at = after
                _, token = next(matches(letters, at))
            else:
                dead.add(at)
                last = ids.pop()
                at -= lengths[last]
                token = shorter[last]

    def chunk(self, chunk: str) -> tuple[str, int, str]:
        """Ids as text, their number, and the decoded tokens of one lower-case chunk without white space."""
        ids: list[int] = []
        get, old = self.word_memo.young.get, self.word_memo.recall
        for word in (chunk,) if chunk.isascii() and chunk.isalpha() else WORDS.findall(chunk):
            known = get(word) or old(word)
            if known is None:
                known = self.word(word.encode())
                self.word_memo.add(word, known)
            ids += known
        names = self.names
        found = (" ".join([names[i] for i in ids]), len(ids), self.decoder.decode(ids))
        self.memo.add(chunk, found)
        return found

    def pieces(self, text: str) -> list[tuple[str, int, str]]:
        """``chunk`` results of a whole text in order; special tokens in it are taken as such."""
        found: list[tuple[str, int, str]] = []
        at = 0
        for mark in self.marks.finditer(text) if self.marks else ():
            found += self._plain(text[at : mark.start()])
            found.append((str(self.vocabulary.special[mark[0]]), 1, mark[0]))
            at = mark.end()
        return found + self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> list[tuple[str, int, str]]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma
        text = text.lower()
        chunks = text.split() if not SEPARATORS.search(text) else regex.split(f"[{SPACE}]+", text)
        get, old = self.memo.young.get, self.memo.recall
        return [get(c) or old(c) or self.chunk(c) for c in chunks]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, _, _ in self.pieces(text or "") for i in ids.split()]


#: The encoder of a worker, kept from task to task of one vocabulary.
_KEPT: list[Encoder] = []


def _encoder(vocabulary: Vocabulary) -> Encoder:
    if not _KEPT or _KEPT[0].vocabulary is not vocabulary:
        _KEPT[:] = [Encoder(vocabulary)]
    return _KEPT[0]


def encode(docs: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids`` (array of token ids) of every whole text; a null text has none.

    The vocabulary file is read where Spark's driver runs and sent to the workers; its size does not depend
    on the data. Repeated keys stay separate rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary_path))

    def transform():
        encoder = _encoder(shared.value)
        return lambda batch: [batch.column(0), [encoder.encode(t) for t in batch.column(1).to_pylist()]]

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(F.col(key), F.col(text).cast("string")), transform, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text`` from ``key, ids``; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary_path))

    def transform():
        decoder = Decoder(shared.value)
        return lambda batch: [batch.column(0), [decoder.decode(i or []) for i in batch.column(1).to_pylist()]]

    kind = encoded.schema[key].dataType.simpleString()
    return map_batches(encoded.select(F.col(key), F.col(ids)), transform, f"`{key}` {kind}, text string")


def digests(docs: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of every whole text, encoded and decoded in one pass,
    with the ``ids`` themselves behind if asked for.

    The ids are hashed in decimal with single blanks between; the decoded text is looked up from those ids.
    A null text counts as empty; repeated keys stay; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary_path))

    def transform():
        encoder = _encoder(shared.value)

        def digest(body: str | None) -> tuple:
            found = [p for p in encoder.pieces(body or "") if p[1]]
            ids = " ".join([p[0] for p in found])
            decoded = " ".join([p[2] for p in found])
            own = (sum([p[1] for p in found]), _sha(ids), _sha(decoded))
            return (*own, np.fromstring(ids, dtype=np.int32, sep=" ")) if keep_ids else own

        return lambda batch: [batch.column(0), *map(list, zip(*map(digest, batch.column(1).to_pylist())))]

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return map_batches(docs.select(F.col(key), F.col(text).cast("string")), transform, schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
