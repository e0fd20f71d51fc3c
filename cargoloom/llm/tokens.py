"""Token ids of whole texts by the tokenizers library, with each distinct chunk encoded once per worker.

A text is cut before blanks and line feeds that follow something that isn't white space.  The byte-level pattern never
crosses such a place, and no added token does, so the ids of the chunks, one after the other, are the ids of the whole text.
Texts are cut by Arrow, a column at a time, and only the distinct pieces of a column are looked up.
An added token that stands in a text gets its own id, as the library does it.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .words import ragged

DEFAULT_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

#: Distinct chunks that a worker remembers before it starts anew; affects speed only.
REMEMBERED = 400_000
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
_CUT = re.compile(r"(?<!\s)(?=[ \n])")
#: Chunks that are encoded in one text, and bytes of texts that are cut at once; both affect speed only.
_JOINED, STEP_BYTES = 128, 4 << 20


class _Slots(dict):
    """Numbers for chunks, which are known by what follows ``before``, or by all of it from a line feed; new ones are noted for encoding."""

    def __init__(self, owner: "ChunkEncoder", before: str, known: dict[str, int] | None = None):
        super().__init__(known or {})
        self.owner, self.before = owner, before

    def __missing__(self, piece: str) -> int:
        owner = self.owner
        self[piece] = slot = owner.count
        owner.count += 1
        loose = not piece or piece[-1].isspace()
        if loose:
            owner.loose.add(slot)
        feed = piece[:1] == "\n"
        chunk = piece if feed else self.before + piece
        if self.before and not loose and (feed or not piece[0].isspace()):
            owner.joined.append(chunk)
            owner.joined_slots.append(slot)
        else:
            owner.alone.append((slot, chunk))
        return slot


class ChunkEncoder:
    def __init__(self, vocabulary: str):
        self.tokenizer = Tokenizer.from_file(vocabulary)
        ids, added = self.tokenizer.get_vocab(with_added_tokens=False), self.tokenizer.get_added_tokens_decoder()
        self.bytes_of = np.zeros(max([*ids.values(), *added]) + 1, np.int64)
        for token, i in ids.items():
            self.bytes_of[i] = len(token)  # a character of the file stands for a byte
        for i, token in added.items():
            if re.search(r"\s", token.content) or token.lstrip or token.rstrip or token.single_word:
                raise ValueError(f"the added token {token.content!r} reaches over blanks, where texts are cut")
            self.bytes_of[i] = len(token.content.encode())
        self.spaced, self.plain = _Slots(self, " "), _Slots(self, "")
        self.count, self.used, self.loose = 0, 0, set()  # loose: chunks that end in white space
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start, self.length, self.seen = (np.zeros(1 << 15, np.int64) for _ in range(3))
        self._nothing_new()

    def _nothing_new(self) -> None:
        self.joined: list[str] = []
        self.joined_slots: list[int] = []
        self.alone: list[tuple[int, str]] = []

    def _forget(self) -> None:
        """Keep the chunks that came up more than once lately, or none if these are too many."""
        kept = np.flatnonzero(self.seen[:self.count] > 1)
        kept = kept if len(kept) < REMEMBERED // 2 else kept[:0]
        number = np.full(self.count, -1)
        number[kept] = np.arange(len(kept))
        place = number.tolist()
        renamed = lambda old: {p: n for p, slot in old.items() if (n := place[slot]) >= 0}
        self.spaced, self.plain = _Slots(self, " ", renamed(self.spaced)), _Slots(self, "", renamed(self.plain))
        self.loose = {place[slot] for slot in self.loose if place[slot] >= 0}
        sizes = self.length[kept]
        ids = self.ids[ragged(self.start[kept], sizes)]
        self.ids[:len(ids)], self.used, self.count = ids, len(ids), len(kept)
        self.start[:len(kept)], self.length[:len(kept)] = np.cumsum(sizes) - sizes, sizes
        self.seen[:] = 0

    def _chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(chunks of all texts, how many each has).  A text's first has no blank before it, and is none if the text begins with one.

        A blank is put before each line feed but those that follow another or a carriage return; where white space stood
        before it, an empty piece or one that ends in white space tells.
        """
        for old, new in (("\n", " \n"), ("\r \n", "\r\n"), ("\n \n", "\n\n"), ("\n \n", "\n\n")):
            texts = pc.replace_substring(texts, old, new)
        split = pc.split_pattern(texts, " ")
        many, pieces = np.array(pc.list_value_length(split)).astype(np.int64), split.flatten()
        first, chunks = np.cumsum(many) - many, np.empty(len(pieces), np.int64)
        later = np.ones(len(pieces), bool)
        later[first] = False
        found = pieces.filter(pa.array(later)).dictionary_encode()
        slots = np.fromiter(map(self.spaced.__getitem__, found.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(found.dictionary))
        chunks[later] = slots[np.array(found.indices)]
        chunks[first] = [self.plain[piece] if piece else -1 for piece in pieces.take(pa.array(first)).to_pylist()]
        none = chunks[first] < 0
        return chunks[chunks >= 0], many - none

    def _careful(self, text: str) -> list[int]:
        """As ``_chunks`` for a text with white space before a blank, where it isn't cut."""
        return [self.plain[c] for c in _CUT.split(text) if c]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _keep(self, slots: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.start[slots], self.length[slots] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)

    def _learn(self) -> None:
        """Encode the new chunks: in one call those that a joined text falls apart into again, the others one by one."""
        while self.count > len(self.start):
            self.start, self.length, self.seen = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.length, self.seen))
        for at in range(0, len(self.joined), _JOINED):
            chunks = self.joined[at:at + _JOINED]
            ids = self._ids("".join(chunks))
            ends = np.cumsum(np.array(pc.binary_length(pa.array(chunks, pa.string()))), dtype=np.int64)
            upto = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
            self._keep(np.array(self.joined_slots[at:at + _JOINED]), ids, np.diff(upto, prepend=0))
        for slot, chunk in self.alone:
            ids = self._ids(chunk)
            self._keep(np.array([slot]), ids, np.array([len(ids)]))
        self._nothing_new()

    def encode(self, texts: pa.Array | list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids as one array and the offsets of the texts, null being empty; ``end_id`` closes each text."""
        if self.count > REMEMBERED:
            self._forget()
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        chunks, many = self._chunks(texts)
        if self.loose:
            loose = np.zeros(self.count, bool)
            loose[list(self.loose)] = True
            before = loose[chunks]
            before[np.cumsum(many)[many > 0] - 1] = False  # white space at the end of a text does no harm
            if before.any():
                slots = np.split(chunks, np.cumsum(many)[:-1])
                for i in np.unique(np.repeat(np.arange(len(texts)), many)[before]).tolist():
                    slots[i] = np.array(self._careful(texts[i].as_py()), np.int64)
                many, chunks = np.array([len(s) for s in slots], np.int64), np.concatenate(slots)
        self._learn()
        self.seen[:self.count] += np.bincount(chunks, minlength=self.count)
        sizes = self.length[chunks]
        ids = self.ids[ragged(self.start[chunks], sizes)]
        per_text = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(many)])]
        if end_id is None:
            return ids, per_text
        return np.insert(ids, per_text[1:], end_id).astype(np.uint32), per_text + np.arange(len(per_text))


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> ChunkEncoder:
    return ChunkEncoder(vocabulary)
