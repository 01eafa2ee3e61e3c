"""Token ids of whole Arrow columns by the tokenizers library.

A text is cut wherever white space follows something else, and where one of ``.,;:!?#$%&*()`` follows a letter of
ASCII or Latin-1. Both public vocabularies start a new token there whatever comes next, so a piece has the same ids
wherever it stands. Each distinct piece of a slice is encoded once, and the pieces met so far stay in a table of the
Python process, of a fixed size.

Where a vocabulary marks the ends of words, pieces of white space and letters are encoded many in one text, which takes
half the time: as many end marks as pieces means one word a piece, whose ids end at its mark. A text with another
number of marks is encoded piece by piece.
"""

from __future__ import annotations

import os
import sys
import types
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from contrasieve.llm._scan import raw

REMEMBERED = 1_000_000
BATCH = 1 << 14
#: Pieces encoded in one text.
JOINED = 64
SLICE = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?#$%&*()")] = True
_WIDE = np.zeros(256, bool)
_WIDE[[0xE1, 0xE2, 0xE3]] = True


def _process() -> types.ModuleType:
    """What lives as long as the Python process: functions travel by value, so a module of theirs would not."""
    return sys.modules.setdefault("_contrasieve_process", types.ModuleType("_contrasieve_process"))


def pieces(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces begin, with the end of the data. White space after a wide white space is no cut."""
    space = _SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        last, second, third = data[at - 1], data[np.maximum(at, 2) - 2], data[np.maximum(at, 3) - 3]
        # the byte before ends a character that may be a wide space
        wide = (at > 1) & (second == 0xC2) & ((last == 0x85) | (last == 0xA0)) | (at > 2) & _WIDE[third]
        cut[at[~wide]] = True
        stop = np.flatnonzero(_STOP[data[1:]]) + 1
        last = data[stop - 1]
        latin = (stop > 1) & (data[np.maximum(stop, 2) - 2] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
        cut[stop[_LETTER[last] | latin]] = True
    cut[bounds] = True
    cut[len(data)] = True
    return np.flatnonzero(cut)


def _word_ends(tokenizer) -> np.ndarray | None:
    """Which ids end a word, if the vocabulary says so."""
    mark = getattr(tokenizer.model, "end_of_word_suffix", None)
    if not mark:
        return None
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    last = np.zeros(max(vocabulary.values()) + 1, bool)
    last[[k for word, k in vocabulary.items() if word.endswith(mark)]] = True
    return last


def _is_word(piece: str) -> bool:
    return piece[1:].isalpha() and piece[0].isspace()


class Encoder:
    """Ids of texts under one tokenizer file."""

    def __init__(self, path: str):
        made = _process().__dict__.setdefault("encoders", {})
        if path not in made:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            made[path] = types.SimpleNamespace(
                tokenizer=tokenizer, known={}, ids=np.zeros(0, np.uint32), size=np.zeros(0, np.int64), last=_word_ends(tokenizer)
            )
        self.store = made[path]

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some pieces in a row, and how many each has."""
        if self.store.last is None or len(texts) < JOINED:
            return self._one_by_one(texts)
        word = np.fromiter(map(_is_word, texts), bool, len(texts))
        order = np.concatenate([np.flatnonzero(word), np.flatnonzero(~word)])
        joined, sizes = self._in_groups([texts[k] for k in order[: word.sum()]])
        others, more = self._one_by_one([texts[k] for k in order[word.sum() :]])
        flat, size = np.concatenate([joined, others]), np.concatenate([sizes, more])
        # back in the order of the pieces
        place, turn = np.cumsum(size) - size, np.argsort(order)
        place, size = place[turn], size[turn]
        ends = np.cumsum(size)
        return flat[np.repeat(place - (ends - size), size) + np.arange(size.sum())], size

    def _in_groups(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        groups = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        ids, size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(groups), BATCH // JOINED):
            some = groups[at : at + BATCH // JOINED]
            for group, found in zip(some, self.store.tokenizer.encode_batch_fast(["".join(g) for g in some], add_special_tokens=False)):
                own = np.array(found.ids, np.uint32)
                ends = np.flatnonzero(self.store.last[own]) + 1
                if len(ends) == len(group) and ends[-1] == len(own):
                    own_size = np.diff(ends, prepend=0)
                else:
                    own, own_size = self._one_by_one(group)
                ids.append(own)
                size.append(own_size)
        return np.concatenate(ids), np.concatenate(size)

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [[e.ids for e in self.store.tokenizer.encode_batch_fast(texts[at : at + BATCH], add_special_tokens=False)] for at in range(0, len(texts), BATCH)]
        size = np.fromiter(map(len, chain.from_iterable(ids)), np.int64, len(texts))
        return np.fromiter(chain.from_iterable(chain.from_iterable(ids)), np.uint32, size.sum()), size

    def _look_up(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row of ids, and for each distinct piece its place there and its length."""
        store = self.store
        which = np.fromiter(map(store.known.get, texts, repeat(-1)), np.int64, len(texts))
        ids, size = store.ids, store.size
        new = np.flatnonzero(which < 0)
        if len(new):
            fresh, sizes = self._encode(texts[new].tolist())
            which[new] = len(size) + np.arange(len(new))
            keep = new[: REMEMBERED - len(store.known)]
            ids, size = np.concatenate([ids, fresh]), np.concatenate([size, sizes])
            store.known.update(zip(texts[keep].tolist(), which[keep].tolist()))
            store.size = size[: len(store.known)]
            store.ids = ids[: store.size.sum()]
        place = np.cumsum(size) - size
        return ids, place[which], size[which]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (unsigned 32-bit) and the n + 1 places where texts begin; null is empty."""
        data, bounds = raw(texts)
        begin = pieces(data, bounds)
        if len(begin) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        column = pa.LargeStringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = column.dictionary_encode()
        flat, place, size = self._look_up(coded.dictionary.to_numpy(zero_copy_only=False))
        which = coded.indices.to_numpy(zero_copy_only=False)
        lengths = size[which]
        ends = np.cumsum(lengths)
        out = flat[np.repeat(place[which] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        # texts begin at the first piece at or after their own place
        first = np.searchsorted(begin[:-1], bounds)
        return out, np.concatenate([[0], ends])[first]


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; a parameter everywhere, never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)
