"""Repeated word sequences, found by recompression.

Rounds name runs and pairs of symbols. Names are 64-bit fingerprints of what they stand for, so equal runs and
pairs get equal names in every task without a dictionary to exchange; a bit of each name, new in every round,
says whether it is the left or the right half of pairs. Lengths are capped per round, so whether a symbol
begins at a place depends on at most ``MARGIN`` words before and after it: equal sequences have the same symbols
inside, whatever surrounds them. Of the symbols inside each window, the one with the least name is its key;
shared keys reveal repeats, and fingerprints of the whole content verify them (``_repeats``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasieve.llm._keys import KEY, own_keys, with_ids
from contrasieve.llm._repeats import repeated_windows, unpack, windows_of
from contrasieve.llm._scan import NO_ID, Rolling, mix, sliding_min, word_hashes, words
from contrasieve.llm.suffix_dedup import cover

#: Longest run and longest pair of each round, in words. What decides a boundary lies within 2 words of it after
#: the runs of round 1, within 2 + 2 after its pairs (of symbols up to 2) and within 4 + 3 after those of round 2.
ROUNDS = ((2, 3), (0, 4))
MARGIN, LONGEST = 7, 4
_PLACE = np.uint64((1 << 28) - 1)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def join_runs(name, start, size, text, cap: int):
    """Name each longest run of two or more equal symbols of one text, if it has at most ``cap`` words."""
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(name)))
    fits = (count > 1) & (count * size[head] <= cap)
    keep = new | np.repeat(~fits, count)
    name = name.copy()
    name[head[fits]] = mix(name[head[fits]] * _ODD + count[fits].astype(np.uint64))
    size = size.copy()
    size[head[fits]] *= count[fits]
    return name[keep], start[keep], size[keep], text[keep]


def join_pairs(name, start, size, text, cap: int, turn: int):
    """Name each left symbol with the right symbol after it, if both together have at most ``cap`` words."""
    if len(name) < 2:
        return name, start, size, text
    right = (mix(name + np.uint64((turn + 1) * int(_ODD) % (1 << 64))) & np.uint64(1)) == 1
    pair = np.flatnonzero(~right[:-1] & right[1:] & (text[1:] == text[:-1]) & (size[1:] + size[:-1] <= cap))
    keep = np.ones(len(name), bool)
    keep[pair + 1] = False
    name, size = name.copy(), size.copy()
    name[pair] = mix(mix(name[pair] + np.uint64(turn)) * _ODD + name[pair + 1])
    size[pair] += size[pair + 1]
    return name[keep], start[keep], size[keep], text[keep]


def symbols(tokens: np.ndarray, text: np.ndarray):
    """Names, first words and lengths of the symbols after all rounds."""
    state = (tokens, np.arange(len(tokens)), np.ones(len(tokens), np.int64), text)
    for turn, (runs, pairs) in enumerate(ROUNDS):
        if runs:
            state = join_runs(*state, runs)
        state = join_pairs(*state, pairs, turn)
    return state[:3]


def symbol_runs(length: int):
    """Runs of windows by the symbol that they share, for ``repeated_windows``."""
    region = length - 2 * MARGIN - LONGEST + 1  # where a symbol can begin and lie wholly inside the margins
    if region < LONGEST:
        raise ValueError(f"windows of fewer than {2 * MARGIN + 2 * LONGEST - 1} words may hold no whole symbol")

    def runs(data: np.ndarray, bounds: np.ndarray):
        begin, end, first_word = words(data, bounds)
        n = len(begin) - length + 1
        if n <= 0:
            none = np.zeros(0, np.int64)
            return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
        tokens = word_hashes(data, begin, end)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(first_word))
        name, start, _ = symbols(tokens, text)
        key = np.full(len(tokens), np.iinfo(np.uint64).max, np.uint64)
        key[start] = (name & ~_PLACE) | start.astype(np.uint64)
        names = np.zeros(len(tokens), np.uint64)
        names[start] = name
        least = sliding_min(key, region)[MARGIN : MARGIN + n]
        at = (least & _PLACE).astype(np.int64)
        valid = np.arange(length, length + n) <= first_word[1:][text[:n]]
        change = np.ones(n, bool)
        change[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(change)
        last = np.append(first[1:], n)
        keep = valid[first]
        first, last = first[keep], last[keep]
        content = Rolling(tokens, 1).of(first, last - 1 + length)
        row = text[first]
        return row, first - first_word[row], last - first, names[at[first]], mix(content)

    return runs


WINDOW_BYTES = 10


def window_units(length: int):
    """Every window of a text as a fingerprint of 80 bits (those of keys with few contents add the key's 64)."""

    def units(data: np.ndarray) -> np.ndarray:
        begin, end, _ = words(data, np.array([0, len(data)]))
        tokens = word_hashes(data, begin, end) if len(begin) else np.zeros(0, np.uint64)
        one, two = (mix(Rolling(tokens, k).every(length)) for k in (0, 1))
        both = np.empty((len(one), WINDOW_BYTES), np.uint8)
        both[:, :8] = one.view(np.uint8).reshape(-1, 8)
        both[:, 8:] = two.view(np.uint8).reshape(-1, 8)[:, : WINDOW_BYTES - 8]
        return both

    return units


def fingerprints(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = np.zeros((len(units), 16), np.uint8)
    wide[:, :WINDOW_BYTES] = units
    both = wide.view(np.uint64)
    return both[:, 0].copy(), both[:, 1].copy()


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """Remove each word covered by ``length`` words that also occur in an earlier document.

    Earlier: with a smaller id, or with the same id where it stands before.

    A word is a longest run of bytes other than 0x20 and 0x09 to 0x0D, unchanged. Windows are judged on the
    input. Returns ``id_col``, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and
    kept: the text without the removed words and the white space after each; untouched where nothing is removed.
    Null text has no words, and kept is empty. Null ids come before all others and return as null. Rows that
    share an id are documents of their own, in an order that is fixed once (see ``own_keys``).
    Other columns are ignored.
    """
    if (keyed := own_keys(docs.select(id_col, text_col), id_col, text_col)) is not None:
        return with_ids(drop_repeats(keyed, KEY, text_col, length), keyed, id_col, KEY).withColumnRenamed(KEY, id_col)
    units = window_units(length)
    spans, texts = repeated_windows(docs, id_col, text_col, symbol_runs(length), units, WINDOW_BYTES, fingerprints, 1, same_doc=False)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for doc, size, body, found in zip(batch["doc"].to_pylist(), batch["size"].to_pylist(), batch["body"], batch["spans"]):
                data = unpack(size, body.as_py())
                begin, end, _ = words(data, np.array([0, size]))
                gone = np.zeros(len(begin), bool)
                if found.is_valid:
                    one, _ = fingerprints(units(data))
                    at = windows_of(found)
                    every = np.flatnonzero(np.isin(one, one[at[at < len(one)]]))
                    gone = cover(len(begin), every, length)
                out.append((doc, len(begin), int(gone.sum()), *_kept(data, begin, end, gone)))
                held += size
                if held > 1 << 20 or len(out) >= 256:
                    yield _rows(out)
                    out, held = [], 0
            if out:
                yield _rows(out)

    joined = texts.join(spans, "doc", "left")
    done = joined.mapInArrow(finish, "doc bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
    return done.select(F.nullif("doc", F.lit(NO_ID)).alias(id_col), "n_words", "n_removed", "kept_sha256", "kept")


def _kept(data: np.ndarray, begin: np.ndarray, end: np.ndarray, gone: np.ndarray) -> tuple[str, str]:
    plain = data.tobytes()
    if gone.any():
        nexts = np.append(begin[1:], len(data))
        step = np.zeros(len(data) + 1, np.int32)
        np.add.at(step, begin[gone], 1)
        np.add.at(step, nexts[gone], -1)
        plain = data[np.cumsum(step)[:-1] == 0].tobytes()
    return hashlib.sha256(b" ".join(plain.translate(_BLANK).split())).hexdigest(), plain.decode("utf-8", "replace")


#: ``bytes.split`` also cuts at no other bytes than these six.
_BLANK = bytes(0x20 if 0x09 <= b <= 0x0D else b for b in range(256))


def _rows(out: list[tuple]) -> pa.RecordBatch:
    doc, n, gone, digest, kept = zip(*out)
    cols = [*(pa.array(x, pa.int64()) for x in (doc, n, gone)), pa.array(digest), pa.array(kept)]
    return pa.RecordBatch.from_arrays(cols, ["doc", "n_words", "n_removed", "kept_sha256", "kept"])
