"""Encoding texts by words that a worker remembers.

The byte-level pattern of both tokenizers always ends a match between letters
and the marks behind them, before and behind a single line break, and before a
single space between two characters that are not white space (a token reaches
over a space only by starting with it). There a text can be cut: the ids of
the whole are the ids of the words in a row. Words repeat (Zipf). Arrow cuts a
batch's texts and numbers their words; only the distinct ones are looked up,
and Arrow puts the results together again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space by Unicode's or by Python's definition.
_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_TWO_SPACES = f"[{_SPACE}]{{2}}"
_SINGLE_SPACE = f"([^{_SPACE}])( [^{_SPACE}])"
_SINGLE_BREAK = f"([^{_SPACE}])\n([^{_SPACE}])"
#: Latin letters, which are letters in every version of Unicode, and ASCII marks behind them.
_LETTER_MARK = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([!-/:-@\[-`{-~])"
#: Where texts are cut.
_CUT = "\0"


def _cut_plain(texts: pa.Array) -> pa.Array:
    """Lists of words of texts without two white spaces in a row, or a space at an end."""
    texts = pc.replace_substring(pc.replace_substring(texts, " ", _CUT + " "), "\n", f"{_CUT}\n{_CUT}")
    return pc.split_pattern(pc.replace_substring_regex(texts, _LETTER_MARK, rf"\1{_CUT}\2"), _CUT)


def _cut_any(texts: pa.Array) -> pa.Array:
    """Lists of words of texts without the cut character; a pass takes every second of two places a character apart."""
    for _ in range(2):
        texts = pc.replace_substring_regex(texts, _SINGLE_SPACE, rf"\1{_CUT}\2")
    for _ in range(2):
        texts = pc.replace_substring_regex(texts, _SINGLE_BREAK, f"\\1{_CUT}\n{_CUT}\\2")
    return pc.split_pattern(pc.replace_substring_regex(texts, _LETTER_MARK, rf"\1{_CUT}\2"), _CUT)


def cut(texts: pa.Array, whole: tuple[str, ...] = ()) -> tuple[pa.Array, np.ndarray, np.ndarray | None]:
    """The words of all texts, where each text's words begin (and the last ones end), and the order of texts, if it is another.

    A text that contains one of ``whole``, or the cut character, is one word.
    """
    odd = pc.or_(pc.match_substring_regex(texts, _TWO_SPACES), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
    kinds = np.where(odd, 1, 0)
    for found in (_CUT, *whole):
        kinds = np.where(pc.match_substring(texts, found), 2, kinds)
    lists = []
    for kind, by in ((0, _cut_plain), (1, _cut_any), (2, lambda x: pa.ListArray.from_arrays(pa.array(range(len(x) + 1), pa.int32()), x))):
        if len(some := texts.filter(pa.array(kinds == kind))):
            lists.append(by(some))
    words = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.string()))
    offsets = words.offsets.to_numpy()
    order = None if len(lists) < 2 else np.argsort(np.argsort(kinds, kind="stable"), kind="stable")
    return words.flatten(), offsets - offsets[:1], order


class Recall:
    """Values of keys, computed together and remembered for a while.

    Two generations of at most ``limit`` keys are kept: what is met again
    moves to the younger one, and what has not been met for a generation is
    forgotten. Long keys are not remembered.
    """

    LONG = 64

    def __init__(self, compute: Callable[[list[str]], list], limit: int):
        self.compute, self.limit = compute, limit
        self.young: dict = {}
        self.old: dict = {}

    def __call__(self, wanted: list[str]) -> list:
        """The values of keys that differ from each other."""
        found = list(map(self.young.get, wanted))
        missing = [i for i, value in enumerate(found) if value is None]
        if missing:
            get, new = self.old.get, []
            for i in missing:
                value = found[i] = get(wanted[i])
                if value is None:
                    new.append(i)
            for start in range(0, len(new), 20_000):
                part = new[start : start + 20_000]
                for i, value in zip(part, self.compute([wanted[i] for i in part]), strict=True):
                    found[i] = value
            if len(self.young) + len(missing) > self.limit:
                self.old, self.young = self.young, {}
            self.young.update((wanted[i], found[i]) for i in missing if len(wanted[i]) <= self.LONG)
        return found


class WordEncoder:
    """Texts to the bytes of their words in a row, such as ids.

    ``encode`` turns a list of words into as many byte strings, or into pairs
    of them where ``pairs``; as many words as ``limit`` says are remembered in
    each of two generations. Texts that contain one of ``whole`` aren't cut.
    """

    def __init__(self, encode: Callable[[list[str]], list], limit: int, pairs: bool = False, whole: tuple[str, ...] = ()):
        self.pairs, self.whole, self.values = pairs, whole, Recall(encode, limit)

    def __call__(self, texts: pa.Array) -> list[pa.Array]:
        """One array of bytes, or two, one value a text; null texts are empty ones."""
        words, offsets, order = cut(pc.fill_null(texts, ""), self.whole)
        coded = words.dictionary_encode()
        values = self.values(coded.dictionary.to_pylist())
        out = []
        for each in zip(*values, strict=True) if self.pairs and values else [values] * (1 + self.pairs):
            each = pa.array(each, pa.binary()).take(coded.indices)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each), b"")
            out.append(joined if order is None else joined.take(pa.array(order)))
        return out


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that the texts of a slice have about ``size`` bytes together, or are one."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(lengths), 0
        while at < len(batch):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, stop - at)
            at = stop
