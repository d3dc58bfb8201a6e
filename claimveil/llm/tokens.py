"""Token ids of whole texts by a public tokenizer, each distinct piece of text encoded once.

A text is cut only where the tokenizer itself always cuts, so that the pieces' ids, joined, are the text's ids: before a
single space or line feed between other characters, and before a full stop or comma that follows a letter or digit.
Byte-level BPE starts a new unit at each of these, and word-end BPE neither normalises nor merges across them. Texts with
other white space, runs of it, or punctuation before a full stop are cut by a slower pattern; texts that hold a special
token's string or a NUL are encoded whole.

Batches are cut and their pieces numbered as whole Arrow columns; the ids of all pieces are then gathered by one index.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import slices

#: White space as the tokenizers see it (Unicode's White_Space), which differs from str.isspace().
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SLOW = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")
#: What the quick cuts can't take: runs of spaces and line feeds, rarer white space, or a full stop or comma after something
#: other than a letter or digit. In Arrow's syntax.
RARE = r"  |\n\n| \n|\n |[\t\v\f\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
STOP = r"[^A-Za-z0-9\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}][.,]"
#: Distinct pieces that a worker keeps, and their bytes; beyond them it begins again, which costs time and changes nothing.
KEPT, KEPT_BYTES = 200_000, 32 << 20
#: Pieces that are encoded in one line, and bytes of text that are cut at a time.
TOGETHER, SLICE = 64, 8 << 20


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... up to each count, one after the other."""
    out = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    out += np.arange(len(out))
    return out


class Encoder:
    """Ids of texts as unsigned 32-bit integers."""

    def __init__(self, path: str, kept: int = KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept = kept
        vocabulary = self.tokenizer.get_vocab()
        self.bytewise = self.tokenizer.normalizer is None
        #: Tokens with which a byte-level piece begins, or a word ends.
        self.marks = np.zeros(max(vocabulary.values()) + 1, bool)
        self.marks[[k for t, k in vocabulary.items() if (t[0] == "Ġ" if self.bytewise else t.endswith("</w>"))]] = True
        self._forget()

    def _forget(self) -> None:
        #: Pieces known so far; of each, where its ids begin in ``flat`` and how many there are.
        self.pieces = pa.array([], pa.large_string())
        self.starts, self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, pieces: pa.Array) -> None:
        """Encodes pieces that begin with a space in joined lines and finds each one's ids by the marks; others one by one."""
        plain = pc.match_substring_regex(pieces, "^ [^ ]" if self.bytewise else r"^ \pL+$")
        joined, alone = pieces.filter(plain), [pieces.filter(pc.invert(plain))]
        cuts = np.append(np.arange(0, len(joined), TOGETHER), len(joined))
        lines = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), joined), pa.scalar("", pa.large_string()))
        told = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines.to_pylist(), add_special_tokens=False)] if len(joined) else []
        marked = [self.marks[x] for x in told]
        bad = np.array([m.sum() for m in marked], np.int64) != np.diff(cuts)  # a letter that normalises to a word's end
        for k in np.flatnonzero(bad).tolist():
            alone.append(joined.slice(cuts[k], cuts[k + 1] - cuts[k]))
            told[k], marked[k] = told[k][:0], marked[k][:0]
        if bad.any():
            joined = joined.filter(pa.array(np.repeat(~bad, np.diff(cuts))))
        ids, at = np.concatenate([self.flat[:0], *told]), np.flatnonzero(np.concatenate([np.zeros(0, bool), *marked]))
        ends = np.append(at[1:], len(ids)) if self.bytewise else at + 1
        counts = np.diff(ends[: len(joined)], prepend=0)
        alone = pa.concat_arrays(alone)
        single = self.whole(alone.to_pylist())
        counts = np.concatenate([counts, np.array([len(x) for x in single], np.int64)])
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(counts) - counts)
        self.counts = np.append(self.counts, counts)
        self.flat = np.concatenate([self.flat, ids, *single])
        self.pieces = pa.concat_arrays([self.pieces, joined, alone])

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """Each piece's number among those known; new ones are learned."""
        told = pieces.dictionary_encode()
        if len(self.pieces) > self.kept or self.pieces.nbytes > KEPT_BYTES:
            self._forget()
        number = pc.index_in(told.dictionary, value_set=self.pieces)
        if number.null_count:
            self._learn(told.dictionary.filter(pc.is_null(number)))
            number = pc.index_in(told.dictionary, value_set=self.pieces)
        return number.to_numpy(zero_copy_only=False)[told.indices.to_numpy(zero_copy_only=False)]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids side by side, and where each text's end; null: none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        ids, ends, size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        for a, b in slices(pc.binary_length(texts).to_pylist(), SLICE):
            told, upto = self._some(texts.slice(a, b - a))
            ids.append(told)
            ends.append(upto + size)
            size += len(told)
        return np.concatenate(ids), np.concatenate(ends)

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring(texts, "\0")
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd_at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        told = pc.replace_with_mask(texts, odd, pa.scalar("", pa.large_string())) if len(odd_at) else texts
        slow = pc.or_(pc.match_substring_regex(told, RARE), pc.match_substring_regex(told, STOP))
        cut = told
        for mark in (" ", "\n", ",", "."):
            cut = pc.replace_substring(cut, mark, "\0" + mark)
        if slow.true_count:
            cut = pc.replace_with_mask(cut, slow, pa.array(["\0".join(SLOW.findall(t)) for t in told.filter(slow).to_pylist()], pa.large_string()))
        cut = pc.split_pattern(cut, "\0")
        number = self._numbers(cut.flatten())
        counts = self.counts[number]
        ids = self.flat[gather(self.starts[number], counts)]
        upto = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        ends = np.concatenate(([0], np.cumsum(counts)))[upto[1:]]
        if len(odd_at):
            parts = np.split(ids, ends[:-1])
            for k, found in zip(odd_at, self.whole(texts.take(pa.array(odd_at)).to_pylist())):
                parts[k] = found
            ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return ids, ends

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; null: none."""
        ids, ends = self.column(pa.array(list(texts), pa.large_string()))
        return [x.astype("<u4").tobytes() for x in np.split(ids, ends[:-1])] if len(ends) else []


def with_end(ids: np.ndarray, ends: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts, each with an id more at its end."""
    return np.insert(ids, ends, end), ends + np.arange(1, len(ends) + 1)


def encoder(path: str) -> Encoder:
    """This worker's encoder, kept between tasks."""
    kept = sys.modules[__name__].__dict__.setdefault("_ENCODERS", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
