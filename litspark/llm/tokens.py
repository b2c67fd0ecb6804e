"""Token ids of whole text columns by a public tokenizer, one encoding per distinct piece.

For a tokenizer that lower-cases, drops white space and never merges across the
pieces of its splitting pattern, the ids of a text are the ids of its pieces in
turn. Arrow splits texts into words and distinct words into pieces; a
task encodes a piece once, many in one call, and keeps a bounded cache. Words
with signs outside ``_PLAIN`` go to the tokenizer as they are.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_PIECES = 250_000
#: Longer pieces are encoded each time, so that the cache stays bounded in bytes.
CACHED_CHARS = 48
_JOINED = 1000
#: Signs whose case, form and class are the same everywhere.
_LETTERS = "^[a-zß-öø-ÿ]+$"
_PLAIN = "^[!-~À-ÖØ-öø-ÿ“”‘’–—…«»]*$"
#: The tokenizer's own splitting pattern (a fixed value).
_PIECES = r"('s|'t|'re|'ve|'m|'ll|'d|\pL+|\pN|[^\s\pL\pN]+)"


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``flat[start:start + length]``, one after the other."""
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(n, len(flat)) < 1 << 31 else np.int64
    at = np.arange(n, dtype=kind)
    at -= np.repeat((ends - lengths - starts).astype(kind), lengths)
    return flat[at]


class _Table:
    """Id runs by number, growing."""

    def __init__(self) -> None:
        self.flat, self.starts, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])


class WordEncoder:
    """Flat ids and row offsets of string columns; ``end_id`` closes every row."""

    def __init__(self, name: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        vocab = self._tokenizer.get_vocab()
        self._closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self._closes[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self._numbers: dict[str, int] = {}
        self._known = _Table()

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        runs = [e.ids for e in self._tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for r in runs for i in r], dtype=np.uint32), np.array([len(r) for r in runs], dtype=np.int64)

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each piece ends with a closing token, so many can share a call."""
        flat, lengths = [], []
        for lo in range(0, len(pieces), _JOINED):
            part = pieces[lo:lo + _JOINED]
            ids = np.array(self._tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            n = np.diff(np.flatnonzero(self._closes[ids]), prepend=-1)
            if len(n) != len(part) or n.sum() != len(ids):
                ids, n = self._whole(part)
            flat.append(ids)
            lengths.append(n)
        return np.concatenate(flat), np.concatenate(lengths)

    def _pieces(self, pieces: list[str]) -> tuple[_Table, np.ndarray]:
        """A table with the ids of the pieces, and each piece's number in it."""
        if len(self._numbers) > CACHE_PIECES:
            self._numbers, self._known = {}, _Table()
        numbers = self._numbers
        new = [p for p in pieces if p not in numbers]
        if not new:
            return self._known, np.fromiter((numbers[p] for p in pieces), np.int64, len(pieces))
        flat, lengths = self._joined(new)
        short = np.fromiter((len(p) <= CACHED_CHARS for p in new), bool, len(new))
        starts = np.cumsum(lengths) - lengths
        at = len(self._known.lengths)
        self._known.add(_gather(flat, starts[short], lengths[short]), lengths[short])
        numbers.update((p, at + i) for i, p in enumerate(p for p, s in zip(new, short) if s))
        if short.all():
            return self._known, np.fromiter((numbers[p] for p in pieces), np.int64, len(pieces))
        table, at = _Table(), len(self._known.lengths)
        table.flat, table.starts, table.lengths = self._known.flat, self._known.starts, self._known.lengths
        table.add(_gather(flat, starts[~short], lengths[~short]), lengths[~short])
        here = {p: at + i for i, p in enumerate(p for p, s in zip(new, short) if not s)}
        return table, np.fromiter((numbers[p] if p in numbers else here[p] for p in pieces), np.int64, len(pieces))

    def _words(self, words: pa.Array) -> _Table:
        """Ids of distinct words, by their place."""
        plain = pc.and_(pc.match_substring_regex(words, _PLAIN), pc.invert(pc.match_substring(words, "<|")))
        is_plain = plain.to_numpy(zero_copy_only=False)
        lower = pc.utf8_lower(words.filter(plain))
        # Only words of more than letters have more than one piece.
        mixed = pc.invert(pc.match_substring_regex(lower, _LETTERS))
        cut = pc.utf8_rtrim_whitespace(pc.replace_substring_regex(lower.filter(mixed), _PIECES, r"\1 "))
        split = pc.ascii_split_whitespace(pc.replace_with_mask(lower, mixed, cut))
        found = split.flatten().dictionary_encode()
        table, numbers = self._pieces(found.dictionary.to_pylist())
        piece = numbers[found.indices.to_numpy()]
        counts = np.diff(split.offsets.to_numpy())
        sizes = table.lengths[piece]
        plain_flat = _gather(table.flat, table.starts[piece], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        odd_flat, odd_lengths = self._whole(words.filter(pc.invert(plain)).to_pylist()) if not is_plain.all() else (plain_flat[:0], ends[:0])
        out = _Table()
        out.flat = np.concatenate([plain_flat, odd_flat])
        out.lengths, out.starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        out.lengths[is_plain], out.starts[is_plain] = np.diff(ends), ends[:-1]
        out.lengths[~is_plain], out.starts[~is_plain] = odd_lengths, len(plain_flat) + np.cumsum(odd_lengths) - odd_lengths
        return out

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        counts = np.diff(split.offsets.to_numpy())
        words = split.flatten().dictionary_encode()
        table = self._words(words.dictionary)
        # The end id is one more word behind each row's words.
        starts, lengths = np.append(table.starts, len(table.flat)), np.append(table.lengths, 1)
        flat = np.append(table.flat, np.uint32(end_id))
        order = np.insert(words.indices.to_numpy().astype(np.int64), np.cumsum(counts), len(words.dictionary))
        sizes = lengths[order]
        ids, rows = _gather(flat, starts[order], sizes), np.cumsum(counts + 1)
        return ids, np.concatenate([[0], np.cumsum(sizes)[rows - 1]]) if len(rows) else np.zeros(1, np.int64)
