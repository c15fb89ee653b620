"""Exact ids from the tokenizers library, which sees every distinct piece of text once per worker.

Both tokenizers cut text at blanks, and a token never reaches over such a cut. So a text's ids are
those of its pieces, and a worker keeps the ids of the pieces it has met lately: when `PIECES` are new, the
pieces before them are forgotten unless they are met again. That costs time and changes nothing.
"""
from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces of a generation; a worker remembers two, at about 200 bytes a piece in a dictionary and 40 in Arrow arrays.
PIECES = 1 << 19
#: Characters of text that are encoded at a time.
CHARS = 1 << 19
#: The same where the pieces of all of them are numbered in one pass.
MANY_CHARS = 1 << 22
#: Bytes of a piece in Arrow arrays; a longer one hardly comes again and isn't remembered.
LONGEST = 1 << 8
#: Pieces that go to the library as one text, and such texts at a time.
GROUP = 64
GROUPS = 256

_SPACE = "\\s\x1c-\x1f\x85\u180e\u200b-\u200d\u2060\ufeff"
_LONE_BLANK = re.compile(f"(?<=[^{_SPACE}]) (?=[^{_SPACE}])")
_EDGES = frozenset(c for c in map(chr, [*range(0x3001), 0xFEFF]) if re.match(f"[{_SPACE}]", c))
#: Letters and signs that neither composition nor lower case make longer or shorter in UTF-8.
_STEADY = re.compile("[\x21-\x7e\xa1-\u012f\u0131-\u017f]+")
#: The same for Arrow, after a line break or not.
_STEADY_PIECE = f"\\A\n?{_STEADY.pattern}\\z"


def slices(texts: list[str], chars: int = CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of `texts` with about `chars` characters each; a longer text is a range of its own."""
    start = total = 0
    for i, text in enumerate(texts):
        if i > start and total + len(text) > chars:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def gathered(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Small batches together, until they hold `size` bytes."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield pa.Table.from_batches(held)
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)


class Pieces:
    """The library's tokenizer, and the ids of pieces as little-endian bytes."""

    def __init__(self, path: str, suffix: str = "", limit: int = PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        size = max(names.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.names = [""] * size
        self.width = np.zeros(size, np.int64)  # bytes of text behind each id
        for name, i in names.items():
            self.names[i] = name
            plain = name if name in added else name.removesuffix(suffix) if suffix else name
            self.width[i] = len(plain.encode()) if name in added else len(plain)
        self.limit = limit
        self.memo: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids straight from the library."""
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def known(self, piece: str) -> bool:
        return piece in self.memo or piece in self.before

    def unknown(self, pieces: set[str]) -> set[str]:
        """Those that have to be learnt; what was known before is kept from now on."""
        new = pieces.difference(self.memo)
        again = {p: self.before[p] for p in new if p in self.before}
        self.memo |= again
        return new.difference(again)

    def turn(self) -> None:
        """Begin a new generation if this one is full. Not within a batch."""
        if len(self.memo) > self.limit:
            self.before, self.memo = self.memo, {}

    def learn(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """The ids of each piece. Pieces of steady width go to the library together, with blanks in between."""
        out, steady, rest = {}, [], []
        for p in pieces:
            (steady if _STEADY.fullmatch(p) else rest).append(p)
        groups = [steady[i:i + GROUP] for i in range(0, len(steady), GROUP)]
        joined = [" ".join(g) for g in groups]
        for group, text, e in zip(groups, joined, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            ends = np.cumsum(np.fromiter(map(len, text.encode().split(b" ")), np.int64, len(group)))
            reach = np.concatenate([[0], np.cumsum(self.width[ids])])
            cuts = np.searchsorted(reach, ends)
            if reach[-1] != ends[-1] or (reach[cuts] != ends).any():  # a token over a cut: never seen, never trusted
                rest += group
                continue
            at, data, size = 0, ids.tobytes(), self.dtype.itemsize
            for piece, cut in zip(group, cuts.tolist(), strict=True):
                out[piece] = data[at * size:cut * size]
                at = cut
        out.update(zip(rest, self.whole(rest), strict=True))
        return out


class BlankCut(Pieces):
    """For byte-level vocabularies, where a blank before a word belongs to the word's token.

    A text is cut before blanks that come before a character other than white space, and around each line break that
    stands alone, which is an id of its own. There the vocabulary's pattern always begins a new token. A piece
    stands for itself and the blank before it; one at the beginning of a line is written with the line break before it instead.

    The memo is two Arrow arrays, pieces and their ids. All pieces of some texts are numbered in one pass together with those
    of the memo, so Python meets a piece only when it is new.
    """

    def __init__(self, path: str, limit: int = PIECES):
        super().__init__(path, limit=limit)
        self.line_break = self.whole(["\n"])[0]
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.met = np.zeros(0, bool)  # in this generation

    def turn(self) -> None:
        if np.count_nonzero(self.met) > self.limit:
            kept = pa.array(self.met)
            self.words, self.ids = self.words.filter(kept), self.ids.filter(kept)
            self.met = np.zeros(len(self.words), bool)

    def lines(self, text: str) -> list[str]:
        """The text cut at line breaks, if all of them stand alone."""
        lines = text.split("\n")
        if len(lines) > 1 and any(not x or x[0] in _EDGES or x[-1] in _EDGES for x in lines):
            return [text]
        return lines

    def broken(self, text: str) -> str:
        """The text with blanks where it is cut, or with a blank before nothing where that can't be told from its own blanks."""
        lines = self.lines(text)
        return "\n " if len(lines) == 1 and " \n" in text else "\n" + " \n".join(lines)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        self.turn()
        parts = pc.split_pattern(pa.array(map(self.broken, texts), pa.large_string()), " ")
        out = self.joined(parts.values, parts.offsets.to_numpy())
        odd = [i for i, ids in enumerate(out) if ids is None]
        if odd:  # some blanks come before white space
            cuts = [[("" if k else "\n") + p for line in self.lines(texts[i]) for k, p in enumerate(_LONE_BLANK.split(line))] for i in odd]
            found = self.joined(pa.array(chain.from_iterable(cuts), pa.large_string()), np.cumsum([0, *map(len, cuts)]))
            for i, ids in zip(odd, found, strict=True):
                out[i] = ids
        return out

    def joined(self, pieces: pa.LargeStringArray, edges: np.ndarray) -> list[bytes | None]:
        """The ids of the texts whose pieces lie between two `edges`; None if a piece of the text has none."""
        ids = self.look_up(pieces)
        ends, data = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, ids.offset * 8), memoryview(ids.buffers()[2] or b"")
        skip = len(self.line_break)  # that of the first line
        out: list[bytes | None] = [bytes(data[a + skip:b]) for a, b in pairwise(ends[edges].tolist())]
        if ids.null_count:
            none = np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False))
            for i in np.unique(np.searchsorted(edges, none, "right") - 1).tolist():
                out[i] = None
        return out

    def look_up(self, pieces: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of each piece, null where a piece after a blank begins with white space or is empty."""
        numbered = pieces.dictionary_encode()
        words, known = numbered.dictionary, len(self.words)
        # The memo passes by the few pieces of these texts: it is the larger side, and so it isn't hashed.
        places = pc.index_in(self.words, value_set=words)
        at, here = places.filter(places.is_valid()).to_numpy(), places.is_valid().to_numpy(zero_copy_only=False)
        entry = np.full(len(words), -1, np.int64)
        entry[at] = np.flatnonzero(here)
        fresh = entry < 0
        entry[fresh] = known + np.arange(np.count_nonzero(fresh))
        new = words.filter(pa.array(fresh))
        learnt = self.learn_pieces(new)
        ids = pa.concat_arrays([self.ids, learnt])
        kept = pc.and_(learnt.is_valid(), pc.less_equal(pc.binary_length(new), LONGEST))
        self.words, self.ids = (pa.concat_arrays([old, x.filter(kept)]) for old, x in ((self.words, new), (self.ids, learnt)))
        self.met = np.concatenate([self.met | here, np.ones(len(self.words) - known, bool)])
        return ids.take(pa.array(entry)).take(numbered.indices)

    def learn_pieces(self, pieces: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of new pieces."""
        steady = pc.match_substring_regex(pieces, _STEADY_PIECE).to_numpy(zero_copy_only=False)
        ids = self.learn_steady(pieces.filter(pa.array(steady)))
        if ids is None:
            ids, steady = pa.array([], pa.large_binary()), np.zeros(len(pieces), bool)
        if steady.all():
            return ids
        others = np.flatnonzero(~steady)
        texts = pieces.take(pa.array(others)).to_pylist()
        told = [k for k, p in enumerate(texts) if p and (p[0] == "\n" or p[0] not in _EDGES)]
        heads = [texts[k][0] == "\n" for k in told]
        found: list[bytes | None] = [None] * len(texts)
        for k, head, x in zip(told, heads, self.whole([texts[k][1:] if head else " " + texts[k] for k, head in zip(told, heads, strict=True)]), strict=True):
            found[k] = self.line_break + x if head else x
        order = np.argsort(np.concatenate([np.flatnonzero(steady), others]))
        return pa.concat_arrays([ids, pa.array(found, pa.large_binary())]).take(pa.array(order))

    def learn_steady(self, pieces: pa.LargeStringArray) -> pa.LargeBinaryArray | None:
        """The ids of pieces of steady width, which go to the library together; None if a token reaches over a cut: never seen, never trusted."""
        texts = pieces.to_numpy(zero_copy_only=False).tolist()
        joined = [(" " + " ".join(texts[i:i + GROUP])).replace(" \n", "\n") for i in range(0, len(texts), GROUP)]
        found = [np.zeros(0, self.dtype)]
        for i in range(0, len(joined), GROUPS):  # the library's results are much larger than the ids
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(joined[i:i + GROUPS], add_special_tokens=False)]
            found.append(np.fromiter(chain.from_iterable(encoded), self.dtype, sum(map(len, encoded))))
        ids = np.concatenate(found)
        blanks = ~pc.starts_with(pieces, "\n").to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(pieces).to_numpy() + blanks)])
        reach = np.concatenate([[0], np.cumsum(self.width[ids])])
        cuts = np.searchsorted(reach, ends)
        if reach[-1] != ends[-1] or (reach[cuts] != ends).any():
            return None
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(texts), [None, pa.py_buffer(cuts * self.dtype.itemsize), pa.py_buffer(ids.tobytes())])


_SHARED: dict[tuple, object] = {}


def shared(kind: type, *args):
    """One object per worker process, kept from task to task."""
    key = (kind, *args)
    if key not in _SHARED:
        _SHARED[key] = kind(*args)
    return _SHARED[key]
