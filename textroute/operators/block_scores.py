"""Scores of whole texts against one block of the index, counted and ranked inside a task.

A text's tokens are looked up in the block's terms as it passes by, so neither tokens nor scores become rows: a query
leaves the task as its best chunks.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa

#: Scores, and postings that are added up to them, held at a time; a single query may have more.
CELLS = 1 << 20
#: Scope masks that a task keeps.
MASKS = 1 << 10

# Letters and digits of ASCII in lower case, everything else a blank. Two characters outside ASCII have an ASCII letter as lower case.
_TABLE = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 for c in range(256))
_KELVIN, _DOTTED_I = "K".encode(), "İ".encode()


def tokens(text: bytes) -> list[bytes]:
    """`search_tokens` of a text in UTF-8."""
    return text.replace(_KELVIN, b"k").replace(_DOTTED_I, b"i ").translate(_TABLE).split()


@dataclass
class Block:
    """Postings by term, as arrays. A slot is a chunk's place with one class, slots are ordered by place."""
    terms: list[bytes]
    starts: np.ndarray
    slots: np.ndarray
    weights: np.ndarray
    classes: np.ndarray  # of each slot
    first: np.ndarray  # slot of each place
    places: pa.Array

    @classmethod
    def of(cls, slots: pa.Table, postings: pa.Table) -> Block:
        """From `(cls, place, at, slot)`, numbered in the order of places and classes, and `(term, slot, weight)`."""
        slots = slots.sort_by("slot")
        at = slots["at"].to_numpy()
        first = np.flatnonzero(np.diff(at, prepend=-1))
        coded = postings["term"].combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        codes = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        terms = [t.encode() for t in coded.dictionary.to_pylist()]
        starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(terms)))])
        places = slots["place"].combine_chunks()
        places = places.combine_chunks() if isinstance(places, pa.ChunkedArray) else places
        return cls(terms, starts, postings["slot"].to_numpy()[order], postings["weight"].to_numpy()[order], slots["cls"].to_numpy(), first,
                   places.take(pa.array(first)))

    def mask(self, allowed: list[int] | None) -> np.ndarray:
        """The slots whose class is in a bitmap of classes."""
        words = np.array(allowed or [0], np.int64)
        word = np.minimum(self.classes // 64, len(words) - 1)
        return (words[word] >> (self.classes % 64) & 1 == 1) & (self.classes // 64 < len(words))

    def scores(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A row for each query, given its terms and their counts, a column for each slot."""
        terms = np.concatenate([t for t, _ in found])
        counts = np.concatenate([n for _, n in found])
        rows = np.repeat(np.arange(len(found)), [len(t) for t, _ in found])
        sizes = self.starts[terms + 1] - self.starts[terms]
        at = np.repeat(self.starts[terms] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        cells = np.repeat(rows * len(self.classes), sizes) + self.slots[at]
        flat = np.bincount(cells, np.repeat(counts, sizes) * self.weights[at], minlength=len(found) * len(self.classes))
        return flat.astype(np.float64).reshape(len(found), len(self.classes))  # integers if there is nothing to add up

    def best(self, found: list[tuple[np.ndarray, np.ndarray]], masks: list[np.ndarray], leads: list[int], k: int, digits: int) -> pa.Array:
        """Each query's best `k` places as `(o, place, score)`: those of its scope by score, equal ones in the order of places.

        `leads` is where a query's scopes begin. Its scores are those in the first one; the others add their places without a
        score, if they have fewer than `k` with one.
        """
        scores, mask = self.scores(found), np.stack(masks)
        if len(self.first) < len(self.classes):
            scores = np.add.reduceat(np.where(mask, scores, 0.0), self.first, axis=1)
            mask = np.logical_or.reduceat(mask, self.first, axis=1)
        if len(leads) < len(found):
            short = (mask & (scores > 0)).sum(axis=1) < k
            others = np.logical_or.reduceat(mask & short[:, None], leads, axis=0)
            scores, mask = np.where(mask, scores, 0.0)[leads], mask[leads] | others
        order = np.where(mask, -np.round(scores, digits), np.inf)
        if k < order.shape[1]:
            mask = mask & (order <= np.partition(order, k - 1, axis=1)[:, k - 1:k])
        rows, cols = np.nonzero(mask)
        ranked = np.lexsort((cols, order[rows, cols], rows))
        starts = np.searchsorted(rows, np.arange(len(leads) + 1))
        ranked = ranked[np.arange(len(rows)) - starts[rows] < k]
        rows, cols = rows[ranked], cols[ranked]
        items = pa.StructArray.from_arrays(
            [pa.array(order[rows, cols]), self.places.take(pa.array(cols)), pa.array(scores[rows, cols])], ["o", "place", "score"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(len(leads) + 1)).astype(np.int32)), items)


def best_of(block: Block, k: int, digits: int):
    """A map over Arrow batches of `(query_id, scope, allowed, text)`, ordered by id, to `(query_id, best)`.

    Rows of one id are one query, those of one id and scope one text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(block.terms)}.get
        per_term, masks = np.diff(block.starts), {}
        none = pa.list_(pa.struct([("o", pa.float64()), ("place", block.places.type), ("score", pa.float64())]))
        ids, leads, found, wanted, held = [], [], [], [], 0
        scopes, kind = {}, None  # scopes of the last id, and where they are in `found`

        def flush() -> pa.RecordBatch:
            best = block.best(found, wanted, leads, k, digits) if len(block.classes) else pa.array([[]] * len(ids), none)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), best], ["query_id", "best"])

        for batch in batches:
            kind = batch["query_id"].type
            for i, (query, s) in enumerate(zip(batch["query_id"].to_pylist(), batch["scope"].to_pylist(), strict=True)):
                if ids and query != ids[-1] and (held > CELLS or len(found) * len(block.classes) > CELLS):
                    yield flush()
                    ids, leads, found, wanted, held = [], [], [], [], 0
                if not ids or query != ids[-1]:
                    ids.append(query)
                    leads.append(len(found))
                    scopes = {}
                words = tokens(batch["text"][i].as_py() or b"")
                known = np.fromiter(map(number, words, repeat(-1)), np.int64, len(words))
                terms, counts = np.unique(known[known >= 0], return_counts=True)
                if s in scopes:
                    before = found[scopes[s]]
                    terms, at = np.unique(np.concatenate([before[0], terms]), return_inverse=True)
                    counts = np.bincount(at, np.concatenate([before[1], counts]), minlength=len(terms)).astype(np.int64)
                    held += int(per_term[terms].sum() - per_term[before[0]].sum())
                    found[scopes[s]] = terms, counts
                    continue
                if s not in masks:
                    if len(masks) >= MASKS:
                        masks.clear()
                    masks[s] = block.mask(batch["allowed"][i].as_py())
                scopes[s] = len(found)
                found.append((terms, counts))
                wanted.append(masks[s])
                held += int(per_term[terms].sum())
        if ids:
            yield flush()
    return run
