"""TF-IDF over words and characters, kept as long `(id, block, term, ...)` tables.

Raw rows are hash-partitioned by id once and lie sorted there, so a task meets the rows of a record one after the other.
Terms are counted, weighted and normalised record by record; what many records share is added up in the task before it moves.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_tokens, words
from ..session import broadcast_if_small, materialize, spread

WORD_BLOCK, CHAR_BLOCK = "word", "char"
MIN_DF = {WORD_BLOCK: 3, CHAR_BLOCK: 5}
MAX_FEATURES = {WORD_BLOCK: 200_000, CHAR_BLOCK: 200_000}


# Records a task works on at once, terms and words it holds before it passes them on, words whose pairs are counted by number.
ROWS, HELD, WORDS, PAIRED = 256, 1 << 21, 1 << 19, 1 << 20
# A term is a number below 2^50: two words of 25 bits, or up to five characters of 10 bits, left-aligned.
_CODE, _WORD, _CHAR = 50, 25, 10
_MASK, _ODD = (1 << _CODE) - 1, 1 << 4 * _CHAR
_COUNT = 12
_MOST = (1 << _COUNT) - 1


def block_items(text: Column) -> dict[str, Column]:
    """What the terms of each block are made of: words of two or more characters, and all words with a space between."""
    return {WORD_BLOCK: word_tokens(text), CHAR_BLOCK: F.array_join(words(F.lower(text)), " ")}


class Words:
    """Words and pairs of neighbours as numbers. A frozen one knows no further words: their terms are left out.

    `sizes` tells which are wanted: 1 for words, 2 for pairs.
    """

    def __init__(self, terms: list[str] | None = None, sizes: tuple[int, ...] = (1, 2)) -> None:
        self.ids, self.frozen, self.sizes = {}, terms is not None, sizes
        for word in {w for t in terms or () for w in t.split(" ")}:
            self.ids[word] = len(self.ids) + 1

    def full(self) -> bool:
        return len(self.ids) >= WORDS

    def code(self, term: str) -> int:
        first, *rest = [self.ids.get(w, 0) for w in term.split(" ")]
        return first if not rest else first << _WORD | rest[0] if len(rest) == 1 else 0

    def codes(self, items: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """`(row, code)` of every term, repeats included."""
        sizes = pc.fill_null(pc.list_value_length(items), 0).to_numpy()
        row, flat = np.repeat(np.arange(len(items)), sizes), items.flatten().dictionary_encode()
        known, said = self.ids, flat.dictionary.to_pylist()
        numbers = np.array([known.get(w, 0) if self.frozen else known.setdefault(w, len(known) + 1) for w in said], np.int64)
        at = numbers[flat.indices.to_numpy()] if len(flat) else np.array([], np.int64)
        one = at > 0 if 1 in self.sizes else np.zeros(len(at), bool)
        together = (row[1:] == row[:-1]) & (at[1:] > 0) & (at[:-1] > 0) if 2 in self.sizes else np.zeros(max(0, len(at) - 1), bool)
        return (np.concatenate([row[one], row[1:][together]]),
                np.concatenate([at[one], (at[:-1] << _WORD | at[1:])[together]]))

    def decode(self, codes: np.ndarray) -> pa.Array:
        names = pa.array(["", *self.ids], pa.string())
        first, second = codes >> _WORD, codes & (1 << _WORD) - 1
        pairs = pc.binary_join_element_wise(names.take(pa.array(first)), names.take(pa.array(second)), " ")
        return pc.if_else(pa.array(first > 0), pairs, names.take(pa.array(second)))


class Grams:
    """3- to 5-grams of words padded with spaces as numbers; a padded word shorter than a gram size has none of that size.

    The first 1,023 characters have a number each. A gram with any other character is numbered as a whole.
    """

    def __init__(self, terms: list[str] | None = None) -> None:
        self.frozen, self.odd, self.names = terms is not None, {}, [""]
        self.place, self.chars = np.zeros(0x110000, np.int64), [0]
        if terms is not None:
            self._learn(np.unique(self._points("".join(terms))))
            for term in terms:
                if 3 <= len(term) <= 5 and not self.place[self._points(term)].all():
                    self._odd(term)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"place": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.place = np.zeros(0x110000, np.int64)
        self.place[self.chars[1:]] = np.arange(1, len(self.chars))

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le"), np.uint32)

    def _learn(self, points: np.ndarray) -> None:
        for point in points.tolist():
            if point and not self.place[point] and len(self.chars) < 1 << _CHAR:
                self.place[point] = len(self.chars)
                self.chars.append(point)

    def _odd(self, gram: str) -> int:
        if gram not in self.odd:
            self.odd[gram] = len(self.names)
            self.names.append(gram)
        return self.odd[gram]

    def full(self) -> bool:
        return len(self.odd) >= WORDS

    def code(self, term: str) -> int:
        at = self.place[self._points(term)].tolist()
        if not 3 <= len(at) <= 5 or not all(at):
            return self.odd.get(term, 0)
        return sum(x << _CHAR * (4 - i) for i, x in enumerate(at))

    def codes(self, items: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """`(row, code)` of every term, repeats included."""
        texts = [f" {t or ''} " for t in items.to_pylist()]
        text = "".join(texts)
        row, points = np.repeat(np.arange(len(texts)), [len(t) for t in texts]), self._points(text)
        at, inside = self.place[points], points != 32
        if not self.frozen and not at.all():
            self._learn(np.unique(points[at == 0]))
            at = self.place[points]
        n, rows, out = len(at), [], []
        ok = at > 0
        code, whole, known = at << 4 * _CHAR, np.ones(n, bool), ok
        for size in range(2, 6):
            if n < size:
                break
            m = n - size + 1
            # No space but at either end, so a gram doesn't leave its padded word.
            whole = whole[:m] & inside[size - 2:size - 2 + m] if size > 2 else whole[:m]
            code, known = code[:m] | at[size - 1:] << (5 - size) * _CHAR, known[:m] & ok[size - 1:]
            if size > 2:
                kept = whole & known
                rows.append(row[:m][kept])
                out.append(code[kept])
                if (not self.frozen or self.odd) and not known.all():
                    for i in np.flatnonzero(whole & ~known).tolist():
                        number = self.odd.get(text[i:i + size], 0) if self.frozen else self._odd(text[i:i + size])
                        if number:
                            rows.append(row[i:i + 1])
                            out.append(np.array([number], np.int64))
        return np.concatenate(rows or [np.array([], np.int64)]), np.concatenate(out or [np.array([], np.int64)])

    def decode(self, codes: np.ndarray) -> pa.Array:
        chars = np.array(self.chars, np.uint32)
        points = np.stack([chars[(codes >> _CHAR * (4 - i)) & (1 << _CHAR) - 1] for i in range(5)], axis=1)
        names = np.ascontiguousarray(points, "<u4").view("<U5").reshape(-1).astype(object)
        for i in np.flatnonzero(codes < _ODD).tolist():
            names[i] = self.names[codes[i]]
        return pa.array(names, pa.string())


_CODERS = {WORD_BLOCK: Words, CHAR_BLOCK: Grams}


def by_record(df: DataFrame, id_col: str, text: str, blocks: tuple[str, ...], *keep: Column) -> DataFrame:
    """`(id, items per block, kept columns)`: the rows of a record are neighbours in one task."""
    items = block_items(F.col(text))
    rows = spread(df.select(id_col, text, *keep), id_col).sortWithinPartitions(id_col)
    return rows.select(id_col, *[items[b].alias(f"_{b}") for b in blocks], *rows.columns[2:])


def id_type(df: DataFrame, id_col: str) -> str:
    return f"`{id_col}` {df.schema[id_col].dataType.simpleString()}"


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list, np.ndarray]]:
    """Few rows at a time: the rows, the ids of their records and each row's record, 0 for the one the last slice ended with."""
    last = [object()]
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            rows, ids, record = batch.slice(start, ROWS), list(last), []
            for name in rows.column(0).to_pylist():
                if name != ids[-1]:
                    ids.append(name)
                record.append(len(ids) - 1)
            last = ids[-1:]
            yield rows, ids, np.array(record, np.int64)


def counted(record: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(record, code, count)`, ascending."""
    return _split(*_runs(record << _CODE | codes))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and how often each occurs."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.concatenate([[len(keys) > 0], keys[1:] != keys[:-1]])[:len(keys)])
    return keys[starts], np.diff(starts, append=len(keys))


def _split(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return keys >> _CODE, keys & _MASK, n


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    places, where = np.unique(keys, return_inverse=True)
    return places, np.bincount(where, n, len(places)).astype(np.int64)


def renewed(coder: Words | Grams, codes: np.ndarray) -> tuple[Words | Grams, np.ndarray]:
    """A coder that knows these terms only, and their codes in it."""
    names = coder.decode(codes).to_pylist()
    new = type(coder)(names) if isinstance(coder, Grams) else Words(names, coder.sizes)
    new.frozen = False
    return new, np.array([new.code(t) for t in names], np.int64)


Terms = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def records(batches: Iterable[pa.RecordBatch], coders: list, place: Callable[[int, np.ndarray], np.ndarray] | None = None,
            ) -> Iterator[tuple[list, Terms, np.ndarray]]:
    """Records with all their rows: ids, `(record, term, count)` per block, and the sums of the columns that follow the blocks.

    `place` turns the codes of a block into numbers of its own, below 0 for terms that are left out. The record a slice
    ends with waits for the next one.
    """
    held, total, name = None, None, []
    for rows, ids, record in slices(batches):
        last, found, rest = len(ids) - 1, [], []
        kept = [c.to_numpy(zero_copy_only=False) for c in rows.columns[len(coders) + 1:]]
        sums = np.stack([np.bincount(record, c, len(ids)) for c in kept], axis=1) if kept else np.zeros((len(ids), 0))
        if total is not None:
            sums[0] += total
        total = sums[last]
        for i, coder in enumerate(coders):
            row, codes = coder.codes(rows.column(i + 1))
            at, code, n = counted(record[row], codes)
            if place:
                code = place(i, code)
                at, code, n = at[code >= 0], code[code >= 0], n[code >= 0]
            if held:
                more = (at == 0).any()
                at, code = np.concatenate([np.zeros(len(held[i][0]), np.int64), at]), np.concatenate([held[i][0], code])
                n = np.concatenate([held[i][1], n])
                if more:
                    at, code, n = _split(*_added(at << _CODE | code, n))
            done = at < last
            rest.append((code[~done], n[~done]))
            found.append((at[done], code[done], n[done]))
        start = 0 if held else 1
        if last > start:
            yield ids[start:-1], [(at - start, code, n) for at, code, n in found], sums[start:-1]
        held, name = rest, ids[-1:]
        for i, coder in enumerate(coders):
            if coder.full() and not coder.frozen:
                coders[i], codes = renewed(coder, held[i][0])
                held[i] = codes, held[i][1]
    if held:
        yield name, [(np.zeros(len(code), np.int64), code, n) for code, n in held], total[None, :]


def lists(sizes: np.ndarray, flat: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)


class Kinds:
    """Batches passed on, with the Arrow type of their first column."""

    def __init__(self, batches: Iterable[pa.RecordBatch]) -> None:
        self.batches, self.kind = batches, None

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        for batch in self.batches:
            self.kind = batch.schema.field(0).type
            yield batch


def term_arrays(df: DataFrame, id_col: str = "complaint_id", text: str = "narrative",
                blocks: tuple[str, ...] = (WORD_BLOCK, CHAR_BLOCK)) -> DataFrame:
    """`(id, block, terms)`: one row per record and block, its terms ascending with their counts `(term, tf)`."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches, coders = Kinds(batches), [_CODERS[b]() for b in blocks]
        for ids, found, _ in records(batches, coders):
            for block, coder, (at, code, n) in zip(blocks, coders, found):
                distinct, where = np.unique(code, return_inverse=True)
                names = coder.decode(distinct)
                order = pc.sort_indices(names).to_numpy()
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                by_name = np.argsort(at << _CODE | rank[where])
                flat = pa.StructArray.from_arrays([names.take(pa.array(where[by_name])), pa.array(n[by_name])], names=["term", "tf"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batches.kind), pa.array([block] * len(ids), pa.string()), lists(np.bincount(at, minlength=len(ids)), flat)],
                    names=[id_col, "block", "terms"])

    schema = f"{id_type(df, id_col)}, block string, terms array<struct<term:string,tf:bigint>>"
    return by_record(df, id_col, text, blocks).mapInArrow(count, schema)


def term_counts(df: DataFrame, id_col: str = "complaint_id", text: str = "narrative",
                blocks: tuple[str, ...] = (WORD_BLOCK, CHAR_BLOCK), keep_empty: bool = False) -> DataFrame:
    """`(id, block, term, tf)` for the chosen blocks, counted in one pass over the partitioned texts.

    Words: runs of two or more word characters and pairs of neighbours. Characters: 3- to 5-grams
    inside words padded with a space on both sides; a padded word shorter than a gram size gives no gram
    of that size. `keep_empty` keeps a row with a null term for a block without any.
    """
    inline = F.inline_outer if keep_empty else F.inline
    return term_arrays(df, id_col, text, blocks).select(id_col, "block", inline("terms"))


def text_frequencies(df: DataFrame, id_col: str = "complaint_id", text: str = "narrative",
                     blocks: tuple[str, ...] = (WORD_BLOCK, CHAR_BLOCK)) -> DataFrame:
    """`document_frequencies` of all texts, without a row per record and term.

    A task adds up what its records hold and passes it on when that is too much, so its memory doesn't grow.
    """
    return _added_up(by_record(df, id_col, text, blocks), blocks, lambda: [_CODERS[b]() for b in blocks])


def _added_up(rows: DataFrame, blocks: tuple[str, ...], make: Callable[[], list]) -> DataFrame:
    """`(block, term, df, total_tf)` of the terms that the coders know in rows of `by_record`."""
    def named(i: int, coder: Words | Grams, codes: np.ndarray) -> list[pa.Array]:
        return [pa.array([blocks[i]] * len(codes), pa.string()), coder.decode(codes)]

    counts = rows.mapInArrow(_frequencies(make, named, ["block", "term"]), "block string, term string, df bigint, total_tf bigint")
    return counts.groupBy("block", "term").agg(F.sum("df").alias("df"), F.sum("total_tf").alias("total_tf"))


def _frequencies(make: Callable[[], list], shown: Callable[[int, Words | Grams, np.ndarray], list[pa.Array]], names: list[str]):
    """A task's sums of document and total counts per term, with the columns that `shown` makes of the terms' codes."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = make()
        # The terms so far of the record a slice ended with.
        held, seen = [[] for _ in coders], [np.array([], np.int64) for _ in coders]

        def out(i: int) -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held[i]))
            code = keys >> _COUNT + 1
            starts = np.flatnonzero(np.concatenate([[len(code) > 0], code[1:] != code[:-1]])[:len(code)])
            df, tf = ((np.add.reduceat(x, starts) if len(starts) else x) for x in (keys >> _COUNT & 1, keys & _MOST))
            return pa.RecordBatch.from_arrays([*shown(i, coders[i], code[starts]), pa.array(df), pa.array(tf)], names=[*names, "df", "total_tf"])

        for rows, ids, record in slices(batches):
            for i, coder in enumerate(coders):
                row, codes = coder.codes(rows.column(i + 1))
                at, code, n = counted(record[row], codes)
                fresh = (at > 0) | ~np.isin(code, seen[i]) if record[0] == 0 else np.ones(len(at), bool)
                ended = code[at == len(ids) - 1]
                seen[i] = np.union1d(seen[i], ended) if len(ids) == 1 else ended
                # A term, whether its record is new to it, and its count in one number; larger counts take several.
                while (n > _MOST).any():
                    many = n > _MOST
                    held[i].append(code[many] << _COUNT + 1 | _MOST)
                    n = np.where(many, n - _MOST, n)
                held[i].append(code << _COUNT + 1 | fresh << _COUNT | n)
                if sum(map(len, held[i])) >= HELD:
                    yield out(i)
                    held[i] = []
                    if coder.full() and not coder.frozen:
                        coders[i], seen[i] = renewed(coder, seen[i])
        for i in range(len(coders)):
            if held[i]:
                yield out(i)
    return count


def text_vocabulary(df: DataFrame, id_col: str = "complaint_id", text: str = "narrative", blocks: tuple[str, ...] = (WORD_BLOCK, CHAR_BLOCK),
                    min_df: dict[str, int] | None = None, max_features: dict[str, int] | None = None) -> DataFrame:
    """`frequent_terms` of the texts, without counting pairs of words that can't be among them.

    A pair is in no more records than each of its words and occurs no more often. So once `max_features` words are above the
    floor, only pairs of words that occur as often as the last of these can be frequent; they are counted by number.
    """
    min_df, max_features = min_df or MIN_DF, {b: n for b, n in (max_features or MAX_FEATURES).items() if b in blocks}
    if WORD_BLOCK not in max_features:
        return frequent_terms(text_frequencies(df, id_col, text, blocks), min_df, max_features)
    rows = by_record(df, id_col, text, blocks)
    found = _added_up(rows, blocks, lambda: [Words(sizes=(1,)) if b == WORD_BLOCK else _CODERS[b]() for b in blocks])
    found = materialize(found.filter(F.col("df") >= _floor(min_df)), "words")
    cut = _cut(_histogram(found), WORD_BLOCK, max_features[WORD_BLOCK])
    least, floor = cut[0] if cut else 1, min_df.get(WORD_BLOCK, 1)
    kept = found.filter((F.col("block") == WORD_BLOCK) & (F.col("total_tf") >= least)).select("term")
    if kept.count() >= PAIRED:
        return frequent_terms(text_frequencies(df, id_col, text, blocks), min_df, max_features)
    shared = df.sparkSession.sparkContext.broadcast(Words(kept.toPandas()["term"].tolist(), (2,)))
    numbers = by_record(df, id_col, text, (WORD_BLOCK,)).mapInArrow(
        _frequencies(lambda: [shared.value], lambda i, coder, codes: [pa.array(codes)], ["code"]), "code bigint, df bigint, total_tf bigint")
    numbers = numbers.groupBy("code").agg(F.sum("df").alias("df"), F.sum("total_tf").alias("total_tf"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([WORD_BLOCK] * len(batch), pa.string()), shared.value.decode(batch["code"].to_numpy()),
                                              batch["df"], batch["total_tf"]], names=["block", "term", "df", "total_tf"])

    frequent = numbers.filter((F.col("df") >= floor) & (F.col("total_tf") >= least)).mapInArrow(named, found.schema)
    return _most_frequent(materialize(found.unionByName(frequent), "terms"), max_features)


class KnownTerms:
    """A vocabulary as arrays, for work within a row: `max_features` bounds what travels to the tasks."""

    def __init__(self, vocab: DataFrame, blocks: tuple[str, ...], *keep: str) -> None:
        self.blocks, self.terms, self.idf, self.kept, self.coders, self.sorted = blocks, {}, {}, {}, [], []
        for block in blocks:
            rows = vocab.filter(F.col("block") == block).select("term", "idf", *keep).toPandas()
            terms = rows["term"].tolist()
            self.terms[block], self.idf[block] = np.array(terms, object), rows["idf"].to_numpy(np.float64)
            self.kept[block] = {c: rows[c].tolist() for c in keep}
            coder = _CODERS[block](terms)
            codes = np.array([coder.code(t) for t in terms], np.int64)
            order = np.argsort(codes)
            self.coders.append(coder)
            self.sorted.append((codes[order], order))

    def place(self, i: int, codes: np.ndarray) -> np.ndarray:
        """Where in the vocabulary the terms are, -1 for others."""
        known, order = self.sorted[i]
        if not len(known):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return np.where(known[at] == codes, order[at], -1)

    def values(self, i: int, record: np.ndarray, place: np.ndarray, tf: np.ndarray, n: int) -> np.ndarray:
        """Sublinear tf times idf, scaled to length 1 per record."""
        weight = (1.0 + np.log(tf)) * self.idf[self.blocks[i]][place]
        return weight / np.sqrt(np.bincount(record, weight * weight, n))[record]

    def records(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, Terms, np.ndarray]]:
        """Ids, `(record, place, value)` per block and sums of the rows of `by_record`."""
        for ids, found, sums in records(batches, self.coders, self.place):
            yield ids, [(at, term, self.values(i, at, term, n, len(ids))) for i, (at, term, n) in enumerate(found)], sums

    def rows(self, columns: list[pa.Array]) -> Terms:
        """`(row, place, value)` per block, every row a record."""
        out = []
        for i, coder in enumerate(self.coders):
            at, code, n = counted(*coder.codes(columns[i]))
            place = self.place(i, code)
            at, place, n = at[place >= 0], place[place >= 0], n[place >= 0]
            out.append((at, place, self.values(i, at, place, n, len(columns[i]))))
        return out


def text_tfidf(df: DataFrame, vocab: DataFrame, id_col: str = "complaint_id", text: str = "narrative",
               blocks: tuple[str, ...] = (WORD_BLOCK, CHAR_BLOCK)) -> DataFrame:
    """`tfidf` of the texts over a vocabulary that fits a task."""
    shared = df.sparkSession.sparkContext.broadcast(KnownTerms(vocab, blocks))

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches, known = Kinds(batches), shared.value
        names = {b: pa.array(known.terms[b], pa.string()) for b in blocks}
        for ids, found, _ in known.records(batches):
            for block, (at, place, value) in zip(blocks, found):
                flat = pa.StructArray.from_arrays([names[block].take(pa.array(place)), pa.array(value)], names=["term", "value"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batches.kind), pa.array([block] * len(ids), pa.string()), lists(np.bincount(at, minlength=len(ids)), flat)],
                    names=[id_col, "block", "terms"])

    schema = f"{id_type(df, id_col)}, block string, terms array<struct<term:string,value:double>>"
    return by_record(df, id_col, text, blocks).mapInArrow(valued, schema).select(id_col, "block", F.inline("terms"))


def term_sums(df: DataFrame, vocab: DataFrame, measures: dict[str, Column], id_col: str = "complaint_id", text: str = "narrative",
              blocks: tuple[str, ...] = (WORD_BLOCK, CHAR_BLOCK)) -> DataFrame:
    """`(block, term, one column per measure)`: the values of `tfidf` times each measure of their record, added up per term.

    Measures of a record's rows add up; rows without an id take no part. A task adds into arrays as long as the vocabulary.
    """
    shared, names = df.sparkSession.sparkContext.broadcast(KnownTerms(vocab, blocks)), list(measures)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        sums = {b: np.zeros((len(names), len(known.terms[b]))) for b in blocks}
        met = {b: np.zeros(len(known.terms[b]), bool) for b in blocks}
        for ids, found, measured in known.records(batches):
            named = np.array([name is not None for name in ids])
            for block, (at, place, value) in zip(blocks, found):
                at, place, value = at[named[at]], place[named[at]], value[named[at]]
                met[block][place] = True
                for i in range(len(names)):
                    np.add.at(sums[block][i], place, value * measured[at, i])
        for b in blocks:
            at = np.flatnonzero(met[b])
            yield pa.RecordBatch.from_arrays(
                [pa.array([b] * len(at), pa.string()), pa.array(known.terms[b][at], pa.string()), *[pa.array(x[at]) for x in sums[b]]],
                names=["block", "term", *names])

    kept = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(name) for name, c in measures.items()]
    rows = by_record(df, id_col, text, blocks, *kept)
    schema = "block string, term string, " + ", ".join(f"`{name}` double" for name in names)
    return rows.mapInArrow(summed, schema).groupBy("block", "term").agg(*[F.sum(name).alias(name) for name in names])


def word_terms(df: DataFrame, id_col: str = "complaint_id", text: str = "narrative") -> DataFrame:
    """`(id, term, tf)` of words and pairs of words."""
    return term_counts(df, id_col, text, (WORD_BLOCK,)).drop("block")


def char_terms(df: DataFrame, id_col: str = "complaint_id", text: str = "narrative") -> DataFrame:
    """`(id, term, tf)` of character grams."""
    return term_counts(df, id_col, text, (CHAR_BLOCK,)).drop("block")


def document_frequencies(terms: DataFrame) -> DataFrame:
    """`(block, term, df, total_tf)`; counts are combined in the map tasks before the exchange."""
    return terms.groupBy("block", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"))


def vocabulary(terms: DataFrame, n_docs: int | None = None, min_df: dict[str, int] | None = None,
               max_features: dict[str, int] | None = None) -> DataFrame:
    """`frequent_terms` of counted terms."""
    return frequent_terms(document_frequencies(terms), min_df, max_features)


def frequent_terms(frequencies: DataFrame, min_df: dict[str, int] | None = None,
                   max_features: dict[str, int] | None = None) -> DataFrame:
    """`(block, term, df, total_tf)`: per block the most frequent terms above the document floor.

    Terms are ranked by total count, then by name. The cut is found from the histogram of total
    counts (few distinct values, one row each), so the candidate terms are never sorted in one
    place; only terms tied at the cut count are ordered, and at most `max_features` of them kept.
    """
    min_df, max_features = min_df or MIN_DF, max_features or MAX_FEATURES
    return _most_frequent(materialize(frequencies.filter(F.col("df") >= _floor(min_df)), "terms"), max_features)


def _floor(min_df: dict[str, int]) -> Column:
    return reduce(lambda acc, kv: F.when(F.col("block") == kv[0], F.lit(kv[1])).otherwise(acc), min_df.items(), F.lit(1))


def _histogram(eligible: DataFrame) -> DataFrame:
    """`(block, total_tf, n, upto)`: how many terms have a count, and how many at least that."""
    falling = Window.partitionBy("block").orderBy(F.desc("total_tf")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (eligible.groupBy("block", "total_tf").agg(F.count("*").alias("n"))
                    .withColumn("upto", F.sum("n").over(falling)))


def _cut(histogram: DataFrame, block: str, limit: int) -> tuple[int, int] | None:
    """The count of the last of `limit` terms and how many with that count are among them; None if there are fewer."""
    cut = (histogram.filter((F.col("block") == block) & (F.col("upto") >= limit))
                    .orderBy("upto").limit(1).collect())
    return (cut[0]["total_tf"], limit - (cut[0]["upto"] - cut[0]["n"])) if cut else None


def _most_frequent(eligible: DataFrame, max_features: dict[str, int]) -> DataFrame:
    histogram, parts = _histogram(eligible), []
    for block, limit in max_features.items():
        mine = eligible.filter(F.col("block") == block)
        cut = _cut(histogram, block, limit)
        if not cut:
            parts.append(mine)
            continue
        at, room = cut
        parts.append(mine.filter(F.col("total_tf") > at))
        parts.append(mine.filter(F.col("total_tf") == at).orderBy("term").limit(room))
    return reduce(DataFrame.unionByName, parts)


def with_idf(vocab: DataFrame, n_docs: int) -> DataFrame:
    """Add the smoothed inverse document frequency."""
    return vocab.withColumn("idf", F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0)


def weighted_terms(terms: DataFrame, vocab: DataFrame, how: str = "inner") -> DataFrame:
    """Terms in the vocabulary with their weight before normalisation.

    `max_features` bounds the vocabulary, and its size is measured before it is broadcast, so the
    terms normally keep their partitioning by id.
    """
    hit = terms.join(broadcast_if_small(vocab), ["block", "term"], how)
    return hit.withColumn("weight", (F.lit(1.0) + F.log(F.col("tf"))) * F.col("idf"))


def tfidf(terms: DataFrame, vocab: DataFrame, id_col: str = "complaint_id", *keep: str) -> DataFrame:
    """`(id, block, term, value)`: sublinear tf times idf, scaled to length 1 per record and block.

    `keep` names further vocabulary columns for the result.
    """
    weighted = weighted_terms(terms, vocab.select("block", "term", "idf", *keep))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(id_col, "block")))
    return weighted.withColumn("value", F.col("weight") / norm).select(id_col, "block", "term", "value", *keep)


def class_weights(df: DataFrame, label: str = "product") -> DataFrame:
    """Per class `n / (k * n_class)`, and the inverse frequency divided by its mean over classes."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("classes"),
                                 F.avg(1.0 / F.col("n")).alias("mean_inverse"))).scalar()
    return (counts.withColumn("_t", totals)
                  .select(label, "n",
                          (F.col("_t.rows") / (F.col("_t.classes") * F.col("n"))).alias("balanced"),
                          (1.0 / F.col("n") / F.col("_t.mean_inverse")).alias("inverse_frequency")))
