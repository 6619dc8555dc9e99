"""LM scoring by Katz backoff over word trigrams.

P(w | u v) = d3(c(uvw)) c(uvw) / c(uv) where the training text has uvw, alpha(uv) P(w | v) where it has the context uv but not uvw, P(w | v)
where it has neither; P(w | v) likewise from bigrams, alpha(v) and P(w) = (c(w) + 1) / (N + V + 1). Counts of 1 to `DISCOUNTED` are discounted
by Good and Turing (Katz's form), for bigrams and trigrams from their own numbers of counts; larger ones lose `ALWAYS`, so that every context
frees some mass. alpha normalises exactly: what the discounts of a context free, over the lower order's mass of the words not seen after it. The
end of a text is a token; two ends are the context of a text's first word.

The model is three tables that are partitioned by hash, and none is broadcast: words, bigrams by their first word, trigrams by their first two. Texts are
cut into chunks of tokens, and a chunk evaluates its tokens from the lowest order up: it sends its distinct words to their cells, which count them and give
each word a number; then its distinct bigrams (numbers, so that no two contexts are taken for one), then its trigrams. A cell counts what all chunks
send, answers each chunk with the counts it asked for and, where a chunk holds an n-gram that was never seen, with the sums that alpha of its
context needs. Sums for documents are made in the chunk alone, in the order of the text. Contexts that many tokens follow (`heavy`, at most
`MOST_HEAVY`) are divided among cells by the whole n-gram; their sums meet in a small table. Cells follow the bytes of the texts, so that each
holds about `CELL_BYTES` worth of them. Each chunk sends to each cell, so that messages grow with the square of the table while bytes do not: cells
are as large as memory allows, and a chunk works on what it is told by all cells at once.

Edge cases: null texts are empty (their end is a token); without training texts every P is that of the unigram base; repeated rows, and rows
of one doc_id, are scored each on its own; rows without doc_id are scored, but not learned from (held_out is null); very long texts are cut
into several chunks that know the words before them; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import mix, released, table, text_chunks, words_of, written
from corpusloom.llm.packed import by_cell, keyed_rows, narrow, offsets, pack, spread, unpack

#: Counts up to this are discounted.
DISCOUNTED = 5
#: What larger counts lose.
ALWAYS = 0.05
MODULUS, HELD_OUT = 7, 2
END = np.uint64(0x5851F42D4C957F2D)
#: Bytes of text that are read, and tokens that are evaluated, at a time; bytes of text for each cell of a table.
CHUNK, TOKENS, CELL_BYTES = 6_000_000, 1_000_000, 12_000_000
#: A context that at least so many tokens follow is heavy, unless over MOST_HEAVY were.
HEAVY_FROM, MOST_HEAVY = 100_000, 100_000
#: Times that chunks go through the trigrams, each for a part of the cells, so that no more than a part is on its way at once.
PASSES = 2
SENT = "chunk long, cell int, kind int, payload binary"
#: Kinds of rows: a chunk's tokens, what it asks, what it is told by words, bigrams and trigrams, and what a cell tells all.
BODY, ASKED, WORDS, PAIRS, TRIPLES, ALL = range(6)
_STATS = DISCOUNTED + 1


def _rows(rows: list[tuple[int, int, int, bytes]]):  # noqa: ANN202
    import pyarrow as pa

    chunk, cell, kind, payload = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(cell, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], ["chunk", "cell", "kind", "payload"])


def discounts(n: list[float]) -> np.ndarray:
    """Katz's d(1) .. d(DISCOUNTED) from the numbers of n-grams of count 1 .. DISCOUNTED + 1; what ALWAYS asks for where these allow none."""
    cut = (DISCOUNTED + 1) * n[DISCOUNTED] / n[0] if n[0] else 1.0
    out = []
    for r in range(1, DISCOUNTED + 1):
        star = (r + 1) * n[r] / (r * n[r - 1]) if n[r - 1] else 1.0
        d = (star - cut) / (1 - cut) if cut < 1 else 1.0
        out.append(min(d if d > 0 else 0.5, 1 - ALWAYS / r))
    return np.array(out)


def _left(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The discounted counts."""
    return np.where(c > DISCOUNTED, c - ALWAYS, np.concatenate([[0.0], d * np.arange(1, DISCOUNTED + 1)])[np.minimum(c, DISCOUNTED)])


def _freed(stats: list[np.ndarray], d: np.ndarray) -> np.ndarray:
    """What contexts free in all, from their numbers of n-grams of count 1 .. DISCOUNTED and above."""
    return sum((1 - d[r - 1]) * r * stats[r - 1] for r in range(1, DISCOUNTED + 1)) + ALWAYS * stats[DISCOUNTED]


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, and of each key its place among them."""
    order = np.argsort(key)
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    which = np.empty(len(key), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return key[order[new]], order[new], which


def _joint(*numbers: np.ndarray) -> np.ndarray:
    """One number for each combination."""
    out = numbers[0].astype(np.uint64)
    for x in numbers[1:]:
        high, low = int(out.max()) if len(out) else 0, int(x.max()) + 1 if len(x) else 1
        if high and high.bit_length() + low.bit_length() > 63:
            out = _distinct(out)[2].astype(np.uint64)
        out = out * np.uint64(low) + x.astype(np.uint64)
    return out


def _joined(answers: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The arrays of all cells' answers, a cell after the other."""
    return [np.concatenate(x) for x in zip(*answers, strict=True)]


def _places(asked: Iterator[tuple[int, np.ndarray]]) -> np.ndarray:
    return np.concatenate([k for _, k in asked])


# --- chunks -------------------------------------------------------------------------------------------------------


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end; the text of each token; its place in the text."""
    hashes, _, _, first = words_of(texts, lower=True)
    n = np.diff(first) + 1
    doc, at = spread(n)
    last = at == n[doc] - 1
    tokens = np.full(len(doc), END, dtype=np.uint64)
    tokens[~last] = hashes
    return tokens, doc, at


def _cut(batches: Iterator, cells: int) -> Iterator:
    """Chunks of the texts, each with a row for what it asks of each cell of words."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for rows, ids, train, texts in text_chunks(batches, ("row", "doc_id", "train"), limit=CHUNK):
        tokens, doc, at = _tokens([t or b"" for t in texts])
        for lo in range(0, len(tokens), TOKENS):
            part, of = tokens[lo : lo + TOKENS], doc[lo : lo + TOKENS]
            lead = [tokens[lo - k] if at[lo] >= k else END for k in (2, 1)]  # the two tokens before, or ends
            pieces, n = np.unique(of, return_counts=True)
            words, _, local = _distinct(np.concatenate([np.array(lead, dtype=np.uint64), part]))
            taught = np.array(train, dtype=bool)[of]
            times = np.bincount(local[2:], minlength=len(words))
            learned = np.bincount(local[2:][taught], minlength=len(words))
            order = np.argsort(-times, kind="stable")  # frequent words get small numbers in the chunk
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            words, times, learned, local = words[order], times[order], learned[order], rank[local]
            own = [ids[k] for k in pieces.tolist()]
            asked = list(_word_cells(words, cells))
            place = np.empty(len(words), dtype=np.int64)  # of each word among what the cells answer, a cell after the other
            place[np.concatenate([k for _, k in asked])] = np.arange(len(words))
            out = [(number, -1, BODY, pack(
                np.array([rows[k] for k in pieces.tolist()], dtype=np.int64), np.array([k or 0 for k in own], dtype=np.int64), np.array([k is None for k in own], dtype=np.uint8),
                np.array(train, dtype=np.uint8)[pieces], narrow(at[lo : lo + 1].astype(np.int64)), narrow(n), narrow(place), np.flatnonzero(words == END), local.astype(np.uint32),
            ))]
            out += [(number, c, ASKED, pack(words[k], narrow(learned[k]), narrow(times[k]))) for c, k in asked]
            yield _rows(out)
            number += 1


def _word_cells(words: np.ndarray, cells: int) -> Iterator[tuple[int, np.ndarray]]:
    """(cell, places of its words, by hash)."""
    by_hash = np.argsort(words)
    for c, k in by_cell((mix(words[by_hash]) % np.uint64(cells)).astype(np.int64), cells):
        yield c, by_hash[k]


class _Chunk:
    """A chunk's tokens, and what the cells have told it so far. Bigrams and trigrams are the distinct ones, in order of their words' numbers."""

    def __init__(self, told: list[tuple], cells: int, heavy: dict[str, np.ndarray], n: float, v: float):
        answers: dict[int, list] = {k: [] for k in (WORDS, PAIRS, TRIPLES)}
        for _, cell, kind, payload in told:
            if kind == BODY:
                self.rows, self.ids, self.nulls, self.train, (begun,), self.n, place, end, self.local = unpack(payload)
            else:
                answers[kind].append((cell, payload))
        self.cells, self.heavy, self.answers = cells, heavy, {k: [unpack(p) for _, p in sorted(x, key=lambda r: r[0])] for k, x in answers.items()}
        self.total, self.mass = n, n + v + 1
        # words: in order of their numbers from now on
        number, count = (np.concatenate(x).astype(np.int64)[place] for x in zip(*self.answers[WORDS], strict=True))
        order = np.argsort(number)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.number, self.count, self.end = number[order], count[order], int(rank[end[0]]) if len(end) else -1
        tok = rank[self.local]
        self.doc, place = spread(self.n.astype(np.int64))
        self.first = place + np.where(self.doc == 0, int(begun), 0) == 0  # begins a text
        self.token, self.before = tok[2:], np.where(self.first, self.end, tok[1:-1]) if self.first.any() else tok[1:-1]
        self.taught = self.train[self.doc].astype(bool)
        # bigrams: of each token, with the pair of the two tokens before the chunk
        size = np.uint64(len(self.number))
        pair = np.concatenate([[tok[0] * len(self.number) + tok[1]], self.before * len(self.number) + self.token]).astype(np.uint64)
        keys, _, which = _distinct(pair)
        self.pair = which[1:]
        self.pair_first, self.pair_last = (keys // size).astype(np.int64), (keys % size).astype(np.int64)
        self.context = np.concatenate([which[:1], self.pair[:-1]])
        self.context[self.first] = len(keys)  # two ends

    def bigrams_asked(self) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, the distinct bigrams it is asked for)."""
        v, w = self.number[self.pair_first], self.number[self.pair_last]
        own = mix(v.view(np.uint64))
        divided = np.isin(v, self.heavy["words"])
        cell = np.where(divided, mix(own + w.view(np.uint64)), own) % np.uint64(self.cells)
        return by_cell(cell.astype(np.int64), self.cells)

    def ask_bigrams(self) -> Iterator[tuple[int, bytes]]:
        learned = np.bincount(self.pair[self.taught], minlength=len(self.pair_first))
        for c, k in self.bigrams_asked():
            v, w = self.pair_first[k], self.pair_last[k]
            yield c, pack(narrow(self.number[v]), narrow(self.number[w]), narrow(learned[k]), narrow(self.count[w]))

    def tell_bigrams(self, d2: np.ndarray) -> None:
        """Takes the counts of the bigrams, and from them P(w | v)."""
        n = len(self.pair_first)
        self.pair_count, weight = np.zeros(n, dtype=np.int64), np.full(n, np.nan)
        counts, contexts, stats, seen = _joined(self.answers[PAIRS])
        k = _places(self.bigrams_asked())
        self.pair_count[k] = counts
        lack = k[counts == 0]
        if len(lack) and len(contexts):
            order = np.argsort(contexts)
            v = self.number[self.pair_first[lack]]
            at = order[np.minimum(np.searchsorted(contexts, v, sorter=order), len(contexts) - 1)]
            ok = contexts[at] == v
            weight[lack[ok]] = (_freed(stats.reshape(-1, _STATS).T, d2) / (1 - seen.astype(float) / self.mass))[at[ok]]
        v, w = self.pair_first, self.pair_last
        lack = np.flatnonzero((self.pair_count == 0) & (self.count[v] > 0))
        heavy = self.heavy["words"]
        if len(heavy) and len(lack):
            at = np.minimum(np.searchsorted(heavy, self.number[v[lack]]), len(heavy) - 1)
            ok = heavy[at] == self.number[v[lack]]
            weight[lack[ok]] = self.heavy["word_weights"][at[ok]]
        total = np.maximum(self.count[v], 1)
        seen = self.pair_count > 0
        base = (self.count[w] + 1) / self.mass
        self.pair_p = np.where(seen, _left(self.pair_count, d2) / total, np.where(self.count[v] > 0, weight / total * base, base))
        # trigrams
        key = self.context.astype(np.uint64) * np.uint64(len(self.number)) + self.token.astype(np.uint64)
        keys, at, self.triple = _distinct(key)
        self.triple_context, self.triple_pair = (keys // np.uint64(len(self.number))).astype(np.int64), self.pair[at]
        ends = self.count[self.end] if self.end >= 0 else 0
        self.context_count = np.append(self.pair_count, ends)[self.triple_context]

    def _context_words(self) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the two words before each distinct trigram's last."""
        end = self.number[self.end] if self.end >= 0 else 0
        return np.append(self.number[self.pair_first], end)[self.triple_context], np.append(self.number[self.pair_last], end)[self.triple_context]

    def trigrams_asked(self) -> Iterator[tuple[int, np.ndarray]]:
        u, v = self._context_words()
        own = mix(mix(u.view(np.uint64)) + v.view(np.uint64))
        self.heavy_context = self._heavy_contexts(u, v)
        w = self.number[self.pair_last[self.triple_pair]]
        cell = np.where(self.heavy_context >= 0, mix(own + w.view(np.uint64)), own) % np.uint64(self.cells)
        return by_cell(cell.astype(np.int64), self.cells)

    def _heavy_contexts(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Of each context its place among the heavy ones, or -1."""
        hu, hv = self.heavy["pair_first"], self.heavy["pair_last"]
        out = np.full(len(u), -1, dtype=np.int64)
        if len(hu):
            some = np.flatnonzero(np.isin(v, hv))
            keys = _joint(np.concatenate([hu, u[some]]), np.concatenate([hv, v[some]]))
            order = np.argsort(keys[: len(hu)])
            at = np.minimum(np.searchsorted(keys[: len(hu)][order], keys[len(hu) :]), len(hu) - 1)
            ok = keys[: len(hu)][order][at] == keys[len(hu) :]
            out[some[ok]] = order[at[ok]]
        return out

    def ask_trigrams(self, turn: int) -> Iterator[tuple[int, bytes]]:
        """What is asked of every PASSES-th cell."""
        learned = np.bincount(self.triple[self.taught], minlength=len(self.triple_pair))
        u, v = self._context_words()
        w = self.number[self.pair_last[self.triple_pair]]
        pair, total = self.pair_count[self.triple_pair], self.count[self.pair_first[self.triple_pair]]
        for c, k in self.trigrams_asked():
            if c % PASSES == turn:
                yield c, pack(narrow(u[k]), narrow(v[k]), narrow(w[k]), narrow(learned[k]), narrow(pair[k]), narrow(total[k]))

    def tell_trigrams(self, d3: np.ndarray) -> np.ndarray:
        """log10 P of each distinct trigram."""
        n = len(self.triple_pair)
        counts, weight = np.zeros(n, dtype=np.int64), np.full(n, np.nan)
        u, v = self._context_words()
        found, cu, cv, stats, mass = _joined(self.answers[TRIPLES])
        k = _places(self.trigrams_asked())
        counts[k] = found
        lack = k[found == 0]
        if len(lack) and len(cu):
            keys = _joint(np.concatenate([cu, u[lack]]), np.concatenate([cv, v[lack]]))
            order = np.argsort(keys[: len(cu)])
            at = np.minimum(np.searchsorted(keys[: len(cu)][order], keys[len(cu) :]), len(cu) - 1)
            ok = keys[: len(cu)][order][at] == keys[len(cu) :]
            weight[lack[ok]] = (_freed(stats.reshape(-1, _STATS).T, d3) / np.maximum(1 - mass, 1e-300))[order[at[ok]]]
        lack = (counts == 0) & (self.heavy_context >= 0)
        weight[lack] = self.heavy["pair_weights"][self.heavy_context[lack]]
        p, total = self.pair_p[self.triple_pair], np.maximum(self.context_count, 1)
        return np.log10(np.where(counts > 0, _left(counts, d3) / total, np.where(self.context_count > 0, weight / total * p, p)))

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, offsets(self.n.astype(np.int64))[:-1]) if len(x) else np.zeros(len(self.n))


# --- cells --------------------------------------------------------------------------------------------------------


def _counted(keys: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct keys: a place and the training count; of each row, its key's place."""
    _, first, which = _distinct(keys)
    return first, np.bincount(which, learned, minlength=len(first)).astype(np.int64), which


def _told_to(rows: list[tuple], lengths: list[int], answer: Callable[[slice], bytes], cell: int, kind: int) -> list[tuple]:
    at = offsets(np.array(lengths))
    return [(r[1], cell, kind, answer(slice(int(at[k]), int(at[k + 1])))) for k, r in enumerate(rows)]


def _count_words(cell: int, rows: list[tuple], cells: int, heavy_from: int) -> list[tuple]:
    parts = [unpack(r[3]) for r in rows]
    words, learned, times = (np.concatenate(x) for x in zip(*parts, strict=True))
    first, count, which = _counted(words, learned)
    all_ = np.bincount(which, times, minlength=len(first))
    order = np.argsort(-count, kind="stable")
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.arange(len(order)) * cells + cell
    out = _told_to(rows, [len(p[0]) for p in parts], lambda s: pack(narrow(number[which[s]]), narrow(count[which[s]])), cell, WORDS)
    heavy = all_ >= heavy_from
    return [*out, (-1, cell, ALL, pack(np.array([count.sum(), (count > 0).sum()]), number[heavy], count[heavy], words[first][heavy].view(np.int64)))]


def _by_context(context: np.ndarray, count: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of sorted contexts (a row for each n-gram type): where each begins; numbers of types by count; the mass of the types that were seen."""
    begin = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(context) else np.zeros(0, dtype=np.int64)
    add = lambda x: np.add.reduceat(x, begin) if len(begin) else x[:0]
    stats = [add((count == r).astype(np.int32)) for r in range(1, DISCOUNTED + 1)] + [add((count > DISCOUNTED).astype(np.int32))]
    return begin, stats, add(np.where(count > 0, mass, 0))


def _totals(count: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(count, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2].astype(float)


def _count_bigrams(cell: int, rows: list[tuple], heavy: dict[str, np.ndarray], heavy_from: int) -> list[tuple]:
    parts = [unpack(r[3]) for r in rows]
    v, w, learned, own = (np.concatenate(x) for x in zip(*parts, strict=True))
    first, count, which = _counted(_joint(v, w), learned)  # types by v, then w
    tv = v[first].astype(np.int64)
    begin, stats, seen = _by_context(tv, count, own[first].astype(np.int64) + 1)
    divided = np.isin(tv[begin], heavy["words"])
    at = np.cumsum(np.r_[False, tv[1:] != tv[:-1]]) if len(tv) else tv
    each = np.stack(stats, axis=1).astype(np.int32)

    def answer(s: slice) -> bytes:
        found = count[which[s]]
        lack = np.unique(at[which[s]][found == 0])
        lack = lack[~divided[lack]]
        return pack(narrow(found), tv[begin[lack]], each[lack].ravel(), seen[lack])

    out = _told_to(rows, [len(p[0]) for p in parts], answer, cell, PAIRS)
    big = count >= heavy_from
    return [*out, (-1, cell, ALL, pack(_totals(count), tv[begin[divided]], *(x[divided].astype(np.int64) for x in stats), seen[divided], tv[big], w[first][big].astype(np.int64), count[big]))]


def _count_trigrams(cell: int, rows: list[tuple], heavy: dict[str, np.ndarray], d2: np.ndarray) -> list[tuple]:
    parts = [unpack(r[3]) for r in rows]
    u, v, w, learned, pair, total = (np.concatenate(x) for x in zip(*parts, strict=True))
    context = _joint(u, v)
    first, count, which = _counted(_joint(context, w), learned)
    tc = context[first]
    p = _left(pair[first].astype(np.int64), d2) / np.maximum(total[first], 1)
    begin, stats, mass = _by_context(tc, count, p)
    tu, tv = u[first[begin]].astype(np.int64), v[first[begin]].astype(np.int64)
    hu, hv = heavy["pair_first"], heavy["pair_last"]
    keys = _joint(np.concatenate([hu, tu]), np.concatenate([hv, tv]))
    divided = np.isin(keys[len(hu) :], keys[: len(hu)])
    at = np.cumsum(np.r_[False, tc[1:] != tc[:-1]]) if len(tc) else tc
    each = np.stack(stats, axis=1).astype(np.int32)

    def answer(s: slice) -> bytes:
        found = count[which[s]]
        lack = np.unique(at[which[s]][found == 0])
        lack = lack[~divided[lack]]
        return pack(narrow(found), tu[lack], tv[lack], each[lack].ravel(), mass[lack])

    out = _told_to(rows, [len(p[0]) for p in parts], answer, cell, TRIPLES)
    return [*out, (-1, cell, ALL, pack(_totals(count), tu[divided], tv[divided], *(x[divided].astype(np.int64) for x in stats), mass[divided]))]


# --- the three rounds ---------------------------------------------------------------------------------------------


def _in_cells(asked: DataFrame, count: Callable[[int, list[tuple]], list[tuple]], parts: int) -> DataFrame:
    """Answers of the cells to what chunks ask; chunks' tokens go through as they are."""

    def run(batches: Iterator) -> Iterator:
        now, rows = -1, []
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                for row in zip(*(c.to_pylist() for c in b.slice(lo, 64).columns), strict=True):
                    if row[0] < 0:
                        yield _rows([(row[1], *row[:1], *row[2:])])
                        continue
                    if row[0] != now and rows:
                        yield from told(now, rows)
                        rows = []
                    now = row[0]
                    rows.append(row)
        if rows:
            yield from told(now, rows)
        released()

    def told(cell: int, rows: list[tuple]) -> Iterator:
        out = count(cell, rows)
        for lo in range(0, len(out), 500):
            yield _rows(out[lo : lo + 500])

    place = F.when(F.col("cell") >= 0, F.col("cell").cast("long")).otherwise(F.xxhash64("chunk"))
    return asked.select("cell", "chunk", "kind", "payload").repartition(parts, place).sortWithinPartitions("cell", "chunk").mapInArrow(run, SENT)


def _in_chunks(told: DataFrame, parts: int, make: Callable[[list[tuple]], Iterator], schema: str) -> DataFrame:
    """`make` over the rows (chunk, cell, kind, payload) of each chunk."""

    def run(batches: Iterator) -> Iterator:
        for _, rows in keyed_rows(batches):
            yield from make(rows)

    return told.where(F.col("kind") != ALL).repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(run, schema)


def _told_all(told: DataFrame, merge: Callable[[list[list[np.ndarray]]], list[np.ndarray]]) -> list[np.ndarray]:
    """What the cells tell all (a few numbers and heavy contexts), merged in a few tasks and then here."""

    def run(batches: Iterator) -> Iterator:
        held: list[list[np.ndarray]] = []
        for b in batches:
            held += [unpack(p) for p in b.column(0).to_pylist()]
            held = [merge(held)] if held else []
        yield _rows([(-1, 0, ALL, pack(*held[0]))] if held else []).select(["payload"])

    found = told.where(F.col("kind") == ALL).select("payload").coalesce(32).mapInArrow(run, "payload binary").collect()
    return merge([unpack(bytes(r.payload)) for r in found]) if found else []


def _merged(parts: list[list[np.ndarray]], keys: int) -> list[np.ndarray]:
    """Sums of the same keys (the first columns), in the order of the keys."""
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    _, first, which = _distinct(_joint(*columns[:keys]))
    return [c[first] for c in columns[:keys]] + [np.bincount(which, c, minlength=len(first)) for c in columns[keys:]]


def in_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % MODULUS != HELD_OUT


def cells_of(size: int, parts: int) -> int:
    """Cells of a table for so many bytes of text: one for each `CELL_BYTES`, or each partition where these are smaller."""
    return max(1, -(-size // CELL_BYTES), min(parts, size // 1000))


def _evaluated(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_tokens, n_known, train_tokens, base, score of pieces of texts."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(in_training(F.col("doc_id")), F.lit(False)).alias("train"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = cells_of(size, parts)
    heavy_from = max(HEAVY_FROM, size // 2 // MOST_HEAVY)
    none = np.zeros(0, dtype=np.int64)

    # words
    first = written(_in_cells(rows.mapInArrow(lambda b: _cut(b, cells), SENT), lambda c, r: _count_words(c, r, cells, heavy_from), parts), "katz-words")
    totals, numbers, counts, words = _told_all(first, lambda x: [sum(p[0] for p in x), *map(np.concatenate, list(zip(*x, strict=True))[1:])]) or [np.zeros(2), none, none, none]
    n, v = map(float, totals)
    heavy = {"words": np.sort(numbers), "pair_first": none, "pair_last": none}
    ends = words.view(np.uint64) == END
    end = (int(numbers[ends][0]), int(counts[ends][0])) if ends.any() else (0, 0)

    # bigrams
    def ask_bigrams(told: list[tuple]) -> Iterator:
        chunk = _Chunk(told, cells, heavy, n, v)
        yield _rows([(told[0][0], c, ASKED, p) for c, p in chunk.ask_bigrams()])

    second = written(_in_cells(_in_chunks(first, parts, ask_bigrams, SENT), lambda c, r: _count_bigrams(c, r, heavy, heavy_from), parts), "katz-bigrams")
    many = _STATS + 3
    totals, words, *sums, bu, bv, _ = _told_all(second, lambda x: [sum(p[0] for p in x), *_merged([p[1:many] for p in x], 1), *(np.concatenate(c) for c in zip(*(p[many:] for p in x), strict=True))]) or [np.zeros(_STATS), *[none] * (many + 2)]
    d2 = discounts(totals.tolist())
    weights = np.zeros(len(heavy["words"]))
    weights[np.searchsorted(heavy["words"], words)] = _freed(sums[:_STATS], d2) / (1 - sums[_STATS] / (n + v + 1))
    heavy = heavy | {"word_weights": weights, "pair_first": np.append(bu, end[0]), "pair_last": np.append(bv, end[0])}
    if end[1] < heavy_from or ((bu == end[0]) & (bv == end[0])).any():
        heavy = heavy | {"pair_first": bu, "pair_last": bv}

    # trigrams
    def ask_trigrams(told: list[tuple], turn: int) -> Iterator:
        chunk = _Chunk(told, cells, heavy, n, v)
        chunk.tell_bigrams(d2)
        yield _rows([(told[0][0], c, ASKED, p) for c, p in chunk.ask_trigrams(turn)])

    passes = [_in_chunks(first.unionByName(second), parts, lambda told, turn=turn: ask_trigrams(told, turn), SENT) for turn in range(PASSES)]
    passes = [written(_in_cells(asked, lambda c, r: _count_trigrams(c, r, heavy, d2), parts), "katz-trigrams") for asked in passes]
    third = reduce(DataFrame.unionByName, passes)
    totals, hu, hv, *sums = _told_all(third, lambda x: [sum(p[0] for p in x), *_merged([p[1:] for p in x], 2)]) or [np.zeros(_STATS), *[none] * (_STATS + 3)]
    d3 = discounts(totals.tolist())
    weights = np.zeros(len(heavy["pair_first"]))
    keys = _joint(np.concatenate([heavy["pair_first"], hu]), np.concatenate([heavy["pair_last"], hv]))
    order = np.argsort(keys[: len(weights)])
    weights[order[np.searchsorted(keys[: len(weights)][order], keys[len(weights) :])]] = _freed(sums[:_STATS], d3) / np.maximum(1 - sums[_STATS], 1e-300)
    heavy = heavy | {"pair_weights": weights}

    def evaluate(told: list[tuple]) -> Iterator:
        import pyarrow as pa

        chunk = _Chunk(told, cells, heavy, n, v)
        chunk.tell_bigrams(d2)
        value = chunk.tell_trigrams(d3)[chunk.triple]
        count = chunk.count[chunk.token]
        base = chunk.sums(np.log10((count + 1) / (n + v + 1)))
        known = chunk.sums((count > 0).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunk.rows), pa.array(chunk.ids, mask=chunk.nulls.astype(bool)), pa.array(chunk.n.astype(np.int64)), pa.array(known), pa.array(base), pa.array(chunk.sums(value))],
            ["row", "doc_id", "n_tokens", "n_known", "base_score", "score"],
        )

    schema = "row long, doc_id long, n_tokens long, n_known long, base_score double, score double"
    return _in_chunks(first.unionByName(second).unionByName(third), parts, evaluate, schema).withColumn("train_tokens", F.lit(int(n)).cast("long"))


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of `docs`; learns from those of the training fold."""
    sums = _evaluated(docs).groupBy("row", "doc_id", "train_tokens").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return sums.select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: log10 probabilities of every document under the unigram base and the Katz model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scores(docs).withColumn("held_out", ~in_training(F.col("doc_id"))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
