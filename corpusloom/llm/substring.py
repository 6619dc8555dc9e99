"""Substring dedup by relative Lempel-Ziv parsing.

Documents are factored against reference blocks. A block is a hash cell of seeds: the seed of a window of `WINDOW` words is the least hash of its
runs of `SEED` words, so that equal windows meet in one block wherever they stand, and neighbouring windows mostly share a seed and travel as one
run of words. A first pass finds the seeds that stand in more than one document; only runs of these go to blocks. A block indexes every window
of its runs by place. It then parses each run greedily: from the first place on that an earlier document has, a factor is the longest stretch that
stands in a run of one earlier document, (source, place, length); where it ends, at the factor's boundary, the index is asked again for the window
that begins there, which reaches back into the factor, until the run is parsed. The words of each factor are compared with those of its source;
factors have `WINDOW` words at least and become duplicate spans. Runs are cut where the seed changes: the next block goes on with the next window,
and the spans of a document from all blocks are joined.

Equal runs are parsed once, for the earliest document that has them (`first`); for every other document the whole run is a factor with that one as its
source. Who has a run travels as plain rows that are joined on the run's digest, so that a passage in very many documents is no large group
anywhere. Seeds that stand in very many documents (`HOT_FROM`) give way to the least hash of longer runs of words.

Edge cases: null texts have no words; texts shorter than a window lose nothing; very long texts are parsed run by run; rows of one doc_id are one document for
the comparison and keep their own spans (they are told apart by a hash of the text); repeated rows are cut alike; rows without doc_id are neither
reference nor cut; an empty table gives an empty result; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import dropped, free_name, mix, rolling, table, text_chunks, words_of, written
from corpusloom.llm.packed import by_cell, keyed_rows, offsets, pack, spread, unpack

WINDOW = 50
SEED = 8
#: A seed in at least so many documents is hot, unless over MOST_HOT were.
HOT_FROM, MOST_HOT = 50_000, 100_000
#: Runs that a block holds, about.
BLOCK = 10_000


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(values.dtype).max, dtype=values.dtype)]).reshape(-1, width)
    left, right = np.minimum.accumulate(padded, axis=1).ravel(), np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def windows_of(texts: list[bytes], window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Word hashes of texts, and for each window of a text: its first word's place, its text, its place there and its seed."""
    hashes, _, _, first = words_of(texts)
    seeds = sliding_min(rolling(hashes, seed), window - seed + 1)
    doc, at = spread(np.maximum(np.diff(first) - window + 1, 0))
    where = first[:-1][doc] + at
    return hashes, where, doc, at, seeds[where]


def seeds_of(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """seed, doc_id, text_key: the distinct seeds of each document."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for ids, keys, texts in text_chunks(batches, ("doc_id", "text_key")):
            _, _, doc, _, seeds = windows_of([t or b"" for t in texts], window, seed)
            begin = np.flatnonzero(np.r_[True, (seeds[1:] != seeds[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else doc
            order = begin[np.lexsort((seeds[begin], doc[begin]))]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (doc[order][1:] != doc[order][:-1]) | (seeds[order][1:] != seeds[order][:-1])
            at = order[new]
            yield pa.RecordBatch.from_arrays([pa.array(seeds[at].view(np.int64)), pa.array(np.array(ids, dtype=np.int64)[doc[at]]), pa.array(np.array(keys, dtype=np.int64)[doc[at]])], ["seed", "doc_id", "text_key"])

    return docs.mapInArrow(run, "seed long, doc_id long, text_key long")


def _runs(hashes: np.ndarray, where: np.ndarray, doc: np.ndarray, at: np.ndarray, seeds: np.ndarray, plain: np.ndarray, kept: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows (at most `window`) and seed of each run of kept neighbouring windows with one seed."""
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (seeds[1:] != seeds[:-1]) | (plain[1:] != plain[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    new[spread(np.diff(np.append(begin, len(doc))))[1] % window == 0] = True  # a passage that comes back keeps its seed: no run grows without bound
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(doc)))
    return begin[kept[begin]], length[kept[begin]], seeds[begin][kept[begin]]


def _sent(batches: Iterator, window: int, seed: int, hot: np.ndarray, cells: int) -> Iterator:
    """Rows (cell, payload) of runs by block, and rows (digest, doc_id, text_key, place, windows) of who has them."""
    import pyarrow as pa

    names = ["cell", "payload", "digest", "doc_id", "text_key", "place", "windows"]
    null = lambda kind, n: pa.nulls(n, kind)
    for ids, keys, shared, texts in text_chunks(batches, ("doc_id", "text_key", "seeds")):
        hashes, where, doc, at, plain = windows_of([t or b"" for t in texts], window, seed)
        if not len(doc):
            continue
        mine = np.concatenate([mix(np.array(s, dtype=np.int64).view(np.uint64) ^ mix(np.full(len(s), k, dtype=np.uint64))) for k, s in enumerate(shared)])
        kept = np.isin(mix(plain ^ mix(doc.astype(np.uint64))), mine)
        seeds = plain
        if len(hot) and (often := np.isin(plain.view(np.int64), hot)).any():
            longer = max(seed, window * 2 // 3)
            seeds = np.where(often, mix(sliding_min(rolling(hashes, longer), window - longer + 1)[where]), plain)
        begin, length, of = _runs(hashes, where, doc, at, seeds, plain, kept, window)
        if not len(begin):
            continue
        words = [hashes[a : a + n + window - 1] for a, n in zip(where[begin].tolist(), length.tolist(), strict=True)]
        digests = [hashlib.blake2b(w.tobytes(), digest_size=16).digest() for w in words]
        owner, key, place = np.array(ids, dtype=np.int64)[doc[begin]], np.array(keys, dtype=np.int64)[doc[begin]], at[begin]
        yield pa.RecordBatch.from_arrays([null(pa.int32(), len(begin)), null(pa.binary(), len(begin)), pa.array(digests, pa.binary()), pa.array(owner), pa.array(key), pa.array(place.astype(np.int32)), pa.array(length.astype(np.int32))], names)
        earliest: dict[bytes, int] = {}
        for k in np.lexsort((place, owner)).tolist():
            earliest.setdefault(digests[k], k)
        lead = np.array(sorted(earliest.values()))
        out = []
        for c, g in by_cell((mix(of[lead]) % np.uint64(cells)).astype(np.int64), cells):
            g = lead[g]
            local, index = np.unique(np.concatenate([words[k] for k in g]), return_inverse=True)
            out.append((c, pack(length[g].astype(np.int32), local, index.astype(np.uint32), owner[g], place[g].astype(np.int32), np.frombuffer(b"".join(digests[k] for k in g), dtype=np.uint8))))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary()), null(pa.binary(), len(out)), *(null(k, len(out)) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names)


class Block:
    """Distinct runs with the earliest document that has each, and the index of their windows."""

    def __init__(self, runs: list[np.ndarray], first: np.ndarray, place: np.ndarray, window: int):
        self.window, self.first, self.place = window, first, place
        self.words, self.word_at = np.concatenate(runs), offsets(np.array([len(r) for r in runs]))
        self.length = np.diff(self.word_at) - window + 1
        self.at = offsets(self.length)
        self.run, self.offset = spread(self.length)
        hashes = rolling(self.words, window)[self.word_at[:-1][self.run] + self.offset]
        order = np.lexsort((self.first[self.run], hashes))
        new = np.r_[True, hashes[order][1:] != hashes[order][:-1]]
        self.group = np.empty(len(order), dtype=np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.by_group, self.group_at = order, np.append(np.flatnonzero(new), len(order))
        self.has_earlier = self.first[self.run[order[self.group_at[:-1]]]][self.group] < self.first[self.run]

    def parse(self) -> tuple[np.ndarray, ...]:
        """Factors of all runs: run, first window, windows, source document, place there (in words)."""
        nothing = len(self.run)
        following = np.where(self.has_earlier, np.arange(nothing), nothing)
        following = np.append(np.minimum.accumulate(following[::-1])[::-1], nothing)  # the next window that an earlier document has
        now, end = self.at[:-1].copy(), self.at[1:]
        todo = np.arange(len(now))
        found: list[tuple[np.ndarray, ...]] = []
        while len(todo):
            now[todo] = following[now[todo]]
            todo = todo[now[todo] < end[todo]]
            if not len(todo):
                break
            size, source = self._longest(now[todo])
            size, source = self._compared(now[todo], size, source)
            ok = size > 0
            found.append((todo[ok], self.offset[now[todo[ok]]], size[ok], self.first[self.run[source[ok]]], self.place[self.run[source[ok]]] + self.offset[source[ok]]))
            now[todo] += np.maximum(size, 1)
            todo = todo[now[todo] < end[todo]]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, dtype=np.int64) for _ in range(5))

    def _longest(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For windows that an earlier document has: the most windows from there that one run of an earlier document has, and where."""
        groups = np.unique(self.group[at])
        n = self.group_at[groups + 1] - self.group_at[groups]
        which, k = spread(n)
        here = self.by_group[self.group_at[groups][which] + k]  # all places that hold one of these windows, those of a group together
        same = which
        target = np.full(len(self.run), -1, dtype=np.int64)
        target[at] = np.arange(len(at))
        of = target[here]
        size, source = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        step = 0
        while len(here):
            # places that agree so far are one class; its earliest document is a source for all later ones
            order = np.lexsort((self.first[self.run[here]], same))
            here, same, of = here[order], same[order], of[order]
            head = np.flatnonzero(np.r_[True, same[1:] != same[:-1]])
            lead = here[np.repeat(head, np.diff(np.append(head, len(here))))]
            open_ = (of >= 0) & (self.first[self.run[lead]] < self.first[self.run[here]])
            size[of[open_]], source[of[open_]] = step + 1, lead[open_]
            alive = np.zeros(int(same.max()) + 1, dtype=bool)
            alive[same[open_]] = True
            go = alive[same] & (self.offset[here] + step + 1 < self.length[self.run[here]])
            here, same, of = here[go], same[go], np.where(open_, of, -1)[go]
            step += 1
            if len(here):
                same = np.unique(same * (len(self.group_at) + 1) + self.group[here + step], return_inverse=True)[1]
        return size, source

    def _compared(self, at: np.ndarray, size: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Factors as their words confirm them; where two windows only share a hash, all earlier places of that hash are compared."""
        own, other = (self.word_at[self.run[x]] + self.offset[x] for x in (at, source))
        which, k = spread(size + self.window - 1)
        wrong = np.unique(which[self.words[own[which] + k] != self.words[other[which] + k]])
        for w in wrong.tolist():
            size[w] = 0
            g = self.group[at[w]]
            for q in self.by_group[self.group_at[g] : self.group_at[g + 1]].tolist():
                if self.first[self.run[q]] >= self.first[self.run[at[w]]]:
                    break
                a, b = own[w], self.word_at[self.run[q]] + self.offset[q]
                most = min(self.word_at[self.run[at[w]] + 1] - a, self.word_at[self.run[q] + 1] - b)
                differ = np.flatnonzero(self.words[a : a + most] != self.words[b : b + most])
                windows = (int(differ[0]) if len(differ) else int(most)) - self.window + 1
                if windows > size[w]:
                    size[w], source[w] = windows, q
        return size, source


def _factors(rows: list[tuple], window: int) -> Iterator:
    """digest, first (document), factors (array of start and end in words of the run, source, place there) of the runs of a block."""
    import pyarrow as pa

    runs, digests, first, place = [], [], [], []
    known: dict[bytes, int] = {}
    for _, payload in rows:
        length, local, index, owner, at, flat = unpack(payload)
        for k, (words, doc, p) in enumerate(zip(np.split(local[index], np.cumsum(length + window - 1)[:-1]), owner.tolist(), at.tolist(), strict=True)):
            digest = flat[16 * k : 16 * k + 16].tobytes()
            j = known.setdefault(digest, len(runs))
            if j == len(runs):
                runs.append(words)
                digests.append(digest)
                first.append(doc)
                place.append(p)
            elif (doc, p) < (first[j], place[j]):
                first[j], place[j] = doc, p
    run, start, size, source, there = Block(runs, np.array(first, dtype=np.int64), np.array(place, dtype=np.int64), window).parse()
    order = np.argsort(run, kind="stable")
    ends = np.searchsorted(run[order], np.arange(len(runs) + 1))
    values = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start[order], (start + size + window - 1)[order], source[order], there[order])], ["start", "end", "source", "place"])
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(first, pa.int64()), lists], ["digest", "first", "factors"])


FACTOR = "struct<start: long, end: long, source: long, place: long>"


def factors(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, text_key (hash of the text), start, end (words), source (an earlier doc_id), and where in a run of it the words stand, for each
    factor of at least `window` words."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).where("doc_id is not null and text is not null")
    seeds = written(seeds_of(rows, window, seed), "rlz-seeds")
    shared = written(seeds.groupBy("seed").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("seed", "n"), "rlz-shared")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = np.sort(np.array([r.seed for r in shared.where(F.col("n") >= max(HOT_FROM, total // MOST_HOT)).select("seed").collect()], dtype=np.int64))  # MOST_HOT at most
    asked = written(seeds.join(shared, "seed").groupBy("doc_id", "text_key").agg(F.collect_set("seed").alias("seeds")), "rlz-asked")
    dropped(seeds, shared)
    cells = max(1, min(parts, total), total // BLOCK)
    sent = rows.join(asked, ["doc_id", "text_key"]).select("doc_id", "text_key", "seeds", "text")
    sent = written(sent.mapInArrow(lambda b: _sent(b, window, seed, hot, cells), "cell int, payload binary, digest binary, doc_id long, text_key long, place int, windows int"), "rlz-runs")

    def parse(batches: Iterator) -> Iterator:
        for _, runs in keyed_rows(batches):
            yield from _factors(runs, window)

    blocks = sent.where("cell is not null").select("cell", "payload").repartition(min(cells, parts), "cell").sortWithinPartitions("cell")
    parsed = blocks.mapInArrow(parse, f"digest binary, first long, factors array<{FACTOR}>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), (F.col("windows") + (window - 1)).cast("long").alias("end"), F.col("first").alias("source"), F.lit(0).cast("long").alias("place")))
    members = sent.where("cell is null").select("digest", "doc_id", "text_key", F.col("place").alias("at"), "windows").join(parsed, "digest")
    found = members.select("doc_id", "text_key", "at", F.explode(F.when(F.col("doc_id") > F.col("first"), whole).otherwise(F.col("factors"))).alias("f"))
    return found.select("doc_id", "text_key", (F.col("at") + F.col("f.start")).cast("int").alias("start"), (F.col("at") + F.col("f.end")).cast("int").alias("end"), "f.source", "f.place")


def duplicate_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, text_key, spans (array of word ranges [start, end)) for each document that repeats a window of an earlier one."""
    return factors(docs, window, seed).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def kept_words(words: list[bytes], spans: list[dict] | None) -> list[bytes]:
    if not spans:
        return words
    cut = np.zeros(len(words) + 1, dtype=np.int64)
    for s in spans:
        cut[s["start"]] += 1
        cut[s["end"]] -= 1
    return [w for w, c in zip(words, np.cumsum(cut).tolist(), strict=False) if not c]


def deduplicated(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """`docs` with duplicate words removed from the texts that have any (their words are then joined by one space); other texts stay as they are."""
    names = docs.columns
    own, key, spans = (free_name(docs, c) for c in ("rlz_id", "rlz_key", "rlz_spans"))
    found = written(duplicate_spans(docs.select("doc_id", "text"), window, seed).select(F.col("doc_id").alias(own), F.col("text_key").alias(key), F.col("spans").alias(spans)), "rlz-spans")
    joined = docs.join(found, (docs["doc_id"].cast("long") == found[own]) & (F.xxhash64(docs["text"].cast("string")) == found[key]), "left").select(*(docs[c] for c in names), found[spans])
    at = names.index("text")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                spans, texts = b.column(len(names)).to_pylist(), b.column(at).cast(pa.binary()).to_pylist()
                kept = [t if s is None else b" ".join(kept_words(t.split(), s)) for s, t in zip(spans, texts, strict=True)]
                columns = b.columns[: len(names)]
                columns[at] = pa.array(kept, pa.binary()).cast(pa.string()).cast(columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(cut, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: doc_id, n_words, n_removed, kept_sha256 of every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = written(duplicate_spans(docs), "rlz-spans")
    joined = docs.withColumn("text_key", F.xxhash64("text")).join(spans, ["doc_id", "text_key"], "left").select("doc_id", "spans", "text")

    def digest(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for ids, spans, texts in text_chunks(batches, ("doc_id", "spans")):
            rows = []
            for s, t in zip(spans, texts, strict=True):
                words = (t or b"").split()
                kept = kept_words(words, s)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, removed, sha = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without the words that repeat earlier documents; n_chars follows the text where the column is there."""
    out = deduplicated(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(words) - 48)) AS p FROM d WHERE len(words) >= 50),
windows AS (SELECT s.doc_id, s.p, md5_number(array_to_string(words[s.p:s.p + 49], ' ')) AS w FROM starts s JOIN d USING (doc_id)),
firsts AS (SELECT w, min(doc_id) AS source FROM windows GROUP BY w),
cut AS (SELECT doc_id, list(p) AS ps FROM windows JOIN firsts USING (w) WHERE source < doc_id GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(ps) AS p FROM cut), LATERAL (SELECT unnest(range(p, p + 50)) AS q)),
gone_lists AS (SELECT doc_id, list(q) AS qs FROM gone GROUP BY doc_id),
places AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS q FROM d),
kept AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.q) AS text FROM places p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.q = g.q GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(qs), 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN gone_lists USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
