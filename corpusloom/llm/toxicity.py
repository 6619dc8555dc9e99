"""Toxicity: Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned: from a bounded sample of labelled rows (`MAX_TRAINING_ROWS`), words whose document counts set toxic rows apart become
terms, and beginnings shared by many such words become stems. Each distinct word of a text (lower case, marks at its edges gone) is matched
against the trie: exactly, by a stem, or by an automaton that accepts all words within one edit of it (two from eight letters on; a
swap of neighbours is one edit), run down the trie together with it. Words that the sample shows in rows that are not toxic
never match by edits. A hit weighs its log-odds times a context score of the words around it: quotation marks and words of reporting lower it,
address in the second person raises it. The score is a logistic function, fitted on the sample, of the log of the summed weights.

What is learned is bounded by the sample alone: all its words that pass the tests are kept.

Edge cases: null and empty texts have no hits; without labelled rows of both classes (empty tables too) the lexicon is empty and scores are the
prior's; very long texts are scored whole, one at a time; repeated rows get equal scores and count once in the sample; a null doc_id is scored, never
learned from, and has a null held_out; labels of one doc_id that contradict one another count as the lower; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import _BASE, _BASE_INVERSE, _power, mix, rolling, table, text_chunks, words_of, written
from corpusloom.llm.quality import labelled_sample, training_fold

MAX_TRAINING_ROWS = 20_000
#: A term's or stem's log-likelihood ratio against chance is at least this.
LEAST_RATIO = 18.0
#: A term whose lookalikes are clean words more often than this matches no misspellings.
LEAST_TRUST = 0.4
TOXIC_AT = 0.5
WINDOW = 6
CACHED = 300_000
_EDGE = " \t.,;:!?*#$%&|\"'`´‘’“”«»„()[]{}<>-–—…¡¿"
#: Marks that begin a quotation, and those that end what each begins. The apostrophe is none: it also stands for letters left out.
_QUOTES = {'"': frozenset('"'), "“": frozenset("”"), "„": frozenset("“”"), "«": frozenset("»"), "»": frozenset("«"), "‘": frozenset("’")}
_REPORTING = frozenset("said says wrote writes quoted quote called calls term word dit écrit mot sagte schrieb wort dijo escribió palabra".split())
_ADDRESS = frozenset("you your you're u du dich dir tu te toi vous usted tú".split())


def automaton(word: str) -> tuple[dict[str, int], int]:
    """The Levenshtein automaton of a word: for each letter the places where it may be read next, and the accepting place. A state is a tuple of
    bit sets: set j holds the places that j edits lead to."""
    reads: dict[str, int] = {}
    for i, c in enumerate(word):
        reads[c] = reads.get(c, 0) | 1 << i
    return reads, 1 << len(word)


def step(reads: dict[str, int], state: tuple[int, ...], c: str, before: tuple[int, ...] | None, last: str) -> tuple[int, ...]:
    """The state after reading c; `before` and `last` are the state and letter of one step earlier, for swaps."""
    here = reads.get(c, 0)
    out = [(state[0] & here) << 1]
    for j in range(1, len(state)):
        places = (state[j] & here) << 1 | state[j - 1] | state[j - 1] << 1 | out[j - 1] << 1
        if before is not None:
            places |= (before[j - 1] & here & reads.get(last, 0) >> 1) << 2
        out.append(places)
    return tuple(out)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of hashes up to each letter of all words, where each word begins, and its length."""
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sums = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(mix(points + np.uint64(1)) * _power(_BASE, len(points)), out=sums[1:])
    return sums, np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64) if len(words) else length, length


def _substrings(letters: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of the `size` letters at `at` of each word that has them."""
    sums, begin, length = letters
    rows = np.flatnonzero(length >= at + size)
    lo = begin[rows] + at[rows]
    return rows, (sums[lo + size] - sums[lo]) * _power(_BASE_INVERSE, len(sums))[lo]


@dataclass
class Lexicon:
    """A trie of the terms, stems by their length, and for each term the share of its weight that a misspelling carries."""

    terms: dict[str, float]
    stems: dict[str, float]
    vetoes: frozenset[str] = frozenset()
    trust: dict[str, float] = field(default_factory=dict)
    root: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        pieces: dict[tuple[int, int], dict[str, int]] = {}  # by place and size, the edits that a piece there is worth
        for word in self.terms:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = word
            if len(word) >= 4:
                edits = self.allowed(word)
                cuts = [len(word) * k // (edits + 1) for k in range(edits + 2)]
                swapped = [word[: c - 1] + word[c] + word[c - 1] + word[c + 1 :] for c in cuts[1:-1]]
                # of n + 1 pieces, n edits leave one as it is, unless one is a swap over a cut. With a swap over the first cut, the other edit
                # leaves the last piece or stands behind the first (swapped) one; over the second, it leaves the first or the (swapped) last.
                marks = [(word[a:b], a, edits) for a, b in zip(cuts, cuts[1:], strict=False)] + [(swapped[0][: cuts[1]], 0, 0)]
                if edits == 2:
                    marks.append((swapped[1][cuts[2] :], cuts[2], 1))
                for piece, a, shift in marks:
                    for at in range(max(0, a - shift), a + shift + 1):
                        at_here = pieces.setdefault((at, len(piece)), {})
                        at_here[piece] = max(edits, at_here.get(piece, 0))
        self._pieces = [(at, at + size, of.get) for (at, size), of in sorted(pieces.items())]
        self._shortest, self._longest = min((len(t) - self.allowed(t) for t in self.terms), default=0), max(map(len, self.terms), default=-9) + 2
        self._stem_sizes = sorted({len(x) for x in self.stems})
        seen: dict[tuple[int, int], set[str]] = {}  # by place and size, what a word that matches may have there
        for (at, size), of in pieces.items():
            seen.setdefault((at, size), set()).update(of)
        for whole in (*self.terms, *self.stems):
            seen.setdefault((0, len(whole)), set()).add(whole)
        self._seen = [(at, size, np.sort(_substrings(_letters(list(of)), np.zeros(len(of), dtype=np.int64), size)[1])) for (at, size), of in sorted(seen.items())]
        self._seen = [(at, size, known) for at, size, known in self._seen if len(known)]

    @staticmethod
    def allowed(term: str) -> int:
        return 2 if len(term) >= 8 else 1 if len(term) >= 4 else 0

    def _tries(self, word: str) -> int:
        """The edits that are worth trying: 0 where no term has a piece of `word` about where it stands there."""
        return max([get(word[a:b], 0) for a, b, get in self._pieces], default=0)

    def within(self, word: str, edits: int) -> list[tuple[str, int]]:
        """(term, edits) of all terms that the automaton of `word` accepts on the trie."""
        reads, end = automaton(word)
        start = tuple((1 << j + 1) - 1 for j in range(edits + 1))
        found: list[tuple[str, int]] = []
        stack: list[tuple[dict, tuple[int, ...], tuple[int, ...] | None, str]] = [(self.root, start, None, "")]
        while stack:
            node, state, before, last = stack.pop()
            for c, below in node.items():
                if not c:
                    if (n := next((j for j, places in enumerate(state) if places & end), None)) is not None:
                        found.append((below, n))
                    continue
                now = step(reads, state, c, before, last)
                if now[-1] & (2 * end - 1):
                    stack.append((below, now, state, c))
        return found

    def candidates(self, raw: list[str]) -> list[str]:
        """Of words as they stand, those that can match: with a term, stem or piece where it has to be. All words at a time, by hashes."""
        bare = [w.strip(_EDGE) for w in raw]
        letters = _letters(bare)
        ok = np.zeros(len(raw), dtype=bool)
        for at, size, known in self._seen:
            rows, hashes = _substrings(letters, np.full(len(raw), at, dtype=np.int64), size)
            near = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            ok[rows[known[near] == hashes]] = True
        return [raw[k] for k in np.flatnonzero(ok).tolist()]

    def misspelt(self, word: str) -> tuple[str, int] | None:
        """The heaviest term that `word` may be a misspelling of, and the edits."""
        if not max(3, self._shortest) <= len(word) <= self._longest or not (edits := self._tries(word)):
            return None
        near = [(self.terms[t] * (0.85 if n == 1 else 0.6), t, n) for t, n in self.within(word, edits) if 0 < n <= self.allowed(t)]
        return max(near)[1:] if near else None

    def match(self, raw: str) -> float:
        """The weight of a word as it stands in a lower-cased text; 0 where it is no hit."""
        word = raw.strip(_EDGE)
        if (w := self.terms.get(word)) is not None:
            return w
        for n in self._stem_sizes:
            if len(word) >= n and (w := self.stems.get(word[:n])) is not None:
                return w
        if word in self.vetoes or (found := self.misspelt(word)) is None:
            return 0.0
        trust = self.trust.get(found[0], 1.0)
        return self.terms[found[0]] * (0.85 if found[1] == 1 else 0.6) * trust if trust >= LEAST_TRUST else 0.0


@dataclass
class Scorer:
    lexicon: Lexicon
    slope: float
    bias: float
    _cache: dict[str, float] = field(default_factory=dict)

    def context(self, words: list[str], at: int) -> float:
        around = words[max(0, at - WINDOW) : at + WINDOW + 1]
        before, after = words[max(0, at - WINDOW) : at + 1], words[at : at + WINDOW + 1]
        ends = {w.rstrip(".,;:!?")[-1:] for w in after}
        quoted = any(not ends.isdisjoint(_QUOTES.get(w[0], ())) for w in before)
        bare = {w.strip(_EDGE) for w in around}
        factor = (0.3 if quoted else 1.0) * (0.6 if bare & _REPORTING else 1.0)
        return factor * (1.5 if bare & _ADDRESS else 1.0)

    def evidence(self, texts: list[str]) -> np.ndarray:
        split = [t.lower().split() for t in texts]
        words = set().union(*split)
        fresh = words - self._cache.keys()
        if len(self._cache) + len(fresh) > CACHED:
            self._cache.clear()
            fresh = words
        match, new = self.lexicon.match, list(fresh)
        self._cache.update(dict.fromkeys(new, 0.0))
        self._cache.update((w, match(w)) for w in self.lexicon.candidates(new))
        hits = {w for w in words if self._cache[w]}
        out = np.zeros(len(texts))
        for k, words in enumerate(split):
            if hits and not hits.isdisjoint(words):
                out[k] = sum(self._cache[w] * self.context(words, i) for i, w in enumerate(words) if w in hits)
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * np.log1p(self.evidence(texts)) + self.bias)))


def _words_by_label(sample: DataFrame) -> DataFrame:
    """word, toxic, clean: numbers of the sample's documents that hold it."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for ys, texts in text_chunks(batches, ("y",)):
            by: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for y, t in zip(ys, texts, strict=True):
                by[1 if y else 0].update({w.strip(_EDGE) for w in (t or b"").decode("utf-8", "replace").lower().split()} - {""})
            words = list(by[0].keys() | by[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([by[y][w] for w in words], pa.int64()) for y in (1, 0))], ["word", "toxic", "clean"])

    return sample.select("y", "text").mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _one_of_each(sample: DataFrame) -> DataFrame:
    """The sample without near copies: of the rows that share the least hash of three words, the one of the smallest doc_id. Else the words of
    a copied text would count as often as its copies."""

    def sketch(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for ids, ys, texts in text_chunks(batches, ("doc_id", "y")):
            hashes, _, _, first = words_of([t or b"" for t in texts], lower=True)
            least = [int((rolling(h, 3) if len(h) >= 3 else h).min().astype(np.int64)) if len(h) else i for i, h in ((i, hashes[first[i] : first[i + 1]]) for i in range(len(texts)))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(least, pa.int64())], ["doc_id", "y", "text", "sketch"])

    marked = sample.select("doc_id", "y", "text").mapInArrow(sketch, "doc_id long, y int, text string, sketch long")
    return marked.groupBy("sketch").agg(F.min_by(F.struct("doc_id", "y", "text"), "doc_id").alias("r")).select("r.*")


def train(docs: DataFrame, labels: DataFrame, rows: int = MAX_TRAINING_ROWS) -> Scorer:
    sample = written(_one_of_each(labelled_sample(docs, labels, "toxic", 5, 0, rows)), "toxicity-sample")
    n = {r.y: r.n for r in sample.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Scorer(Lexicon({}, {}), 0.0, math.log((toxic + 0.5) / (clean + 0.5)) if toxic + clean else -4.0)
    words = written(_words_by_label(sample), "toxicity-words", 8)
    t, c = F.col("toxic"), F.col("clean")
    odds = F.log((t + 0.1) / F.lit(float(toxic))) - F.log((c + 0.1) / F.lit(float(clean)))
    share = toxic / (toxic + clean)
    ratio = t * F.log(t / (t + c) / share) + F.when(c > 0, c * F.log(c / (t + c) / (1 - share))).otherwise(0.0)  # a likelihood ratio
    apart = lambda df: df.where((t > 0) & (c * 20 <= t)).withColumn("odds", odds).where(ratio >= LEAST_RATIO)
    terms = {r.word: r.odds for r in apart(words.where(F.length("word") >= 3)).collect()}
    heads = words.select(F.explode(F.transform(F.array(*map(F.lit, (4, 5, 6, 7, 8, 9))), lambda k: F.when(F.length("word") > k, F.col("word").substr(F.lit(1), k)))).alias("stem"), "toxic", "clean").where("stem is not null")
    heads = apart(heads.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count(F.lit(1)).alias("n"))).where("n >= 5").withColumn("ratio", ratio)
    stems: dict[str, float] = {}
    for r in heads.orderBy(F.desc("ratio"), F.length("stem"), "stem").collect():
        if not any(r.stem.startswith(s) or s.startswith(r.stem) for s in stems):
            stems[r.stem] = r.odds
    terms = {w: o for w, o in terms.items() if not any(w.startswith(s) for s in stems)}
    plain = Lexicon(terms, stems)

    def near(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found = [(w, x[0], t, c) for w, t, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) if w not in plain.terms and (x := plain.misspelt(w))]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*found, strict=True) if found else ((),) * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["word", "term", "toxic", "clean"])

    lookalikes = words.select("word", "toxic", "clean").mapInArrow(near, "word string, term string, toxic long, clean long").collect()
    ours, theirs = Counter(r.term for r in lookalikes if not r.clean), Counter(r.term for r in lookalikes if r.clean)
    trust = {w: (ours[w] + 1) / (ours[w] + theirs[w] + 1) for w in terms}
    scorer = Scorer(Lexicon(terms, stems, frozenset(r.word for r in lookalikes if r.clean), trust), 1.0, 0.0)
    weighed = _evidence(sample, scorer).toPandas()
    scorer.slope, scorer.bias = _fit(np.log1p(weighed.evidence.to_numpy()), (weighed.y.to_numpy() > 0).astype(float))
    return scorer


def _evidence(sample: DataFrame, scorer: Scorer) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for ys, texts in text_chunks(batches, ("y",)):
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(scorer.evidence([(t or b"").decode("utf-8", "replace") for t in texts]))], ["y", "evidence"])

    return sample.select("y", "text").mapInArrow(run, "y int, evidence double")


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope (not below 0.5) and bias of a logistic regression, by Newton's steps."""
    a, b = 1.0, -1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        h = p * (1 - p)
        g = np.array([((p - y) * x).sum() + ridge * a, (p - y).sum() + ridge * b])
        m = np.array([[(h * x * x).sum() + ridge, (h * x).sum()], [(h * x).sum(), h.sum() + ridge]])
        step = np.linalg.solve(m, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return max(a, 0.5), b


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id and score of each whole text."""

    def run(batches: Iterator) -> Iterator:
        import gc

        import pyarrow as pa

        gc.disable()  # many small strings and no cycles
        try:
            for ids, texts in text_chunks(batches):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scorer.score([(t or b"").decode("utf-8", "replace") for t in texts]))], ["doc_id", "score"])
        finally:
            gc.enable()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: doc_id, held_out, score, predicted for every document."""
    docs = table(spark, sf_dir, "documents")
    scorer = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, scorer).select("doc_id", (~training_fold(F.col("doc_id"), 5, 0)).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))
