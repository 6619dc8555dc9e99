"""Nulls, empty and long texts, ties and repeated rows, empty tables and clashing columns, operator by operator, and held-out floors."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, chat, decontaminate, histogram_shards, quality, toxicity

DOCS = "doc_id long, text string, score double, key string, y int, held_out string"
ROWS = [(1, "one two"), (1, "one two"), (1, "three"), (2, None), (3, ""), (None, "one two"), (None, None), (4, "word " * 60_000)]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, "k", 1, "h") for i, t in rows], DOCS)


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def _corpus(seed: int, n: int = 600) -> tuple[list[tuple[int, str]], list[tuple[int, int, int]]]:
    r = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("ba", "ko", "lin", "tra") for b in ("den", "mis", "ro") for c in ("", "al", "us")]
    docs, labels = [], []
    for i in range(n):
        good, toxic = r.random() < 0.5, r.random() < 0.3
        text = [r.choice(words) for _ in range(r.randrange(20, 80))]
        if not good:
            text = [w.upper() + "!!!" if r.random() < 0.5 else w for w in text]
        for _ in range(r.randrange(1, 4) if toxic else 0):
            text.insert(r.randrange(len(text)), r.choice(["idiot", "worthless", "moron", "worthles", "idoit"]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def test_quality_and_toxicity_on_what_was_held_out(spark):
    docs, labels = _corpus(3)
    for made, module, label, modulus, held_out in ((quality.score, quality, 1, 4, 2), (toxicity.score, toxicity, 2, 5, 0)):
        model = module.train(_docs(spark, docs), _labels(spark, labels))
        got = {r.doc_id: r.score for r in made(_docs(spark, docs), model).collect()}
        apart = [(got[i], x[label]) for i, x in enumerate(labels) if zlib.crc32(str(i).encode()) % modulus == held_out]
        assert len(apart) > 80 and all(0 <= s <= 1 for s, _ in apart)
        pairs = [(a > b) + 0.5 * (a == b) for a, x in apart for b, y in apart if x > y]
        assert np.mean(pairs) > 0.97, module.__name__
        # the fold that is held out changes nothing that is learned
        other = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % modulus == held_out else (i, q, t) for i, q, t in labels]
        again = {r.doc_id: r.score for r in made(_docs(spark, docs), module.train(_docs(spark, docs), _labels(spark, other))).collect()}
        assert again == got


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_of_odd_rows(spark, module):
    docs, labels = _corpus(4, 200)
    model = module.train(_docs(spark, [*docs, *ROWS, (7, "twice")]), _labels(spark, [*labels, (7, 0, 1), (None, 1, 1), (9_999, None, None)]))
    got = Counter((r.doc_id, round(r.score, 9)) for r in module.score(_docs(spark, ROWS), model).collect())
    assert sum(got.values()) == len(ROWS) and max(got.values()) >= 2 and all(0 <= s <= 1 for _, s in got)
    empty = module.train(_docs(spark, []), _labels(spark, []))
    assert module.score(_docs(spark, []), empty).count() == 0
    assert len({r.score for r in module.score(_docs(spark, ROWS), empty).collect()}) == 1


def test_statistics_against_plain_python():
    texts = ["Some words, here: and 12 more!!\nA second line | x", "", "éa é  ¡ok", "the the the end."]
    for t, row in zip(texts, quality.statistics([t.encode() for t in texts]), strict=True):
        x, raw, words = dict(zip(quality.STATISTICS, row, strict=True)), t.encode(), t.encode().split()
        n = max(len(words), 1)
        assert x["share_digit"] == sum(48 <= b < 58 for b in raw) / max(len(raw), 1) and x["share_non_ascii"] == sum(b > 127 for b in raw) / max(len(raw), 1)
        assert np.isclose(x["log_words"], np.log1p(len(words))) and np.isclose(x["mean_word"], sum(map(len, words)) / n)
        assert np.isclose(x["distinct_words"], len(set(words)) / n) and np.isclose(x["top_word"], max(Counter(words).values(), default=0) / n)
        assert np.isclose(x["repeats_last"], sum(a == b for a, b in zip(words, words[1:], strict=False)) / n) and np.isclose(x["words_a_line"], len(words) / (raw.count(b"\n") + 1))


def test_trees_against_walking_one_row_at_a_time():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5))
    model = quality.grow(x, (x[:, 0] * x[:, 2] > 0).astype(float), trees=12, depth=3)
    for row, score in zip(x[:40], model.score(x[:40]), strict=True):
        total = model.base
        for k in model.roots.tolist():
            while model.left[k] != k:
                k = int(model.left[k] if row[model.feature[k]] <= model.threshold[k] else model.right[k])
            total += model.value[k]
        assert np.isclose(score, 1 / (1 + np.exp(-total)))


def test_matching_against_edit_distance():
    def distance(a: str, b: str) -> int:  # with swaps of neighbours
        d = np.add.outer(np.arange(len(a) + 1), np.arange(len(b) + 1))
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return int(d[-1, -1])

    r, terms = random.Random(6), {"idiot": 5.0, "worthless": 4.0, "imbecile": 3.5, "ugly": 2.0, "fool": 2.5}
    lexicon = toxicity.Lexicon(terms, {"lowei": 3.0})
    words = []
    for _ in range(3_000):
        w = list(r.choice(list(terms)))
        for _ in range(r.randrange(4)):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([[], [w[k], r.choice("abéx0")], [r.choice("aeio")], [w[k]]])
            w = w or ["x"]
        words.append("".join(w) + r.choice(["", "!", '"', "..."]))
    words += ["loweixx", "lowe", "", "!!", "patriot"]
    near = set(lexicon.candidates(words))
    for raw in words:
        w = raw.strip(toxicity._EDGE)
        allowed = any(0 < distance(w, t) <= lexicon.allowed(t) for t in terms) and len(w) >= 3
        want = w in terms or w.startswith("lowei") or allowed
        assert (lexicon.match(raw) > 0) == want, raw
        assert not want or raw in near


def test_quotations_need_marks_that_belong_together():
    scorer = toxicity.Scorer(toxicity.Lexicon({"idiot": 5.0}, {}), 2.0, -3.0)
    elided, quoted, address, plain = scorer.evidence(["'tis true that idiot chased dogs' tails", "a man called “the idiot” here", "that idiot is you", "that idiot left"])
    assert elided == plain == 5.0 and quoted < plain < address


def test_tokens_of_odd_rows(spark):
    got = Counter((r.doc_id, len(r.ids)) for r in bpe.encode(_docs(spark, ROWS)).collect())
    assert sum(got.values()) == len(ROWS) and got[(2, 0)] == got[(3, 0)] == got[(None, 0)] == 1 and max(k[1] for k in got) >= 60_000
    back = bpe.decode(bpe.encode(_docs(spark, ROWS))).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in ROWS)
    assert bpe.encode(_docs(spark, [])).count() == 0
    stage = bpe.token_stage(spark, _docs(spark, ROWS), "")
    assert stage.columns == ["doc_id", "n_tokens", "ids"] and stage.count() == len(ROWS)


def test_conversations_of_odd_rows(spark, tmp_path):
    rows = [(None, 1, "user", "a"), (None, 0, None, None), (5, 2, "assistant", "same"), (5, 2, "assistant", "same"), (5, None, "user", "</s>\\"), (-1, 0, "assistant", "own"), (6, 0, "assistant", "x" * 300_000)]
    made = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, origin string")
    made.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.n_turns, r.loss_chars): r for r in chat.query(spark, str(tmp_path)).collect()}
    assert set(got) == {(None, 2, 0), (5, 3, 8), (-1, 1, 3), (-1, 2, len(chat.PROBE)), (6, 1, 300_000)}
    digest = lambda *turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[(5, 3, 8)].turns_sha256 == digest(("user", "</s>\\"), ("assistant", "same"), ("assistant", "same"))
    assert got[(None, 2, 0)].turns_sha256 == digest(("", ""), ("user", "a"))
    made.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert [r.conv_id for r in chat.query(spark, f"{tmp_path}/none").collect()] == [-1]
    whole = {r.conv_id: r for r in chat.format_conversations(made.where("conv_id = 5")).collect()}[5]
    assert "".join(chat.unescape(whole.text[s.start : s.end]) for s in whole.loss) == "samesame"


def test_leaks_of_odd_rows(spark):
    item = "If John Smith has 12 apples and buys 30 kg of pears at 5 dollars each, how much does John pay in total today"
    rows = [(1, "so " + item), (1, "something else altogether that is clean"), (None, item), (None, "clean words"), (2, None), (3, ""), (4, item), (4, item), (5, "filler words go on " * 20_000 + item)]
    bench = spark.createDataFrame([(1, item, "c"), (1, item, "c"), (2, None, "c"), (3, "", "c")], "item_id long, text string, doc_id string")
    got = decontaminate.marked(_docs(spark, rows), bench).collect()
    assert Counter((r.doc_id, r.contaminated) for r in got) == Counter([(1, True), (1, False), (None, True), (None, False), (2, False), (3, False), (4, True), (4, True), (5, True)])
    assert decontaminate.marked(_docs(spark, []), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.marked(_docs(spark, rows), bench.limit(0)).collect())


def _templates(text: str) -> list[tuple[str, str]]:
    """(type or word, value) of each token, by plain Python."""
    import re

    out = []
    for m in re.finditer(r"[^\W_]+(?:[.,]\d+)*", text):
        w = m[0]
        before = text[: m.start()]
        if w[0].isdigit():
            out.append(("#", w))
        elif re.fullmatch(r"[A-Z][a-z]\w*", w) and re.search(r"[a-z0-9,;:] $", before):
            out.append(("n", w.lower()))
        elif w.lower() in decontaminate.UNITS and re.search(r"\d ?$", before):
            out.append(("u", w.lower()))
        else:
            out.append((w.lower(), w.lower()))
    return out


def test_leaks_against_brute_force(spark):
    r = random.Random(12)
    names, plain = ["John", "Mary", "Otto", "Zoe"], "the a box holds many red and green apples which she sold to them before lunch on that long day".split()
    items = []
    for k in range(12):
        words = [r.choice(plain) for _ in range(14)]
        for at in r.sample(range(1, 13), 4):
            words[at] = r.choice([r.choice(names), str(r.randrange(2, 99)), f"{r.randrange(2, 99)} km"])
        items.append((k, " ".join(words)))
    rows = []
    for i in range(60):
        _, text = r.choice(items)
        words = text.split()
        if i % 3 == 0:  # other values, the same for the same
            new = {w: str(int(w) + 100) for w in words if w.isdigit()} | {a: b for a, b in zip(names, names[1:] + names[:1], strict=True)}
            words = [new.get(w, w) for w in words]
        if i % 4 == 1:
            words[r.randrange(len(words))] = "otherwise"
        if i % 5 == 2:
            words = words[: r.randrange(5, 14)]
        rows.append((i, "so it was that " + " ".join(words) + " they said"))

    def leaks(doc: str, item: str) -> bool:
        d, t, w = _templates(doc), _templates(item), min(decontaminate.WINDOW, len(_templates(item)))
        literal = lambda lo: sum(k not in ("#", "n", "u") for k, _ in t[lo : lo + w]) >= min(decontaminate.LITERALS, w)
        starts = range(len(t) - w + 1)
        hits = [(p, q) for q in starts for p in range(len(d) - w + 1) if all((x[0] == y[0]) if literal(q) else (x[1] == y[1]) for x, y in zip(d[p : p + w], t[q : q + w], strict=True))]
        good = set()
        for diagonal in {p - q for p, q in hits if literal(q)}:
            filled = [(t[q + x][0], t[q + x][1], d[p + x][1]) for p, q in hits if literal(q) and p - q == diagonal for x in range(w) if t[q + x][0] in ("#", "n", "u")]
            by: dict = {}
            for kind, own, value in filled:
                by.setdefault((kind, own), set()).add(value)
            if all(len(v) == 1 for v in by.values()) or sum(o == v for _, o, v in filled) >= decontaminate.VERBATIM * len(filled):
                good |= {q for p, q in hits if literal(q) and p - q == diagonal}
        bare = {q for p, q in hits if not literal(q)}
        few = [q for q in starts if literal(q)]
        return len(good | bare) / len(starts) >= decontaminate.COVERAGE or bool(few) and len(good) / len(few) >= decontaminate.COVERAGE

    got = decontaminate.marked(_docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {x.doc_id: list(x.item_ids) for x in got} == {i: [k for k, t in items if leaks(text, t)] for i, text in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_shards_hang_on_the_rows_alone(spark, seed):
    r = random.Random(seed)
    rows = [(None if k % 50 == 0 else k // 2, r.choice(["hot", f"t{r.randrange(150)}"]) if k % 3 else "hot", r.randrange(1, 300), "clash") for k in range(900)]
    df = spark.createDataFrame([(i, t, n + 8, c) for i, t, n, c in rows], "doc_id long, t string, size long, hs_k1 string")
    both = []
    for parts in (3, 5):
        out = histogram_shards.histogram_shards(df.repartition(parts).withColumn("key", F.xxhash64("t")), "key", "size", 6, tie="doc_id")
        assert set(out.columns) == {"doc_id", "t", "size", "hs_k1", "key", "shard", "slot"}
        got = out.toPandas()
        both.append(Counter(zip(got.doc_id.fillna(-1), got.t, got["shard"], strict=True)))
        assert all(sorted(x.slot) == list(range(len(x))) for _, x in got.groupby("shard"))
        total, ideal = got["size"].sum(), got["size"].sum() / 6
        sizes, groups = got.groupby("shard")["size"].sum(), got.groupby("t")["size"].sum()
        assert (abs(sizes - ideal) <= histogram_shards.WHOLE * ideal + 400).all() and total == sum(n + 8 for _, _, n, _ in rows)
        for t, shards in got.groupby("t")["shard"].nunique().items():
            assert shards == 1 or groups[t] > histogram_shards.WHOLE * ideal, t
    apart = (both[0] - both[1]) + (both[1] - both[0])  # rows alike in id and text may change places with one another, as their sizes differ
    assert sum(apart.values()) <= 4
    assert histogram_shards.histogram_shards(df.limit(0).withColumn("key", F.xxhash64("t")), "key", "size", 6, tie="doc_id").count() == 0
