"""Operators on small tables: edge cases against brute-force versions."""

import hashlib
import random

import numpy as np
import pytest

from corpusloom.llm import bpe, cap_filters, chat, common, decontaminate, histogram_shards, jaccard, quality, substring, templates, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in enumerate(texts)], DOCS)


def test_words_and_blocks():
    texts = [b"Hello the  world", b"", b" the\tx\x0b", b"hello"]
    h, s, e, first = common.words_of(texts, lower=True)
    joined = b"\n".join(texts)
    assert [joined[a:b] for a, b in zip(s, e)] == [b"Hello", b"the", b"world", b"the", b"x", b"hello"]
    assert first.tolist() == [0, 3, 3, 5, 6] and h[0] == h[-1] and h[1] == h[3]
    many = [("%d word %d" % (i % 7, i)).encode() for i in range(50)]
    whole = common.words_of(many)
    common.BLOCK_BYTES, kept = 40, common.BLOCK_BYTES
    try:
        assert all(np.array_equal(x, y) for x, y in zip(whole, common.words_of(many)))
    finally:
        common.BLOCK_BYTES = kept


def test_trees_separate_and_edges():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 1] > 0.3).astype(float)
    model = quality.grow(x, y, trees=20)
    assert ((model.score(x) > 0.5) == (y > 0)).mean() > 0.98
    assert quality.grow(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert quality.statistics([b"", b"a", "é ü\n".encode()]).shape == (3, len(quality.STATISTICS))


def test_bpe_against_the_library():
    import base64

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(bpe.RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["", " ", "  a", "a  b \n c\t d", "x\x1cy \x1f z", "it's 's  we'll　ok", "a" * 3000, "漢字" * 200, " \n\n  end  ", "é \U0001f600"]
    texts += ["".join(rng.choice("ab '\n\t　é9!.") for _ in range(rng.randrange(40))) for _ in range(500)]
    model = bpe.bpe(path, public_tokenizers.PATTERN)
    for text, pieces in zip(texts, model.encode_texts(texts), strict=True):
        ids = [i for p in pieces for i in p]
        assert ids == enc.encode_ordinary(text) and model.decode(ids).decode() == text


def test_template_language():
    t = templates.Template('{% for m in xs %}{% if m.a == 1 %}one{% elif m.a == 2 and true %}{{ "t" + "wo" }}{% else %}{{ m.b | upper }}{% endif %}{% generation %};{% endgeneration %}{% endfor %}{# c #}')
    text, spans = t.render(xs=[{"a": 1}, {"a": 2}, {"b": "q"}])
    assert text == "one;two;Q;" and spans == [(3, 4), (7, 8), (9, 10)]
    assert templates.Template("{% if 1 == 1 %}a{{ 1 + 2 }}{% endif %}b").tree.parts[0].value == "a3b"
    assert templates.Template("a  {%- if true -%}  b  {%- endif -%}  c {{- 1 -}} \n d").render()[0] == "abc1d"
    for bad in ("{% for x in y %}", "{{ x.__class__() }}", "{% endif %}", "{{ x | nothing }}"):
        with pytest.raises(templates.TemplateError):
            templates.Template(bad)
    assert templates.Template("{{ x.__class__ }}").render(x="s")[0] == ""


def test_chat_round_trip():
    rows = [("user", "</s>[INST] ok [/INST]"), ("assistant", "a\\b [\\INST] [INST"), ("", ""), ("assistant", "<s></s>")]
    made, reader = chat.template(), chat.Reader()
    made.stream(reader.feed, messages=templates.messages(rows))
    whole, spans = made.render(messages=templates.messages(rows))
    again, masked = chat.Reader(), np.zeros(len(whole), dtype=bool)
    for a, b in spans:
        masked[a:b] = True
    for c, m in zip(whole, masked.tolist(), strict=True):  # the same from the string alone, a letter at a time
        again.feed(c, m)
    assert (again.turns.digest(), again.loss.digest(), again.n_turns, again.loss_chars) == (reader.turns.digest(), reader.loss.digest(), 4, reader.loss_chars)
    assert reader.n_turns == 4
    assert reader.turns.hexdigest() == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()
    assert reader.loss.hexdigest() == hashlib.sha256((rows[1][1] + rows[3][1]).encode()).hexdigest()


def test_levenshtein_automata():
    lexicon = toxicity.Lexicon({"idiot": 5.0, "worthless": 4.0}, {"lowei": 3.0})
    assert lexicon.match("idiot!") == 5.0 and lexicon.match("loweixyz") == 3.0
    for near in ("idi0t", "idoit", "idiott", "idot", "wrthlesss", "worhtless"):
        assert lexicon.match(near) > 0, near
    assert lexicon.match("patriot") == 0 and lexicon.match("") == 0
    scorer = toxicity.Scorer(lexicon, 2.0, -3.0)
    plain, quoted, none = scorer.evidence(["what an idiot he is", 'he said "idiot" once', ""])
    assert plain > quoted > none == 0


def test_jaccard_prefixes_never_lose_a_pair():
    rng = np.random.default_rng(1)
    for _ in range(300):
        base = rng.integers(0, 2**63, 60, dtype=np.uint64)
        a, b = np.unique(base), np.unique(np.r_[base[rng.integers(0, 3) :], rng.integers(0, 2**63, rng.integers(0, 4), dtype=np.uint64)])
        frequent = np.sort(rng.choice(base, 20, replace=False))
        if not jaccard.similar(a, b, 90):
            continue
        p = [o[: jaccard.prefix_size(len(x), 90)] for x in (a, b) for o, r in (jaccard.in_order(x, frequent),)]
        assert jaccard.possible(jaccard.sketch(a), len(a), jaccard.sketch(b), len(b), 90) and len(np.intersect1d(*p))
    far = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (60, 62, 130)]
    assert not any(jaccard.possible(jaccard.sketch(x), len(x), jaccard.sketch(y), len(y), 90) for x in far for y in far if x is not y)


def test_similar_components_edges(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words, "end"]), None, "", "a b", "A  b", " ".join(reversed(words)), " ".join(words)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(documents(spark, texts)).collect()}
    assert [got[i][1] for i in range(8)] == [0, 0, 2, 3, 4, 4, 6, 0] and got[2][0] == got[3][0] == 0 and got[4][0] == 1


def test_substring_against_brute_force(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(30)]
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(30))) for _ in range(12)]
    texts += [" ".join(["x", *passage, "y"]), " ".join([*passage[3:], "z", *passage]), None, "", " ".join(passage)]
    window = 6
    lists = [(t or "").split() for t in texts]
    want = []
    for d, w in enumerate(lists):
        earlier = {tuple(v[i : i + window]) for v in lists[:d] for i in range(len(v) - window + 1)}
        gone = {i + k for i in range(len(w) - window + 1) if tuple(w[i : i + window]) in earlier for k in range(window)}
        want.append(" ".join(x for i, x in enumerate(w) if i not in gone) if gone else texts[d])
    df = documents(spark, texts)
    out = substring.deduplicated(df, window, 2)
    assert out.columns == df.columns and [r.text for r in out.orderBy("doc_id").collect()] == want


def test_decontamination(spark):
    q = "If John Smith has 12 apples and buys 30 kg of pears at 5 dollars each, how much does John pay in total today"
    texts = ["x y. " + q, "so, " + q.replace("John", "Mary").replace("12", "77").replace("30 kg", "4 lb"), None, "", "twelve apples and some other words that say nothing of it"]
    bench = spark.createDataFrame([(7, q), (8, None), (9, q), (1, "")], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, list(r.item_ids), r.reparameterised) for r in decontaminate.marked(documents(spark, texts), bench).collect()}
    assert got == {0: (True, [7, 9], False), 1: (True, [7, 9], True), 2: (False, [], False), 3: (False, [], False), 4: (False, [], False)}


def test_shards_are_even_and_gapless(spark):
    rng = random.Random(2)
    rows = [(i, "same" if i % 3 == 0 else str(i), rng.randrange(8, 200)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, t string, size long")
    from pyspark.sql import functions as F

    out = histogram_shards.histogram_shards(df.withColumn("k", F.xxhash64("t")), "k", "size", 7).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(out) == 600 and sizes.max() - sizes.min() <= 400 and set(out.shard) == set(range(7))
    assert out.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s)))).all()
    assert histogram_shards.histogram_shards(df.withColumn("k", F.xxhash64("t")).limit(0), "k", "size", 7).count() == 0


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 16))
    x = np.concatenate([base, base[:10] + 0.02 * rng.normal(size=(10, 16)), base[:3], 2 * base[3:5]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [0.0] * 16), (102, [float("nan")] * 16), (103, [1.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cap_filters.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.95
    assert all(got[i][0] == hit[i].sum() - 1 for i in range(len(x)))
    assert all(got[i][1] == min(np.flatnonzero(hit[i])) for i in range(len(x)))
    assert all(got[i] == (0, i, True) for i in (100, 101, 102, 103))


def test_substring_keeps_the_middle_of_runs_that_begin_and_end_alike(spark):
    rng = random.Random(9)
    filler = lambda: [f"u{rng.randrange(10**6)}" for _ in range(5)]
    line = ["q8a", "q8b"]  # of a low hash: it comes back within a window and is the seed of all windows
    head, tail = ([x for _ in range(3) for x in [*line, *filler()]] for _ in range(2))
    texts = [" ".join([*head, *(x for _ in range(6) for x in [*line, *filler()]), *tail, *line]) for _ in range(12)]
    window, seed = 12, 2
    lists = [t.split() for t in texts]
    want = []
    for d, w in enumerate(lists):
        earlier = {tuple(v[i : i + window]) for v in lists[:d] for i in range(len(v) - window + 1)}
        gone = {i + k for i in range(len(w) - window + 1) if tuple(w[i : i + window]) in earlier for k in range(window)}
        want.append(" ".join(x for i, x in enumerate(w) if i not in gone))
    assert [r.text for r in substring.deduplicated(documents(spark, texts), window, seed).orderBy("doc_id").collect()] == want


@pytest.mark.parametrize("vectors", [10_000, 1_000_000, 2_000_000])
def test_filters_hold_pairs_at_the_threshold_at_every_size(vectors):
    made = cap_filters.CapFilters(64, vectors, **cap_filters.fitted(64, vectors, 0.95))
    assert made.blocks == (2 if vectors == 10_000 else 3)  # more filters bring the third block earlier
    assert cap_filters.recall(made, 64, 0.95, 1_500, seed=99) >= 0.975


def test_pieces_lose_no_misspelling_that_the_automaton_accepts():
    rng = random.Random(8)
    for near, term in (("wotrhle*s", "worthless"), ("0orthelss", "worthless"), ("ibmeci*e", "imbecile"), ("ptahet*c", "pathetic")):
        assert toxicity.Lexicon({term: 4.0}, {}).misspelt(near) == (term, 2)
    assert toxicity.Lexicon({"worthless": 4.0}, {}).misspelt("wrthles") == ("worthless", 2)
    swap = lambda w, i: w[:i] + w[i + 1] + w[i] + w[i + 2 :]
    edit = (swap, lambda w, i: w[:i] + w[i + 1 :], lambda w, i: w[:i] + "*" + w[i + 1 :], lambda w, i: w[:i] + "*" + w[i:])
    for _ in range(4000):
        terms = ["".join(rng.choices("abcdefghij", k=rng.choice([4, 5, 7, 8, 9, 10, 11, 12]))) for _ in range(rng.choice([1, 5]))]
        lexicon, word = toxicity.Lexicon(dict.fromkeys(terms, 1.0), {}), terms[0]
        for _ in range(2):
            word = rng.choice(edit)(word, rng.randrange(len(word) - 1))
        accepted = [n for t, n in lexicon.within(word, 2) if n <= lexicon.allowed(t)]
        assert lexicon._tries(word) >= max(accepted, default=0) and (not 3 <= len(word) or (lexicon.misspelt(word) is not None) == any(accepted)), (terms, word)


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_WINDOWS, 0])
def test_items_of_few_plain_words_are_found_verbatim(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    items = ["What is 12 * 34 - 56 / 7?", "Solve 3x + 5 = 20 for x", "What is 17 times 23?", "Compute 3/4 + 5/6 - 7/8 + 9/10.", "2, 4, 8, 16, 32, 64: what comes next?", "Convert 5 km and 300 m to 12 miles 4 ft 6 in"]
    mixed = "Take 3, 4, 5, 6, 7, 8, 9, 11, 12, 15 and then say which of all these numbers is the largest one"
    texts = ["so, " + t + " he asked" for t in items] + ["What is 13 * 35 - 57 / 8?", "so, " + mixed, "so, " + "".join(str(9 - int(c)) if c.isdigit() else c for c in mixed)]
    bench = spark.createDataFrame(list(enumerate([*items, mixed])), "item_id long, text string")
    got = {r.doc_id: (list(r.item_ids), r.reparameterised) for r in decontaminate.marked(documents(spark, texts), bench).collect()}
    assert got == {**{i: ([i], False) for i in range(6)}, 6: ([], False), 7: ([6], False), 8: ([6], True)}
