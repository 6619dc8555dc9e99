"""The pipeline's stages on a small corpus: what is kept after each, by brute force, with odd rows and clashing columns."""

from __future__ import annotations

import base64
import random

import corpus_pipeline

from corpusloom.llm import common, quality


def _tables(spark, path: str) -> list[tuple]:
    r = random.Random(21)
    words = [f"{a}{b}{c}" for a in ("ba", "ko", "lin", "tra", "sum") for b in ("den", "mis", "ro", "val") for c in ("", "al", "us", "ent")]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, item = prose(70), "If John Smith has 12 apples and buys 30 kg of pears at 5 dollars each, how much does John pay in total today"
    texts: list[str | None] = [prose(r.randrange(60, 140)) for _ in range(80)]
    junk = ["$$$ !!! CLICK " * 20 + f"{i} ### !!!" for i in range(40)]
    labels = [(i, 1, 0) for i in range(80)] + [(80 + i, 0, 0) for i in range(40)]
    texts += junk
    texts += [texts[3], texts[4] + " more", f"{prose(40)} {passage} {prose(40)}", f"{prose(40)} {passage} {prose(30)}", f"{prose(60)} {item} {prose(60)}", "", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[6]), (None, f"{prose(60)} {item} {prose(60)}"), (None, prose(90))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 1.0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _id string, _rlz_id string, score double")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows


def _similar(a: str, b: str) -> bool:
    x, y = ({tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in (a, b))
    return 100 * len(x & y) >= 80 * len(x | y)


def test_each_stage_and_the_run(spark, tmp_path):
    path = str(tmp_path)
    rows = _tables(spark, path)
    docs = common.table(spark, path, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontamination", "tokens"]
    kept, columns = docs, docs.columns
    model = quality.train(docs, common.table(spark, path, "labels"))
    by_stage = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = common.written(stage(spark, kept, path), f"test-{name}")
        by_stage[name] = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) if name != "tokens" else kept.collect()
        assert name == "tokens" or kept.columns == columns
    key = lambda i, t: (i is None, i or 0, t or "")
    scores = dict(zip([t or "" for _, t in rows], model.score(quality.statistics([(t or "").encode() for _, t in rows])), strict=True))
    good = sorted(key(i, t) for i, t in rows if scores[t or ""] >= quality.KEEP_AT)
    assert by_stage["quality"] == good and not any("CLICK" in t for _, _, t in good) and len(good) > 80
    # near copies: of linked rows the least stays
    want: list[tuple] = []
    for k in good:
        if not k[2].split() or not any(_similar(k[2], w[2]) for w in want if w[2].split()):
            want.append(k)
    assert by_stage["near_duplicates"] == want
    # windows of 50 words that stand in an earlier document
    cut = []
    for k in want:
        words = k[2].split()
        earlier = {tuple(v.split()[p : p + 50]) for w, i, v in want if not w and i < k[1] for p in range(len(v.split()) - 49)} if not k[0] else set()
        gone = {p + x for p in range(len(words) - 49) if tuple(words[p : p + 50]) in earlier for x in range(50)}
        cut.append((*k[:2], " ".join(w for x, w in enumerate(words) if x not in gone) if gone else k[2]))
    assert by_stage["repeated_passages"] == sorted(cut) and cut != want
    clean = [k for k in cut if "buys 30 kg of pears" not in k[2]]
    assert by_stage["decontamination"] == sorted(clean) and len(clean) <= len(cut) - 2

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, tuple(r.ids)) for r in by_stage["tokens"])
    assert tokens == sorted((*k[:2], len(ids), tuple(ids)) for k in clean for ids in (enc.encode_ordinary(k[2]),))
    run = corpus_pipeline.run(spark, path)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, tuple(r.ids)) for r in run.collect()) == tokens


def test_stages_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path)
    _tables(spark, path)
    docs = common.table(spark, path, "documents")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0, name
