from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import index as I
from corpusloom.operators import morph as G
from corpusloom.sources import readers, sinks
from corpusloom.streaming import incremental

TINY = [
    ("t", 1, "நீங்கள் நேற்று வந்தீர்கள். அவன் வந்தான் என்று அவர் கூறினார்."),
    ("t", 2, "நாம் இன்று போவோம். நாங்கள் நேற்று வந்தோம். அவள் வந்தாள்."),
    ("t", 3, "மாணவர்கள் வந்தார்கள். புத்தகங்கள் மேசையில் இருந்தன. நீ வா."),
]


def tiny(spark):
    return spark.createDataFrame(TINY, "corpus string, doc_id long, text string")


def test_frequency_and_absence(spark):
    t = tiny(spark).select("corpus", "doc_id", X.tokens(F.col("text"), X.TAMIL).alias("tokens"))
    asked = spark.createDataFrame([("நீங்கள்",), ("இல்லை",)], "form string")
    got = {r.form: (r.n, r.df, r.attested) for r in I.frequency(I.form_types(I.document_forms(t)).drop("corpus"), asked).collect()}
    assert got == {"நீங்கள்": (1, 1, True), "இல்லை": (0, 0, False)}


def test_kwic(spark):
    s = I.capped(tiny(spark), X.TAMIL)
    r = I.kwic(s, "வந்தார்கள்").collect()
    assert len(r) == 1 and r[0].doc_id == 3 and "மாணவர்கள்" in r[0].left


def test_damaged_text_is_dropped(spark):
    docs = spark.createDataFrame([("c", 1, "வந்தார்கள் மாணவர்கள் நேற்று இருந்தன"), ("c", 2, "கமப தகம நபத மரகத")], "corpus string, doc_id long, text string")
    r = I.build_report(I.gated(docs, X.TAMIL, 3)).first()
    assert (r.n_docs, r.dropped_quality) == (1, 1)


def test_repeated_lines_are_seen_before_gates(spark):
    docs = spark.createDataFrame([("c", 1, "only line"), ("c", 2, "only line."), ("c", 3, None)], "corpus string, doc_id long, text string")
    got = {r.doc_id: r.drop_reason for r in I.gated(docs, X.LATIN, 1, 0.0).collect()}
    assert got == {1: None, 2: "dropped_lang", 3: "dropped_lang"}


def test_token_budget_cuts_the_crossing_sentence(spark):
    docs = spark.createDataFrame([("c", 1, "a b c. d e f. g h")], "corpus string, doc_id long, text string")
    assert [len(r.tokens) for r in I.capped(docs, X.LATIN, 4).orderBy("sent_no").collect()] == [3, 1]


def test_every_kth_row(spark):
    df = spark.range(100).repartition(5)
    assert sorted(r.id for r in I.systematic_sample(df, "id", 10).collect()) == list(range(0, 100, 10))


def test_analysis_and_features(spark):
    raws = ["வா+verb+fin+sim+strong+past=த்+3sgm=ஆன்", "நீ+pron+2plh", "+?"]
    a = spark.createDataFrame([(r,) for r in raws], "raw string").select(G.parsed(F.col("raw")).alias("a")).collect()
    assert a[0].a.lemma == "வா" and [b.label for b in a[0].a.bindings] == ["past", "3sgm"] and a[2].a is None
    f = spark.createDataFrame([(r,) for r in raws[:2]], "raw string").select(G.features(G.parsed(F.col("raw"))).alias("f")).collect()
    assert (f[0].f[0].number, f[0].f[0].gender, f[0].f[0].polarity, f[0].f[0].person, f[0].f[0].anchor) == ("SG", "MASC", "POS", 3, True)
    assert {(x.number, x.honorificity) for x in f[1].f} == {("SG", "POLITE"), ("PL", "FAMILIAR")}


def cut(spark, df):
    return spark.createDataFrame(df.collect(), df.schema)


def judged(spark, raws, gold, number=None, licit=("FAMILIAR", "POLITE"), wanted=None):
    a = cut(spark, spark.createDataFrame(list(enumerate(raws)), "at int, raw string").select("at", G.parsed(F.col("raw")).alias("a")))
    f = cut(spark, a.select("at", F.explode(G.features(F.col("a"))).alias("f")))
    rows = cut(spark, f.agg(F.collect_list(F.col("f").withField("at", F.col("at"))).alias("readings")).withColumns({"gold": F.lit(gold).cast("string"), "wanted": F.array(*map(F.lit, wanted or [gold])).cast("array<string>"), "number": F.lit(number).cast("string")}))
    j = G.judged(F.col("readings"), "honorificity", F.col("gold"), F.col("wanted"), list(licit), [], [2], True, F.col("number"), F.lit(None).cast("string"), F.lit(1.0))
    return rows.select(j.alias("j")).first().j


def test_judgement_by_context(spark):
    assert judged(spark, ["நீ+pron+2plh"], "POLITE").outcome == "UNDECIDABLE"
    assert judged(spark, ["நீ+pron+2plh"], "POLITE", "SG").outcome == "CORRECT"
    assert judged(spark, ["நீ+pron+2plh"], "POLITE", "PL").outcome == "WRONG"
    j = judged(spark, ["நீ+pron+2plh"], None)
    assert j.outcome == "UNDECIDABLE" and j.universal is None


def test_avoidance(spark):
    assert judged(spark, ["வா+verb+fin+3sgm=ஆன்"], "POLITE").outcome == "AVOIDANT_DROP"
    assert judged(spark, ["வா+verb+fin+neg=இல்லை"], "POLITE").outcome == "AVOIDANT_NEG"
    assert judged(spark, ["வீடு+noun+nom"], "POLITE").unparsed_reason == "no_anchor"


def test_lookup_priority(spark):
    table = lambda rows: spark.createDataFrame(rows, "surface string, raws array<string>")
    tokens = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "surface string")
    over = spark.createDataFrame([("d", ["o"], "replace")], "surface string, raws array<string>, mode string")
    got = {r.surface: (r.raws, r.source) for r in G.analysed(tokens, table([("a", ["x"]), ("d", ["x"])]), table([("a", ["y"]), ("b", ["y"])]), over).collect()}
    assert got == {"a": (["x"], "lexicon"), "b": (["y"], "guesser"), "c": ([], "none"), "d": (["o"], "override")}


def test_suffix_rules(spark):
    lexicon = spark.createDataFrame([("walk", ["walk+v"])], "surface string, raws array<string>")
    got = {r.surface: (r.rule, r["round"]) for r in G.rewritten(spark.createDataFrame([("walked",), ("walkeding",), ("zzz",)], "surface string"), [("R1", "ed", ""), ("R2", "ing", "")], lexicon).collect()}
    assert got == {"walked": ("R1", 1), "walkeding": ("R1", 2)}


def test_readers_and_sinks(spark, tmp_path):
    import lzma

    (tmp_path / "a.txt").write_text("one\ntwo\n\nthree\n")
    lines = readers.numbered_lines(spark, str(tmp_path / "a.txt"))
    assert sorted(r.text for r in readers.blank_separated(lines).collect()) == ["one\ntwo", "three"]
    assert [r.text for r in readers.line_blocks(lines, 2, 2).collect()] == ["one\ntwo"]
    (tmp_path / "a.xz").write_bytes(lzma.compress("x\ny\n".encode()))
    assert [r.line for r in readers.xz_lines(spark, str(tmp_path / "a.xz")).orderBy("n").collect()] == ["x", "y"]
    (tmp_path / "c.conllu").write_text("# text = Hi there\n" + "\t".join(["1", "Hi", "hi", "INTJ", "_", "A=1|B=2", "0", "root", "_", "_"]) + "\n" + "\t".join(["1-2", "x", "_", "_", "_", "_", "_", "_", "_", "_"]) + "\n")
    c = readers.numbered_lines(spark, str(tmp_path / "c.conllu"))
    assert [r.text for r in readers.conllu_documents(c).collect()] == ["Hi there"]
    t = readers.conllu_tokens(c).collect()
    assert len(t) == 1 and t[0].feats == {"A": "1", "B": "2"}
    df = spark.createDataFrame([("m", 1, "x"), ("m", 2, "y")], "model string, n int, text string")
    sinks.jsonl(df, str(tmp_path / "out"), "model")
    back = readers.jsonl(spark, str(tmp_path / "out"), "n int, text string")
    assert sorted((r.n, r.text) for r in back.collect()) == [(1, "x"), (2, "y")]
    (tmp_path / "y.yaml").write_text("id: T1\nvalues: [a, b]\n")
    assert '"T1"' in readers.yaml_documents(spark, str(tmp_path / "y.yaml")).first().json
    (tmp_path / "w.xml").write_text("<r><page><title>A</title><ns>0</ns><id>1</id><revision><text>t</text></revision></page><page><title>B</title><ns>1</ns><id>2</id><revision><text>u</text></revision></page></r>")
    assert [r.title for r in readers.wiki_pages(spark, str(tmp_path / "w.xml")).collect()] == ["A"]


def test_event_windows_on_a_stream(spark, tmp_path):
    schema = "event_id long, ts timestamp, event_type string, value double"
    spark.sql("select 1L as event_id, timestamp'2024-01-01 10:00:00' as ts, 'click' as event_type, 2.0D as value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = incremental.event_windows(stream).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("w").first().n == 1
