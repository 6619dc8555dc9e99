import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X


def one(spark, column, **values):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokens_of_the_tamil_script(spark):
    assert one(spark, X.tokens(F.lit("அவர் 2019-ல் வந்தார். Hello நீங்கள்!"), X.TAMIL)) == ["அவர்", "ல்", "வந்தார்", "நீங்கள்"]


def test_decomposed_vowels_are_composed(spark):
    assert one(spark, X.canonical(F.lit("கொடு"), X.TAMIL)) == one(spark, X.canonical(F.lit("கொடு"), X.TAMIL))


def test_letters(spark):
    assert one(spark, X.graphemes(F.lit("வந்தாள்"))) == ["வ", "ந்", "தா", "ள்"]


def test_ratios_of_nothing_are_zero(spark):
    assert one(spark, X.script_ratio(F.lit(""), X.LATIN)) == 0.0
    assert one(spark, X.vowel_sign_ratio(F.lit("123"), X.LATIN)) == 0.0


def test_difference_counts(spark):
    rows = [("abc", "abd"), ("abcd", "xbcy"), ("a", "ab"), ("ab", "a"), ("same", "same")]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    assert [r.x for r in df.select(X.difference_count("a", "b").alias("x")).collect()] == [1, 2, 1, 1, 0]


def test_difference_span_and_iou(spark):
    r = spark.createDataFrame([("he came", "he went")], "a string, b string").select(X.difference_span("a", "b").alias("s")).first().s
    assert (r.start, r.end) == (3, 7)
    assert one(spark, X.iou(F.lit(0), F.lit(4), F.lit(2), F.lit(6))) == 2 / 6


def test_splice(spark):
    r = one(spark, X.spliced(F.lit("abcdef"), F.lit(1), F.lit(3), F.lit("XY")))
    assert (r.text, r.ok) == ("aXYdef", True)
    assert one(spark, X.spliced(F.lit("ab"), F.lit(1), F.lit(9), F.lit(""))).ok is False


def test_clean_names_its_steps(spark):
    """Golden rows: outputs, the answer in them and the steps."""
    golden = [
        ("சூழல்: மீனா காத்திருந்தாள்.\nமொழிபெயர்ப்பு: நண்பகலில் வந்தார்கள்.", "நண்பகலில் வந்தார்கள்.", ["take_labelled_translation_line"]),
        ("<think>no</think> Translation: “அவன் வந்தான்” (avan)", "“அவன் வந்தான்”", ["strip_think_block", "strip_label_prefix", "strip_trailing_transliteration"]),
        ("<think>அவன்", "<think>அவன்", ["LEAKED_THINK_UNCLOSED"]),
        ("```ta\n\"அவன்\"\n```", "அவன்", ["strip_code_fence", "strip_quotes"]),
        ("அவன் வந்தான்\n\nNote: he came", "அவன் வந்தான்", ["strip_explanation_tail"]),
        ("context: he\nHere\nஅவள் (அவன்) [x] (y)", "அவள் (அவன்)", ["drop_context_labelled_line", "take_first_tamil_line", "strip_trailing_transliteration", "strip_trailing_transliteration"]),
        ("", "", []),
    ]
    text, ops = X.clean(F.col("raw"))
    got = spark.createDataFrame([(i, g[0]) for i, g in enumerate(golden)], "i int, raw string").select("i", text.alias("t"), ops.alias("o")).orderBy("i").collect()
    assert [(r.t, list(r.o)) for r in got] == [(t, o) for _, t, o in golden]


def test_sentences_end_behind_closing_quotes(spark):
    assert one(spark, X.sentences(F.lit('He said "stop." Then he left.  \n\n (Really?) Yes!No'))) == ["He said \"stop.", "Then he left.", "(Really?", "Yes!No"]


def test_canonical_forms(spark):
    assert one(spark, X.canonical(F.lit("`(கெ" + "ா)\\"), X.TAMIL)) == "கொ" and one(spark, X.canonical(F.lit("அ:து"), X.TAMIL)) == "அஃது"
    assert one(spark, X.normalise(F.lit("abc"), X.TAMIL, X.LATIN_OR_DIGIT)) is None
    with pytest.raises(Exception, match="not of the script"):
        one(spark, X.normalise(F.lit("a1"), X.TAMIL, X.LATIN_OR_DIGIT, strict=True))


def test_differences_are_of_clusters(spark):
    rows = [("வந்தான்", "வந்தாள்"), ("a b c d", "a x c y"), ("க", "கா"), ("x" * 600 + "a" + "x" * 600, "y" + "x" * 1100 + "z")]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    assert [r.x for r in df.select(X.difference_count("a", "b").alias("x")).collect()] == [1, 2, 1, 99]


def test_flipped_prefers_what_is_attested(spark):
    f = lambda contrast: X.flipped(F.lit("அவன் வந்தான்"), F.lit(11), F.lit(12), F.lit("ள்"[0]), F.lit(contrast).cast("string"), X.TAMIL)
    assert one(spark, f("அவன் வந்தாள்")).reason == "attested" and one(spark, f(None)).ok in (True, False)


def test_surface_hit_without_targets_is_null(spark):
    assert one(spark, X.surface_hit(F.lit("x"), F.array().cast("array<string>"))) is None


def test_token_spans_keep_places(spark):
    r = spark.createDataFrame([(' "word", and.',)], "t string").select(X.token_spans("t").alias("x")).first().x
    assert [(s.token, s.start, s.end) for s in r] == [("word", 2, 6), ("and", 9, 12)]


def test_esa_reply(spark):
    score, none = X.esa_score(F.lit("score: 85 of 100"))
    r = spark.range(1).select(score.alias("s"), none.alias("n")).first()
    assert (r.s, r.n) == (85, False)
