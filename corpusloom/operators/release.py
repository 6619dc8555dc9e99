
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Independent vowels, and the signs they are written as inside a word.
VOWEL_SIGNS = {"அ": "", "ஆ": "ா", "இ": "ி", "ஈ": "ீ", "உ": "ு", "ஊ": "ூ", "எ": "ெ", "ஏ": "ே", "ஐ": "ை", "ஒ": "ொ", "ஓ": "ோ", "ஔ": "ௌ"}
ZERO_MORPH = "∅"
#: The values of the checker that realise a gold value.
GOLD_GROUPS = {
    "clusivity": {"INCL": ["INCL"], "EXCL": ["EXCL"]},
    "gender": {"MASC": ["MASC"], "FEM": ["FEM"]},
    "honorificity": {"T": ["FAMILIAR"], "V": ["POLITE", "DEFERENTIAL"], "VV": ["POLITE", "DEFERENTIAL"]},
    "number": {"SG": ["SG"], "PL": ["PL"]},
    "rationality": {"UYAR": ["UYARTHINAI"], "AHRI": ["AHRINAI"]},
}
#: Endings that mark a person, and what marks negation or no person at all.
PERSON_ENDINGS = {"ீர்கள்": "2", "ார்கள்": "3", "ேன்": "1", "ோம்": "1", "ாய்": "2", "ான்": "3", "ாள்": "3", "ார்": "3"}
NEGATIVES = ["இல்லை", "ில்லை", "வில்லை", "மாட்ட", "வேண்டா", "அல்ல", "அன்று", "கூடாத", "கிடையா", "ாத", "ாது", "ாமல்"]
NO_PERSON = ["்து", "்தி", "ந்து", "ிது"]
NOT, NOT_VERB = "இல்லை", "வில்லை"


def suffix_surface(suffix: Column) -> Column:
    """T-15: a label's suffix as it is written: a first independent vowel as its sign, a zero morph as nothing."""
    signs = F.create_map(*(F.lit(x) for pair in VOWEL_SIGNS.items() for x in pair))
    head = suffix.substr(F.lit(1), F.lit(1))
    return F.when((suffix == "") | (suffix == ZERO_MORPH), "").otherwise(F.concat(F.coalesce(F.try_element_at(signs, head), head), suffix.substr(F.lit(2), F.length(suffix))))


def metric_input(module: Column, source: Column, candidate: Column, reference: Column) -> Column:
    """T-29: what a metric's model reads; the older module has the candidate first and, with a reference, no source. Without a reference: estimation."""
    estimated = reference.isNull()
    older = F.when(estimated, F.concat(F.lit("candidate: "), candidate, F.lit(" source: "), source)).otherwise(F.concat(F.lit("candidate: "), candidate, F.lit(" reference: "), reference))
    newer = F.concat(F.lit("source: "), source, F.lit(" candidate: "), candidate, F.when(estimated, "").otherwise(F.concat(F.lit(" reference: "), reference)))
    return F.when(module == "metricx23", older).otherwise(newer)


def ascii_folded(s: Column) -> Column:
    """T-28: letters with marks as plain ones; what has none goes."""
    marked = "áàâäãåéèêëíìîïóòôöõúùûüñçýÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
    plain = "aaaaaaeeeeiiiiooooouuuuncyAAAAAAEEEEIIIIOOOOOUUUUNCY"
    return F.regexp_replace(F.translate(s, marked, plain), r"[^\x00-\x7F]", "")


def gold_groups() -> list[tuple[str, str, str]]:
    """G-10: (slot, gold value, checker value)."""
    return [(slot, gold, value) for slot, by in GOLD_GROUPS.items() for gold, values in by.items() for value in values]


def reported(slot: Column, value: Column) -> Column:
    """G-10: the gold value that a checker's value is reported as; never the retracted VV."""
    back = {f"{s}|{v}": g for s, g, v in gold_groups() if g != "VV"}
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in back.items() for x in pair)), F.concat(slot, F.lit("|"), value))


def realises(slot: Column, gold: Column, value: Column) -> Column:
    """G-10: whether a checker's value is one of those that realise a gold value."""
    pairs = [f"{s}|{g}|{v}" for s, g, v in gold_groups()]
    return F.concat_ws("|", slot, gold, value).isin(pairs) & slot.isNotNull() & gold.isNotNull() & value.isNotNull()


def gold_errors(form: Column, upos: Column, feats: Column) -> Column:
    """P-13: codes of what a gold token's features contradict in its own morphology."""
    get = lambda k: F.try_element_at(feats, F.lit(k))
    ending = F.coalesce(*(F.when(form.endswith(e), F.lit(p)) for e, p in sorted(PERSON_ENDINGS.items(), key=lambda x: -len(x[0]))))
    negative = F.exists(F.array(*map(F.lit, NEGATIVES)), lambda m: F.contains(form, m))
    plain = F.contains(form, F.lit(NOT_VERB)) | (form == NOT)
    marked = (get("Number").isNotNull() | get("Gender").isNotNull()) & upos.isin("VERB", "AUX")
    bare = F.exists(F.array(*map(F.lit, NO_PERSON)), lambda e: F.endswith(form, e)) & ending.isNull()
    return F.array_compact(F.array(
        F.when(get("Person").isNotNull() & ending.isNotNull() & (ending != get("Person")), "GE-2"), F.when((get("Polarity") == "Neg") & ~negative, "GE-3"),
        F.when((get("Polarity") == "Pos") & plain, "GE-4"), F.when(marked & (plain | bare), "GE-5"),
    ))


def in_slice(name: str, upos: Column, feats: Column) -> Column:
    """P-13, A-27: whether a gold token belongs to a slice."""
    get = lambda k: F.try_element_at(feats, F.lit(k))
    verb, third = upos.isin("VERB", "AUX"), get("Person") == "3"
    rules = {
        "gender_masc": verb & (get("Gender") == "Masc") & (get("Number") == "Sing") & third,
        "gender_fem": verb & (get("Gender") == "Fem") & (get("Number") == "Sing") & third,
        "number_sg": verb & (get("Number") == "Sing") & third,
        "number_pl": verb & (get("Number") == "Plur") & third,
        "polarity_neg": get("Polarity") == "Neg",
    }
    return F.coalesce(rules[name], F.lit(False))


def unique_forms(tokens: DataFrame, form: str, place: list[str]) -> DataFrame:
    """D-05: distinct forms with the place where each is seen first."""
    return tokens.groupBy(form).agg(F.min(F.struct(*place)).alias("first"))


def coverage(forms: DataFrame, lexicon: DataFrame, guesser: DataFrame, artifact: Column) -> DataFrame:
    """A-26: distinct forms that the lexicon has, that the guesser adds, misses, artifacts among these, and the share of the others that has an analysis."""
    has = lambda name, df: df.select("form", F.lit(True).alias(name)).distinct()
    t = forms.select("form").distinct().join(has("l", lexicon), "form", "left").join(has("g", guesser), "form", "left").withColumn("hit", F.coalesce("l", "g", F.lit(False)))
    n, lex, hit = F.count(F.lit(1)), F.count_if(F.coalesce("l", F.lit(False))), F.count_if("hit")
    art = F.count_if(~F.col("hit") & artifact)
    return t.agg(
        n.alias("unique_forms"), lex.alias("lexicon_only"), hit.alias("with_guesser"), (n - hit).alias("misses"), art.alias("artifacts"), F.round(F.try_divide(100.0 * lex, n), 1).alias("lexicon_only_pct"),
        F.round(F.try_divide(100.0 * hit, n), 1).alias("with_guesser_pct"), F.round(F.try_divide(100.0 * hit, n - art), 1).alias("corrected_pct"),
    )


def accepted(measured: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """A-40: one row for each gate: what was measured (field, got), how it must compare, and PASS or FAIL."""
    rule = F.create_map(*(x for k, (op, v) in wanted.items() for x in (F.lit(k), F.struct(F.lit(op).alias("op"), F.lit(float(v)).alias("want")))))
    r = measured.withColumn("rule", F.try_element_at(rule, F.col("field"))).where("rule is not null").select("field", "got", "rule.op", "rule.want")
    ok = F.when(F.col("op") == ">=", F.col("got") >= F.col("want")).otherwise(F.col("got") == F.col("want"))
    return r.withColumn("verdict", F.when(ok, "PASS").otherwise("FAIL"))


def feature_facts(tokens: DataFrame, key: str, feature: str, a: str, b: str) -> DataFrame:
    """A-25: of each key, tokens and tokens without the feature, and whether two values of it are had by the same forms. Distinct forms are counted
    by partial aggregates; no set is collected."""
    forms = tokens.where(F.col(feature).isin(a, b)).groupBy(key, "form").agg(F.count_distinct(feature).alias("k")).groupBy(key).agg((F.min("k") == 2).alias("same"), F.count(F.lit(1)).alias("n_forms"))
    counts = tokens.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(feature).isNull()).alias("unexpressed"))
    return counts.join(forms, key, "left").withColumn("same", F.coalesce("same", F.lit(False)))


def blocked(registry: DataFrame) -> DataFrame:
    """P-09: sources whose text, or even whose counts, must not be released."""
    return registry.where(~F.col("release_ok") | ~F.col("derived_ok")).select("source", F.when(~F.col("derived_ok"), "derived").otherwise("text").alias("blocked"))


def manifest(files: DataFrame, registry: DataFrame, most: int = 1 << 30) -> DataFrame:
    """A-41: sources with bytes, the digest of their files' digests in order (none beyond `most` bytes), and licence flags; sources that aren't registered
    have none. `files` has source, name, bytes, sha256."""
    by = files.groupBy("source").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_files"), F.max("bytes").alias("_largest"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "sha256"))), lambda x: x["sha256"]), ""), 256).alias("sha256"))
    out = by.withColumn("sha256", F.when(F.col("_largest") <= most, F.col("sha256"))).drop("_largest").join(registry, "source", "left")
    return out.withColumns({"release_ok": F.coalesce("release_ok", F.lit(False)), "derived_ok": F.coalesce("derived_ok", F.lit(False))})


def joined_all(rows: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """J-01: each row with its item; a row whose item is missing is an error."""
    marked = rows.join(items.withColumn("_there", F.lit(True)), key, "left")
    ok = F.when(F.col("_there"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"no item for {key} "), F.col(key).cast("string"))).cast("boolean"))
    return marked.where(ok).drop("_there")


def first_controlled(records: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """D-03: of each key the record that stands first in the files' order."""
    rest = [c for c in records.columns if c not in (*keys, *place)]
    return records.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*place)).alias("r")).select(*keys, "r.*")


def first_of(sentences: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """O-04: the first `most` rows of each key, by order."""
    w = Window.partitionBy(key).orderBy(order)
    return sentences.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def minimal_pairs(items: DataFrame, swaps: DataFrame, key: str, text: str, seed: str) -> DataFrame:
    """G-16, J-11, O-06: (key, good, bad, at, reason): of each item one word that the swap table (word, swap) has, chosen by a hash of seed, key and place, is
    exchanged. Items without such a word are rejected, with a reason; none is lost. Words of an item stay in its row, so that nothing but look-ups moves."""
    words = items.select(key, F.col(text).alias("good"), F.posexplode(F.split(text, " ")).alias("at", "word")).select(key, "good", "at", "word")
    chance = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"), F.col("at").cast("string")), 256)
    hits = words.join(swaps, "word").groupBy(key).agg(F.min_by(F.struct("at", "swap", "word"), F.struct(chance, "at")).alias("h"))
    made = items.select(key, F.col(text).alias("good")).join(hits, key, "left")
    split = F.split("good", " ")
    bad = F.array_join(F.transform(split, lambda w, i: F.when(i == F.col("h.at"), F.col("h.swap")).otherwise(w)), " ")
    reason = F.when(F.col("h").isNull(), "no_swap").when(F.col("h.word") == F.col("h.swap"), "same_word")
    return made.select(key, "good", F.when(reason.isNull(), bad).alias("bad"), F.col("h.at").alias("at"), F.coalesce(reason, F.lit("ok")).alias("reason"))


def verified(checks: DataFrame, verdicts: DataFrame, key: list[str]) -> DataFrame:
    """G-21: a check's verdict, made once for each distinct key and joined back."""
    return checks.join(verdicts.dropDuplicates(key), key, "left").withColumn("ok", F.coalesce("ok", F.lit(False)))


def flattened(rows: DataFrame, key: str, tree: str, exempt: list[str], pattern: str) -> DataFrame:
    """N-13: (key, path) of the values of a tree, as JSON of string maps, where a pattern is found, off exempt keys."""
    flat = rows.select(key, F.explode(F.from_json(tree, "map<string,string>")).alias("path", "value"))
    return flat.where(~F.col("path").isin(exempt) & F.col("value").rlike(pattern)).select(key, "path")


def findings(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """G-15: a row for each rule of a template that doesn't hold."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items())))
    return rows.select(key, F.explode(broken).alias("code"))


def paradigms(analyses: DataFrame, cases: list[str]) -> DataFrame:
    """G-22, G-14: (lemma, case, surface) of analyses with exactly one case, the shortest surface first, then by letters; a lemma's case with surfaces of
    different stems is rejected as ambiguous. `analyses` has lemma, stem, tags, surface."""
    own = F.array_intersect("tags", F.array(*map(F.lit, cases)))
    one = analyses.where(F.size(own) == 1).withColumn("case", F.element_at(own, 1))
    by = one.groupBy("lemma", "case").agg(F.min(F.struct(F.length("surface").alias("n"), F.col("surface").alias("surface"))).alias("best"), F.count_distinct("stem").alias("stems"))
    return by.select("lemma", "case", F.when(F.col("stems") == 1, F.col("best.surface")).alias("surface"), F.when(F.col("stems") > 1, "ambiguous").alias("reason"))


#: Endings that a harvest repairs.
REPAIRS = [("இனது", "இயது"), ("இனன", "இன")]


def repaired(surface: Column) -> Column:
    """G-22's repairs of endings."""
    out = surface
    for wrong, right in REPAIRS:
        out = F.when(surface.endswith(wrong), F.concat(surface.substr(F.lit(1), F.length(surface) - len(wrong)), F.lit(right))).otherwise(out)
    return out


def deltas(ids: Column) -> Column:
    """N-01: ascending ids as differences."""
    return F.transform(ids, lambda x, i: F.when(i == 0, x).otherwise(x - F.element_at(ids, F.when(i == 0, 1).otherwise(i))))


def undeltas(gaps: Column) -> Column:
    """N-01, back."""
    return F.transform(gaps, lambda x, i: F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0).cast("long"), lambda acc, v: acc + v))


def half_even(x: Column, places: int) -> Column:
    """M-01: rounding by the decimal that a double is written as, ties to even."""
    return F.bround(x.cast("decimal(38,18)"), places).cast("double")
