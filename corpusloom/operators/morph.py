"""Set-valued analyses and their judgement, inside rows: arrays of readings, no shuffle. Analyses come from a lookup table; transducers are outside.

"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_ANALYSIS = "+?"
ZERO = "∅"
#: Person-number-gender labels and what they say (label, number, gender, rationality, honorificity); a label may have two readings.
PNG = [
    ("1sg", "SG", None, "UYARTHINAI", None),
    ("1pl", "PL", None, "UYARTHINAI", None),
    ("2sg", "SG", None, "UYARTHINAI", "FAMILIAR"),
    ("2sgn", "SG", None, "UYARTHINAI", "FAMILIAR"),
    ("2sgm", "SG", "MASC", "UYARTHINAI", "FAMILIAR"),
    ("2sgf", "SG", "FEM", "UYARTHINAI", "FAMILIAR"),
    ("2sgh", "SG", None, "UYARTHINAI", "POLITE"),
    ("2pl", "PL", None, "UYARTHINAI", "FAMILIAR"),
    ("2plh", "SG", None, "UYARTHINAI", "POLITE"),
    ("2plh", "PL", None, "UYARTHINAI", "FAMILIAR"),
    ("3sgm", "SG", "MASC", "UYARTHINAI", "FAMILIAR"),
    ("3sgf", "SG", "FEM", "UYARTHINAI", "FAMILIAR"),
    ("3sgn", "SG", "NEUT", "AHRINAI", None),
    ("3pln", "PL", "NEUT", "AHRINAI", None),
    ("3sgh", "SG", "EPICENE", "UYARTHINAI", "POLITE"),
    ("3sghe", "SG", "EPICENE", "UYARTHINAI", "POLITE"),
    ("3sge", "SG", "EPICENE", "UYARTHINAI", None),
    ("3ple", "PL", "EPICENE", "UYARTHINAI", "FAMILIAR"),
    ("3pl", "PL", None, "UYARTHINAI", None),
    ("3sg", "SG", None, None, None),
    ("pl", "PL", None, None, None),
]
#: Suffixes that stand for two labels each.
SYNCRETIC = [("ஆர்", ["3sghe", "3ple"]), ("ஆர்கள்", ["3sghe", "3ple"]), ("ஈர்கள்", ["2pl", "2plh"]), ("உங்கள்", ["2pl", "2plh"])]
#: Fixed values.
CLUSIVITY = ["incl", "excl"]
NEGATION = ["neg", "negpart", "negcop", "negfut", "negdeb"]


def parsed(raw: Column) -> Column:
    """N-02: lemma+pos+tag+label=suffix as a struct; null for no analysis."""
    parts = F.split(raw, r"\+")
    rest = F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))
    bindings = F.transform(F.filter(rest, lambda p: p.contains("=")), lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("label"), F.replace(F.substring_index(p, "=", -1), F.lit(ZERO), F.lit("")).alias("suffix")))
    return F.when((raw != NO_ANALYSIS) & (F.size(parts) >= 2), F.struct(F.element_at(parts, 1).alias("lemma"), F.element_at(parts, 2).alias("pos"), F.filter(rest, lambda p: ~p.contains("=")).alias("tags"), bindings.alias("bindings")))


def suffix_bound(analysis: Column) -> Column:
    """N-10."""
    return F.exists(analysis["bindings"], lambda b: b["suffix"] != "")


def _png_map() -> Column:
    by: dict[str, list[Column]] = {}
    for label, number, gender, rationality, honorificity in PNG:
        text = lambda x: F.lit(x).cast("string")
        by.setdefault(label, []).append(F.struct(text(label).alias("label"), text(number).alias("number"), text(gender).alias("gender"), text(rationality).alias("rationality"), text(honorificity).alias("honorificity")))
    return F.create_map(*(x for label, bundles in by.items() for x in (F.lit(label), F.array(*bundles))))


def labels(analysis: Column) -> Column:
    """N-11: labels of suffixes that stand for several, else the bound labels, else the bare tags."""
    syncretic = F.create_map(*(x for s, ls in SYNCRETIC for x in (F.lit(s), F.array(*map(F.lit, ls)))))
    bound = F.flatten(F.transform(analysis["bindings"], lambda b: F.coalesce(F.try_element_at(syncretic, b["suffix"]), F.array(b["label"]))))
    return F.array_distinct(F.concat(bound, analysis["tags"]))


def features(analysis: Column) -> Column:
    """N-03, D-04: distinct readings of an analysis: each person-number-gender bundle with clusivity and polarity; one empty bundle without any."""
    png = F.flatten(F.transform(F.filter(labels(analysis), lambda x: F.map_contains_key(_png_map(), x)), lambda x: F.element_at(_png_map(), x)))
    empty = F.array(F.struct(*(F.lit(None).cast("string").alias(k) for k in ("label", "number", "gender", "rationality", "honorificity"))))
    every = F.concat(analysis["tags"], F.transform(analysis["bindings"], lambda b: b["label"]))
    clusivity = F.upper(F.try_element_at(F.array_intersect(every, F.array(*map(F.lit, CLUSIVITY))), F.lit(1)))
    polarity = F.when(F.arrays_overlap(every, F.array(*map(F.lit, NEGATION))), "NEG").when(analysis["pos"].isin("verb", "aux"), "POS")
    bundle = F.when(F.size(png) > 0, png).otherwise(empty)
    person = lambda r: F.when(r["label"].rlike("^[123]"), F.substring(r["label"], 1, 1).cast("int"))
    anchor = (analysis["pos"] == "pron") | (analysis["pos"].isin("verb", "aux") & F.array_contains(every, "fin"))
    return F.array_distinct(F.transform(bundle, lambda r: F.struct(person(r).alias("person"), *(r[k].alias(k) for k in ("number", "gender", "rationality", "honorificity")), clusivity.alias("clusivity"), polarity.alias("polarity"), analysis["pos"].alias("pos"), anchor.alias("anchor"))))


def analysed(tokens: DataFrame, lexicon: DataFrame, guesser: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """J-15, G-01, G-02: the analyses of each distinct surface: the lexicon's, else the guesser's. An override of mode `replace` stands alone, one of
    mode `augment` is added. Tables have surface and raws (array)."""
    t = tokens.select("surface").distinct().join(lexicon.withColumnRenamed("raws", "_lexicon"), "surface", "left").join(guesser.withColumnRenamed("raws", "_guessed"), "surface", "left")
    none = F.array().cast("array<string>")
    found = F.coalesce("_lexicon", "_guessed", none)
    source = F.when(F.col("_lexicon").isNotNull(), "lexicon").when(F.col("_guessed").isNotNull(), "guesser").otherwise("none")
    if overrides is None:
        return t.select("surface", found.alias("raws"), source.alias("source"))
    t = t.join(F.broadcast(overrides.withColumnRenamed("raws", "_override")), "surface", "left")
    raws = F.when(F.col("mode") == "replace", F.col("_override")).when(F.col("mode") == "augment", F.array_union(found, F.col("_override"))).otherwise(found)
    return t.select("surface", raws.alias("raws"), F.when(F.col("mode").isNotNull(), "override").otherwise(source).alias("source"))


def rewritten(unanalysed: DataFrame, rules: list[tuple[str, str, str]], lexicon: DataFrame, rounds: int = 2) -> DataFrame:
    """G-03, G-04: surfaces without analysis by suffix rules (name, suffix, replacement) in order, the first whose result the lexicon has; each round
    strips once more."""
    todo, done = unanalysed.select("surface", F.col("surface").alias("_form")), None
    for n in range(rounds):
        tries = F.array_compact(F.array(*(F.when(F.col("_form").endswith(s) & (F.length("_form") > len(s)), F.struct(F.lit(k).alias("order"), F.lit(name).alias("rule"), F.concat(F.col("_form").substr(F.lit(1), F.length("_form") - len(s)), F.lit(new)).alias("form"))) for k, (name, s, new) in enumerate(rules))))
        out = todo.select("surface", F.explode(tries).alias("t")).select("surface", "t.*")
        hits = out.join(lexicon.select(F.col("surface").alias("form"), "raws"), "form").groupBy("surface").agg(F.min_by(F.struct("rule", "form", "raws"), F.struct("order", "form")).alias("h"), F.lit(n + 1).alias("round")).select("surface", "h.*", "round")
        done = hits if done is None else done.unionByName(hits)
        todo = out.join(hits, "surface", "left_anti").select("surface", F.col("form").alias("_form")).distinct()
    return done


def _fits(reading: Column, name: str, wanted: Column) -> Column:
    return wanted.isNull() | reading[name].isNull() | (reading[name] == wanted)


def checked(readings: Column, slot: str, expected: Column, number: Column, honorificity: Column) -> Column:
    """G-06: universal, existential, undecidable. Without readings, or with none that fits the context, all are false; a reading without the slot doesn't match."""
    left = F.filter(readings, lambda r: _fits(r, "number", number) & _fits(r, "honorificity", honorificity))
    hits = F.size(F.filter(left, lambda r: F.coalesce(r[slot] == expected, F.lit(False))))
    n = F.size(left)
    universal = (n > 0) & (hits == n)
    return F.struct(universal.alias("universal"), (hits > 0).alias("existential"), ((hits > 0) & (hits < n)).alias("undecidable"), n.alias("n_surviving"), hits.alias("n_matching"))


def context(slot: Column, referent_number: Column, hon: Column) -> tuple[Column, Column]:
    """G-09: what may be filtered on: the number for honorificity and clusivity, else the honorificity that the item holds constant."""
    by_number = slot.isin("honorificity", "clusivity")
    return F.when(by_number, referent_number), F.when(~by_number, F.when(hon == "minus", "FAMILIAR").when(hon == "plus", "POLITE"))


def judged(readings: Column, slot: str, gold: Column, wanted: Column, licit: list[str], neutral: list[str], persons: list[int], verb_final: bool, number: Column, honorificity: Column, share: Column) -> Column:
    """G-08, P-10, P-11: one of eight outcomes for an answer. `readings` are of all its tokens, with `at` (place of the token); `wanted` are the values that
    realise the gold value. No reading: UNPARSED. No committed reading: neutral, then unparsed without an anchor, then negative, then dropped. Else the context
    filter (undone where it leaves nothing), and all, some or none of what stays."""
    pool = F.filter(readings, lambda r: r["person"].isin(persons))
    committed, plain = F.filter(pool, lambda r: r[slot].isin(licit)), F.filter(pool, lambda r: r[slot].isin(neutral) if neutral else F.lit(False))
    if verb_final:
        places = F.when(F.size(committed) > 0, committed).otherwise(plain)
        last = F.array_max(F.transform(places, lambda r: r["at"]))
        committed, plain = F.filter(committed, lambda r: r["at"] == last), F.filter(plain, lambda r: r["at"] == last)
    fit = F.filter(committed, lambda r: _fits(r, "number", number) & _fits(r, "honorificity", honorificity))
    left = F.when(F.size(fit) > 0, fit).otherwise(committed)
    hits, n = F.size(F.filter(left, lambda r: F.array_contains(wanted, r[slot]))), F.size(left)
    anchors = F.filter(readings, lambda r: r["anchor"])
    verbs = F.filter(anchors, lambda r: r["pos"].isin("verb", "aux"))
    negative = F.exists(verbs, lambda r: r["polarity"] == "NEG") & ~F.exists(verbs, lambda r: F.coalesce(r["polarity"] != "NEG", F.lit(True)))
    values = F.array_distinct(F.transform(left, lambda r: r[slot]))
    outcome = (
        F.when(F.size(readings) == 0, "UNPARSED").when((F.size(committed) == 0) & (F.size(plain) > 0), "AVOIDANT_NEUTRAL").when((F.size(committed) == 0) & (F.size(anchors) == 0), "UNPARSED").when((F.size(committed) == 0) & negative, "AVOIDANT_NEG")
        .when(F.size(committed) == 0, "AVOIDANT_DROP").when(gold.isNull(), F.when(F.size(values) == 1, "COMMITTED").otherwise("UNDECIDABLE")).when(hits == n, "CORRECT").when(hits > 0, "UNDECIDABLE").otherwise("WRONG")
    )
    reason = F.when((F.size(readings) == 0) & (share < 0.5), "no_tamil").when(F.size(readings) == 0, "no_analysis").when((F.size(committed) == 0) & (F.size(plain) == 0) & (F.size(anchors) == 0), "no_anchor")
    undefined = gold.isNull()
    some = F.size(committed) > 0
    return F.struct(
        outcome.alias("outcome"), F.when(~undefined, some & (hits == n)).alias("universal"), F.when(~undefined, some & (hits > 0)).alias("existential"), F.when(~undefined, some & (hits > 0) & (hits < n)).alias("undecidable"),
        F.when(some & (F.size(values) == 1), F.element_at(values, 1)).alias("emitted"), F.size(committed).alias("n_candidates"), F.when(some, n).otherwise(0).alias("n_surviving"), reason.alias("unparsed_reason"),
    )


def slices(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """A-27: rows by the first of named conditions that holds; the rest is `other`."""
    bucket = reduce(lambda acc, r: acc.when(r[1], r[0]), rules, F.when(F.lit(False), "")).otherwise("other")
    return df.withColumn("slice", bucket)


def precision_recall(df: DataFrame, keys: list[str], predicted: str, gold: str) -> DataFrame:
    """A-27, A-28, A-38: counts and rates of two boolean columns."""
    p, g = F.col(predicted), F.col(gold)
    by = df.groupBy(*keys).agg(F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"))
    return by.withColumns({"precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))})
