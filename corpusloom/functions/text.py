
from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZERO_WIDTH = "‌‍﻿­"
#: What is taken from the edges of a token.
EDGE_PUNCTUATION = "\"'“”‘’«»`´.,;:!?()[]{}<>…—–-*/\\|_+=~^&%$#@¶§௦"


@dataclass(frozen=True)
class Script:
    """Character classes of a script, as the inside of a regular expression's brackets."""

    letters: str
    vowel_signs: str
    consonants: str
    fold_case: bool
    compose: tuple[tuple[str, str], ...] = ()
    #: A mark that stands for a sign of the script after one of its letters.
    sign: tuple[str, str] | None = None


LATIN = Script(letters=r"\p{L}", vowel_signs="aeiouáéíóúàèìòùâêîôûäëïöü", consonants="b-df-hj-np-tv-zçñß", fold_case=True)
#: Tamil code points, and pairs that compose to one.
TAMIL = Script(
    letters="஀-௿",
    vowel_signs="ா-ௌ",
    consonants="க-ஹ",
    fold_case=False,
    compose=(("ொ", "ொ"), ("ோ", "ோ"), ("ௌ", "ௌ"), ("ஔ", "ஔ"), ("௤", "।"), ("௥", "॥")),
    sign=(":", "ஃ"),
)
#: What a token of the script must not hold.
LATIN_OR_DIGIT = "[A-Za-z0-9०-९]"


def strip_zero_width(s: Column) -> Column:
    """T-01."""
    return F.translate(s, ZERO_WIDTH, "")


def strip_edge_punctuation(s: Column) -> Column:
    """T-02: punctuation once, then white space once; what white space inside hides stays."""
    return F.regexp_replace(F.btrim(s, F.lit(EDGE_PUNCTUATION)), r"(?U)^\s+|\s+$", "")


def compose(s: Column, script: Script) -> Column:
    for a, b in script.compose:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s if script.sign is None else F.regexp_replace(s, f"(?<=[{script.letters}]){script.sign[0]}", script.sign[1])


def normalise(s: Column, script: Script, reject: str | None = None, strict: bool = False) -> Column:
    """T-03: null, or with `strict` an error, where `reject` (a regular expression) is found."""
    bare = strip_edge_punctuation(strip_zero_width(s))
    out = compose(bare, script)
    if reject is None:
        return out
    refused = F.raise_error(F.concat(F.lit("not of the script: "), bare)).cast("string") if strict else F.lit(None).cast("string")
    return F.when(bare.rlike(reject), refused).otherwise(out)


def canonical(s: Column, script: Script) -> Column:
    """T-04: the one form that corpora and questions about them share."""
    out = normalise(s, script)
    return F.lower(out) if script.fold_case else out


@F.pandas_udf(T.StringType())
def nfc(s):  # type: ignore[no-untyped-def]
    """T-05's Unicode part."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def normalise_sentence(s: Column, script: Script) -> Column:
    """T-05."""
    return nfc(compose(nfc(strip_zero_width(s)), script))


def tokens(s: Column, script: Script) -> Column:
    """T-06: runs of letters of the canonical text."""
    if script is LATIN:  # nothing that is taken from edges is a letter, so that trimming whole texts would change no run
        return F.regexp_extract_all(F.lower(strip_zero_width(s)), F.lit(f"[{script.letters}]+"), 0)
    return F.regexp_extract_all(canonical(s, script), F.lit(f"[{script.letters}]+"), 0)


def sentences(s: Column) -> Column:
    """T-08: lines, cut where an end mark, then marks that close what was quoted, then white space stand."""
    bare = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    lines = F.transform(F.split(strip_zero_width(s), "\n"), bare)
    cut = F.flatten(F.transform(lines, lambda x: F.split(x, "(?U)(?<=[.!?।॥…])[\\s\"'“”‘’)\\]]*\\s+")))
    return F.filter(F.transform(cut, bare), lambda x: x != "")


@lru_cache
def _classes(letters: str):  # type: ignore[no-untyped-def]
    """For each code point: 1 for the script's letters, 2 for white space, 4 for zero width."""
    import numpy as np
    import pyarrow.compute as pc

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    out = np.zeros(0x110000, np.uint8)
    out[points] = pc.match_substring_regex(pa.array(map(chr, points), pa.string()), f"^[{letters}]$").to_numpy(zero_copy_only=False)
    for bit, some in ((2, " \t\n\u000b\f\r"), (4, "\u200b\u200c\u200d\ufeff\u00ad")):
        out[[ord(c) for c in some]] |= bit
    return out


def text_slices(texts, most: int = 8_000_000):  # type: ignore[no-untyped-def]
    """Places (low, high) of an Arrow array of texts that hold up to `most` bytes, or one text."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + most, "right")))
        yield low, high
        low = high


def script_counts(s: Column, script: Script) -> Column:
    """T-09, T-11: (letters, bare, shown): code points that are letters of the script, neither white space nor zero width, and not white space."""
    letters = script.letters

    @F.arrow_udf("struct<letters: bigint, bare: bigint, shown: bigint>")
    def counts(texts: pa.Array) -> pa.Array:
        import numpy as np

        parts = []
        for low, high in text_slices(texts):
            some = texts.slice(low, high - low).to_pylist()
            points = np.frombuffer("".join(x or "" for x in some).encode("utf-32-le", "surrogatepass"), np.uint32)
            length = np.array([len(x or "") for x in some])
            kind, full = _classes(letters)[points], length > 0
            start = (np.cumsum(length) - length)[full]
            sums = np.zeros((3, len(some)), np.int64)
            if len(start):
                for k, bits in enumerate((1, 2, 4)):
                    sums[k, full] = np.add.reduceat(kind & bits != 0, start, dtype=np.int64)
            parts.append(np.stack([sums[0], length - sums[1] - sums[2], length - sums[1]]))
        made = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
        return pa.StructArray.from_arrays([pa.array(x, mask=texts.is_null().to_numpy(zero_copy_only=False)) for x in made], ["letters", "bare", "shown"])

    return counts(s)


def _share(part: Column, of: Column) -> Column:
    return F.when(of == 0, 0.0).otherwise(part / of)


def script_ratio(s: Column, script: Script) -> Column:
    """T-09: the script's share of what isn't white space or zero width; 0 for nothing."""
    n = script_counts(s, script)
    return _share(n["letters"], n["bare"])


def script_measures(s: Column, script: Script, least: float = 0.8) -> list[Column]:
    """T-09, T-11, T-10 of whole texts, counted once: ratio, share and in_script."""
    n = script_counts(s, script)
    ratio = _share(n["letters"], n["bare"])
    return [ratio.alias("ratio"), _share(n["letters"], n["shown"]).alias("share"), (ratio >= least).alias("in_script")]


def script_share(s: Column, script: Script) -> Column:
    """T-11: as T-09, but zero-width characters count."""
    bare = F.regexp_replace(s, r"\s", "")
    return F.when(F.length(bare) == 0, 0.0).otherwise(F.length(F.regexp_replace(bare, f"[^{script.letters}]", "")) / F.length(bare))


def in_script(s: Column, script: Script, least: float = 0.8) -> Column:
    """T-10."""
    return script_ratio(s, script) >= least


def vowel_sign_ratio(s: Column, script: Script) -> Column:
    """T-12."""
    n = F.regexp_count(s, F.lit(f"[{script.consonants}]"))
    return F.when(n == 0, 0.0).otherwise(F.regexp_count(s, F.lit(f"[{script.vowel_signs}]")) / n)


def line_key(s: Column, script: Script) -> Column:
    """T-13: lines that differ in edge punctuation have one key."""
    return F.sha2(canonical(s, script), 256)


def graphemes(s: Column) -> Column:
    """T-14."""
    return F.regexp_extract_all(s, F.lit(r"\X"), 0)


def well_formed(s: Column, script: Script) -> Column:
    """T-17: no vowel sign but after a consonant."""
    return ~s.rlike(f"(^|[^{script.consonants}])[{script.vowel_signs}]")


def split_artifact(s: Column, pulli: str = "்", glides: str = "வய") -> Column:
    """T-16."""
    return (F.length(s) >= 3) & s.rlike(f"[{glides}]{pulli}$")


def html_text(s: Column) -> Column:
    """T-18's shape for HTML: comments, scripts and styles go, then tags, a few entities, and white space."""
    for pattern in (r"(?is)<!--.*?-->", r"(?is)<script.*?</script>", r"(?is)<style.*?</style>"):
        s = F.regexp_replace(s, pattern, " ")
    s = F.regexp_replace(s, "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(s, r"[ \t\r\n]+", " "))


#: What a model writes before, after and around its answer.
THINK_OPEN, THINK_BLOCK = r"(?i)<think\b", r"(?is)<think\b[^>]*>.*?</think\s*>"
LABEL_PREFIX = r"(?i)^\s*(tamil|translation|தமிழ்|மொழிபெயர்ப்பு)\s*[:：]\s*"
ANSWER_LINE = r"(?i)^\s*(மொழிபெயர்ப்பு|translation|tamil|தமிழ்)\s*[:：]\s*"
CONTEXT_LINE = r"(?i)^\s*(சூழல்|சூழ்நிலை|context)\s*[:：]\s*"
EXPLANATION = r"(?i)\n\s*(\*\*|##|Explanation\b|Note\b|Here'?s\b)"
CODE_FENCE = r"^```[a-zA-Z]*\s*|\s*```$"
TRAILING_PARENTHESIS = r"\s*[(\[]([^()\[\]]*)[)\]]\s*$"
QUOTE_OPEN, QUOTE_CLOSE = "\"'“‘", "\"'”’"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once: a plan in which each step names the last one several times would double with every step."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def clean(s: Column, script: Script = TAMIL) -> tuple[Column, Column]:
    """T-19: the answer in a raw output, and the names of the steps that changed it, in order. Reasoning goes (one that isn't ended is named and
    stays), then a fence, an explanation after an answer, a label; of several lines the one labelled as answer, else the first in the script that
    isn't labelled as context; then quotation marks and up to three parentheses without the script."""
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    has = lambda x: x.rlike(f"[{script.letters}]")
    parenthesis, fence = "(?U)" + TRAILING_PARENTHESIS, "(?U)" + CODE_FENCE

    def step(name: str, make: Callable[[Column], tuple[Column, Column]]) -> Callable[[Column], Column]:
        """`make` gives for a text whether the step is taken, and the text after it."""

        def run(state: Column) -> Column:
            when, after = make(state["text"])
            return F.struct(F.when(when, after).otherwise(state["text"]).alias("text"), F.when(when, F.array_append(state["ops"], F.lit(name))).otherwise(state["ops"]).alias("ops"))

        return run

    def bare(state: Column) -> Column:
        return F.struct(strip(state["text"]).alias("text"), state["ops"].alias("ops"))

    def one_line(state: Column) -> Column:
        def of(lines: Column) -> Column:
            text, ops = state["text"], state["ops"]
            answer = F.try_element_at(F.filter(lines, lambda x: x.rlike(ANSWER_LINE)), F.lit(1))
            plain = F.filter(lines, lambda x: ~x.rlike(CONTEXT_LINE))
            drop = (F.size(plain) > 0) & (F.size(plain) != F.size(lines))
            body = F.when(drop, plain).otherwise(lines)
            pick = F.coalesce(F.try_element_at(F.filter(body, has), F.lit(1)), F.try_element_at(body, F.lit(1)))
            named = F.when(drop, F.array_append(ops, F.lit("drop_context_labelled_line"))).otherwise(ops)
            first = F.struct(pick.alias("text"), F.when(pick != text, F.array_append(named, F.lit("take_first_tamil_line"))).otherwise(named).alias("ops"))
            labelled = F.struct(strip(F.regexp_replace(answer, ANSWER_LINE, "")).alias("text"), F.array_append(ops, F.lit("take_labelled_translation_line")).alias("ops"))
            return F.when(F.size(lines) <= 1, state).when(answer.isNotNull(), labelled).otherwise(first)

        return let(F.filter(F.split(state["text"], "\r\n|[\n\r\u000b\f\u001c-\u001e\u0085\u2028\u2029]"), lambda x: strip(x) != ""), of)

    def explained(x: Column) -> tuple[Column, Column]:
        head = F.element_at(F.split(x, EXPLANATION, 2), 1)
        return (head != x) & has(head), strip(head)

    def quoted(x: Column) -> tuple[Column, Column]:
        n = F.length(x)
        return (n >= 2) & F.contains(F.lit(QUOTE_OPEN), F.left(x, F.lit(1))) & F.contains(F.lit(QUOTE_CLOSE), F.right(x, F.lit(1))), strip(x.substr(F.lit(2), n - 2))

    def transliterated(x: Column) -> tuple[Column, Column]:
        head = strip(F.regexp_replace(x, parenthesis, ""))
        return x.rlike(parenthesis) & (script_share(F.regexp_extract(x, parenthesis, 1), script) < 0.2) & has(head), head

    state = F.struct(s.alias("text"), F.array().cast("array<string>").alias("ops"))
    for made in (
        step("strip_think_block", lambda x: (x.rlike(THINK_OPEN) & (F.regexp_replace(x, THINK_BLOCK, "") != x), F.regexp_replace(x, THINK_BLOCK, ""))),
        step("LEAKED_THINK_UNCLOSED", lambda x: (x.rlike(THINK_OPEN), x)), bare,
        step("strip_code_fence", lambda x: (x.startswith("```"), strip(F.regexp_replace(x, fence, "")))),
        step("strip_explanation_tail", explained),
        step("strip_label_prefix", lambda x: (x.rlike(LABEL_PREFIX), F.regexp_replace(x, LABEL_PREFIX, ""))), one_line, bare,
        step("strip_quotes", quoted), *[step("strip_trailing_transliteration", transliterated)] * 3, bare,
    ):
        state = let(state, made)
    return state["text"], state["ops"]


def surface_hit(hypothesis: Column, targets: Column) -> Column:
    """T-20: whether any target is in the text; null where there are none."""
    return F.when(F.size(targets) > 0, F.exists(targets, lambda t: F.contains(hypothesis, t)))


def stems(words: Column, morpheme: Column) -> Column:
    """T-21: words that end in the morpheme, without it."""
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.endswith(w, morpheme)), lambda w: w.substr(F.lit(1), F.length(w) - F.length(morpheme))))


def narrowed_span(token: Column, start: Column, end: Column, morpheme: Column) -> Column:
    """T-22."""
    return F.when(F.endswith(token, morpheme), F.struct((end - F.length(morpheme)).alias("start"), end.alias("end")))


def spliced(text: Column, start: Column, end: Column, new: Column) -> Column:
    """T-25: text with [start, end) replaced, and whether that could be done."""
    ok = (start >= 0) & (end <= F.length(text)) & (start < end)
    return F.struct(F.when(ok, F.concat(text.substr(F.lit(1), start), new, text.substr(end + 1, F.length(text)))).alias("text"), ok.alias("ok"), F.when(~ok, "span out of range").alias("reason"))


_SPANS = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(_SPANS)
def token_spans(s):  # type: ignore[no-untyped-def]
    """T-07, T-23: words without the punctuation at their edges, with their places in the text."""
    import re

    def one(text: str | None) -> list[dict]:
        out = []
        for m in re.finditer(r"\S+", text or ""):
            left = len(m[0]) - len(m[0].lstrip(EDGE_PUNCTUATION))
            bare = m[0].strip(EDGE_PUNCTUATION)
            if bare:
                out.append({"token": bare, "start": m.start() + left, "end": m.start() + left + len(bare)})
        return out

    return s.map(one)


@F.pandas_udf(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
def difference_span(good, bad):  # type: ignore[no-untyped-def]
    """T-26: the part of `bad` between the longest common beginning and end."""
    import os

    import pandas as pd

    rows = []
    for a, b in zip(good, bad, strict=True):
        a, b = a or "", b or ""
        head = len(os.path.commonprefix([a, b]))
        tail = len(os.path.commonprefix([a[head:][::-1], b[head:][::-1]]))
        rows.append((head, len(b) - tail))
    return pd.DataFrame(rows, columns=["start", "end"])


def _clusters(s: str) -> list[str]:
    import regex

    return regex.findall(r"\X", s)


def _differences(a: list[str], b: list[str], most: int = 250_000) -> int:
    """Runs in which two sequences differ, off a longest common subsequence; `most` bounds the table of its lengths."""
    head = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[head:], b[head:]
    tail = next((k for k, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b or set(a).isdisjoint(b):
        return int(bool(a or b))
    if len(a) * len(b) > most:
        return 99
    common = [[0] * (len(b) + 1)]  # from the end: common[i][j] of the last i and j items
    for x in reversed(a):
        row = [0]
        for j, y in enumerate(reversed(b)):
            row.append(common[-1][j] + 1 if x == y else max(common[-1][j + 1], row[-1]))
        common.append(row)
    i, j, runs, inside = len(a), len(b), 0, False
    while i and j:
        same = a[len(a) - i] == b[len(b) - j]
        runs += not same and not inside
        inside = not same
        if same:
            i, j = i - 1, j - 1
        elif common[i - 1][j] >= common[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return runs + (not inside and bool(i or j))


@F.pandas_udf(T.IntegerType())
def difference_count(a, b):  # type: ignore[no-untyped-def]
    """T-24: runs in which two texts differ, by grapheme clusters; 99 where the parts between their common ends are too long to compare."""
    import pandas as pd

    return pd.Series([_differences(_clusters(x or ""), _clusters(y or "")) for x, y in zip(a, b, strict=True)])


def flipped(gold: Column, start: Column, end: Column, morpheme: Column, attested: Column, script: Script) -> Column:
    """T-25: the gold text with another value: the attested text where it differs in one run, else the morpheme spliced into the span if that does;
    (text, ok, reason)."""
    whole = normalise_sentence(attested, script)
    part = spliced(gold, start, end, morpheme)
    made = normalise_sentence(part["text"], script)
    runs = difference_count(gold, made)
    taken = F.struct(whole.alias("text"), F.lit(True).alias("ok"), F.lit("attested").alias("reason"))
    refused = F.struct(gold.alias("text"), F.lit(False).alias("ok"), part["reason"].alias("reason"))
    tried = F.struct(made.alias("text"), (runs == 1).alias("ok"), F.when(runs == 1, "spliced").otherwise(F.concat(F.lit("runs: "), runs.cast("string"))).alias("reason"))
    return F.when(attested.isNotNull() & (difference_count(gold, whole) == 1), taken).when(~part["ok"], refused).otherwise(tried)


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    both = overlap(a_start, a_end, b_start, b_end)
    return F.try_divide(both, (a_end - a_start) + (b_end - b_start) - both)


def esa_score(reply: Column) -> tuple[Column, Column]:
    """T-30: the first number of a judge's reply, and whether it begins with NO ERRORS."""
    return F.try_to_number(F.nullif(F.regexp_extract(reply, r"\d{1,3}", 0), F.lit("")), F.lit("999")).cast("int"), F.startswith(F.upper(F.btrim(reply)), F.lit("NO ERRORS"))


def rendered(template: str, fields: dict[str, Column]) -> Column:
    """T-27: a prompt with {name} fields; an absent one is an error."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.raise_error(F.lit(f"missing field {name}")).cast("string")))
    return out


def per_million(n: Column, total: Column) -> Column:
    """M-02."""
    return F.try_divide(n * F.lit(1e6), total)


def log_ratio(a: Column, b: Column) -> Column:
    """M-02: log2 with infinities for zeros."""
    return F.when((a == 0) & (b == 0), F.lit(float("nan"))).when(b == 0, F.lit(float("inf"))).when(a == 0, F.lit(float("-inf"))).otherwise(F.log2(a / b))
