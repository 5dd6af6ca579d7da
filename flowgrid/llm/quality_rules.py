"""Quality rules: a threshold table compiled into one Spark projection.

Everything here is built-in SQL functions on the JVM; no rows leave it and nothing is shuffled,
so the operator scales with the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that separate words and the characters that count as symbols.
WHITE = " \t\n\u000b\f\r"
WHITE_RUN = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"

# Frequent function words by language.
STOP_WORDS = {
    "de": "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist ja mit nach nicht noch nur oder sein sich sie sind so über um und uns vom von vor war was wenn werden wie wir wird zu zum zur",
    "en": "a about all also an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on one or our she so than that the their them there they this to up was we were what when which who will with would you your",
    "es": "a al como con de del desde donde el ella en entre era es esta este fue ha hay la las le lo los más me mi muy no nos o para pero por porque que qué se ser si sin sobre son su sus también te un una uno y ya yo",
    "fr": "a ai au aux avec c ce ces comme d dans de des du elle en est et eu il ils j je l la le les leur lui ma mais me mes n ne nos notre nous on ont ou où par pas plus pour qu que qui s sa se ses si son sont sur ta te un une vous y à été être",
}


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high``; a rule with ``langs`` binds only documents of those languages."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    langs: tuple[str, ...] | None = None


#: The table. Measures are ratios over words or lines unless their name says otherwise.
RULES: tuple[Rule, ...] = (
    Rule("length", "n_words", 50, 100_000),
    Rule("mean_word_length", "mean_word_chars", 2.5, 15.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("letters", "letter_ratio", 0.7, None),
    Rule("stop_words", "stop_ratio", 0.1, None, tuple(STOP_WORDS)),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("bullet_lines", "bullet_ratio", None, 0.9),
    Rule("ellipsis_lines", "ellipsis_ratio", None, 0.3),
)


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _measures(df: DataFrame, text: str, lang: str | None) -> DataFrame:
    """Measures of each text, in three narrow projections.

    No lambda refers to an array outside it, so no projection that the optimiser merges can make
    the cost of a text more than n log n in its words.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    stops = sorted({x for words in STOP_WORDS.values() for w in words.split() for x in (w, w.capitalize())})
    df = df.withColumns(
        {
            "_t": t,
            "_w": F.filter(F.split(t, WHITE_RUN), lambda w: w != ""),
            "_l": F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != ""),
        }
    )
    w, lines = F.col("_w"), F.col("_l")
    # Three-word windows beside each other, hashed with their place.
    whole = F.greatest(F.size(w) - 2, F.lit(0))
    windows = F.arrays_zip(*[F.slice(w, k + 1, whole).alias(name) for k, name in enumerate("abc")])
    hashed = F.transform(windows, lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("i")))
    df = df.withColumns(
        {
            "_s": F.sort_array(hashed),
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": (F.length("_t") - F.length(_without(F.col("_t"), SYMBOLS))).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "_letters": F.length(F.regexp_replace("_t", "\\P{L}+", "")),
            "_stop": F.size(F.filter(w, lambda x: x.isin(stops))),
            "_bullets": F.size(F.filter(lines, lambda x: F.substring(F.btrim(x), 1, 2).isin("- ", "* ", "• ", "‣ ", "· "))),
            "_dots": F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
        }
    )
    s = F.col("_s")
    beside = F.arrays_zip(s.alias("x"), F.slice(s, 2, F.greatest(F.size(s), F.lit(1))).alias("n"))
    df = df.withColumns({"_eq": F.filter(beside, lambda z: F.coalesce(z["x"]["h"] == z["n"]["h"], F.lit(False)))})
    eq = F.col("_eq")
    df = df.withColumns({"_at": F.sort_array(F.array_distinct(F.concat(F.transform(eq, lambda z: z["x"]["i"]), F.transform(eq, lambda z: z["n"]["i"]))))})
    # Each repeated window covers three words, less what the next one covers again.
    at = F.col("_at")
    covered = F.aggregate(
        F.arrays_zip(at.alias("x"), F.slice(at, 2, F.greatest(F.size(at), F.lit(1))).alias("n")),
        F.lit(0),
        lambda acc, z: acc + F.when(z["x"].isNull(), 0).otherwise(F.least(F.lit(3), F.coalesce(z["n"] - z["x"], F.lit(3)))),
    )
    per_word = lambda c: F.try_divide(c.cast("double"), F.col("n_words"))
    per_line = lambda c: F.try_divide(c.cast("double"), F.col("n_lines"))
    return df.withColumns(
        {
            "n_repeat_words": covered.cast("long"),
            "mean_word_chars": per_word(F.col("word_chars")),
            "symbol_ratio": per_word(F.col("n_symbols")),
            "letter_ratio": F.try_divide(F.col("_letters").cast("double"), F.col("word_chars")),
            "stop_ratio": per_word(F.col("_stop")),
            "dup_line_ratio": per_line(F.col("n_dup_lines")),
            "bullet_ratio": per_line(F.col("_bullets")),
            "ellipsis_ratio": per_line(F.col("_dots")),
            "_lang": F.col(lang).cast("string") if lang else F.lit(None).cast("string"),
        }
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """Each rule as one boolean column over the measures; a measure that is null passes."""
    out = {}
    for r in rules:
        m, ok = F.col(r.measure), F.lit(True)
        if r.low is not None:
            ok = ok & (m >= r.low)
        if r.high is not None:
            ok = ok & (m <= r.high)
        ok = F.coalesce(ok, F.lit(True))
        if r.langs is not None:
            ok = ok | ~F.coalesce(F.col("_lang").isin(list(r.langs)), F.lit(False))
        out[r.name] = ok
    return out


#: Names that quality_rules() adds.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_rules(docs: DataFrame, text: str = "text", lang: str | None = "lang", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Judge every whole text by the rule table.

    Returns the columns ``keep``, the five base measures, ``base_failed``, ``kept`` and
    ``failed_rules`` (names, in the table's order). A null or empty text has no words, so it fails
    the base rule. A null language or one outside the stop-word lists is exempt from rules bound to
    languages. Three-word windows of a text are told apart by 64-bit hashes: two different ones of a
    text of 100,000 words are taken for each other with a probability of 3e-10. Repeated rows are judged each by itself; other input columns don't matter, whatever
    their names.
    """
    measured = _measures(docs.select(*[F.col(k) for k in keep], F.col(text).alias("_text_in"), *([F.col(lang).alias("_lang_in")] if lang else [])), "_text_in", "_lang_in" if lang else None)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    compiled = compile_rules(rules)
    failed = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in compiled.items()]), lambda x: x.isNotNull())
    measured = measured.withColumns({"base_failed": base, "failed_rules": failed})
    return measured.select(*keep, *MEASURES, "base_failed", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules")


def apply_quality_rules(docs: DataFrame, text: str = "text", lang: str | None = "lang", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns unchanged."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(text).alias("_text_in"), *([F.col(lang).alias("_lang_in")] if lang else []))
    # The row number keeps the optimiser from pushing the verdict, spelt out, below the measures.
    judged = quality_rules(packed, "_text_in", "_lang_in" if lang else None, keep=("_row",), rules=rules).withColumn("_at", F.monotonically_increasing_id())
    return judged.filter(F.col("kept") & (F.col("_at") >= 0)).select("_row.*")
