"""Operator 1, quality rules: a threshold table compiled into one projection of built-in functions.

Words are maximal runs of characters other than space and \\t..\\r. All ratios are of whole texts.

Defined cases: NULL and '' have no words, so every count is 0 and the base rule fails them. Repeated rows are
judged alike, each on its own. Columns of the input other than id and text are not looked at, so names may clash.
An empty table gives an empty result. Texts of any length: the work on one text is n log n in its words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space, symbols, and function words of the four languages.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = {
    "en": "the of and to in a is it that for was on with as be at by this are or an not from but",
    "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur se ne",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como o",
}


@dataclass(frozen=True)
class Rule:
    """A text passes when low <= measure <= high."""

    measure: str
    low: float = float("-inf")
    high: float = float("inf")


#: The threshold table. Measures are the keys of measures().
RULES = (
    Rule("mean_word_length", 2.0, 14.0),
    Rule("symbols_per_word", high=0.25),
    Rule("stop_word_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.5),
    Rule("bang_per_word", high=0.3),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def stop_forms() -> list[str]:
    """Function words as written: in lower case, with a capital, or in capitals."""
    plain = {w for ws in STOP_WORDS.values() for w in ws.split()}
    return sorted({f for w in plain for f in (w, w.capitalize(), w.upper())})


def count_of(text: str, ascii_chars: str) -> Column:
    """Occurrences of ASCII characters, as the bytes that go when they are replaced."""
    return sum((F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit(c), F.lit("")))) for c in ascii_chars)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def word_array(text: Column) -> Column:
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(inner, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_RUN))


def trigram_array(words: Column) -> Column:
    """3-word windows in order; words hold no spaces, so the joined text is exact."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return F.transform(starts, lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1), F.lit(" "), F.get(words, i + 2)))


def spread(starts: Column) -> Column:
    """Size of the union of [p, p + 3) over ascending starts p."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(starts, zero, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")))["n"]


def repeated_by_text(words: Column) -> Column:
    """Number of words inside 3-word windows that are found twice or more, by sorting the windows' texts."""

    def covered(s: Column) -> Column:
        before = lambda x, i: F.when(i == 0, F.lit(False)).otherwise(F.get(s, i - 1)["g"] == x["g"])
        hits = F.filter(s, lambda x, i: before(x, i) | F.coalesce(F.get(s, i + 1)["g"] == x["g"], F.lit(False)))
        return spread(F.sort_array(F.transform(hits, lambda x: x["i"])))

    return let(F.sort_array(F.transform(trigram_array(words), lambda g, i: F.struct(g.alias("g"), i.alias("i")))), covered)


#: A window as one long: the hash above, its start below. Longer texts are sorted by text.
INDEX_BITS = 24
INDEX_MASK = (1 << INDEX_BITS) - 1


def repeated_words(words: Column) -> Column:
    """The same number, faster: windows are sorted as longs, which needs no comparison of strings. Windows with
    equal hash bits are then compared word by word; where any differ, the text takes the way by text."""
    at = lambda x: x.bitwiseAND(F.lit(INDEX_MASK)).cast("int")
    starts = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    packed = F.transform(starts, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(~INDEX_MASK)).bitwiseOR(i.cast("bigint")))

    def neighbours(s: Column) -> Column:
        """Pairs of windows next to each other in sorted order that have the same hash bits."""
        pair = lambda a, b: F.when(a.bitwiseXOR(b).bitwiseAND(F.lit(~INDEX_MASK)) == 0, F.struct(at(a).alias("a"), at(b).alias("b")))
        return F.array_compact(F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), pair))

    def counted(pairs: Column) -> Column:
        differs = lambda p: F.array(*[F.get(words, p["a"] + k) for k in range(3)]) != F.array(*[F.get(words, p["b"] + k) for k in range(3)])
        starts = F.sort_array(F.array_distinct(F.flatten(F.transform(pairs, lambda p: F.array(p["a"], p["b"])))))
        return F.when(F.size(pairs) == 0, F.lit(0)).when(F.exists(pairs, differs), repeated_by_text(words)).otherwise(spread(starts))

    fast = let(let(F.sort_array(packed), neighbours), counted)
    return F.when(F.size(words) > INDEX_MASK, repeated_by_text(words)).otherwise(fast)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts and ratios) a row. Three projections, no shuffle."""
    stop = stop_forms()
    text = F.coalesce(F.col("_t"), F.lit(""))
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    d = d.select("_id", text.alias("_t"), word_array(F.col("_t")).alias("_w"))
    with_word = F.filter(F.split("_t", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    d = d.select(
        "_id", F.size("_w").alias("n_words"), F.length(F.array_join("_w", "")).alias("word_chars"),
        count_of("_t", SYMBOLS).alias("n_symbols"),
        count_of("_t", "!").alias("n_bangs"),
        with_word.alias("_lines"), repeated_words(F.col("_w")).alias("n_repeat_words"),
        F.size(F.filter("_w", lambda w: w.isin(stop))).alias("n_stop"),
    )
    d = d.withColumns(
        {
            "n_lines": F.size("_lines"),
            "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        }
    ).drop("_lines")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return d.withColumns(
        {
            "mean_word_length": ratio("word_chars", "n_words"),
            "symbols_per_word": ratio("n_symbols", "n_words"),
            "stop_word_ratio": ratio("n_stop", "n_words"),
            "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
            "bang_per_word": ratio("n_bangs", "n_words"),
        }
    )


def compiled(rules=RULES) -> Column:
    """The table as one boolean expression."""
    ok = F.lit(True)
    for r in rules:
        if r.low != float("-inf"):
            ok &= F.col(r.measure) >= r.low
        if r.high != float("inf"):
            ok &= F.col(r.measure) <= r.high
    return ok


def quality_rules(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row an input row: id, counts (long), the ratios, base_failed, failed_rules, kept."""
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    failed = [F.when(~compiled([r]), F.lit(r.measure)) for r in rules]
    m = measures(docs, id_col, text_col)
    counts = [F.col(c).cast("bigint").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return m.select(
        F.col("_id").alias(id_col), *counts, *dict.fromkeys(r.measure for r in rules), base.alias("base_failed"),
        F.array_compact(F.array(*failed)).alias("failed_rules"), (~base & compiled(rules)).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP_SQL = ",".join(f"'{w}'" for w in stop_forms())
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text,'') t, regexp_extract_all(coalesce(text,''), '[^\\x20\\x09-\\x0D]+') w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w)-1)) i, w FROM d WHERE len(w)>=3),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2]) c FROM g),
r AS (SELECT doc_id, count(DISTINCT p) n_repeat_words FROM (SELECT doc_id, unnest([i,i+1,i+2]) p FROM h WHERE c>1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) n_lines, count(*)-count(DISTINCT x) n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) x FROM d)
 WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) n_words, length(regexp_replace(t,'[\\x20\\x09-\\x0D]','','g')) word_chars, length(t)-length(regexp_replace(t,'[#*$%&|<>]','','g')) n_symbols,
 coalesce(n_dup_lines,0) n_dup_lines, coalesce(n_lines,0) n_lines, coalesce(n_repeat_words,0) n_repeat_words, length(t)-length(replace(t,'!','')) n_bangs,
 len(list_filter(w, lambda x: x IN ({_STOP_SQL}))) n_stop FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND word_chars/n_words BETWEEN 2 AND 14 AND n_symbols/n_words<=0.25
 AND n_stop/n_words>=0.02 AND n_dup_lines/n_lines<=0.5 AND n_bangs/n_words<=0.3 AS kept
FROM (SELECT *, n_words<50 OR 100*n_repeat_words>50*n_words base_failed FROM m)"""
