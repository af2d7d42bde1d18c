"""Quality rules: one threshold table compiled into one projection.

``RULES`` names a measure and its lowest and highest passing value.
``quality_rules`` computes base counts with built-in functions only and turns
the table into Boolean columns of the same projection; no user function, no
shuffle, no join.

Words are ``[^\\x20\\x09-\\x0D]+``.  Defined cases: null text has no words and no
lines, so it fails the base rule; ratios over nothing are 0; very long texts are
measured whole; rows are independent, so ties and repeats don't matter; an
input column named like a result column is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the four corpus languages.
STOP_WORDS = (
    "the of to and a in is that for on with as it be by this are was at from or an "
    "le la les de des du et un une en que qui dans pour par sur au est il elle "
    "der die das und in zu den mit von auf ist im dem nicht ein eine als auch es "
    "el los las del y en que un una por con para se su al lo como es"
).split()

#: (measure, lowest, highest); a bound of None is open.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_chars", 2.0, 14.0),
    ("symbol_ratio", None, 0.1),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.3),
)

WORD = r"[^\x20\x09-\x0D]+"
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, pieces) -> Column:
    for piece in pieces:
        text = F.replace(text, F.lit(piece), F.lit(""))
    return text


def _repeated_words(words: Column) -> Column:
    """Words covered by ``WINDOW``-word windows found twice or more in ``words``."""

    def measure(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(ranked, lambda p: spread(F.sort_array(F.transform(
            F.filter(p, lambda x, i: F.coalesce(F.get(p, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["i"]))))

    def spread(starts: Column) -> Column:
        return _let(starts, lambda s: F.aggregate(
            F.transform(s, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW)))),
            F.lit(0), lambda total, x: total + x))

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(_let(words, measure)).cast("long")


def _rule(low: float | None, high: float | None, value: Column) -> Column:
    ok = F.lit(True)
    if low is not None:
        ok = ok & (value >= low)
    if high is not None:
        ok = ok & (value <= high)
    return ok


def quality_rules(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with base counts, a ratio and a verdict per rule, ``base_failed`` and ``kept``.

    Columns: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words`` (long); each measure (double) and ``ok_<measure>``;
    ``base_failed`` and ``kept`` (boolean).
    """
    text = F.coalesce(F.col("__text"), F.lit(""))
    measures = [m for m, _, _ in rules]
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *measures, *(f"ok_{m}" for m in measures), "base_failed", "kept"]
    keep = [c for c in docs.columns if c not in added]
    one = docs.select(docs[f"`{text_col}`"].alias("__text"), *[docs[f"`{c}`"] for c in keep])
    has_word = lambda line: line.rlike(WORD)
    two = one.withColumns({"__words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "__lines": F.filter(F.split(text, "\n"), has_word)})
    n = F.size("__words").cast("long")
    base = {
        "n_words": n,
        "word_chars": F.length(_without(text, SPACES)).cast("long"),
        "n_symbols": (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": _repeated_words(F.col("__words")),
        "__n_lines": F.size("__lines"),
        "__n_stop": F.size(F.filter("__words", lambda w: w.isin(STOP_WORDS))),
        "__n_bullet": F.size(F.filter("__lines", lambda x: x.rlike(r"^\s*[-*•]"))),
        "__n_ellipsis": F.size(F.filter("__lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))),
    }
    three = two.select(*[f"`{c}`" for c in keep], *[c.alias(k) for k, c in base.items()])
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    known = {
        "mean_word_chars": over("word_chars", "n_words"),
        "symbol_ratio": over("n_symbols", "n_words"),
        "stop_word_ratio": over("__n_stop", "n_words"),
        "dup_line_ratio": over("n_dup_lines", "__n_lines"),
        "bullet_line_ratio": over("__n_bullet", "__n_lines"),
        "ellipsis_line_ratio": over("__n_ellipsis", "__n_lines"),
    }
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    verdict = ~failed
    for m, low, high in rules:
        verdict = verdict & _rule(low, high, known[m])
    return three.select(
        *[f"`{c}`" for c in keep], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        *[known[m].alias(m) for m in measures], *[_rule(low, high, known[m]).alias(f"ok_{m}") for m, low, high in rules],
        failed.alias("base_failed"), verdict.alias("kept"),
    )


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
p AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS gram FROM p),
h AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
x AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM h) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(x.n, 0) AS n_repeat_words,
        len(list_filter(words, lambda v: v IN ({stops}))) AS n_stop,
        len(list_filter(lines, lambda l: regexp_matches(l, '^\s*[-*•]'))) AS n_bullet,
        len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)\s*$'))) AS n_ellipsis
      FROM w LEFT JOIN x USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.1 AND n_stop / n_words >= 0.02
  AND n_dup_lines / n_lines <= 0.5 AND n_bullet / n_lines <= 0.9 AND n_ellipsis / n_lines <= 0.3 AS kept
FROM b
""".replace("{stops}", ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS)))
