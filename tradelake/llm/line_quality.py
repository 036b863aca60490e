"""Line-first cleaning: rules per line, failures removed, then a verdict on the document.

Column expressions only, one narrow pass over the documents. A line without a
word passes no judgement and stays. A document is rejected when its base
signals fail or when its failing lines hold more than `max_loss` percent of its
words. A null or word-free text fails the base (fewer than 50 words). Repeated
rows, null ids and further columns of any name are no concern: each row is
judged alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_LOSS_PERCENT = 30
SYMBOLS = "#*$%&|<>"
SPACES = r"[\x20\x09-\x0D]+"
ENDS = r"""[.!?:;)\]"'\x{2026}\x{201D}\x{00BB}][\x20\x09-\x0D]*$"""
SENTENCE = r"[.!?][\x20\x09-\x0D]"
NAVIGATION = (r"(?i)^[\x20\x09-\x0D]*(home|menu|log ?in|log ?out|sign (in|up)|next|previous|search|contact us|about us"
              r"|back to top|skip to content|share (this|on)|read more|click here)([^a-z]|$)")
BOILERPLATE = (r"(?i)all rights reserved|copyright [0-9(]|cookie policy|privacy policy|terms of (use|service)"
               r"|enable javascript|lorem ipsum|^(licensed|released) under |is licensed under ")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once per row."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _count(text: Column, characters: str) -> Column:
    """How many of these characters a text has; the rest goes in long runs."""
    return F.char_length(F.regexp_replace(text, f"[^{characters}]+", ""))


def line_rules(line: Column, w: Column) -> dict[str, Column]:
    """True where a line with the words w fails."""
    n = F.size(w)
    capitals = _count(line, "A-Z")
    return {
        "symbols": _count(line, SYMBOLS) * 5 > n,
        "shouting": (_count(line, "!") * 10 > n * 3) | ((capitals >= 10) & (capitals * 3 > F.char_length(line))),
        "punctuation": ~F.rlike(line, F.lit(ENDS)) & ((n < 20) | ~F.rlike(line, F.lit(SENTENCE))),
        "navigation": (n <= 8) & F.rlike(line, F.lit(NAVIGATION)),
        "boilerplate": (n <= 25) & F.rlike(line, F.lit(BOILERPLATE)),
        "repetition": (n >= 10) & (F.size(F.array_distinct(w)) * 3 < n),
    }


def _judged(line: Column) -> Column:
    def of(w: Column) -> Column:
        first = F.coalesce(*(F.when(bad, F.lit(name)) for name, bad in line_rules(line, w).items()))
        return F.struct(line.alias("line"), w.alias("words"), F.when(F.size(w) > 0, first).alias("fault"))

    return let(words(line), of)


def repeat_words(w: Column, n: int = 3) -> Column:
    """Words inside windows of n words that the array holds twice or more."""
    last = F.size(w) - n

    def windows(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            value = lambda k: F.get(s, k)["h"]
            at = F.filter(s, lambda x, k: F.coalesce((x["h"] == value(k - 1)) | (x["h"] == value(k + 1)),
                                                     x["h"] == value(k - 1), x["h"] == value(k + 1), F.lit(False)))
            places = F.flatten(F.transform(at, lambda x: F.array(*(x["i"] + k for k in range(n)))))
            return F.size(F.array_distinct(places))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(order, twice))

    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))
    return F.when(last < 1, F.lit(0)).otherwise(let(hashes, windows))


def signals(text: Column, *, max_loss: int = MAX_LOSS_PERCENT) -> Column:
    """A struct of base signals, lost words, verdict and cleaned text."""
    def of(lines: Column) -> Column:
        with_words = F.transform(F.filter(lines, lambda x: F.size(x["words"]) > 0), lambda x: x["line"])
        lost = F.aggregate(F.filter(lines, lambda x: x["fault"].isNotNull()), F.lit(0), lambda s, x: s + F.size(x["words"]))
        clean = F.array_join(F.transform(F.filter(lines, lambda x: x["fault"].isNull()), lambda x: x["line"]), "\n")
        distinct = let(with_words, lambda x: F.size(x) - F.size(F.array_distinct(x)))
        every = F.flatten(F.transform(lines, lambda x: x["words"]))
        measured = let(every, lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            repeat_words(w).cast("bigint").alias("n_repeat_words")))
        return let(F.struct(measured.alias("m"), lost.cast("bigint").alias("lost"), distinct.cast("bigint").alias("dup"),
                            clean.alias("clean")), verdict)

    def verdict(x: Column) -> Column:
        n = x["m"]["n_words"]
        failed = (n < MIN_WORDS) | (x["m"]["n_repeat_words"] * 100 > n * MAX_REPEAT_PERCENT)
        return F.struct(
            n.alias("n_words"), x["m"]["word_chars"].alias("word_chars"),
            _count(F.coalesce(text, F.lit("")), SYMBOLS).cast("bigint").alias("n_symbols"),
            x["dup"].alias("n_dup_lines"), x["m"]["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"), (~failed & (x["lost"] * 100 <= n * max_loss)).alias("kept"),
            x["lost"].alias("n_lost_words"), x["clean"].alias("clean"))

    return let(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _judged), of)


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: signals, words on failing lines, verdict."""
    q = docs.select("doc_id", signals(F.col("text"), **options).alias("q")).select("doc_id", "q.*")
    return q.drop("clean")


def clean(docs: DataFrame, **options) -> DataFrame:
    """Kept documents without their failing lines; n_chars, if there, follows the text."""
    q = docs.select(F.struct("*").alias("row"), signals(F.col("text"), **options).alias("q")).where("q.kept")
    new = {"text": F.col("q.clean"), "n_chars": F.char_length("q.clean").cast("bigint")}
    return q.select([new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


REPORT_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT r, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM l),
lf AS (SELECT r, line, len(w) AS n,
  5 * (length(line) - length(translate(line, '{SYMBOLS}', ''))) > len(w)
  OR 10 * (length(line) - length(translate(line, '!', ''))) > 3 * len(w)
  OR (length(regexp_replace(line, '[^A-Z]+', '', 'g')) >= 10 AND 3 * length(regexp_replace(line, '[^A-Z]+', '', 'g')) > length(line))
  OR (NOT regexp_matches(line, {_sql(ENDS)}) AND (len(w) < 20 OR NOT regexp_matches(line, {_sql(SENTENCE)})))
  OR (len(w) <= 8 AND regexp_matches(line, {_sql(NAVIGATION)}))
  OR (len(w) <= 25 AND regexp_matches(line, {_sql(BOILERPLATE)}))
  OR (len(w) >= 10 AND 3 * len(list_distinct(w)) < len(w)) AS bad
  FROM lw WHERE len(w) > 0),
ls AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, sum(CASE WHEN bad THEN n ELSE 0 END) AS lost FROM lf GROUP BY r),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
i AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM i),
p AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) v(k) WHERE c > 1 GROUP BY r),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(lost, 0) AS BIGINT) AS n_lost_words
  FROM d JOIN w USING (r) LEFT JOIN ls USING (r) LEFT JOIN p USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * n_lost_words <= {MAX_LOSS_PERCENT} * n_words AS kept, n_lost_words FROM b
"""
