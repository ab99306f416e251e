"""Quality rules, line first: rules are evaluated per line, failing lines are removed, and a document
that loses too much of its text is rejected.

A line fails by
* punctuation: it is short and has no closing mark, or has more loose signs than words;
* navigation: a quarter or more of its words are separators of a menu;
* boilerplate: it is short and holds a phrase of site furniture.
Lines without a word neither fail nor count. Before the lines, a document fails when it has fewer
than 50 words or over half of its words lie in three-word windows that occur twice or more in it.

Only built-in expressions, and no shuffle: a document's words, lines and windows are arrays of its
row, so the plan is one narrow pass and a lost executor costs its own tasks.

Defined cases: a null text has no words and fails; repeated rows are judged each; a very long text
takes one row's memory; other columns are carried along unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steward.llm.common import BLANK

MIN_WORDS, MAX_REPEATED_PERCENT, MAX_LOST_PERCENT = 50, 50, 50
#: A line without a closing mark fails below this many words; boilerplate is at most so long.
SHORT_LINE, BOILERPLATE_WORDS = 10, 25
LEAST_SIGNS, LEAST_SEPARATORS = 5, 3
WORD = "[^\\x09-\\x0D\\x20]"
SYMBOLS = "[#*$%&|<>]"
SIGNS = "[#*$%&|<>!?~^=+_]"
CLOSED = "[.!?:;…。！？؟।][\"'”’»)\\]」]*[\\x09-\\x0D\\x20]*$"
SEPARATOR = "(?:^|[\\x09-\\x0D\\x20])(?:[|>/]|»|›|·|•)(?=[\\x09-\\x0D\\x20]|$)"
BOILERPLATE = (
    "(?i)(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie (?:policy|settings)|"
    "we use cookies|accept (?:all )?cookies|enable javascript|click here|sign up|log in|subscribe to|"
    "skip to (?:main )?content|back to top|share (?:this|on)|read more|lorem ipsum|powered by)"
)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def with_value(value: Column, use) -> Column:
    """`use(value)` with `value` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def covered_words(windows: Column) -> Column:
    """Words in three-word windows that occur twice or more, given all windows in order."""
    sorted_windows = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        def same(k: Column, other: Column) -> Column:
            return F.coalesce(F.get(s, k)["w"] == F.get(s, other)["w"], F.lit(False))

        return F.array_sort(F.filter(F.transform(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda k: F.when(same(k, k + 1) | same(k, k - 1), F.get(s, k)["i"])), lambda i: i.isNotNull()))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(
        with_value(sorted_windows, repeated), start,
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(covered["n"])


def line_fails(line: Column, n: Column) -> Column:
    # Plain tests first: they spare most lines the patterns.
    signs = F.length(line) - F.length(F.regexp_replace(line, SIGNS, ""))
    separators = F.size(F.split(line, SEPARATOR)) - 1
    return (
        ((n < SHORT_LINE) & ~line.rlike(CLOSED))
        | with_value(signs, lambda s: (s >= LEAST_SIGNS) & (s > n))
        | (line.rlike("[|>/»›·•]") & with_value(separators, lambda s: (s >= LEAST_SEPARATORS) & (4 * s >= n)))
        | ((n <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE))
    )


def judged(docs: DataFrame, blank_lines: bool = False) -> DataFrame:
    """Per row: `row` (all columns of the document), the counts, base_failed, lost_words, kept, lines.

    `lines` has the lines without a word only if `blank_lines` asks for them; they never fail.
    """
    counted = "all_lines" if blank_lines else "l"
    text = F.coalesce(F.col("row.text"), F.lit(""))
    one = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    two = one.select(
        "row", text.alias("t"), words(text).alias("w"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("l"),
        *([F.split(text, "\n").alias("all_lines")] if blank_lines else []))
    three = two.select(
        "row", "t", "w", "l",
        F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), lambda w, i: F.concat_ws(
            " ", w, F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2))).alias("windows"),
        F.transform(counted, lambda line: F.struct(line.alias("line"), F.size(words(line)).cast("long").alias("n"))).alias("sized"))

    def fails(x: Column) -> Column:
        return (x["n"] > 0) & line_fails(x["line"], x["n"]) if blank_lines else line_fails(x["line"], x["n"])

    four = three.select(
        "row",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        covered_words(F.col("windows")).alias("n_repeat_words"),
        F.transform("sized", lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"), fails(x).alias("fails"))).alias("lines"))
    five = four.select(
        "*",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))).alias("base_failed"),
        F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.when(x["fails"], x["n"]).otherwise(F.lit(0).cast("long"))).alias("lost_words"))
    kept = ~F.col("base_failed") & (100 * F.col("lost_words") <= MAX_LOST_PERCENT * F.col("n_words"))
    # A filter on a verdict would be pushed below the projections, and all their expressions written out
    # there several times over. It can't pass a generator, here one that gives each row back.
    return five.select(F.inline(F.array(F.struct(*five.columns, kept.alias("kept")))))


def quality(docs: DataFrame) -> DataFrame:
    """Counts and verdict per document, without the texts."""
    return judged(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "lost_words", "kept")


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id and text of the kept documents with the failing lines removed."""
    return kept_documents(docs.select("doc_id", "text"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The kept documents with the failing lines removed and with all their columns.

    Other lines stay as they are, blank ones too; n_chars, where there is one, follows a changed text.
    """
    good = F.transform(F.filter("lines", lambda x: ~x["fails"]), lambda x: x["line"])
    rows = judged(docs, blank_lines=True).where("kept").select(
        "row", F.when(F.exists("lines", lambda x: x["fails"]), F.array_join(good, "\n")).alias("shorter"))
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    changed = {
        "text": lambda: F.coalesce("shorter", "row.text"),
        "n_chars": lambda: F.when(F.col("shorter").isNull(), F.col("row.n_chars")).otherwise(F.length("shorter").cast(kinds["n_chars"]))}
    return rows.select(*(changed[c]().alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
