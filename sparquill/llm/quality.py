"""Quality rules as a short-circuit cascade.

Every rule is a JVM expression that is true for a text it rejects. A sample of the
documents gives each rule's cost (seconds a row) and which rows it rejects; the cascade
takes, again and again, the rule with most rejections per cost among the rows that no
earlier rule rejected. A CASE expression then evaluates the rules in that order and stops
at the first that rejects. The order changes only the time that is spent: a document is
kept if and only if no rule rejects it.

Null and empty texts, and texts of blanks, are rejected by ``blank``. Repeated rows are
judged alike, each by itself. Other columns pass through untouched, whatever their names.
"""
from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm.common import col
from sparquill.sources import table

#: Rows of the sample from which the order of the rules is estimated, and the input files they come from.
SAMPLE_ROWS = 2000
SAMPLE_FILES = 8

MAX_SYMBOL_WORDS = 0.1  # of words: runs of three of * % & $ #
MAX_PIPES = 0.1  # of words
MAX_SHOUTS = 0.2  # of words: !!
MAX_UPPER = 0.4  # of characters that are not blank: A to Z, from 20 characters on
MAX_NON_WORD = 0.6  # of characters that are not blank: ASCII digits and punctuation, from 40 characters on
MIN_VARIETY = 2.0  # different words / square root of words, from 30 words on
MAX_REPEATED_LINES = 0.5  # of lines, from 6 lines on
MEAN_WORD = (1.5, 25.0)  # characters that are not blank, a word
SYMBOLS = ("***", "%%%", "&&&", "$$$", "###")
NON_WORD = "[!-&(-@\\[\\]^_`{|}~]"


def _count(text: Column, piece: str) -> Column:
    """How often piece occurs in text: a byte search, far cheaper here than a regular expression."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def sizes(text: Column) -> Column:
    """What many rules share: words, counted as spaces and line ends + 1, and characters that are neither."""
    blanks = _count(text, " ") + _count(text, "\n")
    return F.struct((blanks + 1).alias("words"), (F.length(text) - blanks).alias("solid"))


def rules(text: Column, size: Column) -> dict[str, Column]:
    """Each rule's expression by name: true where it rejects, never null for a text that is not null.

    size: sizes(text), computed once a text.
    """
    words, solid = size["words"], size["solid"]
    split = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")
    lines = F.split(text, "\n")
    symbols = reduce(lambda x, y: x + y, (_count(text, s) for s in SYMBOLS))
    return {
        "blank": solid == 0,
        "symbol_words": symbols > MAX_SYMBOL_WORDS * words,
        "pipes": _count(text, "|") > MAX_PIPES * words,
        "shouts": _count(text, "!!") > MAX_SHOUTS * words,
        "upper": (solid >= 20) & (F.regexp_count(text, F.lit("[A-Z]")) > MAX_UPPER * solid),
        "non_word": (solid >= 40) & (F.regexp_count(text, F.lit(NON_WORD + "|[0-9]")) > MAX_NON_WORD * solid),
        "variety": (words >= 30) & (F.size(F.array_distinct(split)) < MIN_VARIETY * F.sqrt(words.cast("double"))),
        "repeated_lines": (F.size(lines) >= 6) & (F.size(lines) - F.size(F.array_distinct(lines)) > MAX_REPEATED_LINES * F.size(lines)),
        "mean_word": (solid > 0) & ((solid < MEAN_WORD[0] * words) | (solid > MEAN_WORD[1] * words)),
        "filler": F.contains(F.lower(text), F.lit("lorem ipsum")),
    }


def _sample(docs: DataFrame, text_col: str) -> DataFrame:
    """Up to SAMPLE_ROWS texts, from files spread evenly over the table."""
    files = sorted(docs.inputFiles())
    if len(files) > SAMPLE_FILES:
        files = files[:: -(-len(files) // SAMPLE_FILES)]
        parts = [docs.sparkSession.read.parquet(f) for f in files] if all(f.endswith(".parquet") for f in files) else []
        if parts and all(text_col in p.columns for p in parts):
            each = [p.select(col(text_col).alias("text")).limit(SAMPLE_ROWS // len(parts)) for p in parts]
            return reduce(DataFrame.unionAll, each)
    return docs.select(col(text_col).alias("text")).limit(SAMPLE_ROWS)


def estimate(docs: DataFrame, text_col: str = "text", repeats: int = 2) -> tuple[dict[str, float], dict[int, int]]:
    """Seconds that each rule takes over the sample, and how many sample rows each set of rejecting rules has.

    The sets are bit masks over the rules in their listed order.
    """
    sample = _sample(docs, text_col).where(F.col("text").isNotNull()).coalesce(1)
    sample = sample.select("text", sizes(F.col("text")).alias("size")).persist()
    tests = rules(F.col("text"), F.col("size"))
    try:
        mask = sum((F.when(e, F.lit(1 << i)).otherwise(F.lit(0)) for i, e in enumerate(tests.values())), F.lit(0))
        masks = {r["mask"]: r["n"] for r in sample.select(mask.alias("mask")).groupBy("mask").agg(F.count("*").alias("n")).collect()}

        def seconds(e: Column) -> float:
            took, probe = [], sample.agg(F.sum(e.cast("int")).alias("x"))
            for _ in range(repeats):
                t = time.perf_counter()
                probe.collect()
                took.append(time.perf_counter() - t)
            return min(took)

        idle = seconds(F.col("text").isNotNull())
        costs = {name: max(1e-4, seconds(e) - idle) for name, e in tests.items()}
    finally:
        sample.unpersist()
    return costs, masks


RULES = ["blank", "symbol_words", "pipes", "shouts", "upper", "non_word", "variety", "repeated_lines", "mean_word", "filler"]


def cascade_order(names: list[str], costs: dict[str, float], masks: dict[int, int]) -> list[str]:
    """Rules by rejections per cost among the sample rows that earlier rules left; ties by listed order."""
    left, todo, order = dict(masks), list(names), []
    while todo:
        best = max(todo, key=lambda r: sum(n for m, n in left.items() if m >> names.index(r) & 1) / costs[r])
        order.append(best)
        todo.remove(best)
        left = {m: n for m, n in left.items() if not m >> names.index(best) & 1}
    return order


def rejected_by(text: Column, order: list[str]) -> Column:
    """Name of the first rule in order that rejects text, null if none does; later rules aren't evaluated."""


    def first(size: Column) -> Column:
        tests = rules(text, size)
        return reduce(lambda case, name: case.when(tests[name], F.lit(name)), order, F.when(text.isNull(), F.lit("blank")))

    # The lambda binds the sizes, so that they are computed once however often Catalyst moves the expression.
    return F.transform(F.array(sizes(text)), first)[0]


def judge(docs: DataFrame, text_col: str = "text", out: str = "keep") -> DataFrame:
    """docs and a boolean column ``out``: false for documents that a rule rejects."""
    order = cascade_order(RULES, *estimate(docs, text_col))
    return docs.withColumn(out, rejected_by(col(text_col), order).isNull())


def passing(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their columns."""
    order = cascade_order(RULES, *estimate(docs, text_col))
    return docs.where(rejected_by(col(text_col), order).isNull())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "keep")


def _sql_count(piece: str) -> str:
    return f"((length(text) - length(replace(text, {piece}, ''))) // length({piece}))"


_BLANKS = "(" + " + ".join(map(_sql_count, ("' '", "chr(10)"))) + ")"
_WORDS, _SOLID, _LINES = f"({_BLANKS} + 1)", f"(length(text) - {_BLANKS})", "string_split(text, chr(10))"
#: Whether any rule rejects the column ``text``, null for a null text.
SQL_REJECTS = f"""(
  {_SOLID} = 0
  OR {" + ".join(_sql_count(f"'{s}'") for s in SYMBOLS)} > {MAX_SYMBOL_WORDS} * {_WORDS}
  OR {_sql_count("'|'")} > {MAX_PIPES} * {_WORDS}
  OR {_sql_count("'!!'")} > {MAX_SHOUTS} * {_WORDS}
  OR ({_SOLID} >= 20 AND len(regexp_extract_all(text, '[A-Z]')) > {MAX_UPPER} * {_SOLID})
  OR ({_SOLID} >= 40 AND len(regexp_extract_all(text, '{NON_WORD}|[0-9]')) > {MAX_NON_WORD} * {_SOLID})
  OR ({_WORDS} >= 30 AND len(list_distinct(string_split(replace(text, chr(10), ' '), ' '))) < {MIN_VARIETY} * sqrt({_WORDS}))
  OR (len({_LINES}) >= 6 AND len({_LINES}) - len(list_distinct({_LINES})) > {MAX_REPEATED_LINES} * len({_LINES}))
  OR ({_SOLID} > 0 AND ({_SOLID} < {MEAN_WORD[0]} * {_WORDS} OR {_SOLID} > {MEAN_WORD[1]} * {_WORDS}))
  OR contains(lower(text), 'lorem ipsum'))"""
ORACLE_SQL = f"SELECT doc_id, NOT coalesce({SQL_REJECTS}, true) AS keep FROM documents"
