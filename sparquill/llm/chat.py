"""Chat formatting that is proved by reparsing.

A conversation's turns are rendered, in the order of their numbers, as

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

A deterministic parser reads the rendering back. Turns whose recovered role or text differs, or
all of them if their number differs, are escaped one degree further and the conversation is
rendered again, until what the parser recovers is identical to the source. An escape puts a
backslash behind each < of a marker: ``<|im_end|>`` becomes ``<\\|im_end|>``, and the parser takes
one away, so that text with backslashes of its own is recovered too.

Defined results: a null text is an empty one, a null role is ``unknown``, line ends in roles are
blanks; turns without number come first; turns of one number are ordered by role, then text, and
equal rows all stay. A null conv_id is one conversation. Other columns are ignored.
"""
from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm.common import col
from sparquill.sources import table

START, END = "<|im_start|>", "<|im_end|>"
_MARK = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")


def escape(text: str) -> str:
    return _MARK.sub(r"<\1\\|\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text)


def render(turns: list[tuple[str, str]], escaped: list[bool]) -> str:
    return "".join(f"{START}{escape(r) if e else r}\n{escape(t) if e else t}{END}\n" for (r, t), e in zip(turns, escaped))


def parse(text: str) -> list[tuple[str, str]] | None:
    """The turns of a rendering; None if the text isn't one."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            return None
        head = text.find("\n", at)
        stop = text.find(END + "\n", head) if head >= 0 else -1
        if stop < 0:
            return None
        role, body = text[at + len(START) : head], text[head + 1 : stop]
        if START in body or END in body or START in role or END in role:
            return None
        turns.append((unescape(role), unescape(body)))
        at = stop + len(END) + 1
    return turns


def formatted(turns: list[tuple[str, str]]) -> tuple[str, int]:
    """The rendering that parses to exactly these turns, and how many of them are escaped in it."""
    escaped = [False] * len(turns)
    while True:
        text = render(turns, escaped)
        found = parse(text)
        if found == turns:
            return text, sum(escaped)
        if found is not None and len(found) == len(turns):
            wrong = [i for i, (a, b) in enumerate(zip(found, turns)) if a != b]
        else:
            wrong = [i for i, (r, t) in enumerate(turns) if _MARK.search(r) or _MARK.search(t)]
        if not any(not escaped[i] for i in wrong):
            raise ValueError("a conversation can't be rendered so that it parses back")
        for i in wrong:
            escaped[i] = True


def _format(conversations: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([formatted([(t["role"], t["text"]) for t in turns]) for turns in conversations], columns=["text", "n_escaped"])


def chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, text, n_turns, n_escaped) of every conversation."""
    role = F.translate(F.coalesce(col(role_col), F.lit("unknown")), "\r\n", "  ")
    turn = F.struct(col(turn_col).alias("turn"), role.alias("role"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    each = turns.select(col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    out = each.select("conv_id", F.size("turns").alias("n_turns"), F.pandas_udf(_format, "text string, n_escaped int")(F.transform("turns", lambda t: F.struct(t["role"], t["text"]))).alias("x"))
    return out.select("conv_id", "x.text", "n_turns", "x.n_escaped")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat(table(spark, sf_dir, "conversations"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, translate(coalesce(role, 'unknown'), chr(13) || chr(10), '  ') AS role, coalesce(text, '') AS text FROM conversations
), e AS (
  SELECT conv_id, turn, role, text,
         regexp_replace(role, '<(\\*)\|(im_start|im_end)\|>', '<\1\\|\2|>', 'g') AS erole,
         regexp_replace(text, '<(\\*)\|(im_start|im_end)\|>', '<\1\\|\2|>', 'g') AS etext FROM t
)
SELECT conv_id,
       string_agg('<|im_start|>' || erole || chr(10) || etext || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text,
       count(*)::INTEGER AS n_turns, count(*) FILTER (WHERE erole <> role OR etext <> text)::INTEGER AS n_escaped
FROM e GROUP BY conv_id
"""
