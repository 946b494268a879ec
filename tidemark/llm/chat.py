"""Chat formatting: conversations to training text with the spans that count for the loss.

The template (``TEMPLATE``) marks every turn with control strings.  The same strings inside a text are
escaped so that no text can pose as a mark: a backslash is doubled, and a control string gets a backslash
after its first character; ``unescape`` takes both back.  A conversation is rendered in parts of ``PART``
turns by turn number, each part in one go from rows sorted by turn, so a conversation that holds a third
of all rows is spread like any other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tidemark.llm.templates import compile_template

PART = 256
CHUNK = 1_000_000
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[TURN ", "[/TURN]")
TEMPLATE = (
    "{% for message in messages %}"
    "{% if message.role == 'user' %}[INST] {{ message.text | escape }} [/INST]"
    "{% elif message.role == 'system' %}[SYS] {{ message.text | escape }} [/SYS]"
    "{% elif message.role == 'assistant' %}<s>{% generation %}{{ message.text | escape }}{% endgeneration %}</s>"
    "{% else %}[TURN {{ message.role | escape | close }}] {{ message.text | escape }} [/TURN]"
    "{% endif %}\n{% endfor %}"
)
_MARKED = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_TAKEN = re.compile(r"\\(.)", re.S)
_TURN = re.compile(
    r"\[INST\] (?P<user>.*?) \[/INST\]\n|\[SYS\] (?P<system>.*?) \[/SYS\]\n|<s>(?P<assistant>.*?)</s>\n"
    r"|\[TURN (?P<role>(?:\\.|[^\]\\])*)\] (?P<other>.*?) \[/TURN\]\n", re.S)


def escape(text: str) -> str:
    return _MARKED.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _TAKEN.sub(r"\1", text) if "\\" in text else text


_SPAN = StructType([StructField("begin", IntegerType()), StructField("end", IntegerType())])
_FORMATTED = [StructField("part", LongType()), StructField("chunk", IntegerType()), StructField("formatted", StringType()),
              StructField("spans", ArrayType(_SPAN))]
_DIGESTS = [StructField("n_turns", LongType()), StructField("turns_sha256", StringType()), StructField("loss_chars", LongType()),
            StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType())]

FILTERS = {"escape": escape, "close": lambda text: text.replace("]", "\\]")}


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", template: str = TEMPLATE) -> DataFrame:
    """Rendered conversations: (conv, ``part``, ``chunk``, ``formatted``, ``spans``), the spans in characters, end exclusive.

    The parts of a conversation in order of (``part``, ``chunk``) follow each other; a chunk ends at a turn
    once it has ``CHUNK`` characters.  Rows go by turn, equal turns by role and text; repeated rows are
    turns of their own.  Null roles and texts are empty, a null turn comes first, rows with a null
    conversation make one conversation.  An empty table gives an empty result; other columns are not
    looked at.
    """
    turns = rows.select(
        F.col(conv_col).alias("conv"), F.coalesce(F.floor(F.col(turn_col) / PART).cast("long"), F.lit(-(1 << 62))).alias("part"),
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = StructType([turns.schema["conv"], *_FORMATTED])
    arrow = to_arrow_schema(schema)
    dealt = turns.repartition("conv", "part").sortWithinPartitions("conv", "part", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, ready, size = compile_template(template, FILTERS), [], 0
        for row in _chunks(render, _turns(batches)):
            ready.append(row)
            size += len(row[3])
            if size > CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), arrow)], schema=arrow)
                ready, size = [], 0
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), arrow)], schema=arrow)

    return dealt.mapInArrow(run, schema).withColumnRenamed("conv", conv_col)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _chunks(render, turns: Iterator[tuple]) -> Iterator[tuple]:
    """Render sorted turns part by part; at most one chunk is held."""
    ahead = next(turns, None)
    while ahead is not None:
        place, ended = ahead[:2], False

        def messages():
            nonlocal ahead, ended
            while ahead is not None and ahead[:2] == place:
                message = {"turn": ahead[2], "role": ahead[3], "text": ahead[4]}
                yield message
                ended = True
                ahead = next(turns, None)

        texts, spans, size, chunk = [], [], 0, 0
        for text, generated in render(messages()):
            if ended and size > CHUNK:
                yield (*place, chunk, "".join(texts), spans)
                texts, spans, size, chunk = [], [], 0, chunk + 1
            ended = False
            if generated:
                spans.append({"begin": size, "end": size + len(text)})
            texts.append(text)
            size += len(text)
        for _ in messages():  # a template that does not read its messages to the end
            pass
        yield (*place, chunk, "".join(texts), spans)


def parse_formatted(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn in text made with ``TEMPLATE``."""
    at = 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn starts at character {at}")
        at = found.end()
        kind = found.lastgroup
        yield (unescape(found["role"]), unescape(found["other"])) if kind == "other" else (kind, unescape(found[kind]))


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Read formatted conversations back: one row of counts and digests per conversation.

    The digests run over a conversation in order, chunk after chunk; nothing but their state is held.
    """
    rows = formatted.select(F.col(conv_col).alias("conv"), "part", "chunk", "formatted", "spans")
    schema = StructType([rows.schema["conv"], *_DIGESTS])
    arrow = to_arrow_schema(schema)
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "part", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ready = None, []
        for batch in batches:
            for conv, text, spans in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4))):
                if now is None or now[0] != conv:
                    if now is not None:
                        ready.append(_closed(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse_formatted(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for span in spans:
                    said = unescape(text[span["begin"]:span["end"]])
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(text)
            if len(ready) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), arrow)], schema=arrow)
                ready = []
        if now is not None:
            ready.append(_closed(now))
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), arrow)], schema=arrow)

    return dealt.mapInArrow(run, schema).withColumnRenamed("conv", conv_col)


def _closed(state: list) -> tuple:
    conv, turns, said, chars, learnt, size = state
    return conv, turns, said.hexdigest(), chars, learnt.hexdigest(), size


def _length_sql(text: str) -> str:
    """Characters of an escaped text in DuckDB: one more for every backslash and control string."""
    return f"length({text}) + len(regexp_extract_all({text}, '\\\\|</?s>|\\[/?INST\\]|\\[/?SYS\\]|\\[TURN |\\[/TURN\\]'))"


ORACLE = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({_length_sql('text')} + 1 + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 7
    ELSE 16 + {_length_sql('role')} + length(role) - length(replace(role, ']', '')) END)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""
