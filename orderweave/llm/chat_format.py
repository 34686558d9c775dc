"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only that reply may be
trained on. A turn is written ``<s>[INST]role[/INST]text</s>``; any control string or backslash inside a role or
a text gets a backslash before it, so the template can always be read back. What follows the last reply (or a
conversation without one) is closed by one more example that has nothing to train on, so no turn is lost.

A conversation's turns meet in one task, sorted there by Spark (which spills), and are read as a stream: the
task holds the longest prefix and one example at a time. Many conversations spread by the hash of their key; one
conversation is one sequence by nature.

Defined results: a null text or role is empty; turns of the same number are ordered by role, then text; turns
without a number come first; repeated rows are turns of their own; rows without a conversation key form one
conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderweave.llm.common import table

# The control strings of the template.
TURN, HEAD, BODY, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = re.compile(r"\\|</?s>|\[/?INST\]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: A whole turn: anything escaped, or any character that begins no control string.
_PLAIN = r"((?:[^\\<\[]++|\\.|(?!</?s>|\[/?INST\])[<\[])*+)"
_TURN = re.compile(rf"<s>\[INST\]{_PLAIN}\[/INST\]{_PLAIN}</s>", re.DOTALL)

EXAMPLES = "conv_id long, example long, n_turns long, formatted string, loss_start long, loss_end long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> str:
    return f"{TURN}{HEAD}{escape(role)}{BODY}{escape(text)}{END}"


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) turns of a formatted string; anything else in it is an error."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        yield unescape(m[1]), unescape(m[2])
        at = m.end()


def expand(turns: Iterator[tuple[str, str]]) -> Iterator[tuple[int, str, int, int]]:
    """(turns so far, formatted, start and end of what may be trained on) for each example of one conversation."""
    prefix, n, closed = "", 0, True
    for role, text in turns:
        n, closed = n + 1, False
        turn = format_turn(role, text)
        if role == "assistant":
            start = len(prefix) + len(turn) - len(END) - len(escape(text))
            yield n, prefix + turn, start, len(prefix) + len(turn) - len(END)
            closed = True
        prefix += turn
    if not closed:
        yield n, prefix, len(prefix), len(prefix)


def read_back(examples: Iterator[tuple[int, str, int, int]]) -> tuple[int, str, int, str, int, int]:
    """What the formatted examples of one conversation say of it; the last one has all turns."""
    loss, loss_chars, total, count, last = hashlib.sha256(), 0, 0, 0, ""
    for _, formatted, start, end in examples:
        text = unescape(formatted[start:end])
        loss.update(text.encode("utf-8", "surrogatepass"))
        loss_chars, total, count, last = loss_chars + len(text), total + len(formatted), count + 1, formatted
    turns, n = hashlib.sha256(), 0
    for role, text in parse(last):
        turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        n += 1
    return n, turns.hexdigest(), loss_chars, loss.hexdigest(), total, count


class _Turns:
    """The rows of sorted batches, conversation by conversation."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
        self.head = next(self.rows, None)

    def conversation(self, key: int | None) -> Iterator[tuple[str, str]]:
        while self.head is not None and self.head[0] == key:
            yield self.head[1] or "", self.head[2] or ""
            self.head = next(self.rows, None)


def _grouped(conversations: DataFrame) -> DataFrame:
    chosen = conversations.select("conv_id", "turn", "role", "text")
    return chosen.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "role", "text")


def chat_examples(conversations: DataFrame) -> DataFrame:
    """All examples: the formatted text, and between which code points it may be trained on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = _Turns(batches)
        schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
        while turns.head is not None:
            key = turns.head[0]
            for k, example in enumerate(expand(turns.conversation(key))):
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (key, k, *example), strict=True))], schema)

    return _grouped(conversations).mapInArrow(run, EXAMPLES)


def chat_digests(conversations: DataFrame) -> DataFrame:
    """For each conversation what its examples say when they are read back; an example lives only as long as it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, out = _Turns(batches), []
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
        schema = pa.schema([(x, pa.string() if "sha" in x else pa.int64()) for x in names])
        while turns.head is not None:
            key = turns.head[0]
            out.append((key, *read_back(expand(turns.conversation(key)))))
            if len(out) >= 1000 or turns.head is None:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []

    return _grouped(conversations).mapInArrow(run, DIGESTS)


# The conversation that the contract adds.
EXTRA = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that is made of control strings, formatted and read back."""
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    return chat_digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))


_E = "replace(replace(replace(replace(replace({}, '\\', '\\\\'), '<s>', '\\<s>'), '</s>', '\\</s>'), '[INST]', '\\[INST]'), '[/INST]', '\\[/INST]')"
OP4_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, 20 + length({_E.format("role")}) + length({_E.format("text")}) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM c),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto, max(k) OVER (PARTITION BY conv_id) AS last FROM n)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(upto) FILTER (role = 'assistant' OR k = last), 0)::BIGINT AS formatted_chars,
  (count(*) FILTER (role = 'assistant' OR k = last))::BIGINT AS n_examples
FROM p GROUP BY conv_id
"""
