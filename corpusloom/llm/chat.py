"""Chat formatting by compiled templates, with a reader that gets turns and loss mask back out of the formatted text.

Control strings inside roles and texts are escaped: a backslash is doubled, and a control string gets a backslash after its first character.
A turn is `<s>[INST]role[/INST]text</s>`; texts of the assistant's turns are the generation block.

Rows are dealt by conv_id and sorted by turn; a conversation streams through the template and the reader, which sees formatted text and the loss mask
and nothing else, a turn at a time, so that its length costs no memory in the query (`format_conversations`, which returns the text as one string, holds
that string). One conversation is one task's: its digests run over its turns in order.

Edge cases: null roles and texts are empty; null turns come first, equal turns go by role and text; repeated rows are turns of their own; a null
conv_id is a conversation of its own; an empty table still has conversation -1 in the query, which stays apart from a conversation -1 of the table;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table
from corpusloom.llm.templates import Template, messages

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
SOURCE = (
    '{% for m in messages %}{{ "<s>" + "[INST]" }}{{ m.role | escape }}{{ "[/INST]" }}'
    '{% if m.role == "assistant" %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}{{ "</s>" }}{% endfor %}'
)
_LAST = "</s>"
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(\\?)")
#: What a turn of a user and of the assistant say in the conversation that the query adds.
PROBE = "</s>[INST] ok [/INST]"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str | None) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], (text or "").replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def template(source: str = SOURCE) -> Template:
    return Template(source, {"escape": escape})


class Reader:
    """Reads formatted text as it comes, in pieces of any size, with its loss mask, and digests the turns that it finds."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self._held: list[tuple[str, bool]] = []
        self._tail = ""

    def feed(self, text: str, masked: bool) -> None:
        self.formatted_chars += len(text)
        self._held.append((text, masked))
        seen = self._tail + text
        self._tail = seen[-(len(_LAST) - 1) :]
        while _LAST in seen:  # an end mark inside a text would be escaped
            whole = "".join(t for t, _ in self._held)
            end = whole.index(_LAST) + len(_LAST)
            now, rest, at = [], [], 0
            for t, m in self._held:
                cut = min(max(end - at, 0), len(t))
                now.append((t[:cut], m))
                rest.append((t[cut:], m))
                at += len(t)
            self._turn(whole[:end], now)
            self._held = [r for r in rest if r[0]]
            seen = whole[end:]
            self._tail = seen[-(len(_LAST) - 1) :]

    def _turn(self, whole: str, pieces: list[tuple[str, bool]]) -> None:
        m = re.fullmatch(r"<s>\[INST\](.*?)\[/INST\](.*)</s>", whole, re.S)
        if not m or _CONTROL.search(m[1]) or _CONTROL.search(m[2]):
            raise ValueError("this is no formatted turn")
        self.turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
        loss = unescape("".join(t for t, masked in pieces if masked))
        self.loss.update(loss.encode("utf-8", "surrogatepass"))
        self.loss_chars += len(loss)
        self.n_turns += 1


def _by_conversation(batches: Iterable) -> Iterator[tuple[int | None, Iterator[tuple[str, str]]]]:
    """(conv_id, its rows) of batches that are sorted by conv_id, origin and turn; the rows are read as they are asked for."""
    rows = (row for b in batches for lo in range(0, b.num_rows, 500) for row in zip(*(c.to_pylist() for c in b.slice(lo, 500).columns), strict=True))
    row = next(rows, None)
    while row is not None:
        conv, origin = row[:2]

        def of(key: tuple = (conv, origin)) -> Iterator[tuple[str, str]]:
            nonlocal row
            while row is not None and row[:2] == key:
                yield row[2] or "", row[3] or ""
                row = next(rows, None)

        turns = of()
        yield conv, turns
        for _ in turns:
            pass


def _dealt(conversations: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """conv_id, origin (1 for the rows of `more`), role, text in the order of turns."""
    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.col("turn").cast("long").alias("turn")]
    rows = conversations.select(*columns, F.lit(0).alias("origin"))
    rows = rows if more is None else rows.unionByName(more.select(*columns, F.lit(1).alias("origin")))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "origin", "turn", "role", "text").select("conv_id", "origin", "role", "text")


def format_conversations(conversations: DataFrame, source: str = SOURCE) -> DataFrame:
    """conv_id, formatted text and loss spans (code points, [start, end))."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        made = template(source)
        for conv, turns in _by_conversation(batches):
            text, spans = made.render(messages=messages(turns))
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "text": text, "loss": [{"start": a, "end": b} for a, b in spans]}], schema=schema)

    import pyarrow as pa

    schema = pa.schema([("conv_id", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    return _dealt(conversations).mapInArrow(run, "conv_id long, text string, loss array<struct<start: long, end: long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: digests of what is read back from the formatted conversations."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        made, out = template(), []
        for conv, turns in _by_conversation(batches):
            reader = Reader()
            made.stream(reader.feed, messages=messages(turns))
            out.append((conv, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.formatted_chars))
            if len(out) == 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (2, 4) else pa.int64()) for k, c in enumerate(zip(*out, strict=True))], names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return _dealt(table(spark, sf_dir, "conversations"), probe).mapInArrow(run, DIGESTS)


ORACLE_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '(<)(s>)|(<)(/s>)|(\[)(INST\])|(\[)(/INST\])', '\1\3\5\7\\\2\4\6\8', 'g') AS e_text,
    regexp_replace(replace(role, '\', '\\'), '(<)(s>)|(<)(/s>)|(\[)(INST\])|(\[)(/INST\])', '\1\3\5\7\\\2\4\6\8', 'g') AS e_role
  FROM rows_
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(e_text) + length(e_role) + 20) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
