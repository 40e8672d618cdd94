r"""Chat formatting with Spark expressions only.

The rows of a conversation are collected as structs and sorted by turn (nulls
last, then role, then text), the places where the role changes cut the array into
blocks whose texts are aggregated, and each merged block is written as::

    ### Role: role
    first text</turn>
    second text</turn>

Inside texts and roles ``\``, ``<`` and ``#`` are written as ``\b``, ``\l`` and
``\h`` (and a newline in a role as ``\n``), so no control string can occur in
them and the texts can be read back exactly. The loss mask is the list of spans
of assistant texts: start and length, in code points of the formatted text.

Defined cases: null roles and texts count as empty; empty turns keep their
marks; repeated rows are turns of their own; rows with a null conv_id form one
conversation; other columns are not read. Each conversation becomes one string,
so it must fit in a row, as any formatted example must; rows are grouped by
conversation and nothing else is. The work in a conversation is in proportion to
its length: arrays are cut by places, and running sums are made by ``CHUNK`` values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storynet.llm.common import table

ROLE, TURN, CHUNK = "### Role: ", "</turn>\n", 512


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<"))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _merged(turns: Column) -> Column:
    """Sorted turns to blocks of (role, texts), one for each run of turns with one role."""
    n = F.size(turns)
    role = lambda i: F.element_at(turns, i)["role"]
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: F.when(i == 1, True).otherwise(role(i) != role(i - 1)))

    def blocks(at: Column) -> Column:
        def block(i: Column, k: Column) -> Column:
            after = F.coalesce(F.try_element_at(at, k + 2), n + 1)
            texts = F.transform(F.slice(turns, i, after - i), lambda t: t["text"])
            return F.struct(role(i).alias("role"), texts.alias("texts"))

        return F.transform(at, block)

    return _let(starts, blocks)


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted: rows of (conv_id, turn, role, text) to one text for each conversation."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turn = F.struct(
        F.col("turn").isNull().alias("last"), "turn", escape_role(role).alias("role"), escape(text).alias("text")
    )
    sorted_turns = F.array_sort(F.collect_list(turn))
    block = lambda b: F.concat(
        F.lit(ROLE), b["role"], F.lit("\n"), F.array_join(F.transform(b["texts"], lambda t: F.concat(t, F.lit(TURN))), "")
    )
    written = lambda t: F.array_join(F.transform(_merged(t), block), "")
    return turns.groupBy("conv_id").agg(sorted_turns.alias("turns")).select("conv_id", _let(F.col("turns"), written).alias("formatted"))


def read_turns(formatted: Column) -> Column:
    """The formatted text back to an array of (role, text, n): n is the length of the text as it stands there."""
    blocks = F.slice(F.split(formatted, ROLE, -1), 2, 2_000_000_000)

    def turns(block: Column) -> Column:
        def of_role(role: Column) -> Column:
            turn = lambda t: F.struct(
                unescape_role(role).alias("role"), unescape(t).alias("text"), F.length(t).cast("long").alias("n")
            )
            texts = F.split(F.substr(block, F.length(role) + 2), TURN, -1)
            return _let(texts, lambda x: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), turn))

        return _let(F.substring_index(block, "\n", 1), of_role)

    return F.flatten(F.transform(blocks, turns))


def _running(values: Column) -> Column:
    """The sum of all values before each one, and of all; by chunks, whose sums are summed in the same way."""
    zero = F.lit(0).cast("bigint")

    def sums(part: Column, start: Column) -> Column:
        return F.aggregate(part, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def by_chunk(chunks: Column) -> Column:
        starts = sums(F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, x: a + x)), zero)
        inner = lambda c, s: F.slice(sums(c, s), F.lit(1), F.size(c))
        return F.flatten(F.zip_with(chunks, F.slice(starts, F.lit(1), F.size(chunks)), inner))

    at = F.sequence(F.lit(0), F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / CHUNK).cast("int"))
    return _let(F.transform(at, lambda k: F.slice(values, k * CHUNK + 1, F.lit(CHUNK))), by_chunk)


def loss_spans(formatted: Column) -> Column:
    """Spans (start, length) of assistant texts in the formatted text, in order."""
    blocks = F.slice(F.split(formatted, ROLE, -1), 2, 2_000_000_000)

    def pieces(block: Column) -> Column:
        """Of each text: the length of what stands before it in its block, its own, and whether it counts."""

        def of_role(role: Column) -> Column:
            texts = F.split(F.substr(block, F.length(role) + 2), TURN, -1)
            header = (F.length(role) + len(ROLE) + 1).cast("bigint")
            piece = lambda t, k: F.struct(
                F.when(k == 0, header).otherwise(F.lit(0).cast("bigint")).alias("before"),
                F.length(t).cast("bigint").alias("length"),
                (role == "assistant").alias("counts"),
            )
            return _let(texts, lambda x: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), piece))

        return _let(F.substring_index(block, "\n", 1), of_role)

    def spans(all_pieces: Column) -> Column:
        before = _running(F.transform(all_pieces, lambda p: p["before"] + p["length"] + len(TURN)))
        span = lambda p, s: F.struct((s + p["before"]).alias("start"), p["length"].alias("length"), p["counts"].alias("counts"))
        counted = F.filter(F.zip_with(all_pieces, before, span), lambda x: x["counts"])
        return F.transform(counted, lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))

    return _let(F.flatten(F.transform(blocks, pieces)), spans)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    more = spark.sql("select -7L conv_id, stack(2, 0L, 'user', 1L, 'assistant') as (turn, role)").withColumn(
        "text", F.lit(hard)
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = format_chats(rows).withColumn("turns", read_turns(F.col("formatted")))
    out = out.withColumn("mask", loss_spans(F.col("formatted")))
    whole = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    loss = F.array_join(
        F.transform(
            "mask",
            lambda m: unescape(F.substr(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int"))),
        ),
        "",
    )
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = "replace(replace(replace({}, '\\', '\\b'), '<', '\\l'), '#', '\\h')"
SQL = rf"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, replace({_ESC.format("role")}, chr(10), '\n') as er, {_ESC.format("text")} as et from r),
o as (select *, coalesce(lag(er) over (partition by conv_id order by turn nulls last, er, et) = er, false) as same from e)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, er, et)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls last, er, et) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(et) + {len(TURN)} + case when same then 0 else {len(ROLE)} + length(er) + 1 end) as bigint) as formatted_chars
from o group by conv_id
"""
