"""Prompts: retrieved knowledge per chunk, numbered code, message lists."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyspark.cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditmill import params as P
from auditmill.functions.text import number_lines
from auditmill.operators.blocks import in_shares, store_blocks

SHARE_ROWS = 4096   # chunks whose entries a task holds at a time
BLOCK_ROWS = 8192


def knowledge_entry(cwe_id: Column, source: Column, title: Column, text: Column, examples: Column,
                    limits: P.TextLimits = P.TextLimits()) -> Column:
    """`[id or SOURCE] title`, the start of the text and up to two examples."""
    label = F.when(F.coalesce(cwe_id, F.lit("")) != "", cwe_id).otherwise(F.upper(source))
    shown = F.transform(F.slice(examples, 1, limits.prompt_examples), lambda e: F.concat(F.lit("  - "), e))
    return F.concat(
        F.lit("["), label, F.lit("] "), title, F.lit("\n"), F.left(text, F.lit(limits.prompt_body)),
        F.when(F.size(shown) > 0, F.concat(F.lit("\nExamples:\n"), F.array_join(shown, "\n"))).otherwise(""),
    )


def knowledge_entries(knowledge: DataFrame, limits: P.TextLimits = P.TextLimits()) -> DataFrame:
    """(id, entry), made once per knowledge row and before it is copied to any hit. Of a doubled id the least entry counts."""
    made = knowledge.select("id", knowledge_entry(
        F.col("cwe_id"), F.col("source"), F.col("title"), F.col("document"), F.col("examples"), limits).alias("entry"))
    return made.groupBy("id").agg(F.min("entry").alias("entry"))


def knowledge_context(hits: DataFrame, knowledge: DataFrame, key: str = "chunk_id", limits: P.TextLimits = P.TextLimits()) -> DataFrame:
    """(key, context): the entries of each chunk in rank order, an empty line between them. `hits` has a row per hit."""
    lists = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("hits"))
    return attach_context(lists, knowledge, limits=limits).filter("context <> ''").select(key, "context")


def attach_context(chunks: DataFrame, knowledge: DataFrame, share_rows: int = SHARE_ROWS, block_rows: int = BLOCK_ROWS,
                   limits: P.TextLimits = P.TextLimits()) -> DataFrame:
    """Chunks with `hits`, a list that is in rank order, and now also `context`; empty for a chunk without hits.

    The entries are stored once and streamed past each share of chunks, which keeps those that it hits: chunks stay where
    they are, and how many entries there are does not matter."""
    blocks, _ = store_blocks(knowledge_entries(knowledge, limits), "id")

    def look_up(share: list[pa.Array]) -> pa.Array:
        lists = share[0]
        wanted, found = lists.flatten().unique(), {}
        if len(wanted):
            for table in blocks.read(["id", "entry"], block_rows):
                mine = table.filter(pa.compute.is_in(table["id"], value_set=wanted))
                found.update(zip(mine["id"].to_pylist(), mine["entry"].to_pylist()))
        return pa.array(["\n\n".join(found[i] for i in ids or () if found.get(i) is not None) for ids in lists.to_pylist()], pa.string())

    @F.arrow_udf("string")
    def contexts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return in_shares(((batch,) for batch in batches), share_rows, look_up)

    return chunks.withColumn("context", contexts(F.col("hits.id")))


def render(template: str, slots: dict[str, Column]) -> Column:
    """The template with its `{slot}`s filled. What is filled in is never searched again."""
    parts, at = [], 0
    while at < len(template):
        opens = [(template.find("{" + name + "}", at), name) for name in slots]
        opens = sorted((pos, name) for pos, name in opens if pos >= 0)
        if not opens:
            parts.append(F.lit(template[at:]))
            break
        pos, name = opens[0]
        parts += [F.lit(template[at:pos]), F.coalesce(slots[name].cast("string"), F.lit(""))]
        at = pos + len(name) + 2
    return F.concat(*parts)


def messages(system: str, user: Column) -> Column:
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", F.lit(system)), message("user", user))


def build_prompts(chunks: DataFrame, system: str = P.SYSTEM_PROMPT, template: str = P.USER_PROMPT) -> DataFrame:
    """Chunks with `context`, now with `messages` in place of it.

    The one-element explode keeps the messages a step of their own: merged with the call-outs
    before and after them, the optimizer would leave one of three nested calls without a plan."""
    user = render(template, {
        "knowledge": F.col("context"),
        "language": F.col("language"),
        "file_path": F.col("file_path"),
        "name": F.col("name"),
        "code": number_lines(F.col("code"), F.col("line_start")),
    })
    return chunks.select("*", F.explode(F.array(messages(system, user))).alias("messages")).drop("context")


pyspark.cloudpickle.register_pickle_by_value(sys.modules[__name__])
