"""Chat formatting in budgeted windows.

Turns of a conversation are cut into windows of whole turns by the running sum of their tokens, those of the formatted turn with its
marks and escapes.  A window takes turns as long as they fit.  Every later window starts with the conversation's system turn and
repeats a little of the history before it, as far as the budget allows; repeated turns are masked, so each assistant text is
under the loss in exactly one window.  A window holds at most ``budget`` tokens, but where its first new turn, with the system turn,
is longer alone: texts are never cut, and the system turn always stays.

Sums and windows are computed in blocks of rows dealt out by range, so one conversation with a third of all rows fills many blocks
and its windows are formatted by many tasks; a window ends with its block.  A window is the largest thing any task holds.

In the text a turn is ``<s> role [INST] text [/INST] </s>`` and a line end.  Control strings inside roles and texts get one
more backslash in front, which reading takes away again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.packing import TOKENIZER, encoder, tokenizer_path
from panelforge.llm.text import filled, slices
from panelforge.session import cut_lineage

_CONTROL = r"(<s>|</s>|\[INST\]|\[/INST\])"
_ESCAPE = re.compile(r"(\\*)" + _CONTROL)
_ESCAPED = re.compile(r"\\(\\*)" + _CONTROL)
_TURN = re.compile(r"<s> (.*?) \[INST\] (.*?) \[/INST\] </s>\n", re.S)


def escape(text: str) -> str:
    """One backslash more before every control string."""
    return _ESCAPE.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    return f"<s> {escape(role)} [INST] ", escape(text), " [/INST] </s>\n"


def format_window(turns: list[dict]) -> tuple[str, list[dict], int]:
    """Text, loss spans (code points, of the escaped texts of new assistant turns), and how many turns are repeated."""
    parts, spans, at = [], [], 0
    for turn in turns:
        head, body, tail = format_turn(turn["role"], turn["text"])
        if turn["new"] and turn["role"] == "assistant":
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        parts += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(parts), spans, sum(not t["new"] for t in turns)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn in a window: the inverse of the formatting."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def _tokens(tokenizer: str):
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path(tokenizer))
        for part in slices(batches, "text"):
            turns = zip(part.column("role").to_pylist(), part.column("text").to_pylist())
            # Turns end with a line end and the vocabulary never joins across one, so a window has the sum of its turns' tokens.
            counts = [len(words.encode("".join(format_turn(role, text)))) // 4 for role, text in turns]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts, pa.int64())], [*part.schema.names, "tokens"])

    return tokens


def placed_turns(turns: DataFrame, tokenizer: str) -> DataFrame:
    """Turns with ``tokens``, ``block`` and ``seq``, written once; ``seq`` grows with conversation and turn.

    Ties in the turn number go by role, then by hash of the text; null turn numbers come first, null roles are empty.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        filled("role").alias("role"),
        filled("text").alias("text"),
    )
    rows = rows.withColumn("tie", F.xxhash64("text"))
    keys = ["conv_id", "turn", "role", "tie"]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    counted = dealt.mapInArrow(_tokens(tokenizer), "conv_id long, turn long, role string, text string, tie long, tokens long")
    return cut_lineage(counted.withColumns({"block": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}))


def _greedy(budget: int, reserve: int):
    """Turns come sorted by conversation, block and place; each gets the place of the first new turn of its window."""

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, start, held = None, 0, 0
        for batch in batches:
            opened = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "block", "pos", "tokens", "system"))
            for conv, number, pos, tokens, system in zip(*columns):
                room = budget if start == 0 else budget - system - reserve
                if (conv, number) != block or held + tokens > room:
                    block, start, held = (conv, number), pos, 0
                held += tokens
                opened.append(start)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(opened, pa.int64())], [*batch.schema.names, "window"])

    return greedy


def choose_windows(placed: DataFrame, budget: int, history: int, history_tokens: int) -> DataFrame:
    """Members of all windows: ``conv_id``, ``window``, ``pos``, ``seq``, ``new``; only numbers are moved here."""
    narrow = placed.select("conv_id", "block", "seq", "role", "tokens")
    blocks = narrow.groupBy("conv_id", "block").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.min_by(F.struct("role", "tokens"), "seq").alias("first")
    )
    by_block = Window.partitionBy("conv_id").orderBy("block")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("first").over(by_block)
    starts = blocks.select(
        F.col("conv_id").alias("c"),
        F.col("block").alias("b"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("pos0"),
        F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("before0"),
        F.when(first["role"] == "system", first["tokens"]).otherwise(F.lit(0)).alias("system"),
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("seq")
    summed = narrow.withColumns(
        {
            "rank": F.row_number().over(inside) - 1,
            "prefix": F.coalesce(F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    known = summed.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    known = known.select(
        "conv_id", "block", (F.col("pos0") + F.col("rank")).alias("pos"), "seq", "tokens", "system", (F.col("before0") + F.col("prefix")).alias("before")
    )
    ordered = known.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos")
    members = "conv_id long, block int, pos long, seq long, tokens long, system long, before long, window long"
    known = cut_lineage(ordered.mapInArrow(_greedy(budget, history_tokens if history else 0), members))
    new = known.select("conv_id", "window", "pos", "seq", F.lit(True).alias("new"))
    spans = known.groupBy("conv_id", "window").agg(
        F.min("pos").alias("start"), F.min("before").alias("at"), F.max("system").alias("system"), F.sum("tokens").alias("size")
    )
    # What the window's own turns and the system turn leave of the budget.
    spans = spans.withColumn("spare", F.least(F.lit(history_tokens), F.lit(budget) - F.col("system") - F.col("size")))
    later = spans.filter("start > 0")
    has_system = F.col("system") > 0
    back = later.withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(max(1, history))))).withColumn("p", F.col("start") - F.col("p"))
    back = back.filter((F.col("p") > 0) | (F.col("p") == 0) & ~has_system) if history else back.filter("false")
    first_turn = later.filter(has_system).withColumn("p", F.lit(0).cast("long"))
    wanted = back.unionByName(first_turn).select(F.col("conv_id").alias("c"), F.col("window").alias("w"), "at", "spare", "p", (has_system & (F.col("p") == 0)).alias("lead"))
    past = wanted.join(known, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("p") == F.col("pos")))
    past = past.filter(F.col("lead") | (F.col("at") - F.col("before") <= F.col("spare")))
    return new.unionByName(past.select("conv_id", F.col("w").alias("window"), "pos", "seq", F.lit(False).alias("new")))


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            made = [format_window(turns) for turns in part.column("turns").to_pylist()]
            texts, losses, repeated = zip(*made)
            yield pa.RecordBatch.from_arrays(
                [part.column("conv_id"), part.column("window"), pa.array(texts), pa.array(losses, spans), pa.array(repeated, pa.int32())],
                ["conv_id", "window", "formatted", "loss", "repeated"],
            )


def format_chats(
    turns: DataFrame, budget: int = 2048, history: int = 2, history_tokens: int = 256, tokenizer: str = TOKENIZER
) -> DataFrame:
    """One row per window: ``conv_id``, ``window`` (rises along the conversation), ``formatted``, ``loss``, ``repeated``.

    ``loss`` holds the code-point spans to train on; the first ``repeated`` turns are the system turn and history shown again.
    Null texts and roles are empty; rows without a conv_id are one conversation; an empty table gives no rows; other
    columns are not read.
    """
    placed = placed_turns(turns, tokenizer)
    members = choose_windows(placed, budget, history, history_tokens)
    whole = members.join(placed.select("seq", "role", "text"), "seq")
    grouped = whole.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("pos", "new", "role", "text"))).alias("turns")
    )
    return grouped.mapInArrow(
        _format, "conv_id long, window long, formatted string, loss array<struct<start:long,end:long>>, repeated int"
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows come sorted by conversation; what is kept of a conversation is two running hashes and three counts."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    current, open_, done = None, None, []

    def close() -> None:
        if open_:
            done.append((current, open_[0], open_[1].hexdigest(), open_[2], open_[3].hexdigest(), open_[4]))

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for row in batch.slice(at, 64).to_pylist():
                if open_ is None or row["conv_id"] != current:
                    close()
                    current, open_ = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = row["formatted"]
                for role, said in read_turns(text)[row["repeated"] :]:
                    open_[0] += 1
                    open_[1].update(f"{role}\n{said}\n".encode())
                for span in row["loss"]:
                    said = unescape(text[span["start"] : span["end"]])
                    open_[2] += len(said)
                    open_[3].update(said.encode())
                open_[4] += len(text)
            if len(done) >= 1000:
                yield rows()
                done.clear()
    close()
    if done:
        yield rows()


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows say when read back; a conversation is one running hash, whatever its length."""
    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(
        _digest,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
