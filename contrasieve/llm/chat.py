"""Conversations as training windows of a token budget.

Prefix sums of turn tokens choose the windows: each runs to the last turn whose sum still lies within the budget, counted
from the first turn it shows. Every window starts with the system turn and with a limited history of the turns before it; both are masked,
so each assistant text is a target exactly once. All of this is DataFrame work; only token counts and the digests
of the check that reads windows back are Python.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts ``&`` becomes ``&amp;`` and ``<|`` becomes
``&lt;|`` (and in roles a line feed ``&#10;``), so no text can hold a mark, and the way back is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrasieve.llm._scan import slices
from contrasieve.llm._tokens import Encoder
from contrasieve.session import cut_lineage

START, END = "<|im_start|>", "<|im_end|>\n"
MAX_TOKENS, HISTORY_TURNS, HISTORY_TOKENS = 1024, 2, 128
#: Turns are counted in blocks, so a very long conversation is not one task's sum.
BLOCK = 256
#: Windows end at every multiple of this many turns, so a very long conversation is not one task's walk either.
SECTION = 4096


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: str) -> str:
    return text.replace("&#10;", "\n").replace("&lt;|", "<|").replace("&amp;", "&")


def shown_parts(role: Column, text: Column) -> tuple[Column, Column]:
    """The marked head of a turn and its escaped text; the closing mark follows."""
    return F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit("&#10;")), F.lit("\n")), escape(text)


def count_tokens(turns: DataFrame, text_col: str, path: str) -> DataFrame:
    """``turns`` with a column tokens in place of the text that is counted."""
    names = [c for c in turns.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for part in slices(batch, text_col):
                _, ends = encoder.column(part[text_col])
                yield pa.RecordBatch.from_arrays([*(part[c] for c in names), pa.array(np.diff(ends).astype(np.int64))], [*names, "tokens"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in turns.schema if f.name != text_col), "tokens bigint"])
    return turns.mapInArrow(run, schema)


def _with_sums(turns: DataFrame) -> DataFrame:
    """rank (from 0) and begin (tokens before) of every turn of its conversation."""
    turns = turns.withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))
    inside = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumns({"rank": F.row_number().over(inside) - 1, "begin": F.coalesce(F.sum("tokens").over(upto), F.lit(0))})
    blocks = turns.groupBy("conv", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("all"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("all").over(before), F.lit(0)).alias("t0"))
    # the keys are never null here (see ``windows``)
    turns = turns.join(blocks, ["conv", "block"])
    return turns.select("conv", "role", "text", "tokens", (F.col("rank") + F.col("n0")).alias("rank"), (F.col("begin") + F.col("t0")).alias("begin"))


def _spans(line: DataFrame, max_tokens: int, history_turns: int, history_tokens: int) -> DataFrame:
    """(conv, w, start, stop, hist): turns start..stop are new in window w, the hist turns before are repeated.

    ``line`` holds conv, rank, begin, tokens and the tokens of the system turn. A history that would push the first new
    turn over the budget is shortened. Sections take the last turns of the one before along as history.
    """
    line = line.withColumn("section", F.floor(F.col("rank") / SECTION))
    lead = line.where(F.col("rank") % SECTION >= SECTION - history_turns).withColumn("section", F.col("section") + 1)
    walks = line.unionByName(lead).groupBy("conv", "section").agg(
        F.sort_array(F.collect_list(F.struct("rank", "begin", "tokens"))).alias("p"), F.max("system").alias("system")
    )
    first = F.col("section") * SECTION

    def jump(x: Column, i: Column) -> Column:
        """How far a window reaches that starts at this turn."""
        room = F.least(F.lit(history_tokens), F.lit(max_tokens) - F.col("system") - x["tokens"])
        fits = [F.when(x["begin"] - F.get("p", i - j)["begin"] <= room, j) for j in range(history_turns, 0, -1)]
        hist = F.coalesce(*fits, F.lit(0))
        reach = F.get("p", i - hist)["begin"] + max_tokens - F.col("system")
        return F.struct(x["rank"].alias("rank"), (x["begin"] + x["tokens"]).alias("end"), reach.alias("reach"), hist.alias("hist"))

    def step(acc: Column, x: Column) -> Column:
        opened = F.struct(x["reach"].alias("reach"), F.concat(acc["starts"], F.array(F.struct(x["rank"].alias("start"), x["hist"].alias("hist")))).alias("starts"))
        return F.when(x["end"] > acc["reach"], opened).otherwise(acc)

    none = F.array().cast("array<struct<start:bigint,hist:int>>")
    zero = F.struct(F.lit(-1).cast("bigint").alias("reach"), none.alias("starts"))
    walks = walks.select("conv", "section", F.element_at("p", -1)["rank"].alias("top"), F.transform("p", jump).alias("q"))
    walks = walks.select("conv", "top", F.aggregate(F.filter("q", lambda x: x["rank"] >= first), zero, step)["starts"].alias("starts"))
    made = walks.select("conv", "top", "starts", F.posexplode("starts").alias("at", "s"))
    stop = F.coalesce(F.get("starts", F.col("at") + 1)["start"] - 1, F.col("top"))
    return made.select("conv", F.col("s.start").alias("w"), "s.start", stop.alias("stop"), "s.hist")


def windows(
    conversations: DataFrame, path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    max_tokens: int = MAX_TOKENS, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS,
) -> DataFrame:
    """Rows conv (key), conv_id, window (rising), repeated (turns at its start that repeat), loss (spans of code points), text.

    Turns stand by turn number (null first), then role and text; repeated rows are turns of their own. Null text
    and null role are empty; rows of a null conversation are one conversation. A system turn counts as such only if it
    comes first. Tokens are those of the turn as it is written, escaped and with its marks. A window exceeds the budget only
    where one turn does not fit beside the system turn, since no turn is cut; it then holds these two alone. Empty
    tables give no rows. Other columns are ignored.
    """
    id_type = conversations.schema[conv_col].dataType
    turns = conversations.select(
        F.to_json(F.array(F.col(conv_col).cast("string"))).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    turns = turns.withColumn("whole", F.concat(*shown_parts(F.col("role"), F.col("text")), F.lit(END)))
    placed = cut_lineage(_with_sums(count_tokens(turns, "whole", path)))
    system = placed.where("rank = 0 AND role = 'system'").select("conv", F.col("tokens").alias("system"), F.struct("role", "text").alias("first"))
    line = placed.select("conv", "rank", "begin", "tokens").join(system.select("conv", "system"), "conv", "left").where("system IS NULL OR rank > 0")
    spans = cut_lineage(_spans(line.withColumn("system", F.coalesce("system", F.lit(0))), max_tokens, history_turns, history_tokens))
    members = spans.select("conv", "w", "start", F.explode(F.sequence(F.col("start") - F.col("hist"), "stop")).alias("rank"))
    body = members.join(placed.select("conv", "rank", "role", "text"), ["conv", "rank"])
    again = spans.select("conv", "w").join(system, "conv", "right")  # a conversation of a system turn alone still has a window
    again = again.select("conv", F.coalesce("w", F.lit(1)).alias("w"), F.lit(0).cast("bigint").alias("rank"), "first.role", "first.text", (F.coalesce("w", F.lit(1)) == 1).alias("fresh"))
    pieces = body.withColumn("fresh", F.col("rank") >= F.col("start")).drop("start").unionByName(again)

    head, inner = shown_parts(F.col("role"), F.col("text"))
    shown = pieces.select(
        "conv", "w", "rank", "fresh", F.concat(head, inner, F.lit(END)).alias("shown"),
        F.length(head).alias("head"), F.length(inner).alias("inner"), (F.col("fresh") & (F.col("role") == "assistant")).alias("target"),
    )
    rows = shown.groupBy("conv", "w").agg(F.sort_array(F.collect_list(F.struct("rank", "fresh", "shown", "head", "inner", "target"))).alias("p"))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("loss"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["head"]
        span_ = F.array(F.struct(begin.alias("begin"), (begin + x["inner"]).alias("end")))
        return F.struct((begin + x["inner"] + len(END)).alias("at"), F.when(x["target"], F.concat(acc["loss"], span_)).otherwise(acc["loss"]).alias("loss"))

    return rows.select(
        "conv", F.get(F.from_json("conv", "array<string>"), F.lit(0)).cast(id_type).alias("conv_id"), F.col("w").alias("window"),
        F.size(F.filter("p", lambda x: ~x["fresh"])).alias("repeated"), F.aggregate("p", zero, step)["loss"].alias("loss"),
        F.array_join(F.transform("p", lambda x: x["shown"]), "").alias("text"),
    )


class _Digest:
    """Running digests of one conversation, window by window."""

    def __init__(self, conv, conv_id):
        self.conv, self.conv_id = conv, conv_id
        self.turns, self.loss_chars, self.chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, repeated: int, loss: list[dict]) -> None:
        self.chars += len(text)
        for shown in text.split(END)[:-1][repeated:]:
            role, _, body = shown.removeprefix(START).partition("\n")
            self.all.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
            self.turns += 1
        for s in loss:
            target = unescape(text[s["begin"] : s["end"]])
            self.loss_chars += len(target)
            self.loss.update(target.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(written: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    id_type = written.schema["conv_id"].dataType.simpleString()
    kind = written.select("conv_id").limit(0).toArrow().schema.field(0).type
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if now is None or now.conv != row["conv"]:
                        if now:
                            done.append(now.row())
                        now = _Digest(row["conv"], row["conv_id"])
                    now.add(row["text"], row["repeated"], row["loss"])
                if len(done) >= 4096:
                    yield out(done)
                    done = []
        if now:
            yield out([*done, now.row()])

    parts = int(written.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written.repartition(parts, "conv").sortWithinPartitions("conv", "window")
    return dealt.mapInArrow(run, f"conv_id {id_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
