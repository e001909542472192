"""Conversations as formatted windows of at most a budget of tokens.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``; control strings inside role
or text are escaped, so they can be read back. Prefix sums of the turns' tokens choose
spans of whole turns: a window holds the conversation's system turn (its first turn, if
the role says so), a limited history of the turns before it, and new turns as long as
the budget lasts. The loss mask covers the texts of new assistant turns alone: a
repeated turn, system or history, is context and no target.

A conversation can be any size, so it is never one group. Turns are dealt by ranges of
(conversation, turn); a task adds up tokens and turns along its range, and one row a
(conversation, range) carries the sums on. The sums put turns into blocks of
``BLOCK_BUDGETS`` budgets; a block is windowed by one task, with the turns just before
it as history and a copy of the system turn, and holds no more than that and one turn.

Cases: null role and text are empty; rows of one turn number are ordered by role and a
hash of their text, equal rows are turns each; a null id is a conversation of its own;
a turn longer than the budget gets a window without history that is over the budget,
it is never cut; a later system turn is a turn like others; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrylake.llm.align import ByteLevel
from ferrylake.llm.common import checkpointed, pick, ship_package, written
from ferrylake.llm.packing import text_runs

BUDGET = 2048
HISTORY = 512               # most tokens of repeated turns, the system turn not counted
BLOCK_BUDGETS = 64          # budgets of new turns in a block
SYSTEM, TARGET = "system", "assistant"

START, END = "<|im_start|>", "<|im_end|>"

_TURNS = ("conv string, pos long, role string, text string, tokens long, before long, "
          "part int")
_WINDOWS = ("conv string, first long, n_turns int, n_repeated int, n_tokens long, "
            "formatted string, loss array<struct<start: int, stop: int>>")


# --- the template ------------------------------------------------------------

_OPENS = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_BLOCK = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """No ``<|`` is left: one more backslash before every bar behind ``<`` and its
    backslashes."""
    return _OPENS.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Also without a line break."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(text: str) -> str:
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", unescape(text))


def format_turn(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a window."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _BLOCK.finditer(formatted)]


# --- tokens and places -------------------------------------------------------

_VOCABULARIES: dict[str, ByteLevel] = {}


def turn_tokens(path: str, role: str, text: str) -> int:
    """Tokens of a formatted turn: its two control strings are one each, the rest is
    encoded by the byte-level vocabulary at ``path``."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = ByteLevel(path)
    encode = _VOCABULARIES[path].encoding.encode_ordinary
    return 3 + len(encode(f"{escape_role(role)}\n{escape(text)}"))


def placed(turns: DataFrame, tokenizer_path: str, conv: str = "conv_id", turn: str = "turn",
           role: str = "role", text: str = "text") -> DataFrame:
    """Turns with their number in the conversation (``pos``, from 0), their tokens in
    the template and the tokens before them."""
    ship_package(turns.sparkSession)
    t = pick(turns, conv=conv, turn=turn, role=role, text=text).select(
        F.when(F.col("conv").isNull(), "").otherwise(
            F.concat(F.lit("="), F.col("conv").cast("string"))).alias("conv"), "turn",
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    order = ["conv", "turn", "role", "tie"]
    t = t.withColumn("tie", F.xxhash64("text"))
    # equal rows end in the same range otherwise, however many they are
    t = t.withColumn("salt", F.monotonically_increasing_id())
    t = t.repartitionByRange(*order, "salt").sortWithinPartitions(*order).select(
        "conv", "role", "text", F.spark_partition_id().alias("part"))

    def along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, pos, before = None, 0, 0
        for b in batches:
            for first, texts in text_runs(b["text"]):
                run = b.iloc[first:first + len(texts)]
                conv = run["conv"].to_numpy()
                n = np.array([turn_tokens(tokenizer_path, r, t)
                              for r, t in zip(run["role"], texts)], np.int64)
                new = np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]])
                at = np.maximum.accumulate(np.where(new, np.arange(len(n)), -1))
                sums = np.concatenate([[0], np.cumsum(n)])
                went = at < 0                       # the last run's conversation goes on
                start = np.maximum(at, 0)
                run = run.assign(tokens=n, pos=np.arange(len(n)) - start + went * pos,
                                 before=sums[:-1] - sums[start] + went * before)
                last, pos = conv[-1], int(run["pos"].iat[-1]) + 1
                before = int(run["before"].iat[-1] + n[-1])
                yield run[[c.split(" ")[0] for c in _TURNS.split(", ")]]

    local = written(t.mapInPandas(along, _TURNS), "turns")
    ends = local.groupBy("conv", "part").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = ends.select("conv", "part", F.sum("n").over(earlier).alias("n0"),
                          F.sum("t").over(earlier).alias("t0")).filter("n0 is not null")
    # one row a range at most: only its first conversation can go on from the one before
    d = local.join(F.broadcast(checkpointed(offsets)), ["conv", "part"], "left")
    return d.select("conv", (F.col("pos") + F.coalesce("n0", F.lit(0))).alias("pos"), "role",
                    "text", "tokens", (F.col("before") + F.coalesce("t0", F.lit(0))).alias("before"))


# --- windows -----------------------------------------------------------------

def spans(tokens: np.ndarray, own: int, budget: int, system: int, history: int
          ) -> Iterator[tuple[int, int, int]]:
    """(first history turn, first new turn, end) of each window over ``tokens``, whose
    turns from ``own`` on are new and those before it candidates for history. The
    prefix sums are searched for the end of the history and of the window."""
    sums = np.concatenate([[0], np.cumsum(tokens)])
    at = own
    while at < len(tokens):
        room = budget - system
        back = max(min(history, room - int(tokens[at])), 0)
        start = int(np.searchsorted(sums, sums[at] - back))
        end = int(np.searchsorted(sums, sums[start] + room, "right")) - 1
        yield start, at, max(end, at + 1)
        at = max(end, at + 1)


def windows(turns: DataFrame, tokenizer_path: str, budget: int = BUDGET, history: int = HISTORY,
            conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            block_budgets: int = BLOCK_BUDGETS) -> DataFrame:
    """One row per window: conversation, number of its first new turn (``first``), its
    turns, how many at its head are repeated, tokens, text, and the loss mask as ranges
    of code points of the text."""
    d = placed(turns, tokenizer_path, conv, turn, role, text)
    size = budget * block_budgets
    kind = turns.schema[conv].dataType
    own = d.withColumn("block", F.floor(F.col("before") / size)).withColumn("use", F.lit(_NEW))
    # near a block's end: maybe the next one's history
    tail = own.filter(F.col("before") % size >= size - history).withColumn(
        "block", F.col("block") + 1).withColumn("use", F.lit(_HISTORY))
    blocks = own.groupBy("conv").agg(F.max("block").alias("last"))
    first = own.filter((F.col("pos") == 0) & (F.col("role") == SYSTEM))
    head = first.join(blocks.filter("last > 0"), "conv").withColumn(
        "block", F.explode(F.sequence(F.lit(1).cast("long"), "last"))).withColumn(
        "use", F.lit(_HEAD)).drop("last")
    rows = own.unionByName(tail).unionByName(head).repartition("conv", "block")
    rows = rows.sortWithinPartitions("conv", "block", "pos", "use")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for b in batches:
            done = []
            for r in b.itertuples(index=False):
                if (r.conv, r.block) != at:
                    done += _block_windows(held, budget, history)
                    at, held = (r.conv, r.block), []
                held.append(r)
            yield pd.DataFrame(done, columns=_COLUMNS)
        yield pd.DataFrame(_block_windows(held, budget, history), columns=_COLUMNS)

    out = rows.mapInPandas(run, _WINDOWS)
    back = F.when(F.col("conv") != "", F.substring("conv", 2, 2**31 - 1)).cast(kind)
    return out.select(back.alias(conv), *[c for c in out.columns if c != "conv"])


_HEAD, _HISTORY, _NEW = range(3)
_COLUMNS = ["conv", "first", "n_turns", "n_repeated", "n_tokens", "formatted", "loss"]


def _block_windows(rows: list, budget: int, history: int) -> list[tuple]:
    """Windows of a block's rows in order: a copy of the system turn, candidates for
    history, new turns."""
    if not rows or rows[-1].use != _NEW:
        return []
    head = [r for r in rows[:1] if r.use == _HEAD]
    rest = rows[len(head):]
    opening = False
    if rest[0].pos == 0 and rest[0].role == SYSTEM:
        # the system turn stands before every window's turns, it is never among them
        opening = rest[0].use == _NEW
        head, rest = (rest[:1] if opening else head), rest[1:]
    system = sum(r.tokens for r in head)
    fixed = [format_turn(r.role, r.text) for r in head]
    parts = [format_turn(r.role, r.text) for r in rest]
    own = sum(r.use == _HISTORY for r in rest)
    found = list(spans(np.array([r.tokens for r in rest], np.int64), own, budget, system, history))
    if opening and not found:
        found = [(0, 0, 0)]                   # nothing but the system turn
    out = []
    for k, (start, new, end) in enumerate(found):
        at, loss = sum(map(len, fixed)), []
        for i in range(start, end):
            if i >= new and rest[i].role == TARGET:
                lead = len(START) + len(escape_role(rest[i].role)) + 1
                loss.append({"start": at + lead, "stop": at + len(parts[i]) - len(END) - 1})
            at += len(parts[i])
        first_new = opening and k == 0        # the system turn is new here
        out.append((rows[0].conv, 0 if first_new else rest[new].pos, len(fixed) + end - start,
                    (0 if first_new else len(fixed)) + new - start,
                    system + sum(r.tokens for r in rest[start:end]),
                    "".join(fixed + parts[start:end]), loss))
    return out


# --- reading back ------------------------------------------------------------

_DIGESTS = ("conv string, n_turns long, turns_sha256 string, loss_chars long, "
            "loss_sha256 string, formatted_chars long")


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the windows of each conversation give back: its turns and the text under
    the loss mask. A digest runs along the conversation, so its windows go to one task
    in order, which reads them one by one and keeps none."""
    ship_package(formatted.sparkSession)
    kind = formatted.schema[conv].dataType
    w = pick(formatted, conv=conv, first="first", n_repeated="n_repeated", text="formatted",
             loss="loss")
    w = w.withColumn("conv", F.when(F.col("conv").isNull(), "").otherwise(
        F.concat(F.lit("="), F.col("conv").cast("string"))))
    w = w.repartition("conv").sortWithinPartitions("conv", "first")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: _Digest | None = None
        for b in batches:
            done = []
            for r in b.itertuples():
                if state is None or state.conv != r.conv:
                    if state:
                        done.append(state.row())
                    state = _Digest(r.conv)
                state.add(r.text, r.n_repeated, r.loss)
            if done:
                yield pd.DataFrame(done, columns=[c.split(" ")[0] for c in _DIGESTS.split(", ")])
        if state:
            yield pd.DataFrame([state.row()],
                               columns=[c.split(" ")[0] for c in _DIGESTS.split(", ")])

    out = w.mapInPandas(read, _DIGESTS)
    back: Column = F.when(F.col("conv") != "", F.substring("conv", 2, 2**31 - 1)).cast(kind)
    return out.select(back.alias(conv), *[c for c in out.columns if c != "conv"])


class _Digest:
    def __init__(self, conv: str):
        self.conv = conv
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: str, repeated: int, loss) -> None:
        new = read_turns(formatted)[repeated:]
        self.n += len(new)
        self.chars += len(formatted)
        for role, text in new:
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for span in loss:
            text = unescape(formatted[span["start"]:span["stop"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return (self.conv, self.n, self.turns.hexdigest(), self.loss_chars,
                self.loss.hexdigest(), self.chars)
