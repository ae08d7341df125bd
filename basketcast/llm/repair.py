"""Conversation structure repair: the cheapest edits that make turns alternate, as one integer minimum.

A conversation's rows are taken by turn (nulls first; rows of one turn by role, then text).  A row has
at most one fault, the first that holds: ``blank`` (nothing but white space), ``duplicate`` (role and text
seen earlier in the conversation), ``truncated`` (its last character other than white space is none of ``.!?``).
Edits: **K**\\ eep, **R**\\ erole to user or assistant, **D**\\ elete, **I**\\ nsert an empty row; after them the
roles' first letters must read ``(s?(ua)+)?``.  Blank and duplicate rows can only be deleted; a truncated
row that stays costs extra.

* **Weights.**  A path's weight is one big integer: the high digits are its cost, the low digits its audit,
  a fixed width of three bits a letter (D 1, I 2, K 3, R 4, as in ASCII order), first letter highest, zeros
  after the end.  So a smaller integer is a cheaper path, and among equally cheap ones that whose letters come
  first in ASCII order, a prefix before what it begins.  Plain ``min`` decides everything.
* **Graph.**  Nodes are (row, what was put out last: nothing, s, u, a), walked from the last row to the first.
  An edge in front of a path adds its cost above, moves the letters down one place and puts its own
  on top; the width has room for every path that can be least (at most two inserts between rows).
* **Roles follow from letters.**  With an odd number of rows put out the first is the kept ``s``; the others
  alternate, user first.

Rows are shuffled by conversation and stream through a task in order.  Held for a conversation are a digest
and a few bytes a row, and four weights of some nine bits a row (so a conversation of n rows costs n steps
on integers of 9n bits); texts are held one at a time.  The repaired rows need the letters of all rows before
the first is put out, so they are a second pass, to which the letters are sent along.

Nulls in role and text count as one space; a null conversation id is a conversation of its own.  Repeated rows are
duplicates.  A conversation of which no row is left has zeros, no letters and no repaired rows.  An
empty frame gives an empty result.  Other columns are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketcast.llm.text import columns_of, rows_out
from basketcast.session import cut_lineage

# Costs of the edits, and letters in ASCII order.
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3
_D, _I, _K, _R = 1, 2, 3, 4
_LETTERS = " DIKR"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
_LEGAL = {"su", "ua", "au"}


def least_edits(initials: str, faults: bytes) -> tuple[int, str]:
    """``(cost, audit)`` of the least path; one first letter and one fault per row."""
    n = len(initials)
    width = 3 * (3 * n + 3)
    top, mask = width - 3, (1 << width) - 1
    never = 1 << (width + (8 * n + 64).bit_length())  # above every cost

    def put(weight: int, cost: int, letter: int) -> int:
        if weight >= never:
            return never
        return ((weight >> width) + cost) << width | letter << top | (weight & mask) >> 3

    e, s, u, a = 0, never, never, 0  # nothing put out is fine, and so is an end after an assistant
    for i in range(n, -1, -1):
        if i < n:
            x, fault = initials[i], faults[i]
            next_e, next_s, next_u, next_a = (put(w, DELETE, _D) for w in (e, s, u, a))
            if fault in (FINE, TRUNCATED):
                extra = CUT_SHORT if fault == TRUNCATED else 0
                to_user = put(u, extra + REROLE, _R)
                if x == "u":
                    to_user = min(to_user, put(u, extra + KEEP, _K))
                to_assistant = put(a, extra + REROLE, _R)
                if x == "a":
                    to_assistant = min(to_assistant, put(a, extra + KEEP, _K))
                if x == "s":
                    next_e = min(next_e, put(s, extra + KEEP, _K))
                next_e, next_s, next_a = (min(w, to_user) for w in (next_e, next_s, next_a))
                next_u = min(next_u, to_assistant)
            e, s, u, a = next_e, next_s, next_u, next_a
        u, a = min(u, put(a, INSERT, _I)), min(a, put(u, INSERT, _I))
        insert = put(u, INSERT, _I)
        e, s = min(e, insert), min(s, insert)
    letters, at = [], top
    while at >= 0 and (digit := e >> at & 7):
        letters.append(_LETTERS[digit])
        at -= 3
    return e >> width, "".join(letters)


def roles_put_out(audit: str) -> Iterator[tuple[str, str | None]]:
    """``(letter, role)`` of every edit; the role is None where the row is deleted or keeps its own."""
    place = -((len(audit) - audit.count("D")) % 2)  # a kept s stands before the first user
    for letter in audit:
        if letter == "D":
            yield letter, None
            continue
        yield letter, None if letter == "K" else ("user", "assistant")[place % 2]
        place += 1


def ordered(rows: DataFrame, *more: str) -> DataFrame:
    """A conversation's rows in one task, in order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key", *more, F.col("turn").asc_nulls_first(), "role", "text")


def conversation_rows(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, dropped: Column | None) -> DataFrame:
    conv = F.col(conv_col)
    return rows.select(F.coalesce(F.concat(F.lit("s"), conv.cast("string")), F.lit("t")).alias("key"), conv.alias("conv"),
                       F.col(turn_col).cast("long").alias("turn"),
                       F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"),
                       (F.lit(False) if dropped is None else dropped).alias("dropped"))


_COUNTS = [(name, pa.int64()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]


class _Conversation:
    """What is known of a conversation while its rows go by."""

    def __init__(self, key: str, conv):
        self.key, self.conv = key, conv
        self.initials, self.faults, self.seen = [], bytearray(), set()
        self.turns, self.first, self.last = 0, None, None

    def add(self, turn: int | None, initial: str, blank: bool, ended: bool, digest: bytes) -> None:
        if blank:
            fault = BLANK
        elif digest in self.seen:
            fault = DUPLICATE
        else:
            fault = FINE if ended else TRUNCATED
        self.seen.add(digest)
        self.initials.append(initial)
        self.faults.append(fault)
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        illegal = sum(x + y not in _LEGAL for x, y in zip(self.initials, self.initials[1:], strict=False))
        # a role without a first letter is like any that fits nowhere
        cost, audit = least_edits("".join(x or " " for x in self.initials), bytes(self.faults))
        return (self.key, self.conv, gaps, self.faults.count(BLANK), self.faults.count(DUPLICATE),
                self.faults.count(TRUNCATED), illegal, cost, audit)


def audit_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                        text_col: str = "text", dropped: Column | None = None) -> DataFrame:
    """One row per conversation: ``key, conv, gaps, blank, duplicate, truncated, illegal, cost, audit``.

    Rows for which ``dropped`` holds only make sure that their conversation is in the result.
    """
    source = conversation_rows(rows, conv_col, turn_col, role_col, text_col, dropped)
    text = F.col("text")
    seen = ordered(source).select(
        "key", "conv", "turn", "dropped", F.substring("role", 1, 1).alias("initial"),
        (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"), text.rlike(r"[.!?][\x20\x09-\x0D]*\z").alias("ended"),
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", text), 256)).alias("digest"))
    schema = ", ".join(["key string", f"conv {source.schema['conv'].dataType.simpleString()}",
                        *(f"{name} long" for name, _ in _COUNTS), "audit string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, types = None, None
        for batch in batches:
            done, conv_type = [], batch.schema.field("conv").type
            types = [("key", pa.string()), ("conv", conv_type), *_COUNTS, ("audit", pa.string())]
            names = ("key", "conv", "dropped", "turn", "initial", "blank", "ended", "digest")
            for key, conv, gone, *features in zip(*columns_of(batch, *names), strict=True):
                if at is None or at.key != key:
                    if at is not None:
                        done.append(at.row())
                    at = _Conversation(key, conv)
                if not gone:
                    at.add(*features)
            yield rows_out(done, types)
        if at is not None:
            yield rows_out([at.row()], types)

    return seen.mapInArrow(run, schema)


_ROW_TYPES = [("key", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())]
_BATCH_CHARS = 1 << 20


def repaired_rows(rows: DataFrame, audits: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                  role_col: str = "role", text_col: str = "text", dropped: Column | None = None) -> DataFrame:
    """``key, place, role, text`` after the edits in ``audits``; a conversation's rows follow each other in a task."""
    source = conversation_rows(rows, conv_col, turn_col, role_col, text_col, dropped).where("NOT dropped")
    both = source.select("key", "turn", "role", "text", F.lit(None).cast("string").alias("audit")).unionByName(
        audits.select("key", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                      F.lit(None).cast("string").alias("text"), "audit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, key, place, out, held = iter(()), None, 0, [], 0

        def emit(role: str, text: str) -> None:
            nonlocal place, held
            out.append((key, place, role, text))
            place, held = place + 1, held + len(text)

        for batch in batches:
            for new_key, role, text, audit in zip(*columns_of(batch, "key", "role", "text", "audit"), strict=True):
                if audit is not None:  # stands before the rows of its conversation
                    for _, made in edits:  # inserts at the end of the one before
                        emit(made, "")
                    edits, key, place = roles_put_out(audit), new_key, 0
                    continue
                for letter, made in edits:
                    if letter == "I":
                        emit(made, "")
                        continue
                    if letter != "D":
                        emit(made or role, text)
                    break
                if held > _BATCH_CHARS:
                    yield rows_out(out, _ROW_TYPES)
                    out, held = [], 0
            yield rows_out(out, _ROW_TYPES)
            out, held = [], 0
        for _, made in edits:
            emit(made, "")
        yield rows_out(out, _ROW_TYPES)

    return (ordered(both, F.col("audit").asc_nulls_last()).select("key", "role", "text", "audit")
            .mapInArrow(run, "key string, place long, role string, text string"))


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """``key, repaired_sha256``: of ``role:text`` of :func:`repaired_rows`, joined by line feeds."""
    types = [("key", pa.string()), ("repaired_sha256", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            done = []
            for key, role, text in zip(*columns_of(batch, "key", "role", "text"), strict=True):
                if key != at:
                    if at is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield rows_out(done, types)
        if at is not None:
            yield rows_out([(at, digest.hexdigest())], types)

    return repaired.mapInArrow(run, "key string, repaired_sha256 string")


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", dropped: Column | None = None) -> DataFrame:
    """The audit of every conversation with the digest of its repaired rows."""
    names = {"conv_col": conv_col, "turn_col": turn_col, "role_col": role_col, "text_col": text_col, "dropped": dropped}
    audits = cut_lineage(audit_conversations(rows, **names))
    digests = repaired_digests(repaired_rows(rows, audits, **names))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return (audits.join(digests, "key", "left")
            .select(F.col("conv").alias(conv_col), *(name for name, _ in _COUNTS), "audit",
                    F.coalesce("repaired_sha256", nothing).alias("repaired_sha256")))


def damage(rows: DataFrame) -> tuple[DataFrame, Column]:
    """A fixed damage of ``conv_id, turn, role, text`` by the crc32 of ``conv_id:turn`` modulo 20, for trials:
    0 drops the row, 1 empties its text, 2 takes out ``.!?``, 3 repeats the row, 4 makes it the user's.
    Nulls are one space.  Returns the rows and the column that marks dropped ones."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    hurt = rows.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("lost"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return hurt.drop("_copy"), F.col("lost")
