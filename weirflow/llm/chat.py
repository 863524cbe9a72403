"""Chat formatting with a grammar round trip.

A conversation is rendered as

    <chat esc=E>\\n  ( <turn ROLE>TEXT</turn>\\n )*  </chat>

The rendered text is parsed again by a deterministic parser, and the recovered
turns are compared with the source.  Texts are first written as they are (E=0).
The grammar has no place for a control string (``<turn``, ``</turn``, ``<chat``,
``</chat``) within a text, so the parser recovers no text from a turn that holds
one; a conversation whose round trip differs is written with its control
characters escaped (E=1: ``\\`` as ``\\b``, ``<`` as ``\\l``), after which no
control string is left in a text and the second round trip is exact by
construction; it is checked all the same.  Roles always have ``\\``, ``<`` and
``>`` escaped.

The loss mask is the list of spans (start, length in bytes of the formatted
text's UTF-8) of the texts of the assistant's turns.

All on the main path is DataFrame expressions, each linear in the conversation
but for the running sum of its turns' sizes (turns ** 1.5, numbers alone).  A
conversation is one row when rendered, as its output is one text; that bounds a
conversation by the size of a row (2 GB), not the table.

Defined results: null text and null role count as empty; turns of one number
are ordered by role, then text; null turns come first; rows of null conv_id
are one conversation; repeated rows are turns of their own; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.quality import let

OPEN, MID, CLOSE = "<turn ", ">", "</turn>\n"
HEAD, TAIL = "<chat esc={}>\n", "</chat>"
ASSISTANT = "assistant"
#: What no text may hold as it stands.
CONTROL = "</?(?:turn|chat)"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """Every backslash of an escaped text starts an escape, so the order of these is safe with \\b last."""
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\g"), F.lit(">")))


def render(turns: Column, level: int) -> Column:
    body = F.transform(turns, lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(MID), escape(t["text"]) if level else t["text"], F.lit(CLOSE)))
    return F.concat(F.lit(HEAD.format(level)), F.array_join(body, ""), F.lit(TAIL))


def running(sizes: Column) -> Column:
    """The sum of the sizes before each: within blocks of about the root of their number, and over the blocks' totals."""

    def sums(x: Column) -> Column:
        # one more than x, the last is the total
        return F.aggregate(x, F.array(F.lit(0).cast("long")), lambda a, v: F.array_append(a, F.element_at(a, -1) + v))

    def placed(blocks: Column) -> Column:
        return let(sums(F.transform(blocks, lambda b: F.element_at(b, -1))), lambda base: F.flatten(F.transform(blocks, lambda b, i: F.transform(F.slice(b, 1, F.size(b) - 1), lambda v: v + F.get(base, i)))))

    n = F.size(sizes)
    width = F.ceil(F.sqrt(n)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1), lambda i: sums(F.slice(sizes, i * width + 1, width)))
    return F.when(n > 0, let(blocks, placed)).otherwise(F.array().cast("array<bigint>"))


def pieces(formatted: Column) -> Column:
    """The parser: array of (role, raw, lead, size): raw is a turn's text as it stands, lead the bytes before it in its turn, size the turn's bytes.

    raw is NULL where a control string stands in it.
    """
    head = len(HEAD.format(0))
    inside = F.substr(formatted, F.lit(head + 1), F.length(formatted) - F.lit(head + len(TAIL)))
    parts = let(F.split(inside, CLOSE), lambda p: F.slice(p, 1, F.size(p) - 1))

    def turn(p: Column) -> Column:
        cut = F.instr(p, MID)
        raw = F.substr(p, cut + F.lit(len(MID)), F.length(p))
        return let(
            raw,
            lambda r: F.struct(
                unescape_role(F.substr(p, F.lit(len(OPEN) + 1), cut - F.lit(len(OPEN) + 1))).alias("role"),
                F.when(~r.rlike(CONTROL), r).alias("raw"),
                (F.octet_length(p) - F.octet_length(r)).cast("long").alias("lead"),
                (F.octet_length(p) + F.lit(len(CLOSE))).cast("long").alias("size"),
            ),
        )

    return F.transform(parts, turn)


def read_back(formatted: Column) -> Column:
    """array of (role, text, lead, size) of the turns in formatted; text is NULL where the grammar has none."""
    escaped = F.startswith(formatted, F.lit(HEAD.format(1)))
    return F.transform(pieces(formatted), lambda t: F.struct(t["role"].alias("role"), F.when(escaped, unescape(t["raw"])).otherwise(t["raw"]).alias("text"), t["lead"].alias("lead"), t["size"].alias("size")))


def loss_spans(back: Column) -> Column:
    """(start, length) in bytes of the assistant's texts."""
    head, close = F.lit(len(HEAD.format(0))).cast("long"), F.lit(len(CLOSE))
    spans = lambda before: F.transform(back, lambda t, i: F.struct(t["role"].alias("role"), (head + F.get(before, i) + t["lead"]).alias("start"), (t["size"] - t["lead"] - close).alias("length")))
    every = let(running(F.transform(back, lambda t: t["size"])), spans)
    return F.transform(F.filter(every, lambda t: t["role"] == ASSISTANT), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))


def same(turns: Column, back: Column) -> Column:
    plain = lambda x: F.transform(x, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return F.coalesce(plain(turns) == plain(back), F.lit(False))


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, escaped, spans, exact) of each conversation in rows (conv_id, turn, role, text)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    turns = F.col("turns")

    def tried(level: int, then) -> Column:
        return let(render(turns, level), lambda f: let(read_back(f), lambda back: then(f, back)))

    def done(level: int, formatted: Column, back: Column) -> Column:
        return F.struct(formatted.alias("formatted"), F.lit(bool(level)).alias("escaped"), loss_spans(back).alias("spans"), same(turns, back).alias("exact"))

    found = tried(0, lambda f, back: F.when(same(turns, back), done(0, f, back)).otherwise(tried(1, lambda g, again: done(1, g, again))))
    return chats.select("conv_id", found.alias("chat")).select("conv_id", "chat.*")


def digest(chats: DataFrame) -> DataFrame:
    """What is read back from the formatted texts and their loss spans alone."""
    escaped = F.startswith("formatted", F.lit(HEAD.format(1)))
    masked = let(F.encode(F.col("formatted"), "UTF-8"), lambda data: F.transform("spans", lambda s: F.decode(F.substring(data, (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8")))
    loss = F.array_join(F.transform(masked, lambda x: F.when(escaped, unescape(x)).otherwise(x)), "")
    whole = lambda turns: F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = let(let(F.col("formatted"), read_back), lambda turns: F.struct(F.size(turns).cast("long").alias("n_turns"), F.sha2(whole(turns), 256).alias("turns_sha256")))
    lost = let(loss, lambda x: F.struct(F.length(x).cast("long").alias("loss_chars"), F.sha2(x, 256).alias("loss_sha256")))
    return chats.select("conv_id", read.alias("read"), lost.alias("lost"), F.length("formatted").cast("long").alias("formatted_chars")).select("conv_id", "read.*", "lost.*", "formatted_chars")
