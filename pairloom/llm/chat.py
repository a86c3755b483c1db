"""Chat formatting (native): sorted turn structs, merged roles, one string and a loss mask.

Grammar of the output; a block holds adjacent turns of one role::

    <s> block*
    block  = [SYS] texts [/SYS] | [INST] texts [/INST] | [ANS] texts </s>
           | [ROLE] role [TEXT] texts [/ROLE]
    texts  = text ([SEP] text)*

Inside texts and role names a backslash is doubled, and a backslash is put after the first
character of each control string; so no control string is left in them, and undoing it is
one replacement. Control strings have ``[`` or ``<`` only in front, so none can straddle the
end of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings of the template (fixed values).
BOS = "<s>"
SEP = "[SEP]"
OPENERS = {"system": "[SYS]", "user": "[INST]", "assistant": "[ANS]"}
CLOSERS = {"system": "[/SYS]", "user": "[/INST]", "assistant": "</s>"}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
#: Elements of an array that are folded, or cut out of one string, at a time.
CHUNK = 256
CONTROLS = (BOS, SEP, *OPENERS.values(), *CLOSERS.values(), *OTHER)


def _quoted(x: str) -> str:
    return x.replace("[", r"\[").replace("]", r"\]")


def escape(text: Column) -> Column:
    rest = "|".join(_quoted(c[1:]) for c in CONTROLS)
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), rf"([<\[])(?=(?:{rest}))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _by_role(role: Column, values: dict[str, str], other: Column) -> Column:
    out = other
    for name, value in values.items():
        out = F.when(role == name, F.lit(value)).otherwise(out)
    return out


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: a transform over a one-element array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _in_chunks(values: Column, size: int) -> Column:
    """An array cut into arrays of ``size`` elements (the last one shorter)."""
    chunks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / size).cast("int"), F.lit(0)))
    return F.transform(chunks, lambda c: F.slice(values, c * size + 1, size))


def _totals_before(lengths: Column) -> Column:
    """Running total of the array before each of its elements.

    A fold that appends copies what it has, so totals are folded within chunks of ``CHUNK``
    elements, and over the chunks; the copying is near linear in the array's size.
    """
    zero = F.array(F.lit(0).cast("long"))
    run = lambda xs: F.aggregate(xs, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def shifted(within: Column) -> Column:
        base = run(F.transform(within, lambda w: F.element_at(w, -1)))
        add = lambda b: F.transform(within, lambda w, c: F.transform(F.slice(w, 1, F.size(w) - 1), lambda v: v + F.get(b, c)))
        return F.flatten(_let(base, add))

    return _let(F.transform(_in_chunks(lengths, CHUNK), run), shifted)


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: id, n_blocks, formatted, loss_spans.

    loss_spans: array of (start, length) in code points of ``formatted``; exactly the texts
    of ``loss_role``, in order. Turns are sorted by turn, then role and text (ties and repeated
    rows all stay); null turns come first. Null texts and roles count as empty; rows with a null
    conversation id form one conversation. Other columns are not read. A conversation is one
    string, so its turns meet in one task.
    """
    struct = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    per = turns.groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_list(struct)).alias("turns"))
    opener = lambda role: _by_role(role, OPENERS, F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1])))
    closer = lambda role: _by_role(role, CLOSERS, F.lit(OTHER[2]))

    def merged(ts: Column) -> Column:
        """Each turn with what stands before its text: a turn of the role before stays in its block."""

        def piece(t: Column, i: Column) -> Column:
            before = F.get(ts, i - 1)["role"]
            opens = (i == 0) | (before != t["role"])
            head = F.when(i == 0, F.concat(F.lit(BOS), opener(t["role"]))).when(opens, F.concat(closer(before), opener(t["role"]))).otherwise(F.lit(SEP))
            return F.struct(opens.alias("opens"), head.alias("head"), escape(t["text"]).alias("text"), (t["role"] == loss_role).alias("loss"))

        return F.transform(ts, piece)

    def made(ps: Column, last: Column) -> Column:
        size = lambda p: (F.length(p["head"]) + F.length(p["text"])).cast("long")
        starts = _totals_before(F.transform(ps, size))
        span = lambda p, at: F.struct((at + F.length(p["head"])).cast("int").alias("start"), F.length(p["text"]).alias("length"), p["loss"].alias("loss"))
        spans = F.filter(F.zip_with(ps, starts, span), lambda s: s["loss"])
        return F.struct(
            F.size(F.filter(ps, lambda p: p["opens"])).cast("long").alias("n_blocks"),
            F.concat(F.array_join(F.transform(ps, lambda p: F.concat(p["head"], p["text"])), ""), closer(last)).alias("formatted"),
            F.transform(spans, lambda s: F.struct(s["start"], s["length"])).alias("loss_spans"),
        )

    done = _let(F.col("turns"), lambda ts: _let(merged(ts), lambda ps: made(ps, F.element_at(ts, -1)["role"])))
    return per.select("id", done.alias("done")).select(F.col("id").alias(id_col), "done.*")


def parse_formatted(formatted: Column) -> Column:
    """The turns (array of role and text) that a formatted conversation was made of."""
    first = "|".join(map(_quoted, (*OPENERS.values(), OTHER[0])))
    last = "|".join(map(_quoted, (*CLOSERS.values(), OTHER[2])))
    whole = rf"(?s)({first})(.*?)(?:{last})"

    def turns(block: Column) -> Column:
        opener, body = F.regexp_extract(block, whole, 1), F.regexp_extract(block, whole, 2)
        head = rf"(?s)^(.*?){_quoted(OTHER[1])}"
        role = _by_role(opener, {o: r for r, o in OPENERS.items()}, unescape(F.regexp_extract(body, head, 1)))
        texts = F.split(F.when(opener == OTHER[0], F.regexp_replace(body, head, "")).otherwise(body), _quoted(SEP), -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.regexp_extract_all(formatted, F.lit(whole), F.lit(0)), turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order and with nothing between.

    A substring is looked for from the start of its string, so the string is first cut into
    the stretches that ``CHUNK`` spans cover.
    """

    def cut(part: Column, text: Column, first: Column) -> Column:
        return F.transform(part, lambda s: unescape(F.substring(text, s["start"] - first + 1, s["length"])))

    def texts(part: Column) -> Column:
        first, last = F.get(part, F.lit(0))["start"], F.element_at(part, -1)
        return _let(F.substring(formatted, first + 1, last["start"] + last["length"] - first), lambda text: cut(part, text, first))

    return F.when(F.size(spans) == 0, F.lit("")).otherwise(F.array_join(F.flatten(F.transform(_in_chunks(spans, CHUNK), texts)), ""))
