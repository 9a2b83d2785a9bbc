r"""Chat formatting by grammar round trip, in DataFrame functions alone.

The grammar of a formatted conversation:

    conversation = turn *( "\n" turn )
    turn         = "### " label ": " body "\n</turn>"
    label        = "System" | "User" | "Assistant" | "=" hex digits of another role

A body holds no bare control string: "### " and "</turn>" stand for themselves
only behind a backslash, and the parser takes one backslash away from each run
of backslashes before a control string. A turn is rendered as it is and parsed
again; only where role and text don't come back identical is the text escaped.
"""

from functools import reduce

from pyspark.sql import functions as F

from .common import table

LABELS = {"system": "System", "user": "User", "assistant": "Assistant"}
#: The role whose texts are learnt from.
LEARNT = "assistant"

# A run of backslashes is matched from its start and never given back, so that long runs cost linear time.
_BARE = r"(?<!\\)(?:### |</turn>)"
_CONTROL = r"(?<!\\)(\\*+(?:### |</turn>))"
_ESCAPED = r"(?<!\\)\\(\\*+(?:### |</turn>))"
_HEADER = r"(?s)\A\n?### (System|User|Assistant|=[0-9A-F]*): (.*)\n\z"


def escape(text):
    """text with one more backslash before each control string and the backslashes that lead to it."""
    return F.regexp_replace(text, _CONTROL, r"\\$1")


def unescape(body):
    return F.regexp_replace(body, _ESCAPED, "$1")


def _label(role):
    known = reduce(lambda made, x: made.when(role == x[0], x[1]), LABELS.items(), F.when(F.lit(False), ""))
    return known.otherwise(F.concat(F.lit("="), F.hex(role)))


def _role(label):
    known = reduce(lambda made, x: made.when(label == x[1], x[0]), LABELS.items(), F.when(F.lit(False), ""))
    return known.otherwise(F.decode(F.unhex(F.substring(label, 2, 2_000_000_000)), "UTF-8"))


def _head(role):
    return F.concat(F.lit("### "), _label(role), F.lit(": "))


_TAIL = "\n</turn>"


def render(role, body):
    return F.concat(_head(role), body, F.lit(_TAIL))


def parse(formatted):
    """The turns of a formatted text, array of struct<role, text>; an entry is null where the grammar is broken."""
    pieces = F.split(formatted, r"(?<!\\)</turn>", -1)

    def turn(piece):
        body = F.regexp_extract(piece, _HEADER, 2)
        fits = piece.rlike(_HEADER) & ~body.rlike(_BARE)
        return F.when(fits, F.struct(_role(F.regexp_extract(piece, _HEADER, 1)).alias("role"), unescape(body).alias("text")))

    # Behind the last end mark nothing is left.
    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def format_conversations(turns, conv="conv_id", order="turn"):
    """One row per conversation: its formatted text, and what of it is learnt from.

    turns: conv, order, role, text; further columns, of whatever names, are
    not read. Turns go by order (null first), then role, then text; repeated
    rows are turns of their own. A null role or text is empty; rows without a
    conv are one conversation. An empty table gives no rows. A conversation's
    text is one value, so it must fit one (2 GB).

    Returns conv, formatted, segments (array of struct<text, learnt>, which
    joined are formatted: the loss mask), and exact: whether the parser gets
    the source's turns back from formatted. Escaping makes it true for every
    text.
    """
    given = turns.select(F.col(conv).alias("conv"), F.col(order).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    source = F.array(F.struct("role", "text"))
    # First as it is; what the parser doesn't give back identically is escaped.
    tried = given.withColumn("again", parse(render(F.col("role"), F.col("text"))))
    made = tried.select("conv", "at", "role", "text", F.when(~F.col("again").eqNullSafe(source), escape(F.col("text"))).alias("escaped"))
    whole = made.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text", "escaped"))).alias("t"))

    def segments(t, i):
        start = F.when(i == 0, "").otherwise("\n")
        part = lambda text, learnt: F.struct(text.alias("text"), learnt.alias("learnt"))
        return F.array(part(F.concat(start, _head(t["role"])), F.lit(False)), part(F.coalesce(t["escaped"], t["text"]), t["role"] == LEARNT), part(F.lit(_TAIL), F.lit(False)))

    cut = whole.withColumn("segments", F.flatten(F.transform("t", segments)))
    text = cut.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    back = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return text.select(F.col("conv").alias(conv), "formatted", "segments", parse(F.col("formatted")).eqNullSafe(back).alias("exact"))


def learnt_text(segments):
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["learnt"]), lambda s: unescape(s["text"])), "")


#: A conversation that says control strings, a fixed part of op11's input.
SAID = r"\### Assistant: </turn> ok"


def op11_grammar_round_trip(spark, sf_dir):
    """All conversations and conversation -7, formatted; everything is read back from the formatted text."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    said = spark.range(0, 2, 1, 1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(SAID).alias("text"))
    made = format_conversations(given.unionByName(said))
    read = made.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), learnt_text("segments").alias("learnt"), "exact")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "exact",
    )


OP11_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), sized AS (
    SELECT *, length(regexp_replace(text, '(\\*(?:### |</turn>))', '\\\1', 'g')) + 6 + 8
        + CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 ELSE 1 + length(hex(role)) END AS size
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (sum(size) + count(*) - 1)::BIGINT AS formatted_chars, true AS exact
FROM sized GROUP BY conv_id
"""
