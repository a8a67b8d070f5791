"""Chat formatting in budgeted windows.

The turns of a conversation, in order of turn number, are cut into windows at turn boundaries.
Prefix sums of the turns' token counts choose the spans, so no conversation is walked turn by turn:
a window holds the turns whose prefix starts in the same half budget, and a turn longer than half a
budget has a window of its own.  Each window repeats the system turn, if it fits into its share of the
budget (``SYSTEM`` tokens; a longer one stands in its own place only), and as many earlier turns as fit
into the history budget.  A window is therefore over ``BUDGET`` only if one turn alone passes the room
for new turns, ``2 * HALF``; turns are never cut.  Repeated turns are never targets, so each assistant
text is under the loss mask exactly once.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and texts every ``<`` followed by
backslashes and ``|`` gets one more backslash, and line ends in roles are written as control
characters, so markers in a text can be told from the template's and the text can be read back.

Only DataFrame functions are used.  Defined results:

- NULL text or role: empty.  NULL turn: before all others.  NULL conversation: a conversation of its own.
- Equal turn numbers and repeated rows: ordered by role and text, each a turn.
- A conversation without system turn repeats none; further system turns are ordinary turns.
- No rows: no rows.  Extra columns are not read.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BUDGET = 2048
HISTORY = 256
SYSTEM = 256  # kept free for the repeated system turn
HALF = (BUDGET - HISTORY - SYSTEM) // 2
OVERHEAD = 4  # tokens of the template around a turn
RANGE_BITS = 10
START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(text):
    """Put one more backslash into each ``<`` backslashes ``|``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text):
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role):
    """A role stands on one line: line ends in it become U+0001 and a digit."""
    return F.replace(escape(F.replace(F.replace(role, F.lit("\x01"), F.lit("\x012")), F.lit("\n"), F.lit("\x011"))),
                     F.lit("\r"), F.lit("\x013"))


def unescape_role(role):
    out = unescape(F.replace(F.replace(role, F.lit("\x013"), F.lit("\r")), F.lit("\x011"), F.lit("\n")))
    return F.replace(out, F.lit("\x012"), F.lit("\x01"))


def token_count(text):
    """Words and punctuation marks; any other column expression can be passed instead."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"))


def ordered_turns(conversations, count=token_count):
    """Turns with their place in the conversation: running sums before each turn.

    A conversation is cut into ranges of turn numbers; the sums of the ranges are scanned per
    conversation and added to the sums inside the range, so a very long one is many tasks' work.
    """
    base = conversations.select(
        F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumns({
        "tokens": (count(F.col("text")) + OVERHEAD).cast("long"),
        "range": F.coalesce(F.shiftright(F.col("turn").cast("long"), RANGE_BITS), F.lit(-(2**62))),
        "conv": F.struct("conv_id")})  # a struct is never NULL, so NULL conversations join as well
    base = base.withColumns({"one": F.lit(1).cast("long"), "system": (F.col("role") == "system").cast("long"),
                             "long": (F.col("tokens") > HALF).cast("long")})
    sums = {"pos": "one", "start": "tokens", "systems": "system", "longs": "long"}
    inside = Window.partitionBy("conv", "range").orderBy("turn", "role", "text").rowsBetween(
        Window.unboundedPreceding, 0)
    across = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = base.groupBy("conv", "range").agg(*[F.sum(c).alias(k) for k, c in sums.items()]).select(
        "conv", "range", *[F.coalesce(F.sum(k).over(across), F.lit(0)).alias(f"{k}_before") for k in sums])
    local = base.withColumns({k: F.sum(c).over(inside) - F.col(c) for k, c in sums.items()})
    joined = local.join(totals, ["conv", "range"])
    return joined.withColumns({k: F.col(k) + F.col(f"{k}_before") for k in sums}).withColumn(
        "is_system", (F.col("system") == 1) & (F.col("systems") == 0)).select(
        "conv", "pos", "start", "longs", "long", "is_system", "role", "text", "tokens")


def with_windows(turns):
    """Adds ``bucket`` and ``window``, the position of the window's first turn.

    Turns that start in the same half budget with no long turn between them share a window.
    """
    t = turns.withColumns({"bucket": F.floor(F.col("start") / HALF), "part": 2 * F.col("longs") + F.col("long")})
    by = Window.partitionBy("conv", "bucket", "part")
    return t.withColumns({"window": F.min("pos").over(by), "w_start": F.min("start").over(by)})


def chat_windows(conversations, count=token_count):
    """One row per window: conv_id, window, segments, text, tokens.

    ``segments`` describes the turns of ``text`` in order: repeated (system turn or history) and
    loss.  History comes from an equi-join of turns and windows on the half budgets that a turn can
    reach; both sides are bounded per half budget.
    """
    turns = cut_lineage(with_windows(ordered_turns(conversations, count)))
    piece = F.struct(
        F.col("kind"), F.col("pos"),
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END + "\n")).alias("out"),
        (F.col("kind") < 2).alias("repeated"),
        ((F.col("kind") == 2) & (F.col("role") == LOSS_ROLE)).alias("loss"), F.col("tokens")).alias("p")
    heads = turns.filter("pos = window").select(
        "conv", F.col("window").alias("w_pos"), F.col("start").alias("w_start"), F.col("bucket").alias("w_bucket"))
    new = turns.withColumn("kind", F.lit(2)).select("conv", "window", piece)
    old = turns.drop("window", "w_start").alias("t")
    reach = F.sequence(F.col("bucket"), F.floor((F.col("start") + HISTORY) / HALF))
    past = old.filter(~F.col("is_system")).withColumn("w_bucket", F.explode(reach)).join(
        heads, ["conv", "w_bucket"]).filter("pos < w_pos AND w_start - start <= %d" % HISTORY)
    past = past.withColumn("kind", F.lit(1)).select("conv", F.col("w_pos").alias("window"), piece)
    again = old.filter(f"is_system AND tokens <= {SYSTEM}").join(heads, "conv").filter("w_pos > pos")
    again = again.withColumn("kind", F.lit(0)).select("conv", F.col("w_pos").alias("window"), piece)
    made = new.unionByName(past).unionByName(again).groupBy("conv", "window").agg(
        F.sort_array(F.collect_list("p")).alias("p"))
    return made.select(
        F.col("conv.conv_id").alias("conv_id"), "window", F.transform("p", lambda x: F.struct(
            x["repeated"].alias("repeated"), x["loss"].alias("loss"))).alias("segments"),
        F.array_join(F.transform("p", lambda x: x["out"]), "").alias("text"),
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("tokens"))


def read_back(windows):
    """The new turns of every window as they stand in its text: role, text, loss, in order.

    The template's markers cannot occur inside an escaped text, so splitting at them is exact.
    """
    parts = F.slice(F.split("text", r"<\|im_start\|>"), 2, F.size("segments"))
    turn = F.transform(F.arrays_zip(parts.alias("part"), F.col("segments").alias("seg")), lambda x: F.struct(
        unescape_role(F.substring_index(x["part"], "\n", 1)).alias("role"),
        unescape(F.substr(x["part"], F.length(F.substring_index(x["part"], "\n", 1)) + 2,
                          F.length(x["part"]) - F.length(F.substring_index(x["part"], "\n", 1)) - 2 - len(END))).alias("text"),
        x["seg"]["repeated"].alias("repeated"), x["seg"]["loss"].alias("loss")))
    return windows.select("conv_id", "window", F.length("text").cast("long").alias("n_chars"),
                          F.filter(turn, lambda x: ~x["repeated"]).alias("turns"))


def conversation_digests(windows):
    """Per conversation: what can be read back from its windows.

    A SHA-256 digest has no mergeable state, so the text of one conversation meets in one row; the
    windows are first reduced to two strings each.
    """
    joined = lambda col: F.array_join(col, "")
    each = read_back(windows).select(
        "conv_id", "window", "n_chars", F.size("turns").cast("long").alias("n"),
        joined(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))).alias("all"),
        joined(F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["text"])).alias("loss"))
    whole = each.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("window", "all", "loss"))).alias("w"))
    whole = whole.withColumns({"_all": joined(F.transform("w", lambda x: x["all"])),
                               "_loss": joined(F.transform("w", lambda x: x["loss"]))})
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.col("_all").cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


_TOK = r"len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'))"
_ESC = r"length(regexp_replace({0}, '<(\\*)\|', '<\\\1|', 'g'))"
_ROLE = "replace(replace(replace(role, chr(1), chr(1) || '2'), chr(10), chr(1) || '1'), chr(13), chr(1) || '3')"
SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '@MARKED@' UNION ALL SELECT -1, 1, 'assistant', '@MARKED@'),
t AS (SELECT *, {_TOK} + {OVERHEAD} AS tokens, {len(START) + len(END) + 2} + {_ESC.format("text")} + {_ESC.format(_ROLE)} AS chars FROM c),
s AS (SELECT *, sum(tokens) OVER w - tokens AS start, row_number() OVER w - 1 AS pos,
    sum((tokens > {HALF})::INT) OVER w - (tokens > {HALF})::INT AS longs,
    role = 'system' AND sum((role = 'system')::INT) OVER w = 1 AS is_system
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, min(pos) OVER (PARTITION BY conv_id, start // {HALF}, 2 * longs + (tokens > {HALF})::INT) AS win FROM s),
h AS (SELECT conv_id, pos, start FROM b WHERE pos = win),
r AS (SELECT b.conv_id, sum(chars) AS chars FROM b JOIN h ON b.conv_id = h.conv_id AND b.pos < h.pos
        AND (b.is_system AND b.tokens <= {SYSTEM} OR h.start - b.start <= {HISTORY}) GROUP BY ALL),
n AS (SELECT conv_id, count(*) AS n_turns, sum(chars) AS chars,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = '{LOSS_ROLE}'), '') AS loss FROM b GROUP BY conv_id)
SELECT n.conv_id, n_turns::BIGINT AS n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars,
  sha256(loss) AS loss_sha256, (n.chars + coalesce(r.chars, 0))::BIGINT AS formatted_chars
FROM n LEFT JOIN r ON n.conv_id = r.conv_id
"""
