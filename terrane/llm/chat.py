"""Chat formatting in budgeted windows, in DataFrame functions only.

A conversation becomes windows of at most ``budget`` tokens as far as whole turns allow. Prefix sums of turn tokens
choose where windows begin; each window repeats the system turn and a limited history, which are masked, so that every
assistant turn is learned from exactly once. Control strings inside texts are escaped and come back whole.

    <turn:ROLE>
    TEXT</turn>
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 256
HISTORY_TURNS = 4
#: Tokens that a turn's marks count as.
TURN_COST = 4
END = "</turn>\n"
TURNS = "array<struct<role:string,text:string,tokens:bigint>>"
SPANS = "array<struct<start:int,end:int>>"


def escape(text: Column) -> Column:
    r"""No ``<`` or ``>`` is left: ``\`` becomes ``\s``, ``<`` ``\l``, ``>`` ``\g``."""
    for a, b in (("\\", "\\s"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in ((">", "\\g"), ("<", "\\l"), ("\\", "\\s")):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def turn_tokens(text: Column) -> Column:
    """Words and marks of a text, and the cost of its turn's marks."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) + F.lit(TURN_COST)


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """Windows of all conversations from rows (conv_id, turn, role, text).

    Columns: conv_id, window, n_repeated (turns repeated at its head), n_new, tokens, formatted, loss: an array of
    (start, end) code points of ``formatted`` that are learned from. Rows of a conversation go by turn, then role, then
    text; null roles and texts are empty; repeated rows are turns of their own; a null conv_id is one conversation.
    A turn over the budget has a window to itself. Other columns are ignored; an empty table gives no windows.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", turn_tokens(F.col("text")).cast("long"))
    # running sums row by row, so that a long conversation costs no more a turn than a short one
    so_far = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("sum", F.sum("tokens").over(so_far))
    talk = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "sum", "tokens"))).alias("s"))
    talk = talk.select("conv_id", F.transform("s", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), x["tokens"].alias("tokens"))).cast(TURNS).alias("t"), F.concat(F.array(F.lit(0).cast("long")), F.transform("s", lambda x: x["sum"])).alias("p"))
    talk = talk.withColumn("sys", (F.element_at("t", 1)["role"] == "system").cast("int"))
    head = F.when(F.col("sys") == 1, F.element_at("t", 1)["tokens"]).otherwise(F.lit(0).cast("long"))
    room = F.greatest(F.lit(1).cast("long"), F.lit(budget - history).cast("long") - head)
    talk = talk.withColumn("room", room)

    # a window begins at turn i when the turns from its predecessor's begin through i exceed the room
    first = F.array(F.lit(0))
    ends = F.transform(F.sequence(F.lit(1), F.size("t")), lambda i: i)
    begin = F.aggregate(
        ends,
        F.struct(F.lit(0).cast("long").alias("base"), F.lit(0).alias("last"), first.alias("begins")),
        lambda s, i: F.when(
            (F.element_at("p", i + 1) - s["base"] > F.col("room")) & (i - 1 > s["last"]),
            F.struct(F.element_at("p", i).alias("base"), (i - 1).alias("last"), F.concat(s["begins"], F.array(i - 1)).alias("begins")),
        ).otherwise(s),
    )["begins"]
    talk = talk.withColumn("begins", begin)

    def window(b: Column, k: Column) -> Column:
        end = F.coalesce(F.try_element_at("begins", k + 2), F.size("t"))
        low = F.greatest(F.col("sys"), b - F.lit(history_turns))
        back = F.when(b > F.col("sys"), F.array_min(F.filter(F.sequence(F.least(low, b), b), lambda j: F.element_at("p", b + 1) - F.element_at("p", j + 1) <= history))).otherwise(b)
        repeat = F.concat(F.when((k > 0) & (F.col("sys") == 1), F.slice("t", 1, 1)).otherwise(F.array().cast(TURNS)), F.slice("t", back + 1, b - back))
        return F.struct(k.alias("window"), repeat.alias("repeat"), F.slice("t", b + 1, end - b).alias("new"))

    spread = talk.select("conv_id", F.explode(F.transform("begins", window)).alias("w")).select("conv_id", "w.window", "w.repeat", "w.new")

    def text_of(x: Column) -> Column:
        return F.concat(F.lit("<turn:"), escape(x["role"]), F.lit(">\n"), escape(x["text"]), F.lit(END))

    head_text = F.array_join(F.transform("repeat", text_of), "")
    body = F.array_join(F.transform("new", text_of), "")
    spread = spread.withColumn("head", head_text)

    def mask(s: Column, x: Column) -> Column:
        a = s["at"] + F.length(escape(x["role"])) + F.lit(len("<turn:>\n"))
        b = a + F.length(escape(x["text"]))
        return F.struct((b + F.lit(len(END))).alias("at"), F.when(x["role"] == "assistant", F.concat(s["spans"], F.array(F.struct(a.alias("start"), b.alias("end"))))).otherwise(s["spans"]).alias("spans"))

    loss = F.aggregate("new", F.struct(F.length("head").alias("at"), F.array().cast(SPANS).alias("spans")), mask)["spans"]
    tokens = F.aggregate(F.concat("repeat", "new"), F.lit(0).cast("long"), lambda s, x: s + x["tokens"])
    return spread.select("conv_id", "window", F.size("repeat").alias("n_repeated"), F.size("new").alias("n_new"), tokens.alias("tokens"), F.concat("head", body).alias("formatted"), loss.alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """Conversations read from formatted windows alone: conv_id, turns (role, text), loss_texts, formatted_chars."""
    pieces = F.split("formatted", END, -1)
    pieces = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))
    turns = F.transform(pieces, lambda x: F.struct(unescape(F.regexp_extract(x, r"^<turn:([^>]*)>\n", 1)).alias("role"), unescape(x.substr(F.instr(x, ">") + 2, F.length(x))).alias("text")))
    texts = F.transform("loss", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["end"] - s["start"])))
    each = windows.select("conv_id", F.struct("window", turns.alias("turns"), texts.alias("texts")).alias("w"), F.length("formatted").cast("long").alias("n"))
    joined = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"), F.sum("n").alias("formatted_chars"))
    return joined.select("conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.flatten(F.transform("w", lambda x: x["texts"])).alias("loss_texts"), "formatted_chars")


def digest(windows: DataFrame) -> DataFrame:
    """What a reader gets back of each conversation, as counts and hashes."""
    loss = F.array_join("loss_texts", "")
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read_back(windows).select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
