"""Chat formatting: conversations as single marked-up texts with a loss mask, in DataFrame functions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role become a block (an array
slice whose texts are joined); marks and escaped texts are concatenated.  No Python worker takes part.

Control strings inside texts and role names are escaped by a ``~`` after their first character, one more if there are
some already, so that no text can hold a control string as it stands and every text can be read back unchanged.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ESCAPE = "~"

# The made conversation of the query's contract.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


@dataclass(frozen=True)
class Template:
    """Marks of a chat template.  Each control string begins with ``<`` or ``[``, which it holds nowhere else."""
    begin: str = "<s>"
    close: str = "</s>"
    opens: tuple[tuple[str, str], ...] = (("system", "[SYS]"), ("user", "[INST]"), ("assistant", "[/INST]"))
    role: str = "[ROLE]"
    text: str = "[TEXT]"
    more: str = "[NEXT]"
    learnt: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> list[str]:
        return [self.begin, self.close, *(m for _, m in self.opens), self.role, self.text, self.more]

    def __post_init__(self):
        c = self.controls
        if any(len(x) < 2 or x[0] not in "<[" or re.search(r"[<\[~]", x[1:]) for x in c):
            raise ValueError("a control string begins with < or [ and holds neither of them, nor ~, after that")
        if len(set(c)) < len(c) or any(a != b and a.startswith(b) for a in c for b in c):
            raise ValueError("no control string may be the beginning of another")

    def pattern(self, escaped: bool) -> str:
        """Control strings with any number of escapes (at least one if ``escaped``)."""
        rests = "|".join(sorted(re.escape(x[1:]) for x in self.controls))
        return rf"([<\[]){ESCAPE if escaped else ''}({ESCAPE}*)({rests})"


DEFAULT = Template()


def escape(text: Column, template: Template = DEFAULT) -> Column:
    return F.regexp_replace(text, template.pattern(False), f"$1{ESCAPE}$2$3")


def unescape(text: Column, template: Template = DEFAULT) -> Column:
    return F.regexp_replace(text, template.pattern(True), "$1$2$3")


def _chars(text: Column) -> Column:
    return F.length(text).cast("long")


def _quoted(mark: str) -> str:
    return rf"\Q{mark}\E"


def format_conversations(rows: DataFrame, template: Template = DEFAULT, id_col: str = "conv_id",
                         turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, mask): one row for each conversation.

    formatted: begin, then for each block of adjacent turns of one role its opening mark, the turns' escaped texts
    with ``more`` between them, and close.  Roles without a mark of their own are named between ``role`` and ``text``.
    mask: runs (chars long, loss boolean) over the code points of formatted, in order: for each turn the marks before
    its text, then its text; last the final close.  loss is true for the texts of the learnt roles.

    Turns go by turn number (null first), then role, then text, so that repeated rows and ties have one order.  A null
    text or role is an empty one; a null conv_id is a conversation like any other; repeated rows are turns as often as
    they stand; an empty table gives no rows; other columns are not read.  A conversation is one cell and so one
    task's work, in time proportional to its length; Spark holds cells of up to 2 GB.
    """
    t = template
    turns = (rows.select(F.col(f"`{id_col}`").cast("long").alias("conv_id"),
                         F.struct(F.col(f"`{turn_col}`").cast("long").alias("turn"),
                                  F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
                                  F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).alias("t"))
             .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))
    # Places (from 0) where a block begins, and where it ends.
    n = F.size("turns")
    starts = turns.withColumn("starts", F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"])))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(n))
    blocks = starts.withColumn("blocks", F.zip_with("starts", ends, lambda a, b: F.struct(
        F.get("turns", a)["role"].alias("role"),
        F.transform(F.slice("turns", a + 1, b - a), lambda x: escape(x["text"], t)).alias("texts"))))

    def opening(role: Column) -> Column:
        known = F.concat(F.lit(t.role), escape(role, t), F.lit(t.text))
        for name, mark in t.opens:
            known = F.when(role == name, F.lit(mark)).otherwise(known)
        return known

    def pieces_of(block: Column, k: Column) -> Column:
        first = F.concat(F.when(k == 0, F.lit(t.begin)).otherwise(F.lit(t.close)), opening(block["role"]))
        return F.transform(block["texts"], lambda x, j: F.struct(
            F.when(j == 0, first).otherwise(F.lit(t.more)).alias("mark"), x.alias("text"),
            block["role"].isin(*t.learnt).alias("loss")))

    def run(text: Column, loss: Column) -> Column:
        return F.struct(_chars(text).alias("chars"), loss.alias("loss"))

    made = blocks.select("conv_id", F.flatten(F.transform("blocks", pieces_of)).alias("pieces"))
    return made.select(
        "conv_id",
        F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["text"])), ""),
                 F.lit(t.close)).alias("formatted"),
        F.concat(F.flatten(F.transform("pieces", lambda p: F.array(run(p["mark"], F.lit(False)),
                                                                   run(p["text"], p["loss"])))),
                 F.array(run(F.lit(t.close), F.lit(False)))).alias("mask"))


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """(conv_id, turns, loss_texts, formatted_chars) read from (conv_id, formatted, mask).

    turns: (role, text) of each turn, unescaped, found by the marks in formatted alone.  loss_texts: the unescaped
    texts under the mask, in order; null if the mask's runs don't fall on the text's turns.
    """
    t = template
    close, more = _quoted(t.close), _quoted(t.more)
    body = F.substring("formatted", F.lit(len(t.begin) + 1), F.length("formatted"))
    blocks = F.split(body, close, -1)
    blocks = F.filter(blocks, lambda b: b != "")  # only what follows the last close is empty

    def role_of(block: Column) -> Column:
        found = unescape(F.regexp_extract(block, f"(?s)^{_quoted(t.role)}(.*?){_quoted(t.text)}", 1), t)
        for name, mark in t.opens:
            found = F.when(block.startswith(mark), F.lit(name)).otherwise(found)
        return found

    def texts_of(block: Column) -> Column:
        marks = "|".join([*(_quoted(m) for _, m in t.opens), f"{_quoted(t.role)}.*?{_quoted(t.text)}"])
        return F.split(F.regexp_replace(block, f"(?s)\\A(?:{marks})", ""), more, -1)

    raw = formatted.select(
        "conv_id", "mask", _chars(F.col("formatted")).alias("formatted_chars"),
        F.flatten(F.transform(blocks, lambda b: F.transform(
            texts_of(b), lambda x: F.struct(role_of(b).alias("role"), x.alias("text"))))).alias("raw"))
    under = F.zip_with("raw", F.filter("mask", lambda m, i: i % 2 == 1), lambda r, m: F.struct(
        r["text"].alias("text"), m["loss"].alias("loss"), (m["chars"] == _chars(r["text"])).alias("fits")))
    laid = raw.withColumn("under", under)
    fits = (F.forall("under", lambda u: F.coalesce(u["fits"], F.lit(False)))
            & (F.aggregate("mask", F.lit(0).cast("long"), lambda n, m: n + m["chars"]) == F.col("formatted_chars")))
    return laid.select(
        "conv_id",
        F.transform("raw", lambda r: F.struct(r["role"].alias("role"), unescape(r["text"], t).alias("text"))).alias("turns"),
        F.when(fits, F.transform(F.filter("under", lambda u: u["loss"]), lambda u: unescape(u["text"], t))).alias("loss_texts"),
        "formatted_chars")


def digest(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of what read_back reads."""
    turns = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    back = read_back(formatted, template).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.array_join("loss_texts", "").alias("loss"), "formatted_chars")
    return back.select("conv_id", "n_turns", "turns_sha256", _chars(F.col("loss")).alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def with_probe(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The rows and the two of the made conversation."""
    two = spark.range(1).select(F.explode(F.array(*(
        F.struct(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"),
                 F.lit(role).alias("role"), F.lit(PROBE_TEXT).alias("text"))
        for k, role in enumerate(("user", "assistant"))))).alias("r")).select("r.*")
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(two)


def oracle() -> str:
    """The same in DuckDB's SQL, for the default template."""
    t = DEFAULT
    place = "ORDER BY turn NULLS FIRST, role, text"

    def chars(text):
        return f"length(regexp_replace({text}, '{t.pattern(False)}', '\\1{ESCAPE}\\2\\3', 'g'))"
    opening = " ".join(f"WHEN '{name}' THEN {len(mark)}" for name, mark in t.opens)
    return f"""
WITH told AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES ({PROBE_ID}, 0, 'user', '{PROBE_TEXT}'), ({PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}')),
laid AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before FROM told
    WINDOW w AS (PARTITION BY conv_id {place})),
sized AS (SELECT *, {chars('text')} + CASE WHEN k > 1 AND role = before THEN {len(t.more)}
    ELSE CASE WHEN k = 1 THEN {len(t.begin)} ELSE {len(t.close)} END
      + CASE role {opening} ELSE {len(t.role) + len(t.text)} + {chars('role')} END END AS chars FROM laid)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' {place})) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' {place}) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) + {len(t.close)} AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""
