r"""Chat formatting by a grammar round trip [native].

A turn is rendered as `### ROLE: TEXT</turn>` and a line feed. The role is URL-encoded, so it holds no colon. The parser is
deterministic: text is cut before every `### ` and at every `</turn>` with a line feed if one follows; in each cut, the first
colon ends the header. Each turn is rendered and parsed alone: where the recovered turn isn't its source, its text is escaped
(a backslash doubled; `</turn>` as `<\/turn>`, `### ` as `##\# `), its header gets a backslash before the colon, and it is
parsed again; a turn that still differed would stop the query. Every cut begins and ends with its turn, so a conversation
parses as its turns do, and no task needs a whole conversation but to join its text.

Output: conv_id, formatted, and the loss mask: for each assistant turn its number, where its rendered text begins in its turn and
in the conversation, and its length, in code points.

Defined results: a null text or role is empty. Turns go by turn (null first), then role and text; rows that repeat are turns
each. A null conv_id is a conversation. An empty table gives no rows. Columns other than those four are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, read, written

END, HEAD = "</turn>", "### "


def turns_of(table: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(column(table, c, "string"), F.lit(""))
    return table.select(column(table, "conv_id", "bigint").alias("conv_id"), column(table, "turn", "bigint").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))


def escaped(text):
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(END), F.lit("<\\/turn>")), F.lit(HEAD), F.lit("##\\# "))


def unescaped(text):
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def head(role, is_escaped):
    return F.concat(F.lit(HEAD), F.url_encode(role), F.when(is_escaped, F.lit("\\")).otherwise(F.lit("")), F.lit(": "))


def cuts(formatted):
    return F.filter(F.split(formatted, r"(?=### )|</turn>\n?"), lambda x: x != "")


def parsed(formatted):
    """The turns in a formatted text: role, text, and the text as it stands there."""

    def turn(cut):
        name = F.substring_index(cut, ":", 1)
        marked = F.endswith(name, F.lit("\\"))
        # A cut that isn't a turn has a null role.
        role = F.when(F.startswith(cut, F.lit(HEAD)), F.try_url_decode(F.regexp_extract(name, r"^### ([^\\]*)", 1)))
        body = F.substr(cut, F.length(name) + 3)
        return F.struct(role.alias("role"), F.when(marked, unescaped(body)).otherwise(body).alias("text"), body.alias("body"))

    return F.transform(cuts(formatted), turn)


def format_conversations(table: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, loss (array of turn, begin, start, length)."""
    t = turns_of(table)
    render = lambda flag, body: F.concat(head(F.col("role"), flag), body, F.lit(END + "\n"))

    def same(rendered):
        p = parsed(rendered)
        first = F.try_element_at(p, F.lit(1))
        return (F.size(p) == 1) & F.coalesce((first["role"] == F.col("role")) & (first["text"] == F.col("text")), F.lit(False))

    t = t.withColumn("raw", render(F.lit(False), F.col("text")))
    t = t.withColumn("is_escaped", ~same(F.col("raw")))
    t = t.withColumn("rendered", F.when(F.col("is_escaped"), render(F.lit(True), escaped(F.col("text")))).otherwise(F.col("raw")))
    t = t.withColumn("rendered", F.when(~F.col("is_escaped") | same(F.col("rendered")), F.col("rendered")).otherwise(F.raise_error(F.lit("a turn doesn't survive its round trip"))))
    t = t.withColumn("begin", F.length(head(F.col("role"), F.col("is_escaped"))))
    t = t.withColumn("length", F.length("rendered") - F.col("begin") - len(END) - 1)
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumn("nth", F.row_number().over(w)).withColumn("before", F.sum(F.length("rendered")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    one = F.struct("nth", "rendered", "role", "begin", (F.coalesce("before", F.lit(0)) + F.col("begin")).alias("start"), "length")
    t = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    mask = F.transform(F.filter("turns", lambda x: x["role"] == "assistant"), lambda x: F.struct(x["nth"].alias("turn"), x["begin"].alias("begin"), x["start"].alias("start"), x["length"].alias("length")))
    return t.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.concat_ws("", F.transform("turns", lambda x: x["rendered"])).alias("formatted"), mask.alias("loss"))


def read_back(output: DataFrame) -> DataFrame:
    """Digests of what the parser recovers from formatted texts and their masks."""
    p = output.select("conv_id", "formatted", "loss", parsed(F.col("formatted")).alias("turns"))
    p = p.withColumn("cuts", cuts(F.col("formatted")))
    whole = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))

    def masked(m):
        cut = F.element_at("cuts", m["turn"])
        under = F.substr(cut, m["begin"] + 1, m["length"])
        return F.when(F.endswith(F.substring_index(cut, ":", 1), F.lit("\\")), unescaped(under)).otherwise(under)

    p = p.withColumn("under", F.concat_ws("", F.transform("loss", masked)))
    return p.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("under").cast("bigint").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = r"\### Assistant: </turn> ok"
    more = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(k).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit(own).alias("text")) for k, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    table = turns_of(read(spark, sf_dir, "conversations")).unionByName(more)
    return read_back(written(format_conversations(table), "chats"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
r AS (
  SELECT *, CASE WHEN contains(text, '### ') OR contains(text, '</turn>')
    THEN 1 + length(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '##\# ')) ELSE length(text) END
    + length('### ' || url_encode(role) || ': ' || '</turn>') + 1 AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
