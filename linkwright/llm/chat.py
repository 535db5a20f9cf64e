"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as assistant and
the others as named users, together with the spans a loss mask keeps: what the assistant says, its
end mark included. A system turn is rendered as system from every perspective and is no participant,
unless a conversation has nobody else (then nothing is rendered for it).

A rendering comes in chunks, so that no conversation has to fit a task: turn // CHUNK_TURNS names the
chunk, and more than CHUNK_TURNS rows with such turns (ties, repeats) go on in further parts. Chunks joined
in order of (chunk, part) are the whole rendering; spans count code points within their chunk.

Defined results: null role speaks as "unknown" (an empty role too), null text is empty, null turns come
first (chunk null), ties go by role and text, repeated rows are rendered as often as they stand, control marks in
a text or a name are broken up by a space so that no turn can forge another, an empty table gives no
rows; further columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK_TURNS = 64
SYSTEM = "system"
START, END = "<|im_start|>", "<|im_end|>"


def _safe(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _speaker(role_col: str) -> Column:
    return F.coalesce(F.nullif(F.col(role_col), F.lit("")), F.lit("unknown"))


def chunks_of_turns(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """(conv_id, chunk, part, says: array of (place, speaker, body)), no array longer than chunk_turns.

    The one shuffle of texts is by conversation and chunk, so a long conversation is dealt over many tasks.
    """
    base = turns.select(F.col(conv_col).alias("conv_id"), F.floor(F.col(turn_col) / chunk_turns).cast("long").alias("chunk"), F.col(turn_col).alias("turn"), _speaker(role_col).alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    order = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), "speaker", "body")
    return (
        base.withColumn("place", F.row_number().over(order) - 1)
        .withColumn("part", F.floor(F.col("place") / chunk_turns).cast("int"))
        .groupBy("conv_id", "chunk", "part")
        .agg(F.array_sort(F.collect_list(F.struct("place", "speaker", "body"))).alias("says"))
    )


def rotate_perspectives(turns: DataFrame, **options) -> DataFrame:
    """One row per conversation, participant and chunk: (conv_id, perspective, chunk, part, n_turns, rendered, spans).

    Participants are the distinct (conversation, speaker) of the turns, found without their texts, before they meet the chunks.
    """
    chunks = chunks_of_turns(turns, **options)
    named = turns.select(F.col(options.get("conv_col", "conv_id")).alias("of_conv"), _speaker(options.get("role_col", "role")).alias("speaker"))
    speakers = named.filter(F.col("speaker") != SYSTEM).distinct().groupBy("of_conv").agg(F.array_sort(F.collect_list("speaker")).alias("speakers"))
    rows = chunks.join(speakers, F.col("conv_id").eqNullSafe(F.col("of_conv"))).select("conv_id", "chunk", "part", "says", F.explode("speakers").alias("perspective"))

    def head(s: Column) -> Column:
        who = F.when(s["speaker"] == F.col("perspective"), F.lit("assistant")).when(s["speaker"] == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), _safe(F.regexp_replace(s["speaker"], r"\s", "_"))))
        return F.concat(F.lit(START), who, F.lit("\n"))

    said = F.transform("says", lambda s: F.struct(head(s).alias("head"), F.concat(_safe(s["body"]), F.lit(END)).alias("body"), (s["speaker"] == F.col("perspective")).alias("learn")))
    rows = rows.withColumn("said", said)
    ends = F.aggregate(
        "said",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + F.length(s["head"]) + F.length(s["body"]) + 1).alias("at"),
            F.when(s["learn"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(s["head"])).alias("begin"), (acc["at"] + F.length(s["head"]) + F.length(s["body"])).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    rendered = F.array_join(F.transform("said", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "")
    return rows.select("conv_id", "perspective", "chunk", "part", F.size("said").alias("n_turns"), rendered.alias("rendered"), ends["spans"].alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["begin"].cast("string"), F.lit(":"), s["end"].cast("string"))), " ")
    return rotate_perspectives(turns).select("conv_id", "perspective", "chunk", "part", "n_turns", "rendered", F.length("rendered").alias("n_chars"), spans.alias("spans"))


ORACLE = r"""
WITH base AS (
  SELECT conv_id, CAST(floor(turn / 64.0) AS BIGINT) AS chunk, turn, coalesce(nullif(role, ''), 'unknown') AS speaker, coalesce(text, '') AS body FROM conversations
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, chunk ORDER BY turn NULLS FIRST, speaker, body) - 1 AS place FROM base
), seen AS (
  SELECT p.conv_id, s.perspective, p.chunk, CAST(p.place // 64 AS INTEGER) AS part, p.place, p.speaker = s.perspective AS learn,
    '<|im_start|>' || CASE WHEN p.speaker = s.perspective THEN 'assistant' WHEN p.speaker = 'system' THEN 'system' ELSE 'user name=' || replace(regexp_replace(p.speaker, '\s', '_', 'g'), '<|', '< |') END || chr(10) AS head,
    replace(p.body, '<|', '< |') || '<|im_end|>' AS said
  FROM placed p JOIN (SELECT DISTINCT conv_id, speaker AS perspective FROM base WHERE speaker <> 'system') s ON p.conv_id IS NOT DISTINCT FROM s.conv_id
), spaced AS (
  SELECT *, coalesce(sum(length(head) + length(said) + 1) OVER (PARTITION BY conv_id, perspective, chunk, part ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM seen
)
SELECT conv_id, perspective, chunk, part, CAST(count(*) AS INTEGER) AS n_turns, string_agg(head || said || chr(10), '' ORDER BY place) AS rendered,
  CAST(sum(length(head) + length(said) + 1) AS INTEGER) AS n_chars,
  coalesce(string_agg(CAST(begins + length(head) AS BIGINT) || ':' || CAST(begins + length(head) + length(said) AS BIGINT), ' ' ORDER BY place) FILTER (learn), '') AS spans
FROM spaced GROUP BY conv_id, perspective, chunk, part
"""
