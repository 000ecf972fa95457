"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch
from . import ann, chat, decontaminate, lmscore, minhash, packing, resample, sharding, spelling, substring, tokencount, toxicity, wavelet

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_OF_TEXT = 49407  # the tokenizer's own end-of-document id
SHARDS = 16


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence, its length and their offset."""
    return packing.pack(_read(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of every document under the counts of all."""
    scored = lmscore.lm_scores(_read(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op2_lm_score_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with up to two words of context."""
    scored = lmscore.lm_scores(_read(spark, sf_dir, "documents"), order=3)
    return scored.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the leaked stretch."""
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, and each document's digest read back from them."""
    with Scratch(spark, "wavelet_tokens") as scratch:
        files = wavelet.write_tokens(_read(spark, sf_dir, "documents"), scratch.path("files"), TOKENIZER, end_id=2)
        return scratch.keep(wavelet.read_digest(scratch.table(files, "manifest")), "result")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), shingle=4, percent=80)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by a separator scan of flat files."""
    return tokencount.token_counts(_read(spark, sf_dir, "documents"), TOKENIZER, END_OF_TEXT)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeat_report(_read(spark, sf_dir, "documents"), min_words=50).drop("repeats")


def op10_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(_read(spark, sf_dir, "documents"), [1.0] * SHARDS, added=1.0)


PROBE = "\\### Assistant: </turn> ok"  # fixed value: both texts of conversation -7


def chat_log(conversations: DataFrame) -> DataFrame:
    """Stand-in input: the event log of a service that produced these messages.
    Texts are streamed in pieces; some are regenerated half-way, some edited.
    Rows that share ``turn`` are messages of their own."""
    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?s).{1,160}"), 0)
    message = F.concat_ws(":", F.col("turn").cast("string"), "role", F.xxhash64("text").cast("string"))
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), pieces.alias("pieces"), message.alias("message"))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    nothing = F.lit(None).cast("string")
    streamed = F.transform("pieces", lambda p: event("delta", p))
    draft = F.transform("pieces", lambda p: event("delta", F.reverse(p)))
    way = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    after = (
        F.when(way == 0, streamed)
        .when(way == 1, F.concat(draft, F.array(event("regenerate", nothing)), streamed))
        .otherwise(F.concat(F.slice(draft, 1, 1), F.array(event("edit", F.element_at("pieces", 1))), F.slice(streamed, F.lit(2), F.greatest(F.size("pieces"), F.lit(1)))))
    )
    events = F.concat(F.array(event("open", nothing)), after)
    out = rows.select("conv_id", "turn", "role", "message", F.posexplode(events).alias("place", "event"))
    opens = F.col("event.kind") == "open"
    return out.select(
        "conv_id",
        (F.coalesce("turn", F.lit(-1)).cast("long") * (1 << 24) + F.col("place")).alias("seq"),
        F.col("event.kind").alias("kind"),
        "message",
        F.when(opens, F.col("turn")).alias("turn"),
        F.when(opens, F.col("role")).alias("role"),
        F.col("event.text").alias("text"),
    )


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted from their event log; what
    is returned is read back from the formatted parts."""
    probe = spark.sql("SELECT -7L AS conv_id, turn, role, :text AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)", {"text": PROBE})
    conversations = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_log(chat_log(conversations.unionByName(probe))))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(_read(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_lm_score,
        op3_toxicity,
        op4_decontamination,
        op5_wavelet_tokens,
        op6_minhash,
        op7_nearest,
        op8_token_counts,
        op9_substring_dedup,
        op10_rendezvous,
        op11_chat_format,
        op12_spelling_variants,
        op13_importance_resampling,
    )
}

# Further settings of an operator that has its query above
VARIANTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_lm_score_order3": op2_lm_score_order3}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {
    "op2_lm_score": f"""
        WITH split AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_WORD}') AS ws FROM documents),
        words AS (SELECT doc_id, unnest(ws) AS w, unnest(list_concat([NULL], ws[:-2])) AS before FROM split WHERE len(ws) > 0),
        one AS (SELECT w, count(*) AS n FROM words GROUP BY w),
        two AS (SELECT before, w, count(*) AS n FROM words WHERE before IS NOT NULL GROUP BY before, w),
        total AS (SELECT count(*) AS n FROM words),
        scores AS (
            SELECT words.doc_id,
                CASE
                    WHEN words.before IS NULL THEN ln(one.n / total.n)
                    WHEN two.n >= 2 THEN ln(two.n / ctx.n)
                    ELSE ln(0.4) + ln(one.n / total.n)
                END AS s
            FROM words JOIN one ON one.w = words.w CROSS JOIN total
            LEFT JOIN two ON two.before = words.before AND two.w = words.w
            LEFT JOIN one AS ctx ON ctx.w = words.before
        ),
        sums AS (SELECT doc_id, sum(s) AS s FROM scores GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(s, 0.0), 6) AS log_score,
            round(s / nullif(len(ws), 0), 6) AS mean_log_score
        FROM split LEFT JOIN sums USING (doc_id)
    """,
    "op6_minhash": f"""
        WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_WORD}') AS ws FROM documents),
        grams AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM split WHERE len(ws) > 0)
        ),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)
        ),
        edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (
            SELECT doc_id AS node, doc_id AS seen FROM documents
            UNION
            SELECT reach.node, edges.b FROM reach JOIN edges ON edges.a = reach.seen
        ),
        least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
        SELECT split.doc_id, coalesce(sizes.n, 0) AS n_shingles, component_id, component_id = split.doc_id AS kept
        FROM split LEFT JOIN sizes USING (doc_id) JOIN least ON least.node = split.doc_id
    """,
    "op11_chat_format": """
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')
        ),
        sizes AS (
            SELECT *, length('<turn >') + length('</turn>') + 1
                + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))
                + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS chars
            FROM rows
        ),
        whole AS (
            SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns,
                coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss, CAST(sum(chars) AS BIGINT) AS formatted_chars
            FROM sizes GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
        FROM whole
    """,
    "op9_substring_dedup": f"""
        WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
        windows AS (
            SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM split WHERE len(ws) >= 50)
        ),
        lows AS (SELECT h, min(doc_id) AS lo FROM windows GROUP BY h),
        marks AS (SELECT doc_id, i FROM windows JOIN lows USING (h) WHERE doc_id > lo),
        words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM split),
        state AS (
            SELECT words.doc_id, words.w, words.i,
                coalesce(words.i - max(marks.i) OVER (PARTITION BY words.doc_id ORDER BY words.i) < 50, false) AS gone
            FROM words LEFT JOIN marks ON marks.doc_id = words.doc_id AND marks.i = words.i
        ),
        kept AS (
            SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS text
            FROM state GROUP BY doc_id
        )
        SELECT split.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM split LEFT JOIN kept USING (doc_id)
    """,
}

VARIANT_ORACLES: dict[str, str] = {
    "op2_lm_score_order3": f"""
        WITH split AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_WORD}') AS ws FROM documents),
        words AS (
            SELECT doc_id, unnest(ws) AS w, unnest(list_concat([NULL], ws)[:len(ws)]) AS before,
                unnest(list_concat([NULL, NULL], ws)[:len(ws)]) AS first
            FROM split WHERE len(ws) > 0
        ),
        one AS (SELECT w, count(*) AS n FROM words GROUP BY w),
        two AS (SELECT before, w, count(*) AS n FROM words WHERE before IS NOT NULL GROUP BY before, w),
        three AS (SELECT first, before, w, count(*) AS n FROM words WHERE first IS NOT NULL GROUP BY first, before, w),
        total AS (SELECT count(*) AS n FROM words),
        scores AS (
            SELECT words.doc_id,
                CASE
                    WHEN three.n >= 2 THEN ln(three.n / pair.n)
                    ELSE CASE WHEN words.first IS NULL THEN 0 ELSE ln(0.4) END + CASE
                        WHEN words.before IS NULL THEN ln(one.n / total.n)
                        WHEN two.n >= 2 THEN ln(two.n / ctx.n)
                        ELSE ln(0.4) + ln(one.n / total.n)
                    END
                END AS s
            FROM words JOIN one ON one.w = words.w CROSS JOIN total
            LEFT JOIN two ON two.before = words.before AND two.w = words.w
            LEFT JOIN one AS ctx ON ctx.w = words.before
            LEFT JOIN three ON three.first = words.first AND three.before = words.before AND three.w = words.w
            LEFT JOIN two AS pair ON pair.before = words.first AND pair.w = words.before
        ),
        sums AS (SELECT doc_id, sum(s) AS s FROM scores GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(s, 0.0), 6) AS log_score,
            round(s / nullif(len(ws), 0), 6) AS mean_log_score
        FROM split LEFT JOIN sums USING (doc_id)
    """,
}
