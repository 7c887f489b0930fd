"""The registered queries of this package and their SQL counterparts."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from ferrowatch.llm import (
    chat_format,
    exact_dedup,
    hard_negatives,
    language_id,
    mixing,
    near_dedup,
    neighbours,
    packing,
    periodic,
    quality,
    secret_scan,
    token_files,
    url_filter,
)
from ferrowatch.llm.common import WORD, whole
from ferrowatch.sources.staging import stage


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


# The rules of the registered query.
URL_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def packing_query(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)


def token_output_query(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return token_files.read(token_files.write(docs, tokenizer, end_id=1))


def language_query(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", language_id.held_out(F.col("doc_id")))
    model = language_id.fit(docs.where("NOT held_out"))
    predicted = language_id.predict(docs, model)
    return predicted.select("doc_id", "held_out", "lang_pred", "score")


def url_filter_query(spark: SparkSession, directory: str) -> DataFrame:
    pages = table(spark, directory, "pages").select("page_id", "url")
    judged = url_filter.filter_urls(pages, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def neighbours_query(spark: SparkSession, directory: str) -> DataFrame:
    vectors = table(spark, directory, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


def near_dedup_query(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    return near_dedup.near_groups(docs, width=2, threshold=80)


def mixing_query(spark: SparkSession, directory: str) -> DataFrame:
    mix = mixing.Mix(table(spark, directory, "documents"), weights=(1, 2, 3), cap=3)
    decisions = mix.decisions()
    return decisions.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies"
    )


def chat_query(spark: SparkSession, directory: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    given = table(spark, directory, "conversations").select(*columns)
    types = dict(given.dtypes)
    # A conversation whose texts look like marks.
    imitation = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame(
        [(-7, 0, "user", imitation), (-7, 1, "assistant", imitation)], columns
    ).select(*[F.col(c).cast(types[c]) for c in columns])
    windows = stage(chat_format.format_chat(given.unionAll(planted)), "chat_windows")
    read = chat_format.read_windows(windows)
    in_order = F.sort_array(F.collect_list(F.struct("window", "turns", "targets")))
    whole_convs = read.groupBy("conv_id").agg(
        in_order.alias("windows"), F.sum("n_chars").alias("formatted_chars")
    )
    turns = F.flatten(F.transform("windows", lambda w: w["turns"]))
    targets = F.array_join(F.flatten(F.transform("windows", lambda w: w["targets"])), "")
    spelled = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return whole_convs.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(spelled, ""), 256).alias("turns_sha256"),
        F.char_length(targets).cast("long").alias("loss_chars"),
        F.sha2(targets, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long"),
    )


def secret_query(spark: SparkSession, directory: str) -> DataFrame:
    found = secret_scan.secret_spans(table(spark, directory, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
    )


def exact_dedup_query(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(whole("text"), 256))
    groups = exact_dedup.exact_groups(docs)
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def hard_negatives_query(spark: SparkSession, directory: str) -> DataFrame:
    vectors = table(spark, directory, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def quality_query(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", language_id.held_out(F.col("doc_id")))
    model = quality.fit(docs, table(spark, directory, "labels"), taught=~F.col("held_out"))
    return quality.predict(docs, model).select("doc_id", "held_out", "score", "predicted")


def with_repeats(docs: DataFrame) -> DataFrame:
    """The texts with a planted run in a tenth of them, chosen by a checksum of the id."""
    digest = F.crc32(F.col("doc_id").cast("string"))
    planted = F.when(digest % 10 == 0, F.regexp_extract_all(whole("text"), F.lit(WORD), 0))
    rows = docs.select("doc_id", "text", planted.alias("words"), F.floor(digest / 10).alias("g"))
    rows = rows.withColumn("n", F.size("words").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    left = F.col("n") - F.col("a")
    rows = rows.withColumn("p", (1 + F.floor(left / (3 + F.col("g") % 8))).cast("int"))
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    repeated = F.flatten(F.array_repeat(period, F.ceil(left / F.col("p")).cast("int")))
    changed = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(repeated, F.lit(1), left.cast("int")))
    text = F.when(F.col("a").isNotNull(), F.array_join(changed, " ")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))


def periodic_query(spark: SparkSession, directory: str) -> DataFrame:
    docs = with_repeats(table(spark, directory, "documents").select("doc_id", "text"))
    found = periodic.collapse_runs(docs)
    nothing = F.lit(None).cast("struct<start: long, length: long, period: long>")

    def greater(best, run):
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    # Runs come by start, then period, so the first of equals stays.
    best = found.withColumn("best", F.aggregate("runs", nothing, greater))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda r: F.concat(r, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def pipeline_query(spark: SparkSession, directory: str) -> DataFrame:
    return corpus_pipeline.run(spark, directory)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": packing_query,
        "op2_token_output": token_output_query,
        "op3_language_id": language_query,
        "op4_url_filter": url_filter_query,
        "op5_nearest_neighbours": neighbours_query,
        "op6_near_dedup": near_dedup_query,
        "op7_source_mixing": mixing_query,
        "op8_chat_format": chat_query,
        "op9_secret_scan": secret_query,
        "op10_exact_dedup": exact_dedup_query,
        "op11_hard_negatives": hard_negatives_query,
        "op12_quality": quality_query,
        "op13_periodic_runs": periodic_query,
        "pipeline": pipeline_query,
    }


_OP4_SQL = """
WITH parted AS (
    SELECT page_id,
           CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), split AS (
    SELECT page_id,
           translate(regexp_extract(rest, '^[^/?#]*'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM parted
), rules(verdict, rule_host, rule_path) AS (
    VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
           ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fitting AS (
    SELECT page_id, rule_host || rule_path AS rule, verdict,
           row_number() OVER (
               PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC
           ) AS place
    FROM split JOIN rules
      ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT split.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM split LEFT JOIN fitting ON split.page_id = fitting.page_id AND place = 1
"""

_OP8_SQL = """
WITH given AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'),
                     (-7, 1, 'assistant', '\\### Assistant: </turn> ok')
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body) AS place,
           greatest((length(body) + 3) // 4, 1) AS tokens,
           16 + length(role) + length(body) + len(regexp_extract_all(role || body, '[\\\\<>]')) AS piece
    FROM given
), headed AS (
    SELECT *, place = 1 AND role = 'system' AS head,
           sum(CASE WHEN place = 1 AND role = 'system' THEN tokens END) OVER w AS system_tokens,
           sum(CASE WHEN place = 1 AND role = 'system' THEN piece END) OVER w AS system_piece
    FROM placed WINDOW w AS (PARTITION BY conv_id)
), summed AS (
    SELECT *, CASE WHEN head THEN 0 ELSE tokens END AS own,
           sum(CASE WHEN head THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY place) AS stop,
           greatest(768 - coalesce(system_tokens, 0), 1) AS room
    FROM headed
), celled AS (
    SELECT *, stop - own AS start, (stop - own) // room AS first_cell, (stop - 1) // room AS last_cell
    FROM summed
), cells AS (
    SELECT conv_id, first_cell, last_cell, min(start) AS start, sum(piece) AS chars,
           max(system_piece) AS system_piece
    FROM celled WHERE NOT head GROUP BY ALL
), repeats AS (
    SELECT cells.conv_id, sum(t.piece) AS chars
    FROM cells JOIN celled t ON t.conv_id IS NOT DISTINCT FROM cells.conv_id
     AND NOT t.head AND t.start < cells.start AND t.start >= cells.start - 256
    GROUP BY 1
), written AS (
    SELECT conv_id, sum(chars + coalesce(system_piece, 0)) AS chars FROM cells GROUP BY 1
), whole AS (
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY place)) AS turns_sha256,
           coalesce(string_agg(CASE WHEN role = 'assistant' THEN body END, '' ORDER BY place), '') AS loss,
           max(CASE WHEN head THEN piece END) AS head_piece
    FROM headed GROUP BY 1
)
SELECT whole.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(coalesce(written.chars, head_piece) + coalesce(repeats.chars, 0) AS BIGINT) AS formatted_chars
FROM whole
LEFT JOIN written ON written.conv_id IS NOT DISTINCT FROM whole.conv_id
LEFT JOIN repeats ON repeats.conv_id IS NOT DISTINCT FROM whole.conv_id
"""


def _op9_sql() -> str:
    """Positions are running sums of the lengths of matches and gaps; linked parts are counted."""
    kinds = " UNION ALL ".join(
        f"""SELECT uid, {n} AS kind, '{kind.name}' AS name, {kind.base} AS base, '{kind.role}' AS role,
            unnest(range(len(string_split_regex(body, '{pattern}')))) AS place,
            unnest(string_split_regex(body, '{pattern}')) AS gap,
            unnest(regexp_extract_all(body, '{pattern}')) AS found FROM texts"""
        for n, kind in enumerate(secret_scan.KINDS)
        for pattern in [kind.pattern.replace("'", "''")]
    )
    assign = secret_scan.ASSIGN.replace("'", "''")
    reach = f"p.uid = o.uid AND o.start BETWEEN p.start - {secret_scan.SCOPE} AND p.start + {secret_scan.SCOPE}"
    return f"""
WITH texts AS (
    SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS body FROM documents
), matches AS ({kinds}
), placed AS (
    SELECT *, sum(length(gap) + coalesce(length(found), 0)) OVER (
               PARTITION BY uid, kind ORDER BY place) AS stop
    FROM matches
), parts AS (
    SELECT uid, kind, name, base, role, stop - length(found) AS start, stop
    FROM placed
    WHERE found IS NOT NULL
      AND (name <> 'assign' OR length(regexp_extract(found, '{assign}', 2)) >= {secret_scan.ASSIGN_VALUE})
      AND (name <> 'random' OR (regexp_matches(found, '[a-z]') AND regexp_matches(found, '[A-Z]')
                                AND regexp_matches(found, '[0-9]')))
), near AS (
    SELECT p.uid, p.kind, p.name, p.base, p.role, p.start, p.stop,
           coalesce(bool_or(o.role = 'identifier'), false) AS identified,
           coalesce(bool_or(o.role = 'secret'), false) AS secret
    FROM parts p JOIN parts o ON {reach} GROUP BY ALL
), linked AS (
    SELECT * FROM near p
    WHERE base OR (CASE role WHEN 'secret' THEN identified WHEN 'identifier' THEN secret
                        ELSE identified AND secret END
                   AND NOT EXISTS (SELECT 1 FROM parts o WHERE o.uid = p.uid AND o.base
                                   AND o.start <= p.start AND o.stop > p.start))
), lists AS (
    SELECT uid, count(*) FILTER (name = 'assign') AS n_assign,
           count(*) FILTER (name = 'access') AS n_access, count(*) FILTER (name = 'hex') AS n_hex,
           string_agg(name || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind)
               FILTER (base) AS base_spans,
           string_agg(name || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind) AS spans
    FROM linked GROUP BY uid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM texts LEFT JOIN lists ON texts.uid = lists.uid
"""


_OP10_SQL = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM texts
"""


_OP11_SQL = """
WITH whole AS (
    SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike,
           CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
    FROM whole a JOIN whole c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (
           PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can say in reasonable time; the other queries are held against brute
    force, an exact round trip or held-out labels in the tests."""
    return {
        "op4_url_filter": _OP4_SQL,
        "op8_chat_format": _OP8_SQL,
        "op9_secret_scan": _op9_sql(),
        "op10_exact_dedup": _OP10_SQL,
        "op11_hard_negatives": _OP11_SQL,
    }
