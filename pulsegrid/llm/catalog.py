"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.llm import (chat, config_packing, filter_audit, fingerprints, jaccard_join, mixing, packing,
                           piece_table, quality_rules, secret_scan, token_counts, toxicity, warc)
from pulsegrid.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_pieces() -> dict:
    """The byte-level vocabulary as a rank file, with the special strings of its JSON form."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json")) as file:
        added = json.load(file)["added_tokens"]
    return {"ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN,
            "special": {t["content"]: t["id"] for t in added}}


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


# A conversation that is full of control strings.
HARD_TURN = r"\### Assistant: </turn> ok"


def op2_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TURN).alias("text"))
    return chat.read_back(chat.format_turns(turns.unionByName(hard)))


def op3_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"))


def op4_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), **byte_pieces(), keep_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_version_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_versions(table(spark, sf_dir, "documents"))


def op6_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(table(spark, sf_dir, "documents"), count_links=False)


def op8_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the number of links of each document."""
    return jaccard_join.link_documents(table(spark, sf_dir, "documents"))


def op9_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (mixing.mix(table(spark, sf_dir, "documents"))
            .select("doc_id", "size", "source_size", "target", "taken"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = config_packing.pack_best_fit(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    arranged = piece_table.fill_in_middle(table(spark, sf_dir, "documents"))
    return piece_table.restore_middle(arranged).drop("text")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


QUERIES = {f.__name__: f for f in (
    op1_warc_revisits, op2_chat_round_trip, op3_secret_spans, op4_power_of_two_packing,
    op5_version_fingerprints, op6_toxicity_scores, op7_quality_rules, op8_jaccard_components,
    op8_link_counts, op9_pivotal_mix, op10_token_counts,
    op11_best_fit_packing, op12_fill_in_middle, op13_filter_audit)}

ORACLES = {
    "op1_warc_revisits": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS s FROM pages),
        f AS (SELECT s, min(page_id) AS first FROM p WHERE b >= 100 GROUP BY s)
        SELECT page_id, b AS payload_bytes, s AS payload_digest,
               CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first THEN first END AS refers_to
        FROM p LEFT JOIN f USING (s)""",
    "op2_chat_round_trip": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('### : ') + length(role) + length(text) + length(chr(10) || '</turn>' || chr(10))
                        + (length(text) - length(replace(text, '### ', ''))) // 4
                        + (length(text) - length(replace(text, '</turn>', ''))) // 7) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op8_jaccard_components": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS MATERIALIZED (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(len(ws) - 4), lambda i: array_to_string(ws[i + 1:i + 5], ' ')) END) AS g FROM w),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        l AS MATERIALIZED (
            SELECT o.a, o.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y USING (g) GROUP BY ALL) o
            JOIN n p ON p.doc_id = o.a JOIN n q ON q.doc_id = o.b WHERE 100 * o >= 80 * (p.n + q.n - o)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
        c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id""",
    "op12_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
            FROM documents),
        l AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u,
                CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
        c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a,
                greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100
                    THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
        p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid,
                array_to_string(u[b + 1:], '') AS suf FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form,
               CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                      ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p""",
    "op13_filter_audit": r"""
        WITH g AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic
            FROM labels GROUP BY doc_id),
        t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
                 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'),
                 coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f
            FROM t LEFT JOIN g USING (doc_id)),
        c AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
        x AS (SELECT unnest(range(1, 6)) AS i),
        o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e
              WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        s AS (SELECT part, o, x.i AS step, o[x.i] AS own, n, good, toxic, f[o[x.i]] AS fails,
                list_bool_or(list_transform(o[1:x.i - 1], lambda k: f[k])) IS TRUE AS gone,
                len(list_filter(f, lambda v: v)) = 1 AS single
              FROM c, o, x),
        r AS (SELECT part, o, step, own,
                sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept,
                sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant,
                sum(CASE WHEN fails AND single THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost,
                sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost
              FROM s GROUP BY ALL)
        SELECT part, array_to_string(list_transform(o, lambda k: 'ABCDE'[k]), '') AS filter_order, CAST(step AS INT) AS step,
               CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
               CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM r""",
}

ORACLES["op8_link_counts"] = ORACLES["op8_jaccard_components"].replace(
    "SELECT d.doc_id,", "SELECT d.doc_id, coalesce(k.n_links, 0) AS n_links,") + """
        LEFT JOIN (SELECT a, count(*) AS n_links FROM l WHERE a <> b GROUP BY a) k ON k.a = d.doc_id"""
