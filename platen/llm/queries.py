"""The registered queries of the corpus operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.llm import alignment, bpe, chat, decontaminate, language, licenses, negatives, quality, simhash, toxicity, unigram, urls, warc
from platen.llm.common import LOWER, UPPER, sha256_hex, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha256_hex(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


#: The conversation that op5 adds: control strings in both of its texts.
CHAT_EXTRA = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT CAST(conv_id AS BIGINT), CAST(turn AS BIGINT), role, text FROM VALUES {', '.join(map(str, CHAT_EXTRA))} AS t(conv_id, turn, role, text)")
    turns = turns.unionByName(extra)
    read = chat.read_back(chat.format_conversations(turns))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    read = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), told.alias("told"), F.array_join("learned", "").alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", sha256_hex(F.col("told")).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), sha256_hex(F.col("learned")).alias("loss_sha256"), "formatted_chars")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")
    both = bpe.encode(table(spark, sf_dir, "documents"), path, with_decoded=True)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), sha256_hex(F.col("decoded")).alias("decoded_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


#: Rules of op8: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


#: A score from which a document is predicted toxic.
TOXIC = 0.3


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "spans")


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def held_out(parts: int, part: int) -> Column:
    """Whether a hash of the id says so; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, F.lit(False))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.train(docs, ~held_out(3, 1)))
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc, "op2_simhash": op2_simhash, "op3_licenses": op3_licenses, "op4_decontaminate": op4_decontaminate, "op5_chat": op5_chat, "op6_bpe": op6_bpe,
    "op7_quality": op7_quality, "op8_urls": op8_urls, "op9_toxicity": op9_toxicity, "op10_tokens": op10_tokens,
    "op11_language": op11_language, "op12_alignment": op12_alignment, "op13_negatives": op13_negatives,
}


def _escaped(column: str, template: chat.Template = chat.Template()) -> str:  # noqa: B008
    sql = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    for mark in template.controls:
        sql = f"replace({sql}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return sql


_T = chat.Template()
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_SMALL_WORDS = rf"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
_LIMITS = quality.Limits()

ORACLES: dict[str, str] = {
    "op13_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (
            SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same)
            WHERE n <= 5),
        g AS (
            SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
                   CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
            FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM g WHERE rank <= 5""",
    "op8_urls": f"""
        WITH urls AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
                   coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
            FROM pages),
        rules(r_host, r_path, r_verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
        fits AS (
            SELECT page_id, r_host || r_path AS rule, r_verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC) AS n
            FROM urls JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
        SELECT urls.page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict
        FROM urls LEFT JOIN (SELECT * FROM fits WHERE n = 1) f ON urls.page_id = f.page_id""",
    "op4_decontaminate": f"""
        WITH w AS (SELECT doc_id, {_SMALL_WORDS} AS words FROM documents),
        b AS (SELECT item_id, {_SMALL_WORDS} AS words FROM benchmark),
        wins AS (
            SELECT DISTINCT item_id, array_to_string(words[s:s + 9], ' ') AS win, least(len(words), 10) AS n
            FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS s FROM b WHERE len(words) > 0)),
        p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM w),
        spans AS (SELECT doc_id, pos, n, array_to_string(words[pos:pos + n - 1], ' ') AS win FROM p, (SELECT DISTINCT n FROM wins) WHERE pos + n - 1 <= len(words)),
        found AS (SELECT doc_id, pos, spans.n, item_id FROM spans JOIN wins ON spans.win = wins.win),
        hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS k FROM found) GROUP BY doc_id),
        own AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN hit ON w.doc_id = hit.doc_id LEFT JOIN own ON w.doc_id = own.doc_id""",
    "op5_chat": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES {", ".join(str(r) for r in CHAT_EXTRA)})),
        m AS (
            SELECT *, coalesce(lag(role) OVER o <> role, true) AS first, {_escaped("role")} AS e_role, {_escaped("text")} AS e_text
            FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(e_text) + CASE WHEN first THEN length(e_role) + {len(_T.open + _T.role_end + _T.close)} ELSE {len(_T.between)} END) AS BIGINT) AS formatted_chars
        FROM m GROUP BY conv_id""",
    "op7_quality": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host, {_WORDS} AS words FROM documents),
        l AS (
            SELECT doc_id, host, unnest(raw) AS raw
            FROM (SELECT doc_id, host, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS raw FROM d)),
        h AS (
            SELECT doc_id, host, raw, md5(trim(regexp_replace(lower(raw), '[0-9]+', '0', 'g'), ' ')) AS line,
                   len(list_filter(string_split_regex(raw, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS n
            FROM l),
        own AS (SELECT doc_id, host, line, sum(n) AS n FROM h GROUP BY ALL),
        copies AS (
            SELECT doc_id, md5(array_to_string(list_transform(list_filter(string_split(regexp_replace(lower(text), '[0-9]+', '0', 'g'), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')), lambda x: md5(trim(x, ' '))), ' ')) AS copy
            FROM d),
        held AS (SELECT host, line, count(DISTINCT copy) AS n FROM own JOIN copies ON own.doc_id = copies.doc_id GROUP BY host, line),
        often AS (
            SELECT held.host, line FROM held JOIN (SELECT host, count(*) AS n FROM d GROUP BY host) t ON held.host = t.host
            WHERE held.n > {_LIMITS.least_docs} AND held.n > {_LIMITS.share_of_host} * t.n),
        gone AS (SELECT doc_id, sum(n) AS n FROM own JOIN often ON own.host = often.host AND own.line = often.line GROUP BY doc_id),
        dups AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM h GROUP BY doc_id),
        win AS (
            SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS c
            FROM (SELECT doc_id, pos, array_to_string(words[pos:pos + 7], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS pos FROM d))),
        reps AS (SELECT doc_id, sum(gap) AS n FROM (SELECT doc_id, least(8, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - pos, 8)) AS gap FROM win WHERE c > 1) GROUP BY doc_id),
        m AS (
            SELECT d.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   coalesce(dups.n, 0) AS n_dup_lines, coalesce(reps.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_removed_words
            FROM d LEFT JOIN dups ON d.doc_id = dups.doc_id LEFT JOIN reps ON d.doc_id = reps.doc_id LEFT JOIN gone ON d.doc_id = gone.doc_id)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
               CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_removed_words AS BIGINT) AS n_removed_words,
               n_words < {_LIMITS.least_words} OR 100 * n_repeat_words > {_LIMITS.repeat_percent} * n_words AS base_failed,
               NOT (n_words < {_LIMITS.least_words} OR 100 * n_repeat_words > {_LIMITS.repeat_percent} * n_words)
                   AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < {_LIMITS.least_left} OR n_words - n_removed_words < {_LIMITS.share_left} * n_words)) AS kept
        FROM m""",
}
