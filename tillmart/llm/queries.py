"""The corpus operators as queries on the test tables, with production parameters: name -> (session, folder) -> rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmart.llm import (
    bpe, decontamination, exact_dedup, language, licenses, line_dedup, manifest, packing, quality, sharding, simhash, url_filter, variants,
)
from tillmart.llm.common import sha256_hex, table
from tillmart.operators.staging import stage

Query = Callable[[SparkSession, str], DataFrame]

#: Fixed values of the contract.
URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]
SHARDS = 24
VOCABULARY = "byte_bpe_50k.json"
MISSPELT, LEAST_CHARS, LEAST_TIMES = 97, 5, 3
#: A word that every licence notice holds.
LICENSE_WORD = r"(?i)\blicensed?\b"


def vocabulary_path() -> str:
    """Where the installed vocabulary file lies, on workers too."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(table(spark, sf_dir, "pages"), URL_RULES)


def jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), "doc_id", "text", SHARDS)


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of a tree of sources and languages. A row without id is named by its text.

    One that speaks of a licence is named as a notice: the licence file of its directory, if its whole text fits a licence.
    Without source or language it is none, as its directory would hold other sources or all of them.
    """
    docs = table(spark, sf_dir, "documents")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text-"), F.md5(F.coalesce("text", F.lit("")))))
    kind = F.when(F.col("source").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(LICENSE_WORD), "NOTICE-").otherwise("")
    path = F.concat_ws("/", "source", "lang", F.concat(kind, name, F.lit(".txt")))
    return licenses.scan_licenses(docs.select("doc_id", path.alias("path"), "text"), "doc_id", "path", "text")


def line_dedup_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc.doc_id", "n_lines", "n_dropped", sha256_hex(F.col("kept_text")).alias("kept_sha256"))


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, span: total + span["behind"] - span["first"])
    return rows.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"),
        sha256_hex(F.array_join("item_ids", ",")).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = quality.score_ids(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def language_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = language.predict(docs, language.fit(docs))
    return rows.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def misspelt_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts; every run whose number is divisible by MISSPELT has lost a code point. A null id counts as empty text."""
    rows = variants.runs(docs)
    number = F.crc32(F.encode(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")), "UTF-8"))
    rows = rows.where(F.char_length("run") >= LEAST_CHARS).select("run", number.alias("h"))
    shorter = variants.without(F.col("run"), (F.col("h") % F.char_length("run")).cast("int"))
    rows = rows.select(F.when(F.col("h") % MISSPELT == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= LEAST_CHARS)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_TIMES)


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(stage(misspelt_words(table(spark, sf_dir, "documents")), "words"))


def merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.document_manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_url_filter": url_verdicts,
    "op2_jump_sharding": jump_shards,
    "op3_license_scan": license_scan,
    "op4_line_dedup": line_dedup_digests,
    "op5_decontamination": contamination,
    "op6_simhash": simhash_components,
    "op7_quality": quality_scores,
    "op8_exact_dedup": exact_duplicates,
    "op9_bpe": bpe_digests,
    "op10_language": language_predictions,
    "op11_best_fit_packing": packed_documents,
    "op12_spelling_variants": spelling_variants,
    "op13_merkle_manifest": merkle_proofs,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc32(text: str) -> str:
    """DuckDB expression of the CRC-32 of a text's UTF-8 bytes."""
    data = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::UBIGINT)"
    byte = "list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda d, z: xor(d >> 1, (d & 1) * 3988292384::UBIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {data}), lambda c, b: {byte}), 4294967295::UBIGINT)"


def _leaf(text: str) -> str:
    shown = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({value}))::VARCHAR || ':' || {value}, '-')" for value in shown) + ")"


#: DuckDB statements of the results. The others need a 64-bit hash, a learned model, a tokenizer or an iteration that SQL lacks.
ORACLE: dict[str, str] = {
    "op4_line_dedup": rf"""
        WITH lines AS (
            SELECT doc_id, line, pos, trim(translate(line, '{_UPPER}', '{_LOWER}'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
        ), frequent AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
        FROM lines LEFT JOIN frequent f ON lines.key = f.key GROUP BY doc_id""",
    "op5_decontamination": rf"""
        WITH doc_words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
        ), item_words AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[p : p + least(len(words), 10) - 1], ' ') AS gram
            FROM item_words, LATERAL (SELECT unnest(range(1, greatest(len(words) - 10 + 1, 1) + 1)) AS p) WHERE len(words) > 0
        ), sizes AS (SELECT DISTINCT size FROM windows),
        grams AS (
            SELECT doc_id, size, p, array_to_string(words[p : p + size - 1], ' ') AS gram
            FROM doc_words, sizes, LATERAL (SELECT unnest(range(1, greatest(len(words) - size + 1, 0) + 1)) AS p)
        ), hits AS (SELECT doc_id, p, size, item_id FROM grams JOIN windows USING (size, gram)),
        places AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS w FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc_words LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_exact_dedup": r"""
        WITH normal AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, sha256(body) AS text_sha256
        FROM normal WINDOW same AS (PARTITION BY body)""",
    "op12_spelling_variants": rf"""
        WITH RECURSIVE runs AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
        ), counted AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS named, run, count(*) AS times FROM runs WHERE length(run) >= {LEAST_CHARS} GROUP BY ALL),
        hashed AS (SELECT run, times, {_crc32("named")} AS h FROM counted),
        words AS (
            SELECT CASE WHEN h % {MISSPELT} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(times)::BIGINT AS n
            FROM hashed GROUP BY 1 HAVING length(word) >= {LEAST_CHARS} AND sum(times) >= {LEAST_TIMES}
        ), places AS (
            SELECT word, substr(word, 1, p::INT - 1) || '*' || substr(word, p::INT + 1) AS blanked, substr(word, 1, p::INT - 1) || substr(word, p::INT + 1) AS shorter
            FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS p)
        ), pairs AS (
            SELECT a.word, b.word AS near FROM places a JOIN places b USING (blanked) WHERE a.word <> b.word
            UNION SELECT a.word, b.word FROM places a JOIN words b ON a.shorter = b.word
            UNION SELECT b.word, a.word FROM places a JOIN words b ON a.shorter = b.word
        ), ranked AS (
            SELECT p.word, near, w.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, near) AS place
            FROM pairs p JOIN words w ON w.word = p.near
        ), forms AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
            FROM words LEFT JOIN (FROM ranked WHERE place = 1) USING (word)
        ), steps AS (
            SELECT word, word AS root FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL
        )
        SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT s.word, root FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NULL) USING (word)""",
    "op13_merkle_manifest": rf"""
        WITH RECURSIVE docs AS (
            SELECT coalesce('=' || source, '') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size,
                doc_id, {_leaf("text")} AS digest, {_leaf("replace(text, chr(10), '')")} AS other, {_crc32("coalesce(doc_id::VARCHAR, '')")} % 2 = 0 AS changed
            FROM documents
        ), nodes AS (
            SELECT 0 AS height, g, pos, size, digest FROM docs
            UNION ALL SELECT height + 1, g, pos // 3, (any_value(size) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE size > 1 GROUP BY height, g, pos // 3
        ), tops AS (SELECT g, digest, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS size FROM nodes WHERE size = 1),
        high AS (
            SELECT 0 AS height, pos, size, digest FROM tops
            UNION ALL SELECT height + 1, pos // 3, (any_value(size) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE size > 1 GROUP BY height, pos // 3
        ), low_steps AS (
            SELECT a.height, a.g, a.pos, a.size, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
            FROM nodes a JOIN nodes b ON a.height = b.height AND a.g = b.g AND a.pos // 3 = b.pos // 3 GROUP BY ALL
        ), high_steps AS (
            SELECT a.height, a.pos, a.size, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
            FROM high a JOIN high b ON a.height = b.height AND a.pos // 3 = b.pos // 3 GROUP BY ALL
        ), low_walk AS (
            SELECT doc_id, digest AS leaf, g, 0 AS height, pos, size, CASE WHEN changed THEN other ELSE digest END AS now, '' AS proof FROM docs
            UNION ALL
            SELECT doc_id, leaf, w.g, w.height + 1, w.pos // 3, (w.size + 2) // 3, sha256(l || now || r), proof || l || r
            FROM low_walk w JOIN low_steps s ON s.height = w.height AND s.g = w.g AND s.pos = w.pos WHERE w.size > 1
        ), high_walk AS (
            SELECT doc_id, leaf, t.digest AS subroot, 0 AS height, t.pos, t.size, now, proof FROM low_walk w JOIN tops t USING (g) WHERE w.size = 1
            UNION ALL
            SELECT doc_id, leaf, subroot, w.height + 1, w.pos // 3, (w.size + 2) // 3, sha256(l || now || r), proof || l || r
            FROM high_walk w JOIN high_steps s ON s.height = w.height AND s.pos = w.pos WHERE w.size > 1
        )
        SELECT doc_id, leaf, subroot, (SELECT digest FROM high WHERE size = 1) AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = (SELECT digest FROM high WHERE size = 1) AS verified
        FROM high_walk WHERE size = 1""",
}
