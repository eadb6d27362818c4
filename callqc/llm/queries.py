"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callqc.llm import chat, decontam, embeddings, importance, langid, mixing, pii, simhash, spelling, token_counts, token_store, toxicity, url_rules
from callqc.llm.common import new_folder, word_count

Query = Callable[[SparkSession, str], DataFrame]

#: Verdict, host, path.
HOST_RULES: list[url_rules.Rule] = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/")]
TOXIC_FROM = 0.7
TOKEN_LIMIT = 512
#: One in so many (document, word) pairs loses a letter.
MISPRINT = 199
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves a remainder; rows without an id are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(True))


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs with the class of the document that the number in their path names: blocked where
    the labels call it toxic or of low quality."""
    pages = table(spark, sf_dir, "pages").select("url")
    number = F.expr("try_cast(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT)")
    labels = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked"))
    return pages.withColumn("doc_id", number).join(labels, "doc_id").select("url", "blocked")


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    mined = url_rules.mine(labelled_pages(spark, sf_dir), "url", "blocked")
    return url_rules.judge(table(spark, sf_dir, "pages"), HOST_RULES, mined)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), rows=~held_out(F.col("doc_id"), 3, 1))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(CONTROL_TEXT).alias("text"))
    return chat.read_back(chat.format_turns(turns.unionByName(probe)))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "best_coverage", "n_items",
                        F.array_join(F.transform("items", lambda x: x["item_id"].cast("string")), ",").alias("item_ids"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(table(spark, sf_dir, "documents")))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, rows=~held_out(F.col("doc_id"), 4, 2))
    return langid.identify(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, sources = mixing.mix(table(spark, sf_dir, "documents"), F.array("source"), word_count(F.col("text")), content=F.xxhash64("text"))
    known = spark.createDataFrame([(name, words, target) for name, (words, target) in sources.items()], "named string, source_size long, target double")
    return (mixed.join(known, F.col("members")[0].eqNullSafe(F.col("named")), "left")
            .select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    token_store.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_store.Store(spark, path).digests()


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, min_words=20, seed=7)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(table(spark, sf_dir, "documents"), min_length=6, min_count=5, misprint=MISPRINT)
    return spelling.group_variants(words, ratio=5)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_url_rules, op2_toxicity, op3_chat, op4_simhash, op5_decontamination, op6_pii, op7_embeddings, op8_language, op9_mixing,
    op10_token_store, op11_importance, op12_spelling, op13_token_counts, pipeline)}

_ESCAPED = "replace({x}, '\\', '\\\\')"
for _c in chat.CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"
_FIXED = len(chat.START + chat.SEP + chat.END)

#: CRC-32 of the UTF-8 bytes of a text whose ``hex()`` is in a column; beside the one-row table ``crc_table``.
_CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc_of)"""
_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(range(1, length({x}), 2), lambda i: CAST('0x' || substr({x}, i, 2) AS BIGINT))),
        lambda c, b: xor(c // 256, crc_of[xor(c % 256, b) + 1])), 4294967295)"""
_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {"op11_importance": f"""
WITH {_CRC_TABLE},
split AS (SELECT 's' AS side, doc_id AS id, regexp_extract_all({_LOWER.format(x="text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
          UNION ALL SELECT 't', item_id, regexp_extract_all({_LOWER.format(x="text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
words AS (SELECT side, id, w, unnest(range(1, len(w) + 1)) AS i FROM split),
features AS (SELECT side, id, w[i] AS f FROM words UNION ALL SELECT side, id, w[i] || ' ' || w[i + 1] FROM words WHERE i < len(w)),
named AS (SELECT f, hex(f) AS x FROM (SELECT DISTINCT f FROM features)),
hashed AS (SELECT f, {_CRC.format(x="x")} % 10000 AS bucket FROM named, crc_table),
counted AS (SELECT side, id, bucket, count(*) AS n FROM features JOIN hashed USING (f) GROUP BY ALL),
totals AS (SELECT sum(n) FILTER (side = 's') AS s, sum(n) FILTER (side = 't') AS t FROM counted),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(sum(n) FILTER (side = 't'), 0) + 1)::DOUBLE * (any_value(s) + 10000)::DOUBLE
                 / ((coalesce(sum(n) FILTER (side = 's'), 0) + 1)::DOUBLE * (any_value(t) + 10000)::DOUBLE))) AS gain FROM counted, totals GROUP BY bucket),
weighed AS (SELECT d.doc_id, len(w) AS n_words, coalesce(m.n, 0) AS n_features, CAST(coalesce(floor(m.total / m.n), 0) AS BIGINT) AS weight
            FROM documents d JOIN split ON side = 's' AND id = d.doc_id
            LEFT JOIN (SELECT id, sum(n) AS n, sum(n * gain) AS total FROM counted JOIN gains USING (bucket) WHERE side = 's' GROUP BY id) m ON m.id = d.doc_id),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('7:' || doc_id), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM weighed),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= floor(25 * n / 100) THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)""", "op12_spelling": f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format(x="text")}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
counted AS (SELECT run, n, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS x
            FROM (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL)),
hashed AS (SELECT run, n, {_CRC.format(x="x")} AS h FROM counted, crc_table),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n
          FROM (SELECT CASE WHEN h % {MISPRINT} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
          WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
shorter AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS other FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
         UNION SELECT a.word, b.word FROM shorter a JOIN words b ON a.rest = b.word
         UNION SELECT b.word, a.word FROM shorter a JOIN words b ON a.rest = b.word),
ranked AS (SELECT near.word, other, o.n, count(*) OVER (PARTITION BY near.word) AS n_near,
                  row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS place
           FROM near JOIN words o ON o.word = near.other),
formed AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 5 * w.n THEN r.other END AS form,
                  CASE WHEN r.n >= 5 * w.n THEN r.n END AS form_n
           FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
chains AS (SELECT word, word AS at FROM formed
           UNION ALL SELECT c.word, f.form FROM chains c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN chains c ON c.word = f.word JOIN formed l ON l.word = c.at AND l.form IS NULL""", "op3_chat": f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({_FIXED} + length({_ESCAPED.format(x="role")}) + length({_ESCAPED.format(x="text")})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""}
