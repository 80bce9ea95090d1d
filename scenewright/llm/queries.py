"""The named queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright.llm import chat, ctw, jump_hash, kneser_ney, merkle, mixing, ngram_join, nn_descent, packing, phrases, secrets, url_rules, whiten
from scenewright.llm.common import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op3_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by jump consistent hashing of doc_id, and the shard each would have among 17."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    out = jump_hash.shard(docs, "doc_id", 16, order=["size", "text_crc32"])
    return out.select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", jump_hash.jump_hash(F.col("doc_id"), 17).alias("grown_shard")
    )


@query
def op9_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of the sources at 5, 2, 1 takes from each document, by Pareto order sampling."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", mixing.n_words(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc")
    )
    mixed = mixing.mix(cut(docs), ["doc_id", "crc"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "inclusion")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> bytes:
    """A public tokenizer's file, read where the driver runs; it is sent along with the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@query
def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens by harmonic packing."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(cut(packing.pieces(docs, ["doc_id"], "text", tokenizer_file(), 1024)), 1024)


@query
def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url by host rules and pattern rules indexed by their rarest token."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = url_rules.HOST_RULES + url_rules.PATTERN_RULES
    return url_rules.judge(pages, "url", rules).select("page_id", "host", "path", "rule", "pattern", "verdict")


ORACLES["op6_url_rules"] = url_rules.brute_force_sql(url_rules.HOST_RULES + url_rules.PATTERN_RULES)


@query
def op8_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every document: three known forms, and runs that a Markov model of random strings explains."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.model_of(docs))
    kinds = [secrets.n_of(F.col("base_spans"), kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]]
    return found.select(
        "doc_id", *kinds, F.sha2(secrets.listed(F.col("base_spans")), 256).alias("base_sha256"), secrets.listed(F.col("secret_spans")).alias("spans")
    )


@query
def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of every document, and whether it stays within its language's perplexity band."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = cut(kneser_ney.measure(docs, kneser_ney.train(docs), carry=["doc_id", "lang"]))
    good = table(spark, sf_dir, "labels").where("quality = 1")
    judged = kneser_ney.judge(measured, cut(kneser_ney.bands(measured, good=good)))
    return judged.select("doc_id", *kneser_ney.MEASURES, "base_failed", "kept", "nats_per_byte", "lower", "upper")


@query
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of at least 90 % common 3-word shingles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.join(docs, words=3, percent=90).select("doc_id", "n_shingles", "component_id")


ORACLES["op7_ngram_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(x) = 0 THEN [] WHEN len(x) < 3 THEN [x]
    ELSE list_transform(range(1, len(x) - 1), lambda i: x[i:i + 2]) END) AS g FROM w),
h AS (SELECT doc_id, hash(g) AS g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY ALL),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT ways.b, r.c FROM r JOIN ways ON ways.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query
def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate embeddings of equal labels at a cosine of 0.93 by NN-descent."""
    found = nn_descent.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return found.select("vec_id", "n_links", "component_id", "kept", "recall")


@query
def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability by context-tree weighting over bytes, and by the unigram baseline."""
    return ctw.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op4_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records with file and offset, audited against a replica in which the records whose html's
    digest begins with 00 have lost their first character and those with 01 are gone."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    rotten = F.when(F.startswith(digest, F.lit("00")), F.expr("substring(html, 2)")).otherwise(F.col("html"))
    copy = pages.where(~F.startswith(digest, F.lit("01"))).withColumn("html", rotten)
    record = merkle.warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    a = merkle.replica(pages, "page_id", record)
    found = merkle.audit(a, merkle.replica(copy, "page_id", record)).where("status in ('damaged', 'missing')")
    found = found.select(F.col("key").alias("k"), F.col("digest").alias("d"), "status")
    out = a.records.join(found, F.col("key").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d")), "left")
    return out.select(
        F.col("key").alias("page_id"), F.col("file").alias("file_id"), "offset", "length", F.col("digest").alias("record_sha256"),
        F.coalesce("status", F.lit("intact")).alias("status"),
    )


ORACLES["op4_merkle_fixity"] = """
WITH r AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
    || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record,
    left(sha256(coalesce(html, '')), 2) AS fate
  FROM pages)
SELECT page_id, CAST(floor(page_id / 1000) AS BIGINT) AS file_id,
  CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY floor(page_id / 1000) ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  strlen(record) AS length, sha256(record) AS record_sha256,
  CASE fate WHEN '00' THEN 'damaged' WHEN '01' THEN 'missing' ELSE 'intact' END AS status
FROM r
"""


@query
def op13_suffix_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language by how much more often they come than their parts would by chance."""
    return phrases.top(phrases.mine(table(spark, sf_dir, "documents").select("lang", "text"), least=100, percent=100), 2000)


ORACLES["op13_suffix_phrases"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS x FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(x) - k + 2), lambda i: array_to_string(x[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest(range(1, 6)) AS k)),
f AS (SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS x FROM f WHERE k > 1 AND f >= 100),
cuts AS (
  SELECT c.lang, c.phrase, a, j, l.f AS l, r.f AS r, n.n,
    CAST(1000 * CAST(a AS HUGEINT) * n.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM (SELECT lang, phrase, a, x, k AS size, unnest(range(1, k)) AS j FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(x[1:j], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(x[j + 1:size], ' ')
  JOIN n ON n.lang = c.lang),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT DISTINCT s.lang, s.phrase FROM (
    SELECT lang, a AS longer, unnest(list_transform(
      list_filter(flatten(list_transform(range(1, k + 1), lambda i: list_transform(range(i + 1, k + 1), lambda j: [i, j]))), lambda p: p[2] - p[1] + 1 < k),
      lambda p: array_to_string(x[p[1]:p[2]], ' '))) AS phrase
    FROM c) s JOIN c ON c.lang = s.lang AND c.phrase = s.phrase WHERE 100 * longer >= 100 * c.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM worst ANTI JOIN inside USING (lang, phrase)
QUALIFY rank <= 2000
"""


@query
def op11_covariance_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the first four components of their quantised entries' covariance, whitened."""
    out = whiten.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), ["vec_id"], "embedding", components=4)
    return out.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


@query
def op12_relational_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    told = chat.format_chats(rows.unionByName(more))
    read = told.select("conv_id", "formatted", chat.turns_of(F.col("formatted")).alias("turns"), chat.learnt_text(F.col("segments")).alias("learnt"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op12_relational_chat"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS opens,
    length(regexp_replace(text, '([<\[])(\\*)(/?s>|sep>|</?SYS>>|/?INST\]|/?ROLE\]|/END\])', '\1\2\\\3', 'g')) AS chars,
    length(regexp_replace(role, '([<\[])(\\*)(/?s>|sep>|</?SYS>>|/?INST\]|/?ROLE\]|/END\])', '\1\2\\\3', 'g')) AS role_chars
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars + CASE WHEN NOT opens THEN 5 WHEN role = 'user' THEN 15 WHEN role = 'system' THEN 18
    WHEN role = 'assistant' THEN 5 ELSE 19 + role_chars END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
