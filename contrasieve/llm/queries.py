"""Named queries of this folder, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrasieve.llm import chat, collocations, cover_trees, decontaminate, packing, quality_mcd, recompression, sharding, suffix_dedup, token_coder, warc, weighted_minhash, whitening
from contrasieve.llm._tokens import tokenizer_path
from contrasieve.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@query
def op4_token_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_coder.write(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"))
    return token_coder.read(spark, folder)


@query
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    folder = f"{shared_folder(spark)}/chat-{uuid.uuid4().hex}"
    chat.windows(turns, tokenizer_path("byte_bpe_50k.json")).write.parquet(folder)
    return chat.read_back(spark.read.parquet(folder))


@query
def op6_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_minhash.near_copies(table(spark, sf_dir, "documents"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mcd.judge(table(spark, sf_dir, "documents"))


@query
def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.drop_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.capture_histories(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_cover_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_trees.top_k(table(spark, sf_dir, "embeddings"))


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


# five hexadecimal digits are four letters of base 32
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {at}, 5))::BIGINT >> {shift}) & 31) + 1)::BIGINT, 1)"
    for at in range(1, 41, 5) for shift in (15, 10, 5, 0)
)

ORACLES["op10_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
     d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest FROM p),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

ORACLES["op9_recompression"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents),
     s AS (SELECT doc_id, unnest(range(1, len(t) - 48)) AS i, t FROM w),
     h AS (SELECT doc_id, i, sha256(array_to_string(t[i:i + 49], ' ')) AS k FROM s),
     m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM h),
     gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM m WHERE first < doc_id),
     lists AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id),
     n AS (SELECT w.doc_id, len(t) AS n_words, coalesce(len(js), 0) AS n_removed,
                  coalesce(list_filter(t, lambda x, k: js IS NULL OR NOT list_contains(js, k)), []) AS kept
           FROM w LEFT JOIN lists USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM n
"""

ORACLES["op12_cover_trees"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     e AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
           FROM e q JOIN e c USING (i) WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

ORACLES["op13_collocations"] = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
     p AS (SELECT lang, unnest(regexp_split_to_array(s, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
     w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
     n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
     g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
           FROM w, (SELECT unnest(range(1, 6)) AS m)),
     f AS (SELECT lang, m, phrase, count(*)::BIGINT AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
     c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
     inner_parts AS (SELECT DISTINCT lang, a, array_to_string(ws[i:i + k - 1], ' ') AS phrase
                     FROM c, (SELECT unnest(range(2, 5)) AS k), (SELECT unnest(range(1, 5)) AS i) WHERE k < m AND i + k - 1 <= m),
     kept AS (SELECT c.* FROM c ANTI JOIN inner_parts USING (lang, phrase, a)),
     cuts AS (SELECT kept.*, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y
              FROM kept, (SELECT unnest(range(1, 5)) AS k) WHERE k < m),
     s AS (SELECT cuts.lang, cuts.phrase, cuts.a, k, fl.a AS l, fr.a AS r, n.n,
                  (1000::HUGEINT * cuts.a * n.n // (fl.a::HUGEINT * fr.a))::BIGINT AS score
           FROM cuts JOIN f fl ON fl.lang = cuts.lang AND fl.phrase = x JOIN f fr ON fr.lang = cuts.lang AND fr.phrase = y JOIN n ON n.lang = cuts.lang),
     b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INTEGER AS rank, phrase, a, l, r, n, score
FROM b QUALIFY rank <= 2000
"""
