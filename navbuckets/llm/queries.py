"""The registered queries of the ten operators and the pipeline, and their DuckDB SQL.

Each query applies its operator, with production parameters, to its whole table and derives
the digest columns from the operator's output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navbuckets.llm import bpe, chat, langid, lexical, packing, pii, tokencount, toxicity, trie, urlfilter
from navbuckets.llm.common import crc_mod, table
from navbuckets.llm.decontam import contamination
from navbuckets.llm.jaccard import similar_components
from navbuckets.llm.topk import exact_topk, quantized


def op1_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = quantized(table(spark, sf, "embeddings"))
    return exact_topk(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held = crc_mod("doc_id", 4) == 2
    model = langid.fit(docs.where(~held))
    return langid.identify(docs.select("doc_id", held.alias("held_out"), "text"), model, ["doc_id", "held_out"])


def op3_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"), window=10)


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held = crc_mod("doc_id", 3) == 1
    model = toxicity.fit(docs, table(spark, sf, "labels").where(~held))
    scored = toxicity.score(docs.select("doc_id", held.alias("held_out"), "text"), model, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.detect(table(spark, sf, "documents").select("doc_id", "text"))
    kinds = F.col("base_spans")["kind"]
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *count, F.sha2(pii.span_text(F.col("base_spans")), 256).alias("base_sha256"),
                        pii.span_text(F.col("spans")).alias("spans"))


def op6_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return similar_components(table(spark, sf, "documents").select("doc_id", "text"), size=3, num=90, den=100)


#: fixed values: the conversation that the contract adds (its texts hold control strings)
ODD_TEXT = "\\### Assistant: </turn> ok"
ODD_TURNS = [(-7, 0, "user", ODD_TEXT), (-7, 1, "assistant", ODD_TEXT)]


def op7_chat(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.union(spark.createDataFrame(ODD_TURNS, turns.schema))
    chats = chat.conversations(chat.linear_tree(turns))
    read, loss = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (chats.select(F.col("tree_id").alias("conv_id"), "formatted", read.alias("turns"), loss.alias("loss"))
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars")))


def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokencount.token_counts(table(spark, sf, "documents"), path, limit=512, keep=["doc_id"])


#: fixed values: the contract's rules (host, path, allow)
URL_RULES = [("org", "/", True), ("example.org", "/es/", False), ("example.org", "/en/1", False),
             ("com", "/fr/", True), ("com", "/de/", False)]


def op9_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, allow boolean")
    return urlfilter.judge_urls(table(spark, sf, "pages"), rules).drop("trust", "distrust")


def op10_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.round_trip(table(spark, sf, "documents"), path, keep=["doc_id"])
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=50)


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf, "conversations")).drop("enter", "leave")


def op13_packing(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    made = packing.packed(table(spark, sf, "documents"), path, size=2048, end_id=1, keep=["doc_id"])
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


Q = {
    "op1_exact_topk": op1_exact_topk,
    "op2_language_id": op2_language_id,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_pii": op5_pii,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_chat": op7_chat,
    "op8_token_counts": op8_token_counts,
    "op9_url_filter": op9_url_filter,
    "op10_bpe": op10_bpe,
    "op11_lexical_search": op11_lexical_search,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_packing": op13_packing,
}

O = {  # noqa: E741
    "op1_exact_topk": """
        WITH v AS (
          SELECT vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
          FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
          FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op3_decontamination": """
        WITH d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        i AS (
          SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        iw AS (
          SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS win
          FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM iw),
        dw AS (
          SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS win
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
        m AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN iw USING (win) WHERE dw.n = iw.n),
        hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit
                FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM m) GROUP BY doc_id),
        its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                       string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM m GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
               coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op7_chat": r"""
        WITH c AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
          FROM (SELECT conv_id, turn, role, text FROM conversations
                UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')))
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
               (sum(length('<turn role="">') + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '"', '&quot;'))
                    + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + length('</turn>') + 1) - 1)::BIGINT AS formatted_chars
        FROM c GROUP BY conv_id""",
    "op6_ngram_jaccard": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
          SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ')
            ELSE array_to_string(w[p : p + 2], ' ') END AS g
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
        e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
        r AS (SELECT doc_id AS id, doc_id AS reach FROM d UNION SELECT r.id, e.y FROM r JOIN e ON e.x = r.reach)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m AS component_id
        FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(reach) AS m FROM r GROUP BY id) ON id = d.doc_id""",
    "op11_lexical_search": """
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        i AS (
          SELECT DISTINCT r, item_id, unnest(w) AS term
          FROM (SELECT row_number() OVER () AS r, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM benchmark)),
        z AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
        f AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf
              FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) GROUP BY r, term),
        g AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
              FROM f, z GROUP BY term, n_docs),
        s AS (
          SELECT i.r AS item, i.item_id, f.r, f.doc_id,
                 sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total))))::BIGINT AS score
          FROM i JOIN f USING (term) JOIN g USING (term), z GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 50""",
    "op12_prefix_trie": r"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(text, '') AS text, sha256(coalesce(role, '') || chr(10) || coalesce(text, '')) AS digest
          FROM conversations WHERE conv_id IS NOT NULL),
        p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS k FROM t),
        c AS (
          SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
            lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
              lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END))) % 4 AS h
          FROM (SELECT DISTINCT conv_id FROM p)),
        s AS (
          SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, k) AS d, digest, text
          FROM (SELECT c.conv_id, 0 AS own, k, digest, text FROM c JOIN p ON p.conv_id = c.base AND k <= h
                UNION ALL SELECT c.conv_id, 1, k, digest, text FROM c JOIN p ON p.conv_id = c.conv_id AND k > h)),
        m AS (
          SELECT conv_id, 0 AS d, '' AS path, NULL AS up, 0 AS w FROM c
          UNION ALL
          SELECT conv_id, d, path, left(path, 64 * (d - 1)), len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))
          FROM (SELECT conv_id, d, text, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM s)),
        e AS (
          SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends
          FROM (SELECT conv_id, path, row_number() OVER (PARTITION BY conv_id ORDER BY d DESC) AS r FROM m) WHERE r = 1 GROUP BY path),
        n AS (SELECT path, any_value(up) AS up, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w FROM m GROUP BY path, d),
        k AS (SELECT up, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up),
        v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.up = n.path),
        x AS (SELECT DISTINCT a.path AS top, b.path FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.d >= a.d),
        y AS (SELECT top, count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.w)::BIGINT AS saved_tokens
              FROM x JOIN v USING (path) GROUP BY top)
        SELECT v.conv_id, v.d::BIGINT AS depth, o.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens,
               sha256(coalesce(ends, '')) AS ends_sha256
        FROM v JOIN y ON y.top = v.path LEFT JOIN n o ON o.path = v.up AND v.d > 0 LEFT JOIN e ON e.path = v.path""",
}
