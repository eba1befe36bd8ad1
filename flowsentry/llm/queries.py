"""Registered queries of the text operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowsentry.llm.bpe import round_trip
from flowsentry.llm.exact_dedup import exact_duplicates
from flowsentry.llm.mixing import mix_sources
from flowsentry.llm.near_dedup import near_duplicates
from flowsentry.llm.packing import pack_documents
from flowsentry.llm.pii import personal_data
from flowsentry.llm.prefix_trie import prefix_trie
from flowsentry.llm.quality import judge
from flowsentry.llm.ranked_search import rank_documents
from flowsentry.llm.suffix_dedup import remove_repeats
from flowsentry.llm.tree_bpe import round_trip as tree_round_trip
from flowsentry.llm.url_filter import judge_urls
from flowsentry.llm.warc import archive_and_read


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """A vocabulary file of the public tokenizer package; the file itself is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op4_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), vocabulary_path())


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def op6_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(_table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"), digest_all=True)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), vocabulary_path())


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"))


def op13_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_round_trip(_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_personal_data": op2_personal_data,
    "op3_mix_sources": op3_mix_sources,
    "op4_pack_tokens": op4_pack_tokens,
    "op5_url_filter": op5_url_filter,
    "op6_warc_zstd": op6_warc_zstd,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_ranked_search": op12_ranked_search,
    "op13_tree_bpe": op13_tree_bpe,
}

ORACLES: dict[str, str] = {
    # Bytes as hex digits: windows are 100 digits at even places, the bytes left are put together again.
    "op1_suffix_dedup": r"""
        WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), w AS (
            SELECT doc_id, i, hash(substr(h, 2 * i + 1, 100)) AS g FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 49)) AS i FROM t WHERE length(h) >= 100)
        ), f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first_id FROM w) WHERE first_id < doc_id
        ), e AS (SELECT doc_id, i, CASE WHEN i > lag(i + 49) OVER (PARTITION BY doc_id ORDER BY i) + 1 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS is_new FROM f
        ), s AS (SELECT doc_id, n, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(is_new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS n FROM e) GROUP BY doc_id, n
        ), k AS (
            SELECT t.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, any_value(h) AS h, list(a ORDER BY a) AS la, list(b ORDER BY a) AS lb FROM s JOIN t USING (doc_id) GROUP BY t.doc_id
        ), r AS (
            SELECT doc_id, n_removed, n_spans, array_to_string(list_transform(range(len(la) + 1), lambda j:
                substr(h, CASE WHEN j = 0 THEN 1 ELSE 2 * lb[j::INT] + 1 END, CASE WHEN j = len(la) THEN length(h) ELSE 2 * la[j::INT + 1] END - CASE WHEN j = 0 THEN 0 ELSE 2 * lb[j::INT] END)), '') AS rest
            FROM k
        )
        SELECT t.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
        FROM t LEFT JOIN r USING (doc_id)
    """,
    # Uniform weights, as the query uses: shares are equal and the filling order is by capacity.
    "op3_mix_sources": r"""
        WITH r AS (
            SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents
        ), rows_ AS (
            SELECT *, CASE WHEN regexp_matches(source, '[0-9]$') THEN 'family' || (regexp_extract(source, '([0-9]{1,9})$', 1)::BIGINT % 4) ELSE 'other' END AS domain FROM r
        ), leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * 2)::BIGINT AS capacity FROM rows_ GROUP BY ALL
        ), domain_in AS (
            SELECT domain, sum(capacity)::BIGINT AS capacity, 0 AS root, (SELECT (sum(tokens) // 2)::BIGINT FROM leaf) AS budget FROM leaf GROUP BY domain
        ),
        domain_w AS (
            SELECT *, coalesce(sum(capacity) OVER (PARTITION BY root ORDER BY capacity, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
                count(*) OVER (PARTITION BY root) - row_number() OVER (PARTITION BY root ORDER BY capacity, domain) + 1 AS remaining
            FROM domain_in
        ), domain_f AS (SELECT *, budget - used >= capacity * remaining AS filled FROM domain_w),
        domain_o AS (
            SELECT *, budget - coalesce(sum(CASE WHEN filled THEN capacity END) OVER (PARTITION BY root), 0) AS rest,
                sum(CASE WHEN filled THEN 0 ELSE 1 END) OVER (PARTITION BY root) AS n_open
            FROM domain_f
        ), domain_b AS (
            SELECT * EXCLUDE (budget), CASE WHEN filled THEN capacity ELSE least(capacity, CASE WHEN n_open > 0 THEN rest // n_open ELSE 0 END) END AS got FROM domain_o
        ),
        lang_in AS (SELECT l.domain, l.lang, sum(l.capacity)::BIGINT AS capacity, any_value(d.got) AS budget FROM leaf l JOIN domain_b d USING (domain) GROUP BY l.domain, l.lang
        ),
        lang_w AS (
            SELECT *, coalesce(sum(capacity) OVER (PARTITION BY domain ORDER BY capacity, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
                count(*) OVER (PARTITION BY domain) - row_number() OVER (PARTITION BY domain ORDER BY capacity, lang) + 1 AS remaining
            FROM lang_in
        ), lang_f AS (SELECT *, budget - used >= capacity * remaining AS filled FROM lang_w),
        lang_o AS (
            SELECT *, budget - coalesce(sum(CASE WHEN filled THEN capacity END) OVER (PARTITION BY domain), 0) AS rest,
                sum(CASE WHEN filled THEN 0 ELSE 1 END) OVER (PARTITION BY domain) AS n_open
            FROM lang_f
        ), lang_b AS (
            SELECT * EXCLUDE (budget), CASE WHEN filled THEN capacity ELSE least(capacity, CASE WHEN n_open > 0 THEN rest // n_open ELSE 0 END) END AS got FROM lang_o
        ),
        leaf_in AS (SELECT l.*, b.got AS budget FROM leaf l JOIN lang_b b USING (domain, lang)
        ),
        leaf_w AS (
            SELECT *, coalesce(sum(capacity) OVER (PARTITION BY domain, lang ORDER BY capacity, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
                count(*) OVER (PARTITION BY domain, lang) - row_number() OVER (PARTITION BY domain, lang ORDER BY capacity, source) + 1 AS remaining
            FROM leaf_in
        ), leaf_f AS (SELECT *, budget - used >= capacity * remaining AS filled FROM leaf_w),
        leaf_o AS (
            SELECT *, budget - coalesce(sum(CASE WHEN filled THEN capacity END) OVER (PARTITION BY domain, lang), 0) AS rest,
                sum(CASE WHEN filled THEN 0 ELSE 1 END) OVER (PARTITION BY domain, lang) AS n_open
            FROM leaf_f
        ), leaf_b AS (
            SELECT * EXCLUDE (budget), CASE WHEN filled THEN capacity ELSE least(capacity, CASE WHEN n_open > 0 THEN rest // n_open ELSE 0 END) END AS got FROM leaf_o
        ),
        need AS (
            SELECT domain, lang, source, got AS leaf_budget, CASE WHEN tokens > 0 THEN least(2, got // tokens) ELSE 0 END AS epochs,
                got - CASE WHEN tokens > 0 THEN least(2, got // tokens) ELSE 0 END * tokens AS need FROM leaf_b
        ), placed AS (SELECT *, md5('7:' || epochs || ':' || doc_id) AS place FROM rows_ JOIN need USING (domain, lang, source)
        ), ahead AS (
            SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM placed
        )
        SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, leaf_budget::BIGINT AS leaf_budget, (epochs + CASE WHEN before_ < need THEN 1 ELSE 0 END)::BIGINT AS copies FROM ahead
    """,
    # Base32 of the SHA-1: 20 bits (five hex digits) give four characters.
    "op6_warc_zstd": r"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages
        ), b AS (
            SELECT page_id, n, h, min(page_id) OVER (PARTITION BY h) AS first_id, array_to_string(list_transform(range(8), lambda i:
                array_to_string(list_transform(range(4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * i::INT + 1, 5))::INT >> (15 - 5 * j::INT)) & 31) + 1, 1)), '')), '') AS digest
            FROM p
        )
        SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM b
    """,
    "op7_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h, length(coalesce(text, '')) AS n
            FROM documents
        ), k AS (
            SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size
            FROM t
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k
    """,
    # CRC-32 bit by bit; every prefix of every rebuilt conversation is spelled out.
    "op11_prefix_trie": r"""
        WITH t AS (
            SELECT conv_id, turn, substr(sha256(strlen(r) || ':' || r || x), 1, 48) || printf('%016x', strlen(x)) AS e
            FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)
        ), c AS (SELECT conv_id, list(e ORDER BY turn NULLS FIRST, e) AS l FROM t GROUP BY conv_id
        ), s AS (
            SELECT conv_id, l, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT)),
                lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 9 AS h FROM c
        ), p AS (
            SELECT s.conv_id, list_concat(coalesce(f.l[1:s.h], []), s.l[s.h + 1:]) AS l FROM s LEFT JOIN c f ON f.conv_id = s.conv_id - s.conv_id % 5
        ), k AS (
            SELECT conv_id, len(l) AS n, d, md5(array_to_string(l[1:d], '')) AS k, CASE WHEN d > 0 THEN md5(array_to_string(l[1:d - 1], '')) END AS pk, CASE WHEN d > 0 THEN l[d] END AS e
            FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM p)
        ), v AS (
            SELECT d, k, min(pk) AS pk, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(('0x' || right(min(e), 16))::BIGINT, 0) AS b,
                sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
            FROM k GROUP BY d, k
        ), kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM v WHERE d > 0 GROUP BY ALL
        ), w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN kids USING (d, k)
        ), below AS (
            SELECT k.d, k.k, sum((w.n_convs - 1) * w.b)::BIGINT AS saved_tokens, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves
            FROM w JOIN k ON k.conv_id = w.conv_id AND k.d <= w.d GROUP BY k.d, k.k
        )
        SELECT w.conv_id, w.d::BIGINT AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
        FROM w JOIN below USING (d, k) LEFT JOIN w u ON u.d = w.d - 1 AND u.k = w.pk
    """,
    "op12_ranked_search": r"""
        WITH i AS (
            SELECT item, item_id, term, count(*) AS q
            FROM (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
            GROUP BY ALL
        ), d AS (
            SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
        ), c AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0
        ), t AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL
        ), w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, c GROUP BY term, n_docs
        ), s AS (
            SELECT item, item_id, doc_id, row_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(terms) * n_docs) // n_terms))))::BIGINT AS score
            FROM i JOIN w USING (term) JOIN t USING (term) JOIN d USING (row_id), c GROUP BY ALL
        )
        SELECT item_id, rank, doc_id, score FROM (
            SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, row_id)::INT AS rank FROM s WHERE score > 0
        ) WHERE rank <= 10
    """,
}
