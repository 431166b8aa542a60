"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from latticework.llm.bpe import op10_bpe
from latticework.llm.embedding_dedup import op1_embedding_dedup
from latticework.llm.mixing import op3_mixing
from latticework.llm.ngram_join import op9_ngram_join
from latticework.llm.quality import op4_quality
from latticework.llm.sharding import op7_sharding
from latticework.llm.simhash import op2_simhash
from latticework.llm.token_binary import op6_token_binary
from latticework.llm.toxicity import op5_toxicity
from latticework.llm.warc import op8_warc

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_token_binary": op6_token_binary,
    "op7_sharding": op7_sharding,
    "op8_warc": op8_warc,
    "op9_ngram_join": op9_ngram_join,
    "op10_bpe": op10_bpe,
}

#: DuckDB SQL of those that SQL can express; the others are held against
#: brute-force versions in tests/llm.
ORACLES: dict[str, str] = {
    "op8_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
FROM f""",
}
