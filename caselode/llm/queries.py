"""The registered queries of the training-data operators and the SQL they are checked against."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caselode.llm.chat import op7_chat_formatting
from caselode.llm.common import ship
from caselode.llm.hnsw import op9_nearest_neighbours
from caselode.llm.impact_index import op10_exact_top_k
from caselode.llm.mixing import op8_mixing
from caselode.llm.ngram_join import op5_ngram_jaccard_join
from caselode.llm.packing import op1_best_fit_packing
from caselode.llm.pii import op3_pii_spans
from caselode.llm.quality import op6_quality_classifier
from caselode.llm.repair import op13_conversation_repair
from caselode.llm.repeats import op11_suffix_array_dedup
from caselode.llm.toxicity import op2_toxicity
from caselode.llm.warc import op4_warc_writer
from caselode.llm.whitening import op12_embedding_whitening


def shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, after the package has been sent to the executors."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_best_fit_packing, op2_toxicity, op3_pii_spans, op4_warc_writer, op5_ngram_jaccard_join, op6_quality_classifier, op7_chat_formatting, op8_mixing, op9_nearest_neighbours, op10_exact_top_k, op11_suffix_array_dedup, op12_embedding_whitening, op13_conversation_repair]
    return {f.__name__: shipped(f) for f in found}


#: Digests in base32: each five hexadecimal digits are four characters.
WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
 list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

JOIN_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(2, len(w) - 1)), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, len(s) AS n FROM s), u AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id AND r.root < e.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY 1) m ON m.doc_id = d.doc_id"""

TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(embedding) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def _escapes(column: str) -> str:
    """How many backslashes escaping adds: one for each control string, however many it holds already."""
    from caselode.llm.chat import CONTROL

    quoted = lambda t: "".join(c if c.isalnum() or c in "</>" else "\\" + c for c in t)
    return " + ".join(f"len(regexp_extract_all({column}, '{quoted(c[0])}\\\\*{quoted(c[1:])}'))" for c in CONTROL)


def chat_sql() -> str:
    """Turns of a conversation are formatted as <|role|>, line end, text, <|end|>, line end: 13 characters of marks."""
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(length(role) + length(text) + 13 + {_escapes("role")} + {_escapes("text")})::BIGINT AS formatted_chars FROM t GROUP BY 1"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that SQL can express; tests hold the others to brute force, round trips or held-out rows."""
    return {"op4_warc_writer": WARC_SQL, "op5_ngram_jaccard_join": JOIN_SQL, "op7_chat_formatting": chat_sql(), "op10_exact_top_k": TOP_K_SQL}
