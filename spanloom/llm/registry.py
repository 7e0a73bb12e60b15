"""Queries of the training-data operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from spanloom.llm.conversation_repair import op11_conversation_repair
from spanloom.llm.conversation_repair_sql import repair_sql
from spanloom.llm.exact_duplicates import OP12_SQL, op12_exact_duplicates
from spanloom.llm.lm_scoring import op4_lm_scores
from spanloom.llm.mixing import op1_mix
from spanloom.llm.near_duplicates import op2_near_duplicates
from spanloom.llm.packing import op6_pack
from spanloom.llm.quality_rules import op9_quality_rules
from spanloom.llm.repeated_strings import op5_repeated_strings
from spanloom.llm.secrets import op10_secrets
from spanloom.llm.site_quality import op8_site_quality
from spanloom.llm.token_files import op3_token_files
from spanloom.llm.vector_duplicates import op7_vector_duplicates
from spanloom.llm.whitening import op13_whiten

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_mix": op1_mix,
        "op2_near_duplicates": op2_near_duplicates,
        "op3_token_files": op3_token_files,
        "op4_lm_scores": op4_lm_scores,
        "op5_repeated_strings": op5_repeated_strings,
        "op6_pack": op6_pack,
        "op7_vector_duplicates": op7_vector_duplicates,
        "op8_site_quality": op8_site_quality,
        "op9_quality_rules": op9_quality_rules,
        "op10_secrets": op10_secrets,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_exact_duplicates": op12_exact_duplicates,
        "op13_whiten": op13_whiten,
        "pipeline": corpus_pipeline.run,
    }


#: Smallest node that links(a, b), both ways, lead to from every one of nodes(node).
REACH = """reach(node, root) AS (SELECT node, node FROM nodes UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node WHERE r.root < l.b),
  component AS (SELECT node, min(root) AS root FROM reach GROUP BY node)"""

OP2_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) END AS g FROM w),
  x AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
  links AS (SELECT a, b FROM (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS total, count(*) AS shared FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL) WHERE 100 * shared >= 85 * (total - shared)),
  nodes AS (SELECT doc_id AS node FROM documents), {REACH}
  SELECT doc_id, len(g) AS n_shingles, root AS component_id, doc_id = root AS kept FROM s JOIN component ON doc_id = node"""

OP7_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
  good AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(e, lambda c: c <> 0)) > 0),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
  nodes AS (SELECT vec_id AS node FROM embeddings), {REACH}
  SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, root AS component_id, vec_id = root AS kept FROM v JOIN component ON vec_id = node"""


def oracle_sql() -> dict[str, str]:
    return {"op2_near_duplicates": OP2_SQL, "op7_vector_duplicates": OP7_SQL, "op11_conversation_repair": repair_sql(), "op12_exact_duplicates": OP12_SQL}
