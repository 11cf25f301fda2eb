"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .centroid_clustering import SQL as _CLUSTER_SQL
from .centroid_clustering import op11_centroid_clustering
from .conversation_repair import SQL as _REPAIR_SQL
from .conversation_repair import op13_conversation_repair
from .jaccard_join import op6_ngram_jaccard_join
from .license_scan import SQL as _LICENSE_SQL
from .license_scan import op12_license_scan
from .media_columns import op5_media_columns
from .packing import op4_best_fit_packing
from .quality_rules import op8_quality_rules
from .source_mixing import op10_source_mixing
from .substring_dedup import op9_substring_dedup
from .token_counts import op3_token_counts
from .token_files import op7_token_files
from .toxicity import op1_toxicity
from .url_filters import op2_url_filters

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_url_filters": op2_url_filters,
    "op3_token_counts": op3_token_counts,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_media_columns": op5_media_columns,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_token_files": op7_token_files,
    "op8_quality_rules": op8_quality_rules,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_source_mixing": op10_source_mixing,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_license_scan": op12_license_scan,
    "op13_conversation_repair": op13_conversation_repair,
}

#: Words, shingle sets, all pairs that share a shingle, their links, and the reachable documents of each.
_JACCARD = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (select doc_id, case when len(ws) >= 3 then list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end sh from w),
x as (select doc_id, len(sh) n, unnest(sh) g from s),
p as (select a.doc_id a, b.doc_id b from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e as (select a, b from p union all select b, a from p),
r(doc_id, root) as (select doc_id, doc_id from s union select e.b, r.root from r join e on r.doc_id = e.a)
select s.doc_id, len(sh) as n_shingles, (select min(root) from r where r.doc_id = s.doc_id) as component_id, (select count(*) from e where e.a = s.doc_id) as n_links from s
"""

#: The other operators train classifiers, tokenize, hash or pack; SQL cannot state those results.
ORACLE_SQL: dict[str, str] = {"op6_ngram_jaccard_join": _JACCARD, "op11_centroid_clustering": _CLUSTER_SQL, "op12_license_scan": _LICENSE_SQL, "op13_conversation_repair": _REPAIR_SQL}
