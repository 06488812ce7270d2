"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from weftgraph.llm.op1_suffix_dedup import ORACLE_SQL as OP1_SQL
from weftgraph.llm.op1_suffix_dedup import op1_suffix_dedup
from weftgraph.llm.op2_pii import op2_pii
from weftgraph.llm.op3_ann import op3_ann
from weftgraph.llm.op4_token_ids import op4_token_ids
from weftgraph.llm.op5_ngram_jaccard import ORACLE_SQL as OP5_SQL
from weftgraph.llm.op5_ngram_jaccard import op5_ngram_jaccard
from weftgraph.llm.op6_toxicity import op6_toxicity
from weftgraph.llm.op7_decontaminate import ORACLE_SQL as OP7_SQL
from weftgraph.llm.op7_decontaminate import op7_decontaminate
from weftgraph.llm.op8_byte_bpe import op8_byte_bpe
from weftgraph.llm.op9_kd_shards import op9_kd_shards
from weftgraph.llm.op10_url_trust import op10_url_trust
from weftgraph.llm.op11_periodic_runs import ORACLE_SQL as OP11_SQL
from weftgraph.llm.op11_periodic_runs import op11_periodic_runs
from weftgraph.llm.op12_exact_topk import ORACLE_SQL as OP12_SQL
from weftgraph.llm.op12_exact_topk import op12_exact_topk
from weftgraph.llm.op13_lexical_search import ORACLE_SQL as OP13_SQL
from weftgraph.llm.op13_lexical_search import op13_lexical_search


def queries():
    return {
        f.__name__: f
        for f in (
            op1_suffix_dedup, op2_pii, op3_ann, op4_token_ids, op5_ngram_jaccard,
            op6_toxicity, op7_decontaminate, op8_byte_bpe, op9_kd_shards, op10_url_trust,
            op11_periodic_runs, op12_exact_topk, op13_lexical_search,
        )
    }


def oracle_sql():
    return {
        "op1_suffix_dedup": OP1_SQL, "op5_ngram_jaccard": OP5_SQL, "op7_decontaminate": OP7_SQL, "op11_periodic_runs": OP11_SQL, "op12_exact_topk": OP12_SQL,
        "op13_lexical_search": OP13_SQL,
    }
