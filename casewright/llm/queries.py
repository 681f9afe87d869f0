"""The operators applied to the test tables, and SQL for the same rows."""

from __future__ import annotations

from . import (
    credentials,
    embed_dedup,
    html_extract,
    line_dedup,
    minhash,
    mixing,
    packing,
    periodic,
    quality,
    search,
    substring,
    topk,
    warc,
)

QUERIES = {
    "op1_line_dedup": line_dedup.op1,
    "op2_minhash": minhash.op2,
    "op3_packing": packing.op3,
    "op4_topk": topk.op4,
    "op5_embed_dedup": embed_dedup.op5,
    "op6_mixing": mixing.op6,
    "op7_html": html_extract.op7,
    "op8_substring": substring.op8,
    "op9_quality": quality.op9,
    "op10_credentials": credentials.op10,
    "op11_warc": warc.op11,
    "op12_periodic": periodic.op12,
    "op13_search": search.op13,
}
ORACLE = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op2_minhash": minhash.OP2_SQL,
    "op4_topk": topk.OP4_SQL,
    "op5_embed_dedup": embed_dedup.OP5_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op8_substring": substring.OP8_SQL,
    "op11_warc": warc.OP11_SQL,
    "op12_periodic": periodic.OP12_SQL,
    "op13_search": search.OP13_SQL,
}
