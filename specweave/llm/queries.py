"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from .decontaminate import op2_decontaminate
from .idfiles import op9_ids
from .langid import op5_language
from .licenses import OP7_SQL, op7_licenses
from .minhash import op6_minhash
from .packing import op10_packing
from .quality import op4_quality
from .topk import OP8_SQL, op8_topk
from .urlfilter import OP3_SQL, op3_url_filter
from .warc import OP1_SQL, op1_warc


def queries() -> dict:
    found = (op1_warc, op2_decontaminate, op3_url_filter, op4_quality, op5_language, op6_minhash, op7_licenses, op8_topk, op9_ids, op10_packing)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op3_url_filter": OP3_SQL, "op7_licenses": OP7_SQL, "op8_topk": OP8_SQL}
