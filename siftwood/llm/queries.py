"""The registered queries of this subpackage and the SQL that checks them."""

from siftwood.llm.bpe import op10_bpe
from siftwood.llm.decontaminate import op7_decontaminate
from siftwood.llm.language_id import op1_language_id
from siftwood.llm.line_dedup import OP2_SQL, op2_line_dedup
from siftwood.llm.near_dedup import OP5_SQL, op5_near_dedup
from siftwood.llm.quality_classifier import op9_quality_classifier
from siftwood.llm.quality_rules import OP8_SQL, op8_quality_rules
from siftwood.llm.secret_scan import OP3_SQL, op3_secret_scan
from siftwood.llm.sharding import op6_sharding
from siftwood.llm.warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_warc": op4_warc,
    "op5_near_dedup": op5_near_dedup,
    "op6_sharding": op6_sharding,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality_rules": op8_quality_rules,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_bpe": op10_bpe,
}

ORACLES = {
    "op2_line_dedup": OP2_SQL,
    "op3_secret_scan": OP3_SQL,
    "op4_warc": OP4_SQL,
    "op5_near_dedup": OP5_SQL,
    "op8_quality_rules": OP8_SQL,
}
