"""Operators for training-data pipelines, and their queries."""

from .centroids import OP13_SQL, op13_centroid_clusters
from .chat import OP10_SQL, op10_chat_format
from .decontamination import OP11_SQL, op11_decontamination
from .licenses import op6_license_scan
from .mixing import OP7_SQL, op7_mixing
from .neighbours import op1_nn_descent
from .packing import op3_packing
from .pii import op4_pii
from .prefixes import OP12_SQL, op12_prefix_trie
from .quality import OP5_SQL, op5_quality_rules
from .repeats import OP2_SQL, op2_suffix_dedup
from .simhash import op8_simhash
from .warc import OP9_SQL, op9_warc

QUERIES = {f.__name__: f for f in (op1_nn_descent, op2_suffix_dedup, op3_packing, op4_pii, op5_quality_rules, op6_license_scan, op7_mixing, op8_simhash, op9_warc, op10_chat_format, op11_decontamination, op12_prefix_trie, op13_centroid_clusters)}
ORACLES: dict[str, str] = {"op2_suffix_dedup": OP2_SQL, "op5_quality_rules": OP5_SQL, "op7_mixing": OP7_SQL, "op9_warc": OP9_SQL, "op10_chat_format": OP10_SQL, "op11_decontamination": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_centroid_clusters": OP13_SQL}
