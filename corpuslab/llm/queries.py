"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from .bpe import op7_bpe_digest
from .decontaminate import ORACLE as OP4_SQL
from .decontaminate import op4_decontaminate
from .divergence import ORACLE as OP13_SQL
from .divergence import op13_source_divergence
from .html import op2_extract_main_text
from .jaccard import ORACLE as OP9_SQL
from .jaccard import op9_jaccard_join
from .lm import op3_lm_score
from .merkle import ORACLE as OP11_SQL
from .merkle import op11_merkle_manifest
from .minhash import ORACLE as OP12_SQL
from .minhash import op12_minhash_dedup
from .quality import ORACLE as OP6_SQL
from .quality import op6_quality_rules
from .secrets import ORACLE as OP10_SQL
from .secrets import op10_secret_scan
from .sharding import op1_shard_shuffle
from .substrings import ORACLE as OP8_SQL
from .substrings import op8_remove_repeats
from .urls import ORACLE as OP5_SQL
from .urls import op5_url_filter

QUERIES = {"op1_shard_shuffle": op1_shard_shuffle, "op2_extract_main_text": op2_extract_main_text, "op3_lm_score": op3_lm_score, "op4_decontaminate": op4_decontaminate, "op5_url_filter": op5_url_filter, "op6_quality_rules": op6_quality_rules, "op7_bpe_digest": op7_bpe_digest, "op8_remove_repeats": op8_remove_repeats, "op9_jaccard_join": op9_jaccard_join, "op10_secret_scan": op10_secret_scan, "op11_merkle_manifest": op11_merkle_manifest, "op12_minhash_dedup": op12_minhash_dedup, "op13_source_divergence": op13_source_divergence}
ORACLE_SQL: dict[str, str] = {"op4_decontaminate": OP4_SQL, "op5_url_filter": OP5_SQL, "op6_quality_rules": OP6_SQL, "op8_remove_repeats": OP8_SQL, "op9_jaccard_join": OP9_SQL, "op10_secret_scan": OP10_SQL, "op11_merkle_manifest": OP11_SQL, "op12_minhash_dedup": OP12_SQL, "op13_source_divergence": OP13_SQL}
