"""Queries of this subpackage, by name, and the SQL for those that SQL can express."""

from quarrystone.llm.bpe import op5_bpe
from quarrystone.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from quarrystone.llm.html_extract import op8_html_extract
from quarrystone.llm.importance import OP13_SQL, op13_importance
from quarrystone.llm.language_id import op12_language
from quarrystone.llm.lattice import op10_lattice_links
from quarrystone.llm.mixing import op3_mixing
from quarrystone.llm.sharding import op7_sharding
from quarrystone.llm.simhash import op6_simhash
from quarrystone.llm.substring_dedup import OP2_SQL, op2_substring_dedup
from quarrystone.llm.suffix_dedup import op9_suffix_dedup
from quarrystone.llm.toxicity import op1_toxicity
from quarrystone.llm.vector_codes import OP11_SQL, op11_vector_codes

QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_substring_dedup, op3_mixing, op4_exact_dedup, op5_bpe, op6_simhash, op7_sharding, op8_html_extract, op9_suffix_dedup, op10_lattice_links,
        op11_vector_codes, op12_language, op13_importance,
    )
}

ORACLES = {"op2_substring_dedup": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op11_vector_codes": OP11_SQL, "op13_importance": OP13_SQL}
