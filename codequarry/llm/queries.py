"""The registered queries of this subpackage, and their SQL where there is one."""

from codequarry.llm.collocations import OP13_SQL, op13_collocations
from codequarry.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from codequarry.llm.html_text import op2_html_text
from codequarry.llm.licence_scan import op6_licence_scan
from codequarry.llm.mixing import op9_mixing
from codequarry.llm.ngram_join import op8_ngram_join
from codequarry.llm.packing import op7_packing
from codequarry.llm.secret_scan import OP11_SQL, op11_secret_scan
from codequarry.llm.spelling_variants import op12_spelling_variants
from codequarry.llm.token_files import op10_token_files
from codequarry.llm.topk_search import OP3_SQL, op3_topk_search
from codequarry.llm.toxicity import op1_toxicity
from codequarry.llm.url_filter import op4_url_filter

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_html_text": op2_html_text,
    "op3_topk_search": op3_topk_search,
    "op4_url_filter": op4_url_filter,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_licence_scan": op6_licence_scan,
    "op7_packing": op7_packing,
    "op8_ngram_join": op8_ngram_join,
    "op9_mixing": op9_mixing,
    "op10_token_files": op10_token_files,
    "op11_secret_scan": op11_secret_scan,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_collocations": op13_collocations,
}

ORACLES = {
    "op3_topk_search": OP3_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op11_secret_scan": OP11_SQL,
    "op13_collocations": OP13_SQL,
}
