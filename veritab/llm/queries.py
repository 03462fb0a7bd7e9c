"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from veritab.llm.align import op12_tokenizer_alignment
from veritab.llm.credentials import credentials_sql, op6_credentials
from veritab.llm.langid import op5_language
from veritab.llm.media import op1_media_sequences
from veritab.llm.mixing import op2_mix_sources
from veritab.llm.packing import op8_pack_windows
from veritab.llm.permindex import op7_permutation_index
from veritab.llm.quality import op4_quality
from veritab.llm.resample import op13_importance_resampling
from veritab.llm.simhash import op3_simhash
from veritab.llm.sitetree import op11_site_style_tree
from veritab.llm.tokens import op10_token_files
from veritab.llm.urlfilter import op9_url_filter, url_filter_sql


def queries():
    found = (op1_media_sequences, op2_mix_sources, op3_simhash, op4_quality, op5_language, op6_credentials, op7_permutation_index, op8_pack_windows, op9_url_filter, op10_token_files, op11_site_style_tree, op12_tokenizer_alignment, op13_importance_resampling)
    return {f.__name__: f for f in found}


def oracle_sql():
    return {"op6_credentials": credentials_sql(), "op9_url_filter": url_filter_sql()}
