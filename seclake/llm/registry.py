"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

from . import ann, collocations, decontaminate, langid, minhash, mixing, packing, pii, prefix_trie, quotes, substring_dedup, token_files, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_minhash": minhash.op4_minhash,
    "op5_token_files": token_files.op5_token_files,
    "op6_quotes": quotes.op6_quotes,
    "op7_ann": ann.op7_ann,
    "op8_mixing": mixing.op8_mixing,
    "op9_langid": langid.op9_langid,
    "op10_warc": warc.op10_warc,
    "op11_packing": packing.op11_packing,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_collocations": collocations.op13_collocations,
}

SQL = {
    "op2_substring_dedup": substring_dedup.SQL,
    "op3_decontaminate": decontaminate.SQL,
    "op4_minhash": minhash.SQL,
    "op6_quotes": quotes.SQL,
    "op10_warc": warc.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_collocations": collocations.SQL,
}
