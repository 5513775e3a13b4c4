"""The registered queries of this package and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from tallyforge.llm import ann, decontaminate, fim, langid, licences, linededup, packing, pseudonyms, secrets, sharding, simhash, spelling, toxicity

QUERIES = {
    "op9_ann": ann.op9_ann,
    "op4_langid": langid.op4_langid,
    "op8_toxicity": toxicity.op8_toxicity,
    "op1_linededup": linededup.op1_linededup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op6_packing": packing.op6_packing,
    "op5_simhash": simhash.op5_simhash,
    "op3_licences": licences.op3_licences,
    "op7_pseudonyms": pseudonyms.op7_pseudonyms,
    "op10_secrets": secrets.op10_secrets,
    "op11_fim": fim.op11_fim,
    "op12_spelling": spelling.op12_spelling,
    "op13_sharding": sharding.op13_sharding,
}

ORACLE_SQL: dict[str, str] = {
    "op3_licences": licences.oracle(),
    "op11_fim": fim.SQL,
}
