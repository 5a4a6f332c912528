"""Queries of the training-data operators, and their SQL where SQL can express them."""

from . import decontaminate, fingerprint, langid, licenses, linededup, merkle, minhash, mixing, prefixes, quality, simhash, toxicity, urls

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_linededup": linededup.op4_linededup,
    "op5_mixing": mixing.op5_mixing,
    "op6_fingerprints": fingerprint.op6_fingerprints,
    "op7_langid": langid.op7_langid,
    "op8_licenses": licenses.op8_licenses,
    "op9_simhash": simhash.op9_simhash,
    "op10_urls": urls.op10_urls,
    "op11_merkle": merkle.op11_merkle,
    "op12_prefixes": prefixes.op12_prefixes,
    "op13_minhash": minhash.op13_minhash,
}
ORACLE = {
    "op3_decontaminate": decontaminate.SQL,
    "op5_mixing": mixing.SQL,
    "op10_urls": urls.SQL,
    "op11_merkle": merkle.SQL,
    "op12_prefixes": prefixes.SQL,
    "op13_minhash": minhash.SQL,
}
