"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from . import chat, classifier, decontaminate, dedup, divergence, fingerprint, lm, mix, pii, simhash, urls, warc, whitening

QUERIES = {
    "op1_mix": mix.op1_mix,
    "op2_chat": chat.op2_chat,
    "op3_warc": warc.op3_warc,
    "op4_classifier": classifier.op4_classifier,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_dedup": dedup.op6_dedup,
    "op7_pii": pii.op7_pii,
    "op8_fingerprint": fingerprint.op8_fingerprint,
    "op9_urls": urls.op9_urls,
    "op10_lm": lm.op10_lm,
    "op11_divergence": divergence.op11_divergence,
    "op12_simhash": simhash.op12_simhash,
    "op13_whitening": whitening.op13_whitening,
}
ORACLE_SQL = {"op1_mix": mix.SQL, "op2_chat": chat.SQL, "op3_warc": warc.SQL, "op5_decontaminate": decontaminate.SQL, "op7_pii": pii.SQL, "op9_urls": urls.SQL, "op11_divergence": divergence.SQL}
