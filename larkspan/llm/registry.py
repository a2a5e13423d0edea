"""The corpus queries: one for each operator, and the SQL of those that SQL can express."""

from larkspan.llm import audio, ctw, exact_dedup, html_extract, license_scan, minhash, mixing, packing, quality, warc

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_quality": quality.query,
    "op3_minhash": minhash.query,
    "op4_audio": audio.query,
    "op5_warc": warc.query,
    "op6_html_extract": html_extract.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_license_scan": license_scan.query,
    "op9_ctw": ctw.query,
    "op10_packing": packing.query,
}

ORACLES = {
    "op1_mixing": mixing.ORACLE,
    "op5_warc": warc.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op8_license_scan": license_scan.ORACLE,
}
