"""The registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, decontaminate, html, jaccard, licenses, lm, packing, pii, quality, runs, simhash, tokenstore, warc
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": lambda s, d: quality.op1(table(s, d, "documents")),
    "op2_warc": lambda s, d: warc.op2(table(s, d, "pages")),
    "op3_pii": lambda s, d: pii.op3(table(s, d, "documents")),
    "op4_tokens": lambda s, d: tokenstore.op4(table(s, d, "documents"), tokenizer("word_bpe_49k.json")),
    "op5_simhash": lambda s, d: simhash.op5(table(s, d, "documents")),
    "op6_licenses": lambda s, d: licenses.op6(table(s, d, "documents")),
    "op7_decontaminate": lambda s, d: decontaminate.op7(table(s, d, "documents"), table(s, d, "benchmark")),
    "op8_lm": lambda s, d: lm.op8(table(s, d, "documents"), tokenizer(lm.PIECES)),
    "op9_html": lambda s, d: html.op9(table(s, d, "pages")),
    "op10_packing": lambda s, d: packing.op10(table(s, d, "documents"), tokenizer("byte_bpe_50k.json")),
    "op11_jaccard": lambda s, d: jaccard.op11(table(s, d, "documents")),
    "op12_runs": lambda s, d: runs.op12(table(s, d, "documents")),
    "op13_align": lambda s, d: align.op13(table(s, d, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")),
}

ORACLES: dict[str, str] = {"op2_warc": warc.SQL, "op7_decontaminate": decontaminate.SQL}
