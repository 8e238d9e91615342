"""Queries and SQL of this subpackage."""

from kernelweave.llm import op02_jaccard, op04_warc, op06_decontaminate, op11_infill, op12_phrases, op13_lines
from kernelweave.llm.op01_pii import op1_pii
from kernelweave.llm.op02_jaccard import op2_jaccard
from kernelweave.llm.op03_bpe import op3_bpe
from kernelweave.llm.op04_warc import op4_warc
from kernelweave.llm.op05_classifier import op5_classifier
from kernelweave.llm.op06_decontaminate import op6_decontaminate
from kernelweave.llm.op07_mixing import op7_mixing
from kernelweave.llm.op08_urls import op8_urls
from kernelweave.llm.op09_suffix import op9_suffix
from kernelweave.llm.op10_quality import op10_quality

QUERIES = {f.__name__: f for f in (op1_pii, op2_jaccard, op3_bpe, op4_warc, op5_classifier, op6_decontaminate, op7_mixing, op8_urls, op9_suffix, op10_quality, op11_infill.op11_infill, op12_phrases.op12_phrases, op13_lines.op13_lines)}
ORACLES = {"op2_jaccard": op02_jaccard.SQL, "op4_warc": op04_warc.SQL, "op6_decontaminate": op06_decontaminate.SQL, "op11_infill": op11_infill.SQL, "op12_phrases": op12_phrases.SQL, "op13_lines": op13_lines.SQL}
