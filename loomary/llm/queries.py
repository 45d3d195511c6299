"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express (none: see the README)."""

from __future__ import annotations

from . import chat, cws, huffman, licenses, lines, merkle, mixing, packing, pii, quality, shards, simhash, vacodes

QUERIES = {
    "op1_shards": shards.op1_shards,
    "op2_lines": lines.op2_lines,
    "op3_licenses": licenses.op3_licenses,
    "op4_cws": cws.op4_cws,
    "op5_packing": packing.op5_packing,
    "op6_token_files": huffman.op6_token_files,
    "op7_quality": quality.op7_quality,
    "op8_mixing": mixing.op8_mixing,
    "op9_simhash": simhash.op9_simhash,
    "op10_chat": chat.op10_chat,
    "op11_vector_codes": vacodes.op11_vector_codes,
    "op12_merkle": merkle.op12_merkle,
    "op13_personal_data": pii.op13_personal_data,
}
ORACLES: dict[str, str] = {"op11_vector_codes": vacodes.ORACLE, "op12_merkle": merkle.ORACLE}
