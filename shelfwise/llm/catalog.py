"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from shelfwise.llm import bpe, chat, collocations, fingerprints, language, lines, mixing, planes, quality, sharding, simhash, toxicity, variants


def queries():
    return {
        "op1_chat": chat.op1_chat,
        "op2_bpe": bpe.op2_bpe,
        "op3_quality": quality.op3_quality,
        "op4_sharding": sharding.op4_sharding,
        "op5_fingerprints": fingerprints.op5_fingerprints,
        "op6_simhash": simhash.op6_simhash,
        "op7_language": language.op7_language,
        "op8_lines": lines.op8_lines,
        "op9_mixing": mixing.op9_mixing,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_variants": variants.op11_variants,
        "op12_planes": planes.op12_planes,
        "op13_collocations": collocations.op13_collocations,
    }


def oracle_sql():
    return {"op1_chat": chat.OP1_SQL, "op3_quality": quality.OP3_SQL, "op9_mixing": mixing.OP9_SQL}
